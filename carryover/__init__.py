"""Does a recorded condition carry over into the next year?  A Spark library.

Every check and figure is a function from DataFrames to a DataFrame.  No
function opens a session, reads a path or looks at the clock; tables and
:class:`carryover.params.Params` are arguments.
"""

from carryover.params import Params

__all__ = ["Params"]
