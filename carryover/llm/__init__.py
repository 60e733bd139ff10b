"""Operators a training-data pipeline needs, each a function of DataFrames.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one
thin query per operator; the operators keep their own, wider interface.
"""
