from carryover.functions.columns import (
    blank,
    byar,
    in_years,
    integer_rate,
    mapped,
    normalise,
    ratio,
    share,
    signed_share,
    trimmed,
    wilson,
)
from carryover.functions.shares import histogram_rank, share_of_total

__all__ = [
    "blank",
    "byar",
    "histogram_rank",
    "in_years",
    "integer_rate",
    "mapped",
    "normalise",
    "ratio",
    "share",
    "share_of_total",
    "signed_share",
    "trimmed",
    "wilson",
]
