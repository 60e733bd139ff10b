"""The same questions in DuckDB SQL, to check the Spark answers against."""

from parity.base import on_hot_lines
from parity.foundation import FOUNDATION
from parity.measurement import MEASUREMENT

PLAIN: dict[str, str] = {**FOUNDATION, **MEASUREMENT}
LINKED = {
    "linked_seq1_agreement": "v3_seq1_agreement",
    "linked_disagreeing_pairs": "v3_disagreeing_pairs",
    "linked_join_integrity": "v6_join_integrity",
    "linked_diabetes_share": "v7_diabetes_share",
    "linked_expand_positions": "expand_positions",
    "linked_condition_records": "condition_records",
}
ORACLE: dict[str, str] = PLAIN | {name: on_hot_lines(PLAIN[plain]) for name, plain in LINKED.items()}

__all__ = ["ORACLE"]
