from carryover.sources.contract import CONTRACTS, conform, violations
from carryover.sources.fixtures import fixture_params, fixture_tables, view_sql
from carryover.sources.tables import load_tables, read_table, write_result

__all__ = [
    "CONTRACTS",
    "conform",
    "fixture_params",
    "fixture_tables",
    "load_tables",
    "read_table",
    "view_sql",
    "violations",
    "write_result",
]
