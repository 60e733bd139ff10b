from __future__ import annotations

import pytest

from carryover.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank and very long texts, absent and repeated ids, repeated rows, clashing columns."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t", "en", "s", 3),
        (None, "a row without an id but with more than five words", "en", "s", 48),
        (4, "the same row twice over and over again", "en", "s", 38),
        (4, "the same row twice over and over again", "en", "s", 38),
        (5, "one id and two texts", "en", "s", 20),
        (5, "with one id", "en", "s", 11),
        (6, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "s", None),
    ]
    names = ["score", "spans", "row", "own", "keys", "starts", "fp", "node", "token_ids", "_h", "_t", "rules"]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in names:
        import pyspark.sql.functions as F

        df = df.withColumn(n, F.lit("kept"))
    return df
