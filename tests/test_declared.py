"""Keys, labels and limits of result tables, read back from what was written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.operators import declared
from carryover.sources.tables import write_result
from tests.small import params

RATE = "v16_population_rate"


@pytest.fixture
def rates(spark):
    rows = [("medicare", "diabetes", 0.8, 0.7), ("other", "diabetes", 0.6, 0.5)]
    return spark.createDataFrame(rows, "book string, condition string, persistence_any double, persistence_office double")


def checked(spark, df, books=("medicare",)):
    known = spark.createDataFrame([(b,) for b in books], "book string")
    return declared.results_checked({RATE: df}, known, params()).first()


def test_limits_survive_being_written(spark, rates, tmp_path):
    back = write_result(declared.with_limits(rates, RATE), str(tmp_path), RATE)
    rows = declared.limits_of(spark, {RATE: back}).collect()
    assert {r.assumption for r in rows if r.figure == "persistence_any"} == {"A1", "A5", "A6", "A7", "A8", "A10"}
    assert all(r.status and r.caveat and r.if_wrong for r in rows)


def test_one_figure_without_limits_is_seen(spark, rates):
    whole = declared.with_limits(rates, RATE)
    bare = whole.withMetadata("persistence_office", {})
    missing = [r.figure for r in declared.limits_of(spark, {RATE: bare}).collect() if r.assumption is None]
    assert missing == ["persistence_office"]
    gone = [r.figure for r in declared.limits_of(spark, {RATE: whole.drop("persistence_any")}).collect() if r.assumption is None]
    assert gone == ["persistence_any"]


def test_repeated_keys_unknown_and_missing_books_are_seen(spark, rates):
    fine = rates.where("book = 'medicare'")
    assert tuple(checked(spark, fine))[1:] == (1, 0, 0, 0)
    assert tuple(checked(spark, fine.union(fine)))[1:] == (2, 1, 0, 0)
    assert checked(spark, rates).unlabelled_rows == 1
    assert checked(spark, fine.withColumn("book", F.lit(None).cast("string"))).unlabelled_rows == 1
    assert checked(spark, fine, ("medicare", "commercial")).missing_books == 1
    assert tuple(checked(spark, fine.limit(0)))[1:] == (0, 0, 0, 1)
