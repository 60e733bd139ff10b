"""Prepared tables: no exchange of either big table, hot line ids split, results as on plain tables."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from carryover.operators import checks, codes, linked, measure
from carryover.plans.registry import QUERIES
from carryover.sources import fixture_params, fixture_tables
from carryover.sources.fixtures import hot_line_tables
from carryover.sources.prepared import read_prepared, write_prepared
from tests.conftest import SF_DIR
from tests.test_scale import plan, rows

CO = "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture(scope="module")
def tables(spark):
    """The fixture with one line of a third of all rows on both sides, repeated and absent line ids."""
    t = fixture_tables(spark, SF_DIR)
    claim, dx = t["claim_line"], t["dx_line"]
    line = claim.where("claim_line_id % 40 = 1").orderBy("claim_line_id").limit(1)
    hot_id = F.lit(line.first().claim_line_id)
    claim = claim.unionByName(claim.limit(4000).withColumn("claim_line_id", hot_id)).unionByName(
        claim.limit(300).withColumn("claim_line_id", F.lit(None).cast("long"))
    )
    claim = claim.unionByName(claim.where("claim_line_id % 50 = 3"))
    hot = dx.limit(20_000).withColumn("claim_line_id", hot_id)
    dx = dx.unionByName(hot).unionByName(dx.limit(500).withColumn("claim_line_id", F.lit(None).cast("long")))
    plain = dict(t.items()) | {"claim_line": claim, "dx_line": dx}
    name = f"linked_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield plain, write_prepared(claim, dx, "claim_line_id", name, buckets=6, hot_rows=2000), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("left", "right", "left_hot", "right_hot", "hot_keys"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


@pytest.fixture(autouse=True)
def one_key_is_enough(spark):
    spark.conf.set(CO, "false")
    yield
    spark.conf.unset(CO)


def test_parts_are_whole_and_disjoint(spark, tables):
    plain, parts, name = tables
    left, right = parts.left(), parts.right()
    assert left.count() == plain["claim_line"].count() and right.count() == plain["dx_line"].count()
    assert spark.table(f"{name}_hot_keys").count() == 1
    for rest, hot in zip(parts.rest, parts.hot):
        assert rest.join(hot, "claim_line_id", "left_semi").count() == 0
        assert rest.where("claim_line_id IS NULL").count() == 0
        assert hot.where("claim_line_id IS NULL").count() > 0
    assert read_prepared(spark, name).rest[0].count() == parts.rest[0].count()


def pairs(plain, parts):
    """(plain result, prepared result, on the rest alone) of everything joined on the line id."""
    p = fixture_params()
    c, d = plain["claim_line"], plain["dx_line"]
    small = codes.code_set(plain["code_map"], p.families[p.main_family])
    labels = codes.family_codes(plain["code_map"], p.families)
    months = plain["member_month"]
    return {
        "v3": (checks.first_position_agreement(c, d), linked.first_position_agreement(parts)),
        "v3 pairs": (checks.disagreeing_pairs(c, d), linked.disagreeing_pairs(parts)),
        "v6": (checks.join_integrity(c, d, p), linked.join_integrity(parts, p)),
        "v7": (checks.recorded_share(c, d, months, small, p), linked.recorded_share(parts, months, small, p)),
        "s4": (
            measure.expand_positions(checks.two_years(c, p), d).groupBy("claim_line_id", "position", "code").count(),
            linked.expand_positions(parts, p).groupBy("claim_line_id", "position", "code").count(),
        ),
        "records": (measure.labelled(c, d, labels, p), linked.condition_records(parts, labels, p)),
    }


def test_results_are_those_of_plain_tables(tables):
    plain, parts, _ = tables
    for name, (want, got) in pairs(plain, parts).items():
        assert got.columns == want.columns, name
        assert rows(got) == rows(want), name


def exchanged(text: str) -> list[str]:
    """Tables that an exchange by line id reads, from an executed plan as text."""
    lines = text.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(claim_line_id" in line:
            depth = line.index("Exchange")
            below = [x for x in lines[i + 1 :] if len(x) > depth]
            found += [x for x in below[:6] if "FileScan" in x]
    return found


def test_no_exchange_of_the_rest(spark, tables):
    plain, parts, name = tables
    p = fixture_params()
    # written, so that labels and codes are files of known size; broadcast as on a cluster
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    from carryover.plans.stages import StageStore

    store = StageStore.of(spark)
    small = store.keep("codes", codes.code_set(plain["code_map"], p.families[p.main_family]))
    labels = store.keep("labels", codes.family_codes(plain["code_map"], p.families))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        rest = parts.rest
        in_place = {
            "v3": linked._agreement_in_place(*rest),
            "v3 pairs": checks.line_pairs(*rest),
            "v6": linked._line_members_in_place(*rest, p),
            "v7": checks.members_by_position(*rest, small, p),
            "s4": measure.expand_positions(checks.two_years(rest[0], p), rest[1]),
            "records": measure.labelled(*rest, labels, p),
        }
        for what, df in in_place.items():
            text = plan(df)
            assert "Bucketed: true" in text and "Exchange hashpartitioning" not in text, what
        # as a whole: only the plain tables of hot lines are dealt out by line
        for what, df in {"v6": linked.join_integrity(parts, p), "s4": linked.expand_positions(parts, p)}.items():
            text = plan(df)
            assert "Exchange hashpartitioning(claim_line_id" in text, what
            assert all("_hot" in x for x in exchanged(text)), what
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_hot_lines_of_the_registered_queries(spark):
    """Each big table has a line of a third of its rows, absent ids and, among the claims, repeated ones."""
    tables = hot_line_tables(spark, SF_DIR)
    plain = fixture_tables(spark, SF_DIR)
    hottest = {}
    for name in ("claim_line", "dx_line"):
        df = tables[name]
        assert df.columns == plain[name].columns
        top = df.where("claim_line_id IS NOT NULL").groupBy("claim_line_id").count().orderBy(F.desc("count")).first()
        assert top["count"] > 0.3 * df.count()
        hottest[name] = top.claim_line_id
        assert df.where("claim_line_id IS NULL").count() > 0
    assert hottest["claim_line"] != hottest["dx_line"]
    twice = tables["claim_line"].groupBy("claim_line_id").count().where("count = 2")
    assert twice.count() > 100
    fan_out = QUERIES["linked_expand_positions"](spark, SF_DIR).groupBy("claim_line_id").count().where("count > 1000")
    assert {r.claim_line_id for r in fan_out.collect()} == set(hottest.values())
