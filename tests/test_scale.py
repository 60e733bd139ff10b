"""Hot keys, bounded broadcasts and the plans behind them."""

from __future__ import annotations

import contextlib
import hashlib
import io
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carryover.functions import histogram_rank, share_of_total
from carryover.operators import checks, codes, measure, profile
from carryover.plans.stages import StageStore, shared_folder, write_prepared
from carryover.plans.study import Study
from carryover.sources import fixture_params, fixture_tables
from tests.conftest import SF_DIR
from tests.small import claims, code_map, dx, full_coverage, line, months, params, position


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def domain(spark, tmp_path_factory):
    """The logical tables as parquet files, as a cluster would hold them."""
    folder = tmp_path_factory.mktemp("domain")
    out = {}
    for name, df in fixture_tables(spark, SF_DIR).items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_nothing_runs_while_a_lookup_query_is_built(spark, domain):
    """One plan for every size: no count decides how a lookup is joined."""
    p = fixture_params()
    small = codes.code_set(domain["code_map"], "^E1")
    c, d = domain["claim_line"], domain["dx_line"]
    builds = [
        lambda: checks.recorded_share(c, d, domain["member_month"], small, p),
        lambda: checks.disagreeing_pairs(c, d),
        lambda: measure.labelled(c, d, codes.family_codes(domain["code_map"], p.families), p),
        lambda: profile.dx_probe(domain["curated_claims"], d, p),
    ]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        built = [b() for b in builds]
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    plain = [rows(b) for b in built]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [rows(b()) for b in builds] == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diagnosis_rows_meet_written_labels_in_their_scan_stage(spark, domain):
    """Known to be small before anything runs: no diagnosis row is shuffled by its code."""
    study = Study(domain, fixture_params(), lookups=StageStore.of(spark))
    every = measure.expand_positions(checks.two_years(domain["claim_line"], study.p), domain["dx_line"])
    for df in (
        study.records,
        study.burden,
        study.retired_codes(),
        measure.label_conditions(every, study.labels, study.p),
        checks.recorded_share(domain["claim_line"], domain["dx_line"], domain["member_month"], study.diabetes, study.p),
        checks.recorded_share(domain["claim_line"], domain["dx_line"], domain["member_month"], study.chronic, study.p, "chronic"),
    ):
        text = plan(df)
        assert "BroadcastHashJoin [code" in text
        # what is dealt out by code afterwards has been counted per code
        assert not re.search(r"hashpartitioning\(code#\d+, \d+\).*\n[^\n]*Project[^\n]*icd9_dx_cd", text)
        assert "SortMergeJoin [code" not in text.split("HashAggregate")[-1]


def test_histogram_rank_is_rank(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") * 7 % 23).alias("s"), "id"
    )
    want = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("s")).cast("long"))
    assert rows(histogram_rank(df, ["g"], "s", "r").select("g", "s", "id", "r")) == rows(want)


def test_one_line_with_a_third_of_all_rows(spark):
    """A placeholder line id on both sides: products are counted, not formed."""
    n = 20_000
    c = claims(spark, [line(i, i, "2023-01-01", top="E11.9") for i in range(100)]).unionByName(
        claims(spark, [line(0, 0, "2023-01-01", top="I10")]).crossJoin(spark.range(n)).drop("id")
    )
    d = dx(spark, [position(i, "01", "E119", i) for i in range(100)]).unionByName(
        dx(spark, [position(0, "01", "E119", 5)]).crossJoin(spark.range(n)).drop("id")
    )
    hot = (n + 1) * (n + 1)
    got = checks.first_position_agreement(c, d).first()
    assert (got.compared_rows, got.agree, got.disagree) == (hot + 99, (n + 1) + 99, n * (n + 1))
    assert rows(checks.disagreeing_pairs(c, d)) == [("E119", "I10", n * (n + 1))]
    links = checks.join_integrity(c, d, params()).first()
    assert (links.claim_lines, links.matched, links.multi_member_lines) == (n + 100, n + 100, n + 1)


def test_one_member_one_doctor_and_one_code_with_most_rows(spark):
    n = 5_000
    days = spark.range(n).select(
        (F.col("id") + 10).alias("claim_line_id"),
        F.lit(1).cast("long").alias("member_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 720).cast("int")).alias("srv_start_dt"),
        F.lit("E11.9").alias("pri_icd9_dx_cd"),
        F.lit("F").alias("plc_srv_cd"),
        F.lit("MED").alias("med_cost_ctg_cd"),
        F.lit("ME").alias("business_ln_cd"),
        F.lit(1).cast("long").alias("srv_prvdr_id"),
    )
    c = days.unionByName(claims(spark, [line(1, 2, "2023-01-01"), line(2, 2, "2023-02-01"), line(3, 2, "2024-02-01")]))
    d = c.select(
        "claim_line_id", F.lit("01").alias("sequence_id"), F.lit("E11.9").alias("icd9_dx_cd"), "member_id", F.lit("Y").alias("poa_cd")
    )
    t = {
        "claim_line": c,
        "dx_line": d,
        "code_map": code_map(spark),
        "member_month": months(spark, full_coverage(1) + full_coverage(2)),
        "provider": spark.createDataFrame([(1, "PCP")], "provider_id bigint, specialty_ctg_cd string"),
    }
    study = Study(t, params())
    got = {r.member_id: (r.mentions, r.carried_any, r.lines, r.judged) for r in study.gates.collect()}
    assert got == {1: (365, True, n, True), 2: (2, True, 3, True)}
    assert study.scores.first().panel == 2


def test_order_and_partitions_do_not_matter(domain):
    p = fixture_params()
    mixed = {k: v.repartition(7).orderBy(F.rand(3)) if k in ("dx_line", "claim_line") else v for k, v in domain.items()}
    for build in (
        lambda s: checks.mismatch_sample(s.t["claim_line"], s.t["dx_line"], s.p),
        lambda s: profile.dx_probe(s.t["curated_claims"], s.t["dx_line"], s.p),
        lambda s: s.gates,
        lambda s: s.scores,
    ):
        assert rows(build(Study(domain, p))) == rows(build(Study(mixed, p)))


@pytest.mark.parametrize("ids", [20_000, 12])
def test_probe_picks_the_first_ids_in_hash_order(spark, ids):
    curated = spark.range(20_000).select((F.col("id") % ids).alias("claim_line_id"), F.col("id").alias("member_id"))
    want = sorted((str(i) for i in range(ids)), key=lambda i: hashlib.md5(i.encode()).hexdigest())[:10]
    assert [str(r.claim_line_id) for r in profile._probe_lines(curated, params(probe_lines=10)).collect()] == want


@pytest.mark.parametrize("lines", [20_000, 300_000])
def test_probe_shuffles_few_ids_however_many_lines(spark, tmp_path, lines):
    """A third of the rows are of one id; ids past the mark never reach the exchange."""
    ids = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    spark.range(lines).select(ids.alias("claim_line_id"), F.col("id").alias("member_id")).write.parquet(f"{tmp_path}/lines")
    curated = spark.read.parquet(f"{tmp_path}/lines")
    probe = profile._probe_lines(curated, params(probe_lines=1000))
    got = [r.claim_line_id for r in probe.collect()]
    every = {7} | {i for i in range(lines) if i % 3}
    assert got == sorted(every, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:1000]
    text = plan(probe)
    filters = [at.start() for at in re.finditer(r"Filter .*ubquery", text)]
    assert filters and filters[0] > text.index("Exchange hashpartitioning(claim_line_id"), "filtered below the exchange"
    hashed = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16).bit_length() for i in every}
    last = max(hashed[i] for i in got)
    assert sum(level <= last for level in hashed.values()) <= 4000


def test_dense_keys_are_counted_by_bitmaps_as_by_grouping(spark):
    keys = [0, 1, 1, 32767, 32768, 32769, -1, -32768, -32769, 10**12, None]
    df = spark.createDataFrame([(k,) for k in keys * 3], "member_id bigint")
    assert rows(profile.distinct_dense(df, "member_id")) == [(9,)]
    assert rows(profile.distinct_dense(df.limit(0), "member_id")) == [(0,)]
    by_group = profile.column_profile(df, "claim_line")
    by_bits = profile.column_profile(df, "claim_line", dense_keys=["member_id"])
    assert rows(by_group) == rows(by_bits)
    assert [(r.n_rows, r.null_rows, r.distinct_values, r.max_length) for r in by_bits.collect()] == [(33, 3, 9, 13)]
    assert "bitmap_construct_agg" in plan(by_bits)
    assert "bitmap_construct_agg" not in plan(by_group)


def test_column_profile_fans_out_one_row_only_and_survives_empty_tables(spark, domain):
    text = plan(profile.column_profile(domain["claim_line"], "claim_line"))
    assert "Expand" not in text
    assert text.index("Generate stack") < text.index("HashAggregate"), "stack stands above the aggregate"
    empty = profile.column_profile(domain["claim_line"].limit(0), "claim_line", dense_keys=["member_id"])
    assert {(r.n_rows, r.null_rows, r.distinct_values in (0, None), r.max_length) for r in empty.collect()} == {(0, 0, True, None)}


def test_volume_reads_no_column(domain):
    text = formatted(profile.table_volume({"claim_line": domain["claim_line"]}))
    assert re.findall(r"ReadSchema: (.*)", text) == ["struct<>"]


def test_filters_and_columns_reach_the_scan(domain):
    p = fixture_params()
    text = formatted(measure.measured_claims(domain["claim_line"], p).select("claim_line_id", "book"))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    for wanted in ("GreaterThanOrEqual(srv_start_dt,1999-01-01)", "LessThan(srv_start_dt,2001", "In(plc_srv_cd", "In(business_ln_cd"):
        assert wanted in pushed
    assert "allowed_amt" not in text
    assert "pri_icd9_dx_cd" not in text


def test_no_pairing_joins_and_no_raw_rows_in_one_partition(domain):
    p = fixture_params()
    study = Study(domain, p)
    frames = {**study.foundation(), **study.build(), **study.figures()}
    for name, df in frames.items():
        text = plan(df)
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_share_of_total_reuses_the_aggregate(spark, domain):
    groups = domain["dx_line"].groupBy("poa_cd").agg(F.count("*").alias("n"))
    df = share_of_total(groups, "n", "share")
    assert abs(sum(r.share for r in df.collect()) - 1) < 1e-3
    assert "ReusedExchange" in plan(df)


def test_skewed_claims_are_split_at_run_time(spark):
    """With small thresholds the skew join appears in the adaptive plan."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        c = spark.range(60_000).repartition(8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("claim_line_id"),
            (F.col("id") % 999).alias("member_id"),
            F.lit("2023-02-01").cast("date").alias("srv_start_dt"),
            F.lit("F").alias("plc_srv_cd"), F.lit("MED").alias("med_cost_ctg_cd"), F.lit("ME").alias("business_ln_cd"),
            F.col("id").alias("srv_prvdr_id"),
        )
        d = spark.range(60_000).select(
            F.col("id").alias("claim_line_id"), F.lit("01").alias("sequence_id"), F.lit("E11.9").alias("icd9_dx_cd")
        )
        df = measure.member_year(measure.labelled(c, d, codes.family_codes(code_map(spark), params().families), params()))
        assert df.count() == 999
        df.collect()
        assert "skew=true" in plan(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_of_a_busy_provider_are_split_where_providers_are_not_broadcast(spark):
    """Curated claims: the attribute join meets a third of all lines on one provider."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plain = [F.lit(v).alias(k) for k, v in {
            "pri_icd9_dx_cd": "E11.9", "prcdr_cd": "P", "business_ln_cd": "ME", "summarized_srv_ind": "Y", "duplicate_ind": "N",
            "med_cost_ctg_cd": "MED", "ntwk_srv_area_id": "N1",
        }.items()]
        c = spark.range(60_000).repartition(8).select(
            F.col("id").alias("claim_line_id"), (F.col("id") % 999).alias("member_id"), F.lit("2023-02-01").cast("date").alias("srv_start_dt"),
            F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 > 0, F.col("id") % 2000).alias("srv_prvdr_id"), F.col("id").cast("double").alias("allowed_amt"), *plain,
        )
        m = spark.range(2_000).select(
            (F.col("id") % 500).alias("member_id"), F.lit("2023").alias("eff_yr"), F.lit("02").alias("eff_mo"), F.col("id").alias("age_nbr"),
            *[F.lit("x").alias(k) for k in ("gender_cd", "mbr_county_cd", "mbr_submarket")],
        )
        d = spark.range(4_000).select(
            (F.col("id") % 1_000).alias("provider_id"), F.col("id").cast("string").alias("epdb_dw_prvdr_id"), F.lit("c").alias("county_nm"), F.lit("PCP").alias("specialty_ctg_cd")
        )
        p = params().with_(provider_key="provider_id", submarkets=())
        df = measure.curate_claims(c, m, d, p)
        got = {r.claim_line_id: (r.age_nbr, r.epdb_dw_prvdr_id) for r in df.collect()}
        assert "skew=true" in plan(df)
        assert got == {
            i: (i % 999 if i % 999 < 500 else None, None if k is None or k >= 1_000 else min(str(k + 1_000 * n) for n in range(4)))
            for i in range(60_000) for k in (0 if i % 3 == 0 else i % 2_000 if i % 7 else None,)
        }
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_scan_task_reduces_the_member_months_it_reads(spark, domain):
    """Curated claims: member months are dealt out as they are read, and sorted where they arrive."""
    p = fixture_params()
    text = plan(measure.curate_claims(domain["claim_line"], domain["member_month"], domain["provider"], p))
    months_read = next(x for x in re.split(r"\n(?=[^\n]*Exchange )", text) if "eff_yr" in x and "FileScan" in x)
    assert "Aggregate" not in months_read and "Sort" not in months_read


@pytest.mark.parametrize("name", ["member_month", "member_raw"])
def test_members_are_unfolded_into_months_by_many_tasks(spark, name):
    """One small file of customers makes 24 times as many rows, not in one task."""
    counts = [r["count"] for r in fixture_tables(spark, SF_DIR)[name].groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(counts) * 4 < sum(counts)


def test_a_hot_key_of_prepared_tables_can_be_split(spark, domain):
    names = {}
    try:
        for name in ("claim_line", "dx_line"):
            names[name] = f"prepared_{name}"
            spark.sql(f"DROP TABLE IF EXISTS {names[name]}")
            write_prepared(domain[name], names[name])
        c, d = (spark.table(n) for n in names.values())
        assert measure.expand_positions(c, d).count() == measure.expand_positions(domain["claim_line"], domain["dx_line"]).count()
        assert "bucket" not in plan(c.join(d.select("claim_line_id"), "claim_line_id")).lower()
    finally:
        for n in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {n}")



class _Session:
    """A session that names a checkpoint folder (fixed once a real one runs)."""

    def __init__(self, named, master):
        self.conf = self
        self.sparkContext = self
        self.named, self.master, self.applicationId = named, master, "app"

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_shared_folder():
    assert shared_folder(_Session("hdfs://x/c", "yarn")) == "hdfs://x/c"
    assert shared_folder(_Session(None, "yarn")) is None
    own = shared_folder(_Session(None, "local[4]"))
    assert own and own == shared_folder(_Session(None, "local[4]"))


def test_stages_are_written_once_and_read_back(spark, domain, tmp_path):
    p = fixture_params()
    store = StageStore(spark, str(tmp_path))
    staged, lazy = Study(domain, p, store), Study(domain, p)
    assert rows(staged.scores) == rows(lazy.scores)
    assert str(tmp_path) in staged.gates.inputFiles()[0]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.keep("gates", staged.gates)
