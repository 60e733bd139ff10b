"""Discovery: what is in each table, before anything is concluded from it."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.functions import blank, share, share_of_total, trimmed
from carryover.params import Params
from carryover.sources.contract import CONTRACTS, same_type

# Planned volumes, in rows; the tables without a figure have none published.
EXPECTED_ROWS = {"claim_line": 40_000_000, "dx_line": 180_000_000}


def _unpivot(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(profiled, value) pairs of several columns from one scan."""
    pairs = ", ".join(f"'{n}', CAST(`{c}` AS STRING)" for c, n in zip(columns, names))
    return df.select(F.expr(f"stack({len(columns)}, {pairs}) AS (profiled, value)"))


def _value_counts(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    return (
        _unpivot(df, columns, names)
        .groupBy("profiled", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _shown(value: str = "value"):
    return F.coalesce(F.col(value), F.lit("(null)")).alias("raw_value")


def distinct_dense(df: DataFrame, key: str) -> DataFrame:
    """Exact number of distinct values of an integer key whose values lie close together.

    A task sends one bitmap of 4 kB for each 32,768 neighbouring values it saw, whatever
    its rows.  A key spread thinly over a wide range would fill bitmaps with single bits:
    such a key is counted by grouping.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(key).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
        .agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    )


def column_profile(
    df: DataFrame, table: str, dataset: str = "input", dense_keys: Collection[str] = (), count_values: bool = True
) -> DataFrame:
    """One row per column: contract against reality, with null, distinct and
    length figures.

    Rows, nulls and lengths are one aggregate of one row over one scan, turned into a
    row per column afterwards.  Distinct values are counted exactly, from a scan of
    each column alone: those of value lists and days are few, so partial
    aggregation leaves little to shuffle; keys named in ``dense_keys`` go through
    :func:`distinct_dense`, other keys are shuffled once per value and task.  Measures
    have no distinct count, and fractional numbers no length, as they have no settled text.
    ``count_values=False`` leaves distinct values out, and their scans.
    """
    fields = {f.name: f for f in CONTRACTS[table]}
    figures, cells = [F.count(F.lit(1)).alias("n_rows")], []
    for i, c in enumerate(df.columns):
        kind = df.schema[c].dataType
        declared = f"'{fields[c].type}'" if c in fields else "CAST(NULL AS STRING)"
        quoted = F.col(f"`{c}`")
        length = F.lit(None) if isinstance(kind, T.FractionalType) else F.max(F.length(quoted.cast("string")))
        figures += [F.count(quoted).alias(f"known_{i}"), length.cast("long").alias(f"length_{i}")]
        cells.append(
            f"{i + 1}, '{c}', {declared}, '{kind.simpleString()}', n_rows - known_{i}, distinct_{i}, length_{i}"
        )
    row = df.agg(*figures)
    for i, c in enumerate(df.columns):
        role = fields[c].role if c in fields else "measure"
        integer = isinstance(df.schema[c].dataType, T.IntegralType)
        if not count_values:
            distinct = F.lit(None).cast("long")
        elif role == "key" and c in dense_keys and integer:
            distinct = distinct_dense(df, c).scalar()
        elif role in ("key", "code", "day"):
            # two levels: counts of one level would be merged into one aggregate that expands every row
            distinct = df.select(f"`{c}`").distinct().agg(F.count(f"`{c}`")).scalar()
        else:
            distinct = F.lit(None).cast("long")
        row = row.withColumn(f"distinct_{i}", distinct)
    names = "ordinal_position, column_name, declared_type, data_type, null_rows, distinct_values, max_length"
    return row.select("n_rows", F.expr(f"stack({len(cells)}, {', '.join(cells)}) AS ({names})")).select(
        F.lit(dataset).alias("dataset_searched"),
        F.lit(table).alias("table_name"),
        "ordinal_position",
        "column_name",
        "declared_type",
        "data_type",
        (F.col("null_rows") > 0).alias("is_nullable"),
        "n_rows",
        "null_rows",
        "distinct_values",
        "max_length",
    )


def column_profiles(
    tables: Mapping[str, DataFrame], dataset: str = "input", dense_keys: Collection[str] = ()
) -> DataFrame:
    """:func:`column_profile` of every table, in order."""
    out = None
    for name, df in tables.items():
        one = column_profile(df, name, dataset, dense_keys)
        out = one if out is None else out.unionByName(one)
    return out.orderBy("dataset_searched", "table_name", "ordinal_position")


def column_listing(df: DataFrame, table: str) -> DataFrame:
    """Names and types of one table's columns, with the rows that support them."""
    return (
        column_profile(df, table, count_values=False)
        .select("ordinal_position", "column_name", "data_type", "n_rows", "null_rows")
        .orderBy("ordinal_position")
    )


def table_volume(tables: Mapping[str, DataFrame], dataset: str = "input") -> DataFrame:
    """Rows per table beside the planned volume; a parquet scan for it reads no column."""
    out = None
    for name, df in tables.items():
        expected = EXPECTED_ROWS.get(name)
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(dataset).alias("dataset_searched"),
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(expected).cast("long").alias("expected_rows"),
            share(F.col("row_count"), F.lit(expected).cast("long")).alias("share_of_expected"),
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy("dataset_searched", "table_name")


def file_volume(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Size and last change of file-backed tables, from the file listing alone."""
    out = None
    for name, path in paths.items():
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("length", "modificationTime")
        )
        one = files.agg(
            F.lit(name).alias("table_name"),
            F.round(F.sum("length") / F.lit(float(1024**3)), 2).alias("size_gb"),
            F.max("modificationTime").alias("last_modified"),
        )
        out = one if out is None else out.unionByName(one)
    return out.orderBy("table_name")


def value_profile(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Distinct values with counts and shares, all columns in one scan."""
    names = [f"{table}.{c}" for c in columns]
    counts = _value_counts(df, columns, names)
    return (
        share_of_total(counts, "n_rows", "share", parts=len(columns))
        .select("profiled", _shown(), "n_rows", "share")
        .orderBy("profiled", F.desc("n_rows"), "raw_value")
    )


def code_shapes(dx_line: DataFrame, code_map: DataFrame) -> DataFrame:
    """Raw length and dot patterns on both sides, before normalisation.

    Rows are counted per written code first, so only distinct codes shuffle.
    """

    def side(df: DataFrame, column: str, name: str) -> DataFrame:
        written = F.col(column)
        codes = (
            df.where(~blank(written))
            .groupBy(written.alias("code"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return codes.groupBy(
            F.lit(name).alias("side"),
            F.length(trimmed(F.col("code"))).alias("raw_length"),
            (F.instr("code", ".") > 0).alias("has_dot"),
        ).agg(F.count(F.lit(1)).alias("distinct_codes"), F.sum("n").alias("n_rows"))

    return (
        side(dx_line, "icd9_dx_cd", "dx_line.icd9_dx_cd")
        .unionByName(side(code_map, "diagnosis_code", "code_map.diagnosis_code"))
        .orderBy("side", F.desc("n_rows"))
    )


def _rows_per_line(df: DataFrame) -> DataFrame:
    return df.groupBy("claim_line_id").agg(F.count(F.lit(1)).alias("n"))


def grain_distribution(curated: DataFrame) -> DataFrame:
    """How many rows a claim line id has; the whole histogram."""
    return (
        _rows_per_line(curated)
        .groupBy(F.col("n").alias("rows_per_claim_line_id"))
        .agg(F.count(F.lit(1)).alias("claim_line_ids"))
        .orderBy("rows_per_claim_line_id")
    )


def grain_totals(curated: DataFrame) -> DataFrame:
    """Rows, distinct ids and rows without an id, over one count per id."""
    no_id = F.col("claim_line_id").isNull()
    return _rows_per_line(curated).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("claim_line_id").alias("distinct_claim_line_ids"),
        F.coalesce(F.sum(F.when(no_id, F.col("n"))), F.lit(0)).alias("null_claim_line_id_rows"),
    )


def _hash_level(hashed: Column) -> Column:
    """Length in bits of the first 60 bits of an md5 text: each level holds half the
    ids of the level above, and every id of a lower level sorts before it."""
    return F.length(F.bin(hashed))


def _probe_lines(curated: DataFrame, p: Params) -> DataFrame:
    """The first ``probe_lines`` distinct line ids in md5 order.

    Only ids that can be among them are shuffled.  A first pass over the id column
    marks 15 bits of each hash in one bitmap per level, which is at most 60 bitmaps of
    4 kB per task; distinct marks are never more than distinct ids, so the lowest
    levels that together hold ``probe_lines`` marks hold all ids wanted - two to three
    times as many in expectation, however many lines there are, and a hot id is one
    mark.  With fewer marks than that every level is kept.
    """
    line = F.col("claim_line_id")
    hashed = curated.where(line.isNotNull()).select(
        line, F.col("member_id").cast("string").alias("member"), F.md5(line.cast("string").cast("binary")).alias("hash")
    ).withColumn("bits", F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")).withColumn("level", _hash_level(F.col("bits")))
    mark = F.expr("shiftright(bits, greatest(level - 16, 0)) & 32767")
    marks = hashed.groupBy("level").agg(F.bitmap_count(F.bitmap_construct_agg(mark)).alias("n"))
    # at most 60 rows
    so_far = F.sum("n").over(Window.orderBy("level"))
    last = marks.select("level", so_far.alias("n")).where(F.col("n") >= p.probe_lines).agg(F.min("level"))
    return (
        hashed.where(F.col("level") <= F.coalesce(last.scalar(), F.lit(60)))
        .groupBy("claim_line_id", "hash")
        .agg(F.min("member").alias("member"))
        .orderBy("hash", line.cast("string"))
        .limit(p.probe_lines)
        .select("claim_line_id", "member")
    )


def dx_probe(curated: DataFrame, dx_line: DataFrame, p: Params) -> DataFrame:
    """A fixed sample of claim lines followed into the diagnosis table.

    A rerun picks the same lines.  The sample is the one side small by
    construction; the diagnosis rows that meet it are reduced to one row of
    flags per line before the counts, which then need no distinct.
    """
    curated, dx_line = same_type(curated, dx_line, "claim_line_id")
    pick = _probe_lines(curated, p)
    seen = F.col("dx_member").isNull()
    flags = (
        dx_line.select("claim_line_id", F.col("member_id").cast("string").alias("dx_member"))
        .join(F.broadcast(pick), "claim_line_id")
        .groupBy("claim_line_id")
        .agg(
            F.bool_or(F.coalesce(F.col("dx_member") != F.col("member"), F.lit(False))).alias("disagrees"),
            F.bool_or(seen).alias("no_member"),
        )
    )
    matched = F.count("disagrees")
    return pick.join(flags, "claim_line_id", "left").agg(
        F.count(F.lit(1)).alias("probe_lines"),
        matched.alias("matched_lines"),
        share(matched, F.count(F.lit(1))).alias("match_rate"),
        F.count_if("disagrees").alias("lines_member_disagree"),
        F.count_if("no_member").alias("dx_member_null_lines"),
    )


def business_lines(curated: DataFrame) -> DataFrame:
    """Rows and members per business line, counted per (line, member) first."""
    value = F.coalesce(F.col("business_ln_cd").cast("string"), F.lit("(null)"))
    return (
        curated.groupBy(value.alias("business_ln_cd"), "member_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("business_ln_cd")
        .agg(F.sum("n").alias("n_rows"), F.count("member_id").alias("members"))
        .orderBy(F.desc("n_rows"), "business_ln_cd")
    )


SUBMARKETS = ("mbr_submarket", "prvdr_submarket")


def submarket_cardinality(curated: DataFrame) -> DataFrame:
    """Distinct values and missing rows of both submarket columns, one scan."""
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("n_rows")))
    return (
        _value_counts(curated, SUBMARKETS, SUBMARKETS)
        .groupBy("profiled")
        .agg(
            F.count("value").alias("distinct_values"),
            F.coalesce(nulls, F.lit(0)).alias("null_rows"),
            F.sum("n_rows").alias("n_rows"),
        )
        .orderBy("profiled")
    )


def submarket_top(curated: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent values per column; each task keeps its own top first."""
    order = Window.partitionBy("profiled").orderBy(F.desc("n_rows"), "raw_value")
    return (
        _value_counts(curated, SUBMARKETS, SUBMARKETS)
        .select("profiled", _shown(), "n_rows")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .drop("place")
        .orderBy("profiled", F.desc("n_rows"), "raw_value")
    )


def year_range(curated: DataFrame) -> DataFrame:
    """Lines and first and last service date per year, without any filter."""
    day = F.col("srv_start_dt")
    return (
        curated.groupBy(F.year(day).alias("yr"))
        .agg(
            F.count(F.lit(1)).alias("claim_lines"),
            F.min(day).alias("min_srv_start_dt"),
            F.max(day).alias("max_srv_start_dt"),
        )
        .orderBy("yr")
    )
