"""What every result table promises, and the check that reads the tables back.

A result declares the key of its rows, whether it is reported by book, and the
assumptions behind each of its figures.  The assumptions travel as metadata of the
figure's column: they are written into the schema of the stored table, and whoever
reads the column has them.  :func:`results_checked` takes nothing from the declaration
but the names: keys, labels and limits are read from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators.gates import ASSUMPTIONS, FIGURES
from carryover.params import Params

UNIT = ("book", "condition")
DOCTOR = (*UNIT, "provider_id")
ANY, OFFICE = FIGURES["persistence_any"], FIGURES["persistence_office"]


@dataclass(frozen=True)
class Result:
    key: tuple[str, ...]
    figures: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def _all(ids: tuple[str, ...], *columns: str) -> dict[str, tuple[str, ...]]:
    return dict.fromkeys(columns, ids)


#: Result tables with a figure that may leave the analysis.
DECLARED: dict[str, Result] = {
    "condition_incidence": Result(UNIT, _all(ANY, "incidence")),
    "provider_scores": Result(DOCTOR, {"score_any": ANY, "score_office": OFFICE, "score_same": OFFICE}),
    "ranking": Result(DOCTOR, _all(OFFICE, "score_same", "expected", "adjusted_ratio")),
    "peer_compare": Result(DOCTOR, _all(OFFICE, "expected", "observed_to_expected", "ratio_low", "ratio_high")),
    "final_list": Result(DOCTOR, _all(OFFICE, "score_same", "interval_high", "peer_rate", "adjusted_ratio", "ratio_high")),
    "v16_population_rate": Result(UNIT, {"persistence_any": ANY, "persistence_office": OFFICE}),
    "v17_score_shape": Result(UNIT, _all(ANY, "end_share", "dip_share")),
    "v19_control_condition": Result(("book",), _all(ANY, "main_persistence", "control_persistence", "control_minus_main")),
    "v20_office_vs_any": Result(UNIT, _all(OFFICE, "mean_gap")),
    "v21_books_separate": Result(UNIT, {"persistence_any": ANY, "persistence_office": OFFICE}),
    "v22_flag_survival": Result(DOCTOR, _all(OFFICE, "score_same", "interval_low", "interval_high", "ratio_low", "ratio_high")),
    "v23_covariate_balance": Result((*UNIT, "covariate"), _all(OFFICE, "standardised_difference")),
    "v24_sensitivity": Result((*UNIT, "mentions", "min_panel"), _all(OFFICE, "overlap")),
}

#: Tables with a row for every book of the records; the others may lack one, as when no doctor is scored.
EVERY_BOOK = ("v16_population_rate", "v20_office_vs_any", "v21_books_separate")


def with_limits(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the assumptions behind each declared figure as metadata of its column."""
    for column, ids in DECLARED[name].figures.items() if name in DECLARED else ():
        limits = [dict(zip(("assumption", "status", "caveat", "if_wrong"), (i, *ASSUMPTIONS[i]))) for i in ids]
        df = df.withMetadata(column, {"limits": limits})
    return df


def limits_of(spark: SparkSession, results: Mapping[str, DataFrame]) -> DataFrame:
    """One row per figure and assumption, from the schemas of ``results``; a declared
    figure without limits, or one whose column is gone, has a row with NULLs."""
    rows = []
    for name in sorted(n for n in DECLARED if n in results):
        schema = {f.name: f for f in results[name].schema}
        for column in DECLARED[name].figures:
            limits = schema[column].metadata.get("limits", []) if column in schema else []
            rows += [(name, column, x["assumption"], x["status"], x["caveat"], x.get("if_wrong")) for x in limits] or [
                (name, column, None, None, None, None)
            ]
    names = "table_name string, figure string, assumption string, status string, caveat string, if_wrong string"
    return spark.createDataFrame(rows, names).orderBy("table_name", "figure", "assumption")


def results_checked(results: Mapping[str, DataFrame], books: DataFrame, p: Params) -> DataFrame:
    """One row per declared table: its rows, repeated keys, rows under no configured book,
    and books of the records (``books``) that should be there and are not."""
    named = list(p.books.values())
    out = None
    for name in sorted(n for n in DECLARED if n in results):
        df, result = results[name], DECLARED[name]
        per_key = df.groupBy(*result.key).agg(F.count(F.lit(1)).alias("n"))
        unnamed = F.col("book").isNull() | ~F.col("book").isin(*named)
        counts = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(unnamed, F.col("n"))), F.lit(0)).alias("unlabelled_rows"),
        )
        if name in EVERY_BOOK:
            missing = books.join(df.select("book").distinct(), "book", "left_anti").agg(F.count(F.lit(1)).alias("m")).scalar()
        else:
            missing = F.lit(0).cast("long")
        one = counts.select(F.lit(name).alias("table_name"), "*", missing.alias("missing_books"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("table_name")
