"""The whole study, gate by gate, with every result written.

Contract, discovery and foundation checks come first; unless every check of the
first gate has passed, or a person has let it through by name, nothing is built on
the data.  Verdicts are taken from the written
results, so each result is computed once.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators import profile, verdict
from carryover.params import Params
from carryover.plans.stages import StageStore
from carryover.plans.study import Study
from carryover.sources.tables import write_result

# Settings a cluster should run with; Spark's defaults already agree on the first
# three.  Hot keys that survive pre-aggregation are split by the skew join.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # prepared tables are bucketed on the line id; joins on line id and code stay in place
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@dataclass(frozen=True)
class Outcome:
    """Where a run ended."""

    verdicts: DataFrame
    stopped_by: tuple[str, ...]


def _write(results: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    return {name: write_result(df, folder, name) for name, df in results.items()}


def _blocking(verdicts: DataFrame, let_through: Collection[str] = ()) -> tuple[str, ...]:
    """Checks that stop the build: those of the first gate that did not pass - open or
    to be reviewed stops as failed does - and any other that blocks and failed."""
    needed = F.col("check").isin(*verdict.GATE_CHECKS["1 foundation"]) & (F.col("verdict") != "PASS")
    failed = F.col("blocks") & (F.col("verdict") == "FAIL")
    stops = verdicts.where(needed | failed).select("check").distinct()
    return tuple(sorted({r["check"] for r in stops.collect()} - set(let_through)))  # at most one row per check


def run(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    p: Params,
    folder: str,
    *,
    read_by_person: Mapping[str, str] | None = None,
    let_through: Collection[str] = (),
    dense_keys: Collection[str] = (),
    stop: bool = True,
) -> Outcome:
    """Run all gates into ``folder``.

    ``dense_keys`` names integer keys numbered one after another, whose distinct
    values the column profile then counts with bitmaps.

    ``let_through`` names foundation checks a person has read and accepted;
    ``stop=False`` goes on past all of them.  Neither changes a verdict.
    """
    study = Study(tables, p, StageStore.of(spark))
    write_result(profile.column_profiles(tables, dense_keys=dense_keys), folder, "column_profile")
    write_result(profile.table_volume(tables), folder, "table_volume")

    metrics = study.foundation_metrics(_write(study.foundation(), folder))
    found = write_result(
        verdict.metric_verdicts(metrics, verdict.FOUNDATION_CHECKS), folder, "foundation_verdicts"
    )
    blocked = _blocking(found, let_through)
    if blocked and stop:
        return Outcome(found, blocked)

    metrics = metrics.unionByName(study.build_metrics(_write(study.build(), folder)))
    metrics = metrics.unionByName(study.figure_metrics(_write(study.figures(), folder)))
    write_result(verdict.check_verdicts(metrics, read_by_person), folder, "check_verdicts")
    signoff = write_result(verdict.gate_signoff(metrics, read_by_person), folder, "gate_signoff")
    return Outcome(signoff, blocked)
