"""Time the headline queries; prints one JSON line.

Each query is run from its parquet files to a full result (a ``noop`` write),
after one untimed run that starts the JVM and compiles the generated code.
Stages a query writes and reads back are part of its time.  BENCH_SF_DIR,
BENCH_CPUS and BENCH_QUERIES (names, or ``all``) may be set.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from carryover.plans.registry import QUERIES

HEADLINE = [
    "v1_sequence_values",
    "v3_seq1_agreement",
    "v3_disagreeing_pairs",
    "v5_presence_pivot",
    "v6_join_integrity",
    "v7_diabetes_share",
    "v8_match_rate",
    "eda_dx_probe",
    "expand_positions",
    "label_conditions",
    "condition_records",
    "member_year",
    "two_year_outcome",
    "attrition",
    "rank_scores",
    "v24_sensitivity",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> None:
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def shuffled(spark: SparkSession) -> int:
    """Shuffle bytes written so far, over all executors."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("carryover-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    shuffle: dict[str, int] = {}
    for name in names:
        run(spark, name, sf_dir)
        before, start = shuffled(spark), time.perf_counter()
        run(spark, name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
        shuffle[name] = shuffled(spark) - before
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shuffle_bytes": shuffle,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
