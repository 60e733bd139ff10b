"""Stages written to the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``.  A written stage survives
the loss of any executor and is re-read without its lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


_own: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the session names for checkpoints.

    Where it names none, a local session gets a folder of its own, removed when
    the program ends; a cluster session gets None, since no machine-local folder
    is shared by its executors.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.TemporaryDirectory(prefix="carryover-")
    return _own[app].name


class StageStore:
    """Writes each stage once under a run of its own and reads it back."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self.path = f"{folder}/study-{uuid.uuid4().hex}"

    @classmethod
    def of(cls, spark: SparkSession) -> "StageStore | None":
        """A store in the session's shared folder; None leaves stages lazy."""
        folder = shared_folder(spark)
        return None if folder is None else cls(spark, folder)

    def keep(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """Write ``df``, in folders of the columns ``by``, and read it back."""
        path = f"{self.path}/{name}"
        df.write.mode("errorifexists").partitionBy(*by).parquet(path)
        return self._spark.read.parquet(path)


def write_prepared(df: DataFrame, table: str) -> None:
    """Save a table for repeated joins, plainly: adaptive execution can then split a hot key,
    which it cannot where a table is bucketed on it."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)
