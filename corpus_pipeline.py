"""The corpus pipeline: what one operator after another keeps of ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns
a DataFrame; :func:`run` writes each result and reads it again.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm import decontaminate, quality, secret_scan, simhash, tokens
from carryover.llm.common import keep, table
from carryover.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorisation machine does not reject: a score of one half or more."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), held_out=quality.held_out())
    return quality.score(docs, machine).where("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links (four-word shingles, four bits)."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, up to the edit budget."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets masked."""
    return secret_scan.redact(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number."""
    table(spark, sf_dir, "documents")  # ships the package
    coded = tokens.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER).drop("text")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: No SQL: scores, fingerprints and token ids have none; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
