"""One thin query per operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm import (
    compression,
    conversations,
    decontaminate,
    quality,
    recompress,
    resample,
    secret_scan,
    simhash,
    suffixes,
    tokens,
    toxicity,
    vectors,
    warc,
)
from carryover.llm.common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.language_model(docs)
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"), model, held_out=toxicity.held_out())
    return toxicity.score(docs, model, classifier).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES))

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(secret_scan.BASE_RULES)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def _secret_spans(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """DuckDB: the spans of one rule, from the lengths of its matches and of the text between."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
        'a': CAST(list_sum(list_transform((string_split_regex(t, {p}))[1:i], lambda g: length(g)))
             + coalesce(list_sum(list_transform((regexp_extract_all(t, {p}))[1:i-1], lambda m: length(m))), 0) AS BIGINT),
        'k': {kind}, 'n': '{name}',
        'z': CAST(list_sum(list_transform((string_split_regex(t, {p}))[1:i], lambda g: length(g)))
             + list_sum(list_transform((regexp_extract_all(t, {p}))[1:i], lambda m: length(m))) AS BIGINT),
        'c': length((regexp_extract_all(t, {p}, {group}))[i])}}), lambda s: s.c >= {least})"""


def _secrets_oracle() -> str:
    every = " || ".join(_secret_spans(k, *rule) for k, rule in enumerate(secret_scan.RULES))
    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"len(list_filter(s, lambda x: x.k = {k})) AS n_{r[0]}" for k, r in enumerate(secret_scan.BASE_RULES))
    line = "array_to_string(list_transform({}, lambda x: x.n || ':' || x.a || ':' || x.z), ',')"
    return f"""
    SELECT doc_id, {counts},
           sha256({line.format(f"list_filter(s, lambda x: x.k < {base})")}) AS base_sha256,
           {line.format("s")} AS spans
    FROM (SELECT doc_id, list_sort({every}) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), held_out=quality.held_out())
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), machine)
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.mend(conversations.damage(table(spark, sf_dir, "conversations"))))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_recompression": op3_recompression,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_vectors": op7_vectors,
    "op8_simhash": op8_simhash,
    "op9_suffixes": op9_suffixes,
    "op10_warc": op10_warc,
    "op11_conversations": op11_conversations,
    "op12_resampling": op12_resampling,
    "op13_compression": op13_compression,
}

ORACLE_SQL: dict[str, str] = {"op5_secrets": _secrets_oracle()}
