"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a document are its hashed words (counts, scaled to length one), a
fixed list of structure statistics of the whole text, and the length its row
states.  The machine adds to a linear score the interactions of all pairs of
features, each the product of two short vectors; with the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
a document is scored in time linear in its features.  It is fitted on a bounded
sample of labelled rows; scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.common import crc_remainder

#: Hash buckets of words, factors of a feature, labelled rows fitted at most, passes over them.
BUCKETS, FACTORS, SAMPLE_ROWS, EPOCHS = 1 << 15, 6, 6_000, 8
#: Words remembered with their bucket in one task.
WORDS_KEPT = 400_000

#: Classes of bytes that are counted, as a share of all bytes.
CLASSES = {
    "upper": bytes(range(ord("A"), ord("Z") + 1)),
    "lower": bytes(range(ord("a"), ord("z") + 1)),
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "symbol": b"#$%&*@^~=+<>\\/_{}[]",
    "bar": b"|",
    "line": b"\n",
    "blank": b" \t\r\x0b\x0c",
}
STATISTICS = [*CLASSES, "words", "word_length", "distinct", "top_word", "repeated", "lines", "repeated_lines", "stated_length"]


def statistics(text: str, words: list[str], stated: float | None) -> list[float]:
    """The structure statistics of a whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    size, n = max(1, len(raw)), max(1, len(words))
    shares = [(len(raw) - len(raw.translate(None, chars))) / size for chars in CLASSES.values()]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(operator.eq, words, words[1:]))
    return [
        *shares,
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        same / n,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max(0.0, float(len(text) if stated is None else stated))),
    ]


class Buckets(dict):
    """Word to bucket, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        at = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return at


@dataclass
class Rows:
    """Sparse words (bucket, value; ``start`` of each row) and dense statistics of rows."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray
    dense: np.ndarray


def features(texts: list[str | None], stated: list[float | None], buckets: Buckets) -> Rows:
    dense, ids, sizes = [], [], []
    for text, length in zip(texts, stated):
        text = text or ""
        words = text.lower().split()
        dense.append(statistics(text, words, length))
        ids.append(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    n = len(texts)
    rows = np.repeat(np.arange(n), sizes)
    keys, counts = np.unique(rows * BUCKETS + (np.concatenate(ids) if ids else np.empty(0, np.int64)), return_counts=True)
    at, index = keys // BUCKETS, keys % BUCKETS
    norm = np.sqrt(np.bincount(at, counts.astype(float) ** 2, n))
    start = np.searchsorted(at, np.arange(n + 1))
    return Rows(index.astype(np.int32), (counts / norm[at]).astype(np.float32), start, np.array(dense, np.float32).reshape(n, -1))


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's entries; rows may be empty."""
    ahead = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, 0, out=ahead[1:])
    return ahead[start[1:]] - ahead[start[:-1]]


@dataclass
class Machine:
    """A fitted machine: weights and factors of buckets, then of statistics."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, rows: Rows) -> np.ndarray:
        return np.clip((rows.dense - self.mean) / self.spread, -4, 4)

    def margin(self, rows: Rows) -> np.ndarray:
        x, d = rows.value[:, None], self.scaled(rows)
        w, v = self.weight, self.factor
        words = v[rows.index] * x
        linear = self.bias + sums(w[rows.index] * rows.value, rows.start) + d @ w[BUCKETS:]
        total = sums(words, rows.start) + d @ v[BUCKETS:]
        squares = sums(words**2, rows.start) + d**2 @ v[BUCKETS:] ** 2
        return linear + 0.5 * (total**2 - squares).sum(1)

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(rows: Rows, label: np.ndarray, seed: int = 7, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Fit by Adagrad on the logistic loss, in a fixed order; no rows give a score of one half."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    dense = rows.dense if len(label) else np.zeros((1, len(STATISTICS)), np.float32)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)), dense.mean(0), dense.std(0) + 1e-3)
    if not len(label):
        return m
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    seen = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in np.array_split(order, max(1, len(order) // 128)):
            part = _take(rows, at)
            d, x, of = m.scaled(part), part.value[:, None], np.repeat(np.arange(len(at)), np.diff(part.start))
            gap = (m.score(part) - label[at]) / len(at)
            words = m.factor[part.index] * x
            total = sums(words, part.start) + d @ m.factor[BUCKETS:]
            used, place = np.unique(part.index, return_inverse=True)
            g = gap[of]
            grad_w = np.bincount(place, g * part.value, len(used))
            step = g[:, None] * (x * total[of] - words * x)
            grad_v = np.stack([np.bincount(place, step[:, f], len(used)) for f in range(FACTORS)], 1)
            at_w = np.concatenate([used, np.arange(BUCKETS, size)])
            grad_w = np.concatenate([grad_w, gap @ d]) + decay * m.weight[at_w]
            grad_v = np.concatenate([grad_v, d.T @ (gap[:, None] * total) - (gap @ d**2)[:, None] * m.factor[BUCKETS:]]) + decay * m.factor[at_w]
            seen[0][at_w] += grad_w**2
            seen[1][at_w] += grad_v**2
            m.weight[at_w] -= rate * grad_w / np.sqrt(seen[0][at_w])
            m.factor[at_w] -= rate * grad_v / np.sqrt(seen[1][at_w])
            m.bias -= rate * gap.sum()
    return m


def _take(rows: Rows, at: np.ndarray) -> Rows:
    parts = [slice(rows.start[i], rows.start[i + 1]) for i in at]
    index = np.concatenate([rows.index[p] for p in parts])
    value = np.concatenate([rows.value[p] for p in parts])
    return Rows(index, value, np.concatenate([[0], np.cumsum([p.stop - p.start for p in parts])]), rows.dense[at])


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    held_out: F.Column | None = None,
) -> Machine:
    """Fit on at most ``sample_rows`` labelled rows, the first by hash of their id.

    Rows with a null id or label, and rows where ``held_out`` is true, are never
    learnt from.  The bound is the only limit on learning; it fixes what reaches
    the driver at any size of the corpus.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    if held_out is not None:
        known = known.where(~held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            made = features(batch.column(1).to_pylist(), batch.column(2).to_pylist(), buckets)
            cut = pa.array(made.start, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(3),
                    pa.ListArray.from_arrays(cut, pa.array(made.index, pa.int32())),
                    pa.ListArray.from_arrays(cut, pa.array(made.value, pa.float32())),
                    pa.array(list(made.dense), pa.list_(pa.float32())),
                ],
                names=["doc_id", "y", "i", "v", "d"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, y double, i array<int>, v array<float>, d array<float>").toArrow().combine_chunks()
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(Rows(*[np.empty(0)] * 3, np.empty((0, len(STATISTICS)))), np.empty(0))
    sizes = [len(x) for x in got["i"]]
    return fit(
        Rows(
            np.concatenate([np.asarray(x.values, np.int32) for x in got["i"]]),
            np.concatenate([np.asarray(x.values, np.float32) for x in got["v"]]),
            np.concatenate([[0], np.cumsum(sizes)]),
            np.array(got["d"].to_pylist(), np.float32),
        ),
        np.array(got["y"].to_pylist()),
    )


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1, of every whole text.

    A null text is scored as an empty one, a null ``n_chars`` as the text's length.
    Other columns are kept; a column already named ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts, stated in parts:
            out = []
            for at in range(0, len(texts), 500):
                lengths = [None if x != x else x for x in stated.iloc[at : at + 500]]
                out.append(shared.value.score(features(list(texts.iloc[at : at + 500]), lengths, buckets)))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return docs.withColumn("score", run(F.col("text"), F.col("n_chars").cast("double")))


def held_out() -> F.Column:
    """The fold of the contract: crc32 of the id as text, modulo 3, is 1."""
    return crc_remainder("doc_id", 3) == 1
