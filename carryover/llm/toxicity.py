"""Toxicity after noisy-channel deobfuscation.

A token written to hide a word is a lattice: a digit or sign may stand for a letter,
a separator or a repeated letter may be dropped, single letters set apart may be
one word.  Viterbi decoding picks the likeliest readings under a character trigram
model, counted over the whole corpus, times fixed channel costs.  The words of the
restored text, and their beginnings, are then scored by a logistic regression.

Tokens and runs of single letters of any length are decoded: of a long one the beginning
of the likeliest path is settled while the rest is still open, so memory does not grow.
Empty texts restore to empty ones; repeated rows are scored alike.

Counting the model is one pass with counts summed per task; fitting uses a bounded
sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm.common import crc_remainder

#: Labelled rows fitted at most, for each label.
SAMPLE_ROWS = 4_000
#: Buckets of words and beginnings, lengths of the beginnings, evidence a feature needs.
BUCKETS, BEGINNINGS, EVIDENCE, LEAST_DOCS = 1 << 22, (4, 5, 6, 7), 20.0, 3
#: Words and tokens remembered in one task.
KEPT = 300_000
#: Letters of a path that stay open behind the last one read, and steps between two looks at it.
LAG, LOOK = 20, 20
#: Paths kept at each state of a lattice, and how much less likely a further reading may be.
PATHS, MARGIN = 3, 4.0

# --- Fixed values: what a sign may stand for, and the channel's costs (negative logs). ---
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*~'^,:;/\\ "
COST_SIGN, COST_DROP, COST_REPEAT, COST_PAIR, COST_SPACE, COST_STAR = 0.7, 0.2, 0.1, 6.0, 1.0, 2.5

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Character classes of the model: 0 is no letter, 1 to 26 the letters, 27 any other letter.
SIZE = 28
_BYTE_CLASS = np.zeros(256, np.int64)
_BYTE_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_BYTE_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_BYTE_CLASS[128:] = 27


def trigrams(texts: list[bytes]) -> np.ndarray:
    """Counts of class triples in ``texts``; two non-letters stand before and after each."""
    total = np.zeros(SIZE**3, np.int64)
    for at in range(0, len(texts), 200):
        c = _BYTE_CLASS[np.frombuffer(b"  ".join([b"", *texts[at : at + 200], b""]), np.uint8)]
        c = c[np.concatenate([[True], ~((c[1:] == 27) & (c[:-1] == 27))])]
        total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    return total


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log probabilities [a, b, c] of c after a, b, counted over every whole text.

    Every task adds up its counts, so at most 28^3 sums per task are shuffled and as
    many reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigrams([t.as_py() for t in batch.column(0)])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["triple", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("t"))
    counted = rows.mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[counted["triple"].to_numpy()] = counted["n"].to_numpy()
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pairs = counts.sum(0)
    single = (pairs.sum(0) + 1) / (pairs.sum() + SIZE)
    after = (pairs + 5 * single) / (pairs.sum(1, keepdims=True) + 5)
    return -np.log((counts + 5 * after) / (counts.sum(2, keepdims=True) + 5))


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character of a lower-case token its readings ("" drops it) and their costs."""
    for c, group in groupby(token):
        run = sum(1 for _ in group)
        arcs: list[tuple[str, float]] = []
        if c.isalpha():
            arcs.append((c, 0.0))
        arcs += [(x, COST_SIGN) for x in STANDS_FOR.get(c, "")]
        if c == " ":
            arcs.append((c, COST_SPACE))
        if c == "*":
            arcs += [(x, COST_STAR) for x in LETTERS]
        first = [*arcs, ("", COST_DROP)] if c in SEPARATORS or not arcs else arcs
        yield first
        repeat = [*arcs, ("", COST_REPEAT if run > 2 else COST_PAIR)]
        for _ in range(run - 1):
            yield repeat


def readings(token: str, model: np.ndarray) -> list[str]:
    """The likeliest reading of a token, and others that are less likely by at most ``MARGIN``.

    Viterbi over the lattice; a state is the last two letters and keeps its best few paths.
    Once the likeliest path is longer than twice ``LAG``, all but its last ``LAG`` letters are
    settled and paths that began otherwise are given up.
    """
    settled: list[str] = []
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for i, arcs in enumerate(lattice(token)):
        after: dict[tuple[int, int], dict[str, float]] = {}
        for (a, b), paths in states.items():
            for letter, extra in arcs:
                c = _class(letter) if letter else b
                cost_of = after.setdefault((b, c) if letter else (a, b), {})
                step = extra + (model[a, b, c] if letter else 0.0)
                for cost, read in paths:
                    if cost + step < cost_of.get(read + letter, np.inf):
                        cost_of[read + letter] = cost + step
        states = {k: sorted((c, r) for r, c in v.items())[:PATHS] for k, v in after.items()}
        if i % LOOK == LOOK - 1:
            _, best = min(path for paths in states.values() for path in paths)
            if len(best) > 2 * LAG:
                begun = best[:-LAG]
                settled.append(begun)
                left = {k: [(c, r[len(begun) :]) for c, r in v if r.startswith(begun)] for k, v in states.items()}
                states = {k: v for k, v in left.items() if v}
    ends: dict[str, float] = {}
    for (a, b), paths in states.items():
        for cost, read in paths:
            ends[read] = min(ends.get(read, np.inf), cost + model[a, b, 0])
    best_ends = sorted((c, r) for r, c in ends.items())
    begun = "".join(settled)
    return [begun + r for c, r in best_ends[:PATHS] if c <= best_ends[0][0] + MARGIN]


_REPEATED = re.compile(r"(.)\1\1")
_TIRED = re.compile(r"([^\w\s])\1{2,}$|[.,;:!?\"')\]]+$|^[\"'(\[]+")


class Restorer:
    """Restored words of texts under one model; tokens seen are remembered."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.seen: dict[str, str] = {}
        self.also: dict[str, list[str]] = {}

    def token(self, token: str) -> str:
        """A lower-case token without the signs around it, decoded where it hides something."""
        known = self.seen.get(token)
        if known is None:
            bare = _TIRED.sub("", _TIRED.sub("", token))
            known = bare
            if not bare.isalpha() or _REPEATED.search(bare):
                letters = sum(c.isalpha() for c in bare)
                if 2 <= letters and 5 * letters >= 2 * len(bare.translate(_NO_SEPARATORS)) or _REPEATED.search(bare) and bare.isalpha():
                    known, *others = readings(bare, self.model)
                    # what separators part may be words of their own, each written to hide something
                    parts = _PARTED.split(bare)
                    others += [self.token(part) for part in parts if 2 < len(part) < len(bare)]
                    if others:
                        self.also[token] = others
            self.seen[token] = known
        return known

    def _spaced(self, letters: str) -> str:
        known = self.seen.get(letters)
        if known is None:
            known = self.seen[letters] = readings(letters, self.model)[0]
        return known

    def words(self, text: str) -> list[str]:
        """The words of the restored text: tokens decoded, and single letters set apart joined."""
        if len(self.seen) > KEPT:  # between texts only: evidence() reads what this text added
            self.seen.clear()
            self.also.clear()
        tokens = text.lower().split()
        seen = self.seen
        out = [seen[t] if t in seen else self.token(t) for t in tokens]
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        if single.sum() > 2:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a > 2:
                    out += self._spaced(" ".join(tokens[a:b])).split()
        return out

    def evidence(self, text: str) -> set[str]:
        """The distinct words of the restored text, with the further readings of decoded tokens."""
        found = set(self.words(text))
        for token in self.also.keys() & set(text.lower().split()):
            found.update(self.also[token])
        return found

    def text(self, text: str) -> str:
        return " ".join(w for w in self.words(text) if w)


_PARTED = re.compile("[" + re.escape(SEPARATORS) + "]+")
_NO_SEPARATORS = {ord(c): None for c in SEPARATORS}


def features_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    parts = [word, *[word[:n] + "^" for n in BEGINNINGS if len(word) > n]]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


@dataclass
class Classifier:
    """Weights of the chosen buckets, and the bias."""

    weights: dict[int, float]
    bias: float


class Scorer:
    """Scores texts: the weights of the distinct features of their restored words, added up."""

    def __init__(self, model: np.ndarray, classifier: Classifier):
        self.restorer, self.classifier = Restorer(model), classifier
        self.known: dict[str, tuple] = {}

    def _word(self, word: str) -> tuple:
        w = self.classifier.weights
        found = tuple(f for f in features_of(word) if f in w)
        if len(self.known) > KEPT:
            self.known.clear()
        self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        known, own = self.known, self._word
        found: set[int] = set()
        for word in self.restorer.evidence(text or ""):
            hit = known[word] if word in known else own(word)
            if hit:
                found.update(hit)
        margin = self.classifier.bias + sum([self.classifier.weights[f] for f in sorted(found)])
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(rows: list[np.ndarray], label: np.ndarray, share: float) -> Classifier:
    """Choose features by their likelihood ratio and fit their weights, with the labels weighted to ``share`` toxic."""
    toxic = label == 1
    if not toxic.any() or toxic.all():
        return Classifier({}, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    count = [np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t == k]), minlength=BUCKETS) for k in (False, True)]
    n0, n1 = (~toxic).sum(), toxic.sum()
    seen = np.flatnonzero(count[0] + count[1] >= LEAST_DOCS)
    a, b = count[1][seen].astype(float), count[0][seen].astype(float)

    def part(x, of):
        p = np.clip(x / of, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (of - x) * np.log(1 - p)

    ratio = 2 * (part(a, n1) + part(b, n0) - part(a + b, n0 + n1))
    chosen = seen[(ratio > EVIDENCE) & (a / n1 > b / n0)]
    place = {int(f): i for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r.tolist() if f in place]] = 1
    weight = np.where(toxic, share / n1, (1 - share) / n0).astype(np.float32)
    w, bias = np.zeros(len(chosen), np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    m = v = np.zeros(len(chosen) + 1, np.float32)
    for t in range(1, 401):
        gap = weight * (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - toxic)
        g = np.concatenate([gap @ x + 2e-4 * w, [gap.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, bias = w - step[:-1], bias - float(step[-1])
    return Classifier({int(f): float(y) for f, y in zip(chosen, w)}, bias)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, held_out: Column | None = None) -> Classifier:
    """Fit on at most ``sample_rows`` rows of each label, the first by hash of their id.

    Rows with a null id or label and rows where ``held_out`` is true are never learnt
    from; the share of each label among all other rows is counted exactly.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out is not None:
        known = known.where(~held_out)
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counted.get(1, 0) / max(1, sum(counted.values()))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("y = 1").orderBy(*order).limit(sample_rows).union(known.where("y = 0").orderBy(*order).limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            found = [sorted({f for w in restorer.evidence(t.as_py() or "") for f in features_of(w)}) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, y int, f array<int>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return fit([np.asarray(f.values, np.int64) for f in got["f"]], got["y"].to_numpy(), share)


def score(docs: DataFrame, model: np.ndarray, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1 of every whole text; a null text scores as an empty one.

    Other columns are kept, one named ``score`` is replaced, repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, classifier))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in parts:
            yield texts.map(scorer.score).astype(float)

    return docs.withColumn("score", run(F.coalesce(F.col(text), F.lit(""))))


def restore(docs: DataFrame, model: np.ndarray, text: str = "text", restored: str = "restored") -> DataFrame:
    """``docs`` with the restored text in a column of its own; null gives the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(shared.value)
        for texts in parts:
            yield texts.map(restorer.text)

    return docs.withColumn(restored, run(F.coalesce(F.col(text), F.lit(""))))


def held_out() -> Column:
    """The fold of the contract: crc32 of the id as text, modulo 5, is 0."""
    return crc_remainder("doc_id", 5) == 0
