"""Recompression and suffix order against every window of every text."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from carryover.llm import recompress, repeats, suffixes
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR


def brute(texts: list, width: int, keep_first: bool) -> list[list[bool]]:
    """Which letters of each (ordered) text go."""
    places: dict = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            places.setdefault(t[s : s + width], []).append((i, s))
    gone = [[False] * len(t) for t in texts]
    for at in places.values():
        for i, s in at[1:] if keep_first else at if len(at) > 1 else []:
            gone[i][s : s + width] = [True] * width
    return gone


def words(text: str | None) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def texts_of(letters: str, seed: int) -> list[str]:
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(40)]
    return [rnd.choice(base)[: rnd.randint(0, 90)] + "x" * rnd.randint(0, 40) + rnd.choice(base) for _ in range(60)]


@pytest.mark.parametrize("width, keep_first, letters", [(4, True, "ab"), (20, True, "ab"), (20, True, "abcdefgh"), (20, False, "abcdefgh"), (12, True, "a")])
def test_words(spark, width, keep_first, letters):
    texts = [" ".join(t) for t in texts_of(letters, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    gone = brute([words(t) for t in texts], width, keep_first)
    for r in recompress.remove_repeats(df, width, keep_first).collect():
        assert r.kept == " ".join(w for w, g in zip(words(texts[r.doc_id]), gone[r.doc_id]) if not g)
        assert r.n_removed == sum(gone[r.doc_id])


@pytest.mark.parametrize("width, keep_first", [(8, False), (20, False), (30, True)])
@pytest.mark.parametrize("hot", [repeats.HOT_POSTS, 0])
def test_bytes(spark, monkeypatch, width, keep_first, hot):
    """With no post allowed every repeated key is hot, and its windows are compared by hash."""
    texts = texts_of("ab c", 5)
    raw = [t.encode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    gone = brute(raw, width, keep_first)
    if not hot:
        real = repeats.revealed
        from pyspark.sql import functions as F

        monkeypatch.setattr(repeats, "revealed", lambda *a: real(*a).withColumn("hot", F.col("keys")))
    for r in suffixes.remove_repeats(df, width, keep_first).collect():
        mine = gone[r.doc_id]
        assert bytes(r.kept) == bytes(b for b, g in zip(raw[r.doc_id], mine) if not g)
        assert r.n_spans == sum(g and not (k and mine[k - 1]) for k, g in enumerate(mine))


@pytest.mark.parametrize("keep_first", [False, True])
def test_hot_key_over_small_batches(spark, monkeypatch, keep_first):
    """Rows that did not post a hot key first send its windows as those that did."""
    monkeypatch.setattr(repeats, "HOT_POSTS", 3)
    rnd = random.Random(9)
    noise = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(60))
    shared = noise()
    texts = [noise() + shared + noise() for _ in range(40)]
    gone = brute([t.encode() for t in texts], 30, keep_first)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        rows = suffixes.remove_repeats(df, 30, keep_first).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for r in rows:
        assert bytes(r.kept) == bytes(b for b, g in zip(texts[r.doc_id].encode(), gone[r.doc_id]) if not g)


def shared(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("width", [3, 8, 21, 64])
@pytest.mark.parametrize("letters", [b"ab", b"a", bytes(range(256)), b"\0\1"])
@pytest.mark.parametrize("side_by_side", [suffixes.SORTED, 5])
def test_previous_factors(monkeypatch, width, letters, side_by_side):
    """Suffix order, factor lengths and sources against every pair of windows."""
    monkeypatch.setattr(suffixes, "SORTED", side_by_side)
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(width, 150))) for _ in range(4)]
    texts.append(texts[1][1:] + texts[0] + b"x" * width)
    runs = [len(t) - width + 1 for t in texts]
    windows = [t[s : s + width] for t in texts for s in range(len(t) - width + 1)]
    starts = np.concatenate([np.arange(n) + sum(map(len, texts[:k])) for k, n in enumerate(runs)])
    order, common = suffixes.suffix_order(np.frombuffer(b"".join(texts), np.uint8), starts, width)
    assert order.tolist() == sorted(range(len(windows)), key=lambda k: (windows[k], k))
    assert common[1:].tolist() == [shared(windows[a], windows[b]) for a, b in zip(order[1:], order)]
    length, source = suffixes.previous_factors(width)(texts, runs)
    for k, window in enumerate(windows):
        assert length[k] == max((shared(window, w) for w in windows[:k]), default=0)
        if length[k]:
            assert source[k] < k and shared(window, windows[source[k]]) == length[k]


def test_symbols_inside_a_repeat_are_the_same():
    rnd = np.random.default_rng(2)
    shared = rnd.integers(0, 5, 60).astype(np.uint64)
    inside = []
    for _ in range(20):
        before, after = (rnd.integers(0, 5, rnd.integers(0, 30)).astype(np.uint64) for _ in "ab")
        symbols = recompress.Symbols(np.concatenate([before, shared, after]))
        symbols.round()
        symbols.round()
        lo, hi = len(before), len(before) + 60
        own = (symbols.low >= lo) & (symbols.high <= hi)
        inside.append({(int(a) - lo, int(b) - lo, int(n)) for a, b, n in zip(symbols.low[own], symbols.high[own], symbols.name[own])})
    assert inside[0] and all(x == inside[0] for x in inside)


def test_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(500)) + " end " + " ".join(f"v{i}" for i in range(300))
    monkeypatch.setattr(repeats, "PIECE", 64)
    method = recompress.method(20)
    from pyarrow import RecordBatch, array

    joined = list(repeats._batches(RecordBatch.from_arrays([array([text.encode()])], names=["t"]), method, 0))
    starts = np.concatenate([j.home(j.starts)[1] for j in joined])
    assert sorted(starts.tolist()) == list(range(len(text.split()) - 19))


@pytest.mark.parametrize("name", ["op3_recompression", "op9_suffixes"])
def test_whole_table(spark, name):
    rows = sorted(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    by_word = name.startswith("op3")
    letters = [words(t) if by_word else t.encode() for _, t in rows]
    gone = dict(zip([i for i, _ in rows], brute(letters, 20 if by_word else 400, by_word)))
    text = dict(zip([i for i, _ in rows], letters))
    for r in QUERIES[name](spark, SF_DIR).collect():
        left = [x for x, g in zip(text[r.doc_id], gone[r.doc_id]) if not g]
        assert r.kept_sha256 == hashlib.sha256(" ".join(left).encode() if by_word else bytes(left)).hexdigest()
        assert r.n_removed == sum(gone[r.doc_id])


def test_odd_rows(spark, odd):
    for f, size in ((recompress.remove_repeats, "n_words"), (suffixes.remove_repeats, "n_bytes")):
        rows = f(odd).collect()
        assert len(rows) == 9
        assert sum(r[size] == 0 for r in rows) == (3 if size == "n_words" else 2)
        assert [r.n_removed > 0 for r in rows if r.doc_id == 4] == [False, False]  # rows equal in id and text are one
        assert f(odd.limit(0)).count() == 0
    long = next(r for r in recompress.remove_repeats(odd).collect() if r.doc_id == 6)
    assert long.n_removed == 60_000 - 977 - 19 + 19
