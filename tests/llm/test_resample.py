"""Importance resampling: interning, gains, weights and the draw against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from carryover.llm import resample as r
from carryover.llm.common import table
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def want(docs, target):
    """docs: (id, text); every row as (id, n_features, weight, score, rank)."""
    s = Counter(bucket(g) for _, t in docs for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, g = grams(text)
        weight = sum(gain[bucket(x)] for x in g)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((x for x in rows if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for x in rows:
        x.append(None)
    for k, x in enumerate(able[: 5 * len(able) // 100], 1):
        x[5] = k
    return sorted(((x[0], x[1], x[2], x[3], x[5]) for x in rows), key=str)


def got(df):
    return sorted(((x.doc_id, x.n_features, x.weight, x.score, x.rank) for x in df.collect()), key=str)


def test_hash_equals_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    for size in [*range(1, 70), 127, 128, 256, 257, 400]:
        start = rng.integers(0, 3000, 20)
        assert r.crc32_of(data, start, np.full(20, size)).tolist() == [zlib.crc32(data[a : a + size]) for a in start]
        assert r.xxhash64_of(data, start, size).tolist() == [xxhash.xxh64_intdigest(bytes(data[a : a + size])) for a in start]


@pytest.mark.parametrize("keys", ["real", "one"])
def test_interning_compares_bytes(monkeypatch, keys):
    """With every key alike the bytes alone must tell n-grams apart."""
    if keys == "one":
        monkeypatch.setattr(r.Interned, "_keys", staticmethod(lambda d, s, z: np.zeros(len(s), np.uint64)))
    words = [b"a", b"b", b"a", b"ab", b"abcdefgh", b"abcdefgi", b"abcdefghi", b"x" * 300, b"x" * 299 + b"y", b"x" * 300, b"a"]
    data = np.frombuffer(b" ".join(words) + b" " * 9, np.uint8)
    size = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    i = r.Interned(data, start, size)
    held = {}
    for w, slot in zip(words, i.slots.tolist()):
        assert held.setdefault(slot, w) == w
    assert len(held) == len(set(words)) and i.count[i.slots].tolist() == [words.count(w) for w in words]
    assert i.bucket[i.slots].tolist() == [zlib.crc32(w) % 10000 for w in words]


def test_blocks_of_any_size(monkeypatch):
    texts = ["one two three four five six", "", "solo", "ÉA é9b x" * 7, "a b c a b c a b c"]
    monkeypatch.setattr(r, "BLOCK_BYTES", 1 << 21)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(r, "BLOCK_WORDS", size)
        seen: dict[int, Counter] = {k: Counter() for k in range(len(texts))}

        def add(block, owner, seen=seen):
            for text, slot in zip(owner.tolist(), block.slots.tolist()):
                seen[text][int(block.bucket[slot])] += 1

        blocks = r.Blocks(add)
        for k, t in enumerate(texts):
            blocks.add(k, r.words_of(t.encode()))
        blocks.flush()
        assert seen == {k: Counter(map(bucket, grams(t)[1])) for k, t in enumerate(texts)}


def test_odd_rows(spark, odd):
    docs = [(x.doc_id, x.text) for x in odd.collect()]
    target = ["the same row twice", None, "", "W7 w8 w9 words beyond\tÄSCII ünd 123"]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    assert got(r.resample(odd, goal)) == want(docs, target)
    assert got(r.resample(odd, goal.limit(0))) == want(docs, [])
    assert r.resample(odd.limit(0), goal).count() == 0


def test_draw_breaks_ties_and_numbers_across_ranges(spark):
    rows = [(i, 20 + i % 3, 1, 0, (i * 7919) % 13) for i in range(2000)] + [(None, 50, 1, 0, 12), (7, 50, 1, 0, 12), (8, 19, 1, 0, 99)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(5)
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for share in (0, 5, 100):
        n = share * len(able) // 100
        drawn = [x for x in r.draw(df, share).collect() if x["rank"] is not None]
        drawn.sort(key=lambda x: x["rank"])
        assert [x["rank"] for x in drawn] == list(range(1, n + 1))
        assert [(x.score, x.doc_id) for x in drawn] == [(x[4], x[0]) for x in able[:n]]


def test_selected_keeps_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    some = r.selected(docs, table(spark, SF_DIR, "benchmark"))
    assert some.columns == docs.columns
    assert {x.doc_id for x in some.collect()} == {x[0] for x in want_sf() if x[4]}


def want_sf():
    import pyarrow.parquet as pq

    d = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    t = pq.read_table(f"{SF_DIR}/benchmark.parquet", columns=["text"]).to_pydict()
    return want(list(zip(d["doc_id"], d["text"])), t["text"])


def test_whole_table(spark):
    assert got(QUERIES["op12_resampling"](spark, SF_DIR)) == want_sf()
