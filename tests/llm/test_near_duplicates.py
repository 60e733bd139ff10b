"""SimHash and vectors against all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from carryover.llm import simhash, vectors
from carryover.llm.common import components
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR


def joined(nodes, pairs) -> dict:
    """Smallest reachable node of each."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    real = [(a, b) for a, b in pairs if a != b]
    got = {r.node: r.component for r in components(df).collect()}
    assert got == joined({x for p in real for x in p}, real)
    assert components(df.limit(0)).count() == 0


def bits(text: str | None, k: int = 4) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_any_four_positions_hold_a_triple():
    assert len(simhash.triples()) == 20
    assert all(any(set(t) <= set(four) for t in simhash.triples()) for four in combinations(range(8), 4))


def test_fingerprints_of_the_whole_table(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    rows = QUERIES["op8_simhash"](spark, SF_DIR).collect()
    prints = {i: bits(t) for i, t in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    near = [(a, b) for a, b in combinations(sorted(docs), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in rows} == joined(docs, near)


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_links_join_what_is_near(spark, monkeypatch, block):
    """Dense groups of fingerprints, with lists of one block and of many."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = set()
    for _ in range(400):
        f = rnd.choice(centres)
        for _ in range(rnd.randint(0, 9)):
            f ^= 1 << rnd.randrange(64)
        prints.add(f - (1 << 64) if f >> 63 else f)
    nodes = spark.createDataFrame([(f, f) for f in prints], "fp long, node long")
    links = [(r.a, r.b) for r in simhash.links(nodes).collect()]
    near = [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in links)
    assert joined(prints, links) == joined(prints, near)


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    of = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert of[1, "0" * 16] == of[2, "0" * 16] == of[3, "0" * 16] == 1
    assert sum(r.component_id is None for r in rows) == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted({(r.doc_id or 0, r.text or "") for r in odd.collect() if r.doc_id not in (2, 3)})
    assert kept[0]["_h"] == "kept" and simhash.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_component(spark):
    """Of every component by shingles of four words and four bits the smallest id stays."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    texts = {}
    for g in range(80):
        base = [word() for _ in range(300)]
        texts[10 * g + 5] = base
        for c in range(1, 4):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = word()
            texts[10 * g + c] = copy
    texts = {i: " ".join(w) for i, w in texts.items()}
    prints = {i: bits(t) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    rows = [(i, t) for i, t in texts.items()] * 2 + [(1, "another text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_carryover", F.lit(1)).repartition(5)
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(i, texts[i]) for i in set(joined(texts, near).values())] + [(1, rows[-1][1])])
    assert simhash.one_of_each(df).columns == df.columns


def test_vectors_of_the_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = np.triu(x @ x.T >= 0.9, 1)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))]
    got = {r.vec_id: r for r in QUERIES["op7_vectors"](spark, SF_DIR).collect()}
    links = {i: sum(i in p for p in pairs) for i in ids}
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values()) and all(got[i].n_links <= n for i, n in links.items())
    assert {i: r.component_id for i, r in got.items()} == joined(ids, pairs)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("exact", [False, True])
def test_recall_over_many_lists(spark, monkeypatch, exact):
    monkeypatch.setattr(vectors, "LIST_ROWS", 16)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base[rng.integers(0, 40, 500)] + rng.normal(size=(500, 24)) * rng.uniform(0.05, 0.5, (500, 1)), base[:5], base[:5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = vectors.near_duplicates(df, exact=exact).collect()
    found = np.array([r.n_links for r in sorted(rows, key=lambda r: r.vec_id)])
    assert (found <= near.sum(1)).all()
    assert found.sum() >= (near.sum() if exact else 0.9 * near.sum())


def test_query_links_vectors_of_few_directions(spark, tmp_path):
    """Steps that stay in few of the dimensions go further towards other centres."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(600, 6)), 4, 0)
    x = (x + rng.normal(size=x.shape) * 0.15) @ rng.normal(size=(6, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = QUERIES["op7_vectors"](spark, str(tmp_path)).collect()
    assert [r.n_links for r in sorted(rows, key=lambda r: r.vec_id)] == near.sum(1).tolist()


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.01]), (9, [1.0]), (10, [0.0, 1e-300])]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id long, embedding array<double>, node string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()]
    for i in (1, 2, 3, 4, 5, 6, 9, 10):
        assert (i, 0, i, True) in got
    assert (7, 3, 7, True) in got and got.count((8, 3, 7, False)) == 2 and (None, 3, 7, False) in got and len(got) == len(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def spectrum(kind: str, rng) -> np.ndarray:
    """Groups of four near vectors: in all directions, in six, of falling scale, or with steps in three directions only."""
    base = np.repeat(rng.normal(size=(1000, 6 if kind == "rank 6" else 64)), 4, 0)
    if kind == "three":
        return base + (rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 64))) * rng.uniform(0.02, 0.3, (4000, 1))
    x = base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.45, (4000, 1))
    return x @ rng.normal(size=(6, 64)) if kind == "rank 6" else x / np.arange(1, 65) if kind == "1/k" else x


@pytest.mark.parametrize("kind", ["isotropic", "rank 6", "1/k", "three"])
def test_recall_of_sufficient_probes(kind):
    """Nearly every link is in a probed list, whatever the directions of the vectors and of their steps."""
    rng = np.random.default_rng(3)
    x = vectors._unit(spectrum(kind, rng))
    q = vectors.fit(x[rng.permutation(len(x))[:2500]], 60, 0.9)
    at = q.lists(x)
    probed = q.probes(x, at, np.sqrt(0.2))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    early = np.where(at[a] <= at[b], a, b)
    assert len(a) > 1000 and probed[early, np.maximum(at[a], at[b])].mean() >= 0.99
    assert (q.probes(x, at, np.sqrt(0.2), exact=True) >= probed).all()
    if kind == "isotropic":
        assert probed.sum() < 0.4 * q.probes(x, at, np.sqrt(0.2), exact=True).sum()
