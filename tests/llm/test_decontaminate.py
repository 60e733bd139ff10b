"""Decontamination against dynamic programming over all documents and items."""

from __future__ import annotations

import random

import duckdb
import pytest

from carryover.llm import decontaminate as d
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR


def distance(item: str, text: str) -> int:
    """Smallest edit distance of the item to a substring, by the table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(300):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))
        assert d.myers(d.letters(item), len(item), text)[0] == distance(item, text)


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.2])
def test_against_the_table(rate):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6)))
    items = [" ".join(word() for _ in range(rnd.randint(3, 12))) for _ in range(12)]
    texts = []
    for _ in range(60):
        passage = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(passage))
            passage[k] = rnd.choice(["", "x", passage[k] + "y"])
        texts.append(" ".join(word() for _ in range(9)) + " " + "".join(passage) + " " + word())
    matcher = d.Matcher(list(enumerate(items)), rate)
    for text in map(d.normal, texts):
        found = {(i, k) for i, k, _ in matcher.search(text)}
        want = {(i, distance(t, text)) for i, t in enumerate(items) if distance(t, text) <= d.budget(len(t), rate)}
        assert found == want


def test_pieces_cover_an_item():
    for length in (1, 5, 37, 240):
        item = "".join(chr(97 + i % 26) for i in range(length))
        for edits in (0, 3, 19):
            assert "".join(p for _, p in d.pieces(item, edits)) == item


def test_whole_table(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall())
    rows = QUERIES["op1_decontamination"](spark, SF_DIR).collect()
    exact = {(i, k) for i, t in docs.items() for k, p in items.items() if d.normal(p) in d.normal(t)}
    assert exact and exact == {(r.doc_id, r.item_id) for r in rows if r.distance == 0}
    for r in rows:
        assert distance(d.normal(items[r.item_id]), d.normal(docs[r.doc_id])[: r.match_end]) == r.distance


def test_odd_rows_and_blocks(spark, odd, monkeypatch):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (None, "the same ROW twice\nover and over again"), (3, "two texts")], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in d.matches(odd, benchmark).collect()}
    assert hits == {(4, None), (5, 3)}
    assert d.matches(odd, benchmark).count() == 3
    assert d.clean(odd, benchmark).count() == 6 and d.clean(odd, benchmark).columns == odd.columns
    assert d.matches(odd.limit(0), benchmark).count() == 0
    assert d.matches(odd, benchmark.limit(0)).count() == 0
    monkeypatch.setattr(d, "BLOCK_ITEMS", 1)
    assert len(list(d.blocks(benchmark, "item_id", "text"))) > 1
    assert {(r.doc_id, r.item_id) for r in d.matches(odd, benchmark).collect()} == hits
    assert d.clean(odd, benchmark).count() == 6
