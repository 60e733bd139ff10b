"""The pipeline: every stage on its own input, against what the stage's rule gives."""

from __future__ import annotations

from itertools import combinations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from carryover.llm import decontaminate, quality
from carryover.llm.common import keep, table
from carryover.llm.queries import TOKENIZER
from tests.conftest import SF_DIR
from tests.llm.test_decontaminate import distance
from tests.llm.test_near_duplicates import bits, joined
from tests.llm.test_secret_scan import spans


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF_DIR, "documents")
    out = [docs]
    for name, stage in p.STAGES:
        docs = keep(stage(spark, docs, SF_DIR), name)
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns(stages):
    assert all(list(d.columns) == p.COLUMNS for d in stages[:-1])
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_quality(spark, stages):
    machine = quality.train(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels"), held_out=quality.held_out())
    before = stages[0]
    scores = machine.score(quality.features(list(before.text), list(before.n_chars), quality.Buckets()))
    assert set(before.doc_id[scores >= 0.5]) == set(stages[1].doc_id) < set(before.doc_id)


def test_near_duplicates(stages):
    """The operator's rule: four-word shingles, links at four bits, one document a component."""
    prints = {i: bits(t) for i, t in zip(stages[1].doc_id, stages[1].text)}
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert near and set(stages[2].doc_id) == set(joined(prints, near).values())


def test_decontamination(spark, stages):
    items = [decontaminate.normal(r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    left = set(stages[3].doc_id)
    for i, text in zip(stages[2].doc_id, stages[2].text):
        if any(t in decontaminate.normal(text) for t in items):
            assert i not in left
    for i, text in zip(stages[2].doc_id, stages[2].text):
        if i not in left:
            body = decontaminate.normal(text)
            assert any(t in body or distance(t, body) <= decontaminate.budget(len(t)) for t in items)


def test_secrets(stages):
    before, after = (dict(zip(d.doc_id, d.text)) for d in stages[3:5])
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i] == text) == (not spans(text))
        assert not [s for s in spans(after[i]) if "[SECRET]" not in after[i][s[0] : s[2] + 8]]


def test_tokens(stages):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    texts = dict(zip(stages[4].doc_id, stages[4].text))
    for i, ids in zip(stages[5].doc_id, stages[5].token_ids):
        assert list(ids) == library.encode(texts[i], add_special_tokens=False).ids


def test_run(spark, stages):
    assert {r.doc_id for r in p.run(spark, SF_DIR).select("doc_id").collect()} == set(stages[5].doc_id)


@pytest.mark.parametrize("stage", p.STAGES, ids=[n for n, _ in p.STAGES])
def test_odd_rows_and_empty_tables(spark, odd, stage):
    """Null, empty, blank and very long texts, absent and repeated ids, clashing extra columns."""
    name, function = stage
    got = function(spark, odd, SF_DIR)
    if name != "tokens":
        assert got.columns == p.COLUMNS
    rows = got.collect()
    assert len(rows) <= odd.count()
    if name in ("secrets", "tokens"):
        assert len(rows) == odd.count()
    if name == "secrets":
        before = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
        assert sorted((r.doc_id or 0, r.text or "") for r in rows) == before
    if name == "decontamination":
        assert len(rows) == odd.count(), "no odd row holds an item"
    assert function(spark, odd.limit(0), SF_DIR).count() == 0
