"""Held-out accuracy, the identity of the machine, lattices, and odd rows."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from carryover.llm import quality, toxicity
from carryover.llm.common import table
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR

LARGER = "/root/testdata/sf0.1"


def judged(spark, name: str, label: str, sf_dir: str):
    rows = QUERIES[name](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where(F.col("held_out")).toPandas()
    score, truth = rows["score"].to_numpy(), rows[label].to_numpy()
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = truth.sum()
    area = (rank[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))
    return area, (rows["predicted"] == truth).mean(), rows


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.93), ("op6_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    area, right, rows = judged(spark, name, label, LARGER)
    assert area > least and right > 0.95
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()


@pytest.mark.parametrize("name, modulus, rest", [("op4_toxicity", 5, 0), ("op6_quality", 3, 1)])
def test_folds_and_every_row(spark, name, modulus, rest):
    import zlib

    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)


def test_linear_time_identity():
    rng = np.random.default_rng(4)
    size = quality.BUCKETS + len(quality.STATISTICS)
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    rows = quality.features(["one two two three", "", None, "A b!"], [None, 0.0, None, 9.0], quality.Buckets())
    for i, margin in enumerate(m.margin(rows)):
        part = slice(rows.start[i], rows.start[i + 1])
        at = [*rows.index[part].tolist(), *range(quality.BUCKETS, size)]
        x = [*rows.value[part].tolist(), *m.scaled(rows)[i].tolist()]
        pairs = sum(m.factor[a] @ m.factor[b] * p * q for (a, p), (b, q) in itertools.combinations(list(zip(at, x)), 2))
        assert margin == pytest.approx(0.3 + sum(m.weight[a] * p for a, p in zip(at, x)) + pairs, rel=1e-4)


def test_scores_of_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    machine = quality.train(odd, labels)
    scored = quality.score(odd, machine).collect()
    assert len(scored) == 9 and all(0 <= r.score <= 1 and r.spans == "kept" for r in scored)
    assert quality.score(odd.limit(0), machine).count() == 0
    assert quality.train(odd.limit(0), labels).score(quality.features([""], [None], quality.Buckets()))[0] == 0.5
    model = toxicity.language_model(odd)
    rated = toxicity.score(odd, model, toxicity.train(odd, labels, model)).collect()
    assert len(rated) == 9 and all(0 <= r.score <= 1 and r.spans == "kept" for r in rated)
    empty = toxicity.language_model(odd.limit(0))
    assert np.isfinite(empty).all()
    none = toxicity.train(odd, labels.limit(0), model)
    assert toxicity.score(odd, model, none).select("score").distinct().count() == 1
    assert toxicity.restore(odd, model).where("restored is null").count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.language_model(table(spark, LARGER, "documents"))


@pytest.mark.parametrize("hidden", ["1d10t", "i.d.i.o.t", "iiidiiiot", "idi0t", "1diot"])
def test_hidden_words(model, hidden):
    assert "idiot" in toxicity.Restorer(model).evidence(f"such an {hidden} here")


def test_spaced_words_and_plain_ones(model):
    r = toxicity.Restorer(model)
    assert "clown" in r.evidence("what a c l o w n he is")
    for token, want in [("the&&&", "the"), ("a$$$", "a"), ("worthless!", "worthless"), ("c1own", "clown"), ("réeuxpa", "réeuxpa")]:
        assert r.token(token) == want


def test_long_tokens_and_long_runs_of_letters(model):
    r = toxicity.Restorer(model)
    token = "you_are_a_complete_1d10t_and_everyone_hates_you"
    assert len(token) == 47 and r.token(token).isalpha() and r.token(token).endswith("andeveryonehatesyou")
    assert {"idiot", "complete", "hates"} <= r.evidence(f"they wrote {token} again")
    said = "i think that you are a stupid liar and a clown so everyone here should hate you and all your works until the end"
    letters = said.replace(" ", "")
    assert len(letters) > 85 and r.token(" ".join(letters)[:5]) is not None
    assert "".join(r.words(" ".join(letters))[len(letters) :]) == letters
    # nothing is cut: the last word of a run is read as after a short one
    assert r.text("x " * 50_000).count("x") >= 50_000


def test_settled_beginnings_are_those_of_the_whole_search(model, monkeypatch):
    tokens = ["a-complete_1d10t.and_every0ne*h4tes-you" * n for n in (1, 2, 5)] + ["wwwoooorrrthlesss" * 8, "s p o k e n " * 9 + "e"]
    quick = [toxicity.readings(t, model)[0] for t in tokens]
    monkeypatch.setattr(toxicity, "LAG", 10**9)
    assert quick == [toxicity.readings(t, model)[0] for t in tokens]


def test_viterbi_against_every_path(model):
    for token in ("1d10t", "s-c-u-m", "aaab", "t0*y"):
        paths = {}
        for arcs in itertools.product(*toxicity.lattice(token)):
            read = "".join(a for a, _ in arcs)
            codes = [0, 0, *map(toxicity._class, read), 0]
            cost = sum(c for _, c in arcs) + sum(model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            paths[read] = min(cost, paths.get(read, np.inf))
        assert toxicity.readings(token, model)[0] == min(paths, key=paths.get)


def test_language_model_counts_every_text(spark, odd):
    texts = [r.text.encode() for r in odd.where("text is not null").collect()]
    whole = sum(toxicity.trigrams([t]) for t in texts)
    assert np.allclose(toxicity.smoothed(whole.astype(float)), toxicity.language_model(odd))


def test_readings_outlast_full_tables(monkeypatch):
    """A text's further readings do not depend on how much was seen before it or in it."""
    model = np.zeros((32, 32, 32))
    text = "k1ck h3l1o " + " ".join(f"word{chr(97 + k)}" for k in range(20))
    whole = toxicity.Restorer(model).evidence(text)
    assert whole > set(toxicity.Restorer(model).words(text))
    monkeypatch.setattr(toxicity, "KEPT", 5)
    small = toxicity.Restorer(model)
    assert all(small.evidence(text) == whole for _ in range(3))
