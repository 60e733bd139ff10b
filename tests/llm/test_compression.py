"""Compression bands: base figures against plain Python, limits by length, kept and rejected texts."""

from __future__ import annotations

import base64
import random
import re

import pytest
import zstandard

from carryover.llm import compression as c
from carryover.llm.common import table
from carryover.llm.queries import QUERIES
from tests.conftest import SF_DIR

WORD = re.compile("[^\x20\x09-\x0d]+")


def want(text):
    text = text or ""
    words = WORD.findall(text)
    lines, again, seen = text.split("\n"), 0, []
    for line in lines:
        again += bool(WORD.search(line)) and line in seen
        seen.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    symbols = sum(text.count(s) for s in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, again, covered


def check(row, text):
    n, chars, symbols, again, covered = want(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (n, chars, symbols, again)
    if covered is not None:
        assert row.n_repeat_words == len(covered)
    assert row.base_failed == (n < 50 or 100 * row.n_repeat_words > 50 * n)
    assert not (row.base_failed and row.kept)


def test_whole_table(spark):
    texts = {x.doc_id: x.text for x in table(spark, SF_DIR, "documents").collect()}
    rows = QUERIES["op13_compression"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check(row, texts[row.doc_id])
    labels = {x.doc_id: x.quality for x in table(spark, SF_DIR, "labels").collect()}
    good = [x.kept for x in rows if labels.get(x.doc_id) == 1 and not x.base_failed]
    assert all(good)


def test_odd_rows(spark, odd):
    rows = c.judge(odd.withColumn("kept", odd["text"])).collect()
    by = {}
    for x in odd.collect():
        by.setdefault(x.doc_id, []).append(x.text)
    assert len(rows) == 9
    for row in rows:
        if row.doc_id != 5:
            check(row, by[row.doc_id][0])
    assert [x.kept for x in rows if x.doc_id in (1, 2, 3)] == [False] * 3
    assert c.judge(odd.limit(0)).count() == 0
    kept = c.keep_prose(odd)
    assert kept.columns == odd.columns and kept.count() == sum(x.kept for x in rows)


@pytest.mark.parametrize(("words", "covered"), [("a b c a b c", 6), ("a a a a", 4), ("a b c d a b c", 6), ("a b a b a", 5), ("x a b c y a b c z", 6), ("a b", 0), ("", 0)])
def test_repeated_words(words, covered):
    assert c.repeated_words(words.split()) == covered


def test_limits_fall_with_length_and_are_interpolated():
    b = c.Bands()
    lows, highs = zip(*(b.of(1 << k) for k in range(0, 24)))
    assert list(lows) == sorted(lows, reverse=True) and list(highs) == sorted(highs, reverse=True)
    for size, low, high in b.limits:
        assert b.of(size) == pytest.approx((low, high))
    assert b.of(1) == b.limits[0][1:] and b.of(1 << 40) == b.limits[-1][1:]
    assert b.of(512) == pytest.approx(((0.35 + 0.26) / 2, (1.00 + 0.76) / 2))


def prose(n, seed=0):
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "son", "der", "la", "ing", "to", "ver", "ca", "ne", "lo", "pre", "sti", "un", "o", "ma", "ti", "gra", "be"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(4000)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def kept(text, bands=c.Bands()):
    return c.measure(text.encode(), bands, zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False))[-1]


def test_prose_repetition_and_noise():
    rng = random.Random(5)
    for n in (50, 200, 1000, 20_000):
        assert kept(prose(n)), n
        noise = base64.b64encode(rng.randbytes(n * 6)).decode()
        assert not kept(noise) or n == 50, n
        assert not kept((prose(12) + "\n") * (n // 4)), n


def test_chunks_catch_what_the_whole_hides():
    """Half prose, half noise: the whole ratio is in its band, the chunks are not."""
    noise = base64.b85encode(random.Random(1).randbytes(40_000)).decode()
    text = prose(6000) + " " + noise
    assert not kept(text)
    assert kept(text, c.Bands(bad_share=1.0, limits=((1, 0.0, 0.75),)))
    tail = prose(20_000) + " " + noise[:2000]
    assert kept(tail)
