"""BPE against the tokenizers library, the gadgets against plain merging, and round trips."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from tokenizers import Tokenizer

from carryover.llm import tokens
from carryover.llm.queries import QUERIES, TOKENIZER
from tests.conftest import SF_DIR

ODD = [
    "", " ", "aaaaaaaaaaaaaaaaaaa aaaa aaaaa", "Σίσυφος ΣΑΣ İstanbul", "<|endoftext|>a<|startoftext|> b<|endoftext", "x\x1cy\x1fz\x85q r",
    "I'll don't he'd we've THEY'RE 's", "é ́a", "Åﬁ ½²", "日本語テキスト 漢字", "🙂🙂👩‍👩‍👧", "1234567 3.14", "​ zero​width",
    "&&&&&&!!!***###" * 300, "q" * 3000,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def test_as_the_library(library):
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF_DIR}/documents.parquet'").fetchall()]
    c = tokens.codec(TOKENIZER)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = c.encode(text)
        assert ids == want.ids
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def plain(word: str, merges: list[tuple[str, str]]) -> list[str]:
    parts, rank = list(word), {m: k for k, m in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


@pytest.mark.parametrize("seed", range(30))
def test_gadgets_accept_what_merging_gives(seed):
    rnd = random.Random(seed)
    vocab, merges = ["a", "b", "c"], []
    for _ in range(12):
        pair = rnd.choice(vocab), rnd.choice(vocab)
        if "".join(pair) not in vocab and len(plain("".join(pair), merges)) == 2 and tuple(plain("".join(pair), merges)) == pair:
            merges.append(pair)
            vocab.append("".join(pair))
    automaton = tokens.Automaton({v: k for k, v in enumerate(vocab)}, merges)
    for _ in range(200):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        assert [vocab[i] for i in automaton.encode(word)] == plain(word, merges)


def test_whole_table(spark, library):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    for r in QUERIES["op2_bpe"](spark, SF_DIR).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark, odd, library):
    coded = tokens.encode(odd, TOKENIZER)
    back = tokens.decode(coded, TOKENIZER).collect()
    assert len(back) == 9 and back[0]["score"] == "kept"
    for r in back:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.token_ids, skip_special_tokens=False)
    assert tokens.digests(odd, TOKENIZER).count() == 9
    assert tokens.digests(odd.limit(0), TOKENIZER).count() == 0
