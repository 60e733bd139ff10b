"""BPE encoding and decoding with an automaton compiled from the merges.

The automaton reads tokens.  It starts with one state that reads every base
symbol and is changed by one *merge gadget* per merge (u, v), in order of rank:
the state reached by u is replaced by a copy that cannot read v, and wherever u
could be read an arc uv is added that leads where v leads.  What it accepts after
all gadgets is exactly the encodings: one token sequence per word.

States are kept as what the gadgets did to them.  The state after token u is the
list of owners whose gadgets cut it (u itself, and the right parts of u up to the
rank that merged them); an arc t is open there unless one of its left parts was
cut before it was merged into t.  So a gadget costs a constant, and the table of
48,894 merges is compiled in well under a second.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = 1 << 60
#: White space as the Unicode property has it, which \s of the pattern means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = regex.compile(f"[^{WHITE}]+")
#: Separators that str.split() takes for white space although the property does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Entries of one generation of a worker's tables of words; of chunks with their strings, which
#: only digests fill; and of (state, arc) pairs.
CACHE, STRINGS, OPEN = 100_000, 250_000, 400_000
#: Rows whose ids a task holds before it sends them on.
ROWS = 500


class Recent:
    """A table of bounded size: two generations, the older one dropped when the newer fills."""

    def __init__(self, size: int = CACHE):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges over words in which every letter is one base symbol.

    A state is the last token read.  Its arcs are the tokens that may follow it; which
    tokens stand at a place of a word is read from one flat table of transitions by
    (node, letter), and which of them a state has from a flat table by (state, arc),
    filled from what the gadgets cut as states and arcs are met.
    """

    #: Letters of the table of transitions: a byte, and 256 more where a word ends.
    LETTERS = 512

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.arcs = vocab
        self.names = list(vocab)
        self.ids = list(vocab.values())
        self.sizes = list(map(len, self.names))
        self.step: dict[int, int] = {}
        self.at: list[int] = [-1]
        for arc, token in enumerate(self.names):
            node = 0
            for letter in token:
                node = self._node(node * self.LETTERS + ord(letter))
            self.at[node] = arc
        self.cut: dict[tuple[str, str], int] = {}
        self.after: dict[str, tuple] = {}
        self.left: dict[str, tuple] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, u, v)
        self.open: dict[int, bool] = {}

    def _node(self, way: int) -> int:
        if way not in self.step:
            self.step[way] = len(self.at)
            self.at.append(-1)
        return self.step[way]

    def _state(self, token: str) -> tuple:
        return self.after.get(token, ((token, NEVER),))

    def _parts(self, token: str) -> tuple:
        return self.left.get(token, ((token, NEVER),))

    def _gadget(self, rank: int, u: str, v: str) -> None:
        self.cut[u, v] = rank
        (_, _), *beyond = self._state(v)
        self.after[u + v] = ((u + v, NEVER), (v, rank), *beyond)
        (_, _), *before = self._parts(u)
        self.left[u + v] = ((u + v, NEVER), (u, rank), *before)

    def reads(self, state: int, arc: int) -> bool:
        """True when the state after token ``state`` has the arc ``arc``."""
        key = state * len(self.names) + arc
        known = self.open.get(key)
        if known is None:
            parts = self._parts(self.names[arc])
            known = not any(
                (rank := self.cut.get((owner, part))) is not None and rank < until and rank <= merged
                for owner, until in self._state(self.names[state])
                for part, merged in parts
            )
            if len(self.open) > OPEN:
                self.open.clear()
            self.open[key] = known
        return known

    def _standing(self, letters: list[int], i: int) -> list[int]:
        """Arcs that stand at place ``i``, shortest first."""
        step, at, node, found = self.step.get, self.at, 0, []
        for letter in letters[i:]:
            node = step(node * 512 + letter)
            if node is None:
                break
            if at[node] >= 0:
                found.append(at[node])
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of the one accepted path over ``word``, one base symbol per letter.

        The longest open arc is followed; where none is left the walk steps back,
        and a position once found without a way to the end is not entered again.
        A prefix has one accepted path, so which arcs led there does not matter.
        """
        sizes, known, many, n = self.sizes, self.open.get, len(self.names), len(word)
        letters = list(map(ord, word))
        standing: dict[int, list[int]] = {}
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        i, state, most = 0, -1, n
        while i < n:
            found = standing.get(i)
            if found is None:
                found = standing[i] = self._standing(letters, i)
            for arc in reversed(found):
                size = sizes[arc]
                if size > most or i + size in dead:
                    continue
                if state >= 0:
                    fits = known(state * many + arc)
                    if not (self.reads(state, arc) if fits is None else fits):
                        continue
                path.append(arc)
                i += size
                ends.append(i)
                state, most = arc, n
                break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a base symbol")
                dead.add(i)
                most = sizes[path.pop()] - 1
                ends.pop()
                i = ends[-1] if ends else 0
                state = path[-1] if path else -1
        ids = self.ids
        return [ids[arc] for arc in path]


class Codec:
    """Text to ids and back for a vocabulary file with word ends, by the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        byte_of = {letter: chr(b) for b, letter in byte_letters().items()}

        def symbols(token: str) -> str:
            """One letter a byte; the last one moved up by 256 where a word ends."""
            body = "".join(byte_of[c] for c in token.removesuffix(suffix))
            return body[:-1] + chr(ord(body[-1]) + 256) if token.endswith(suffix) else body

        ids = model["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.automaton = Automaton(
            {symbols(t): i for t, i in ids.items() if t not in special}, [(symbols(u), symbols(v)) for u, v in model["merges"]]
        )
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in (ids | self.special).items()}
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.seen = Recent(STRINGS)
        self.known = Recent()

    def _word(self, word: str) -> list[int]:
        known = self.known.get(word)
        if known is None:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1")
            known = self.automaton.encode(letters[:-1] + chr(ord(letters[-1]) + 256))
            if len(word) <= 64:
                self.known.put(word, known)
        return known

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        if text.isalpha():
            return self._word(text)
        return [i for word in self.words.findall(text) for i in self._word(word)]

    def _piece(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, decimal ids and arc labels of a chunk, remembered."""
        ids = self._chunk(chunk)
        out = len(ids), " ".join(map(str, ids)), " ".join([self.labels[i] for i in ids])
        if len(chunk) <= 64:
            self.seen.put(chunk, out)
        return out

    def _spans(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens, and their ids where they stand."""
        at = 0
        if "<|" in text:
            for m in self.find_special.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    @staticmethod
    def _split(text: str) -> list[str]:
        return CHUNK.findall(text) if ODD_SPACE.search(text) else text.split()

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        out = []
        for plain, special in self._spans(text):
            new = self.seen.new.get
            for c in self._split(plain):
                p = new(c) or self.seen.get(c)
                if p is None:
                    p = self._piece(c)
                    new = self.seen.new.get
                if p[0]:
                    out.append(p)
            if special is not None:
                out.append((1, str(special), self.labels[special]))
        return out

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for plain, special in self._spans(text or ""):
            for c in self._split(plain):
                ids += self._chunk(c)
            if special is not None:
                ids.append(special)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The arc labels joined by blanks; the file names no decoder. Unknown ids are left out."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a worker, compiled once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in a new column ``ids``.

    A null or empty text has no tokens; the other columns are kept as they are,
    and a column already named ``ids`` is replaced.  Repeated rows stay repeated.
    """

    rest = docs.drop(ids)
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for n in range(0, batch.num_rows, ROWS):
                part = batch.slice(n, ROWS)
                coded = pa.array([c.encode(value.as_py()) for value in part.column(at)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, coded], names=[*part.schema.names, ids])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the decoded text of a column of ids; null ids decode to the empty text."""

    @F.pandas_udf(T.StringType())
    def run(column):
        c = codec(path)
        return column.map(lambda v: c.decode([] if v is None else list(v)))

    return rows.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of tokens, and digests of the ids and of the decoded text.

    The same codec as :func:`encode` and :func:`decode`; each chunk between white
    space is encoded and decoded once per worker and its strings are then reused,
    so neither ids nor decoded texts leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for value in batch.column(1):
                pieces = c.pieces(value.as_py() or "")
                n.append(sum([p[0] for p in pieces]))
                of_ids.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join([p[2] for p in pieces]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
