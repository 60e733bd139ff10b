"""Substring deduplication by recompression.

Words are letters.  A round first names runs of one letter, then names pairs of a
left and a right letter, the sides being a bit of the letter's name.  A name is a
hash of what it stands for, so all tasks give equal strings equal names without a
dictionary, and inside a repeated string the symbols of every round are the same,
but for some at its ends.  Which symbols those are is kept with each symbol: the
words it depends on.

A window of 20 words is anchored at its highest symbol that depends on words of the
window alone (of several, the one of smallest name), keyed by those words.  Symbols
shared by two places reveal candidates, which are verified window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carryover.llm.repeats import Method, Rolling, Runs, U, byte_letters, covered, mix, runs_of, with_repeats

#: Words of a repeat.
WIDTH = 20
_PLACE = 22
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of bytes without ASCII white space."""
    change = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    return np.flatnonzero(change == -1), np.flatnonzero(change == 1)


def word_letters(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    return Rolling(byte_letters(raw)).of(start, end)


class Symbols:
    """Symbols of one round: names, and the letters [low, high) each depends on.

    A symbol at an end of the sequence depends on what is not there: -1, or past the end.
    """

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.name, self.low, self.high, self.size = letters, np.arange(n), np.arange(1, n + 1), n

    def round(self) -> None:
        self._runs()
        self._pairs()

    def _runs(self) -> None:
        """One symbol for each run of equal names; it depends on its neighbours, which differ."""
        first = np.flatnonzero(np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        last = np.concatenate([first[1:], [len(self.name)]]) - 1
        count = (last - first + 1).astype(U)
        name = self.name[first]
        before = np.concatenate([[-1], self.low])[first]
        after = np.concatenate([self.high, [self.size + 1]])[last + 1]
        self.name = np.where(count > 1, mix(name + mix(count)), name)
        self.low, self.high = np.minimum(self.low[first], before), np.maximum(self.high[last], after)

    def _pairs(self) -> None:
        """One symbol for each left name followed by a right one; what stays single depends on why."""
        left = mix(self.name) & U(1) == 0
        opens = np.concatenate([left[:-1] & ~left[1:], [False]])
        closes = np.concatenate([[False], opens[:-1]])
        after_low, after_high = np.concatenate([self.low[1:], [self.size]]), np.concatenate([self.high[1:], [self.size + 1]])
        before_low = np.concatenate([[-1], self.low[:-1]])
        low = np.where(~opens & ~left, np.minimum(self.low, before_low), np.minimum(self.low, np.where(opens, after_low, self.low)))
        high = np.where(opens | left, np.maximum(self.high, after_high), self.high)
        name = np.where(opens, mix(self.name * U(3) + mix(np.concatenate([self.name[1:], [U(0)]]))), self.name)
        stay = ~closes
        self.name, self.low, self.high = name[stay], low[stay], high[stay]


def anchored(width: int, rounds: int):
    def anchors(letters: np.ndarray, starts: np.ndarray) -> Runs:
        n = len(letters)
        hashes = Rolling(letters)
        best = np.full(n, np.iinfo(U).max, U)
        symbols, lows, highs = Symbols(letters), [], []
        for level in range(1, rounds + 1):
            symbols.round()
            fits = np.flatnonzero((symbols.low >= 0) & (symbols.high <= n) & (symbols.high - symbols.low <= width))
            low, high = symbols.low[fits], symbols.high[fits]
            rank = (U(rounds - level) << U(60)) | (symbols.name[fits] >> U(28) << U(_PLACE)) & U((1 << 60) - 1) | np.arange(len(fits), dtype=U)
            lows.append(low)
            highs.append(high)
            slack = width - (high - low)
            for back in range(int(slack.max(initial=-1)) + 1):
                some = (slack >= back) & (low >= back)
                np.minimum.at(best, low[some] - back, rank[some])
        chosen = best[starts]
        none = chosen == np.iinfo(U).max
        place = chosen.copy()
        place[none] = U(1 << 63) | starts[none].astype(U)
        key = np.empty(len(starts), U)
        key[none] = hashes.of(starts[none], starts[none] + width)
        level, index = (chosen >> U(60)).astype(np.int64), (chosen & U((1 << _PLACE) - 1)).astype(np.int64)
        for k in range(rounds):
            here = ~none & (level == rounds - 1 - k)
            key[here] = mix(hashes.of(lows[k][index[here]], highs[k][index[here]]) + U(k + 1))
        return runs_of(starts, place, key)

    return anchors


def method(width: int = WIDTH) -> Method:
    return Method(width, word_letters, anchored(width, max(1, min(7, width.bit_length() - 3))), True)


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_first: bool = True, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Remove every word of a window of ``width`` words that also starts earlier in the corpus.

    Words are what stands between ASCII white space, unchanged.  Earlier: a smaller
    doc_id (absent ones last), or the same document and an earlier start; rows equal in
    id and text are one document, and other rows of one id are ordered by a hash.
    Windows are judged on the input.  A null text has no words; a text of fewer words
    stays whole.  Without ``keep_first`` the first place goes as well.  Returns
    (doc_id, n_words, n_removed, kept), ``kept`` being the words left, joined by
    blanks, or with ``digest`` kept_sha256.
    """
    found = with_repeats(docs, method(width), keep_first, doc_id, text)
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, kept = [], [], []
            for own_id, value, owns, starts in zip(batch.column(0), *batch.columns[2:]):
                words = value.as_py().split()
                rest = words
                if starts.is_valid:
                    gone = covered(own_id.as_py(), owns.as_py(), starts.as_py(), width, len(words))
                    rest = [w for w, g in zip(words, gone.tolist()) if not g]
                size.append(len(words))
                removed.append(len(words) - len(rest))
                text_left = b" ".join(rest)
                kept.append(hashlib.sha256(text_left).hexdigest() if digest else text_left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", last],
            )

    own = docs.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {own}, n_words long, n_removed long, {last} string")
