"""Quality rules: compression bands.

Prose compresses to a narrow band of ratios at each length.  Text that repeats itself
falls below the band, encoded or random text lies above it.  The ratio of compressed
to plain bytes is taken with Zstandard over the whole document, and over each of its
fixed chunks on its own, and is held against limits that depend on the number of
bytes compressed: a short text has little to refer back to, so both limits fall as
texts grow.  Between the lengths of the table the limits are interpolated over the
logarithm of the length.

One pass over the rows, no shuffle; a task holds one document besides its batch.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WORD = re.compile("[^\x20\x09-\x0d]+")
NOT_SYMBOL = re.compile(f"[^{re.escape(SYMBOLS)}]+")


@dataclass(frozen=True)
class Bands:
    """Limits of the compression rule.

    The least ratios are about half of what prose in European languages has at a length,
    the largest ones half again as much; base64 and random letters lie above them from
    about a thousand bytes on.

    ``limits`` holds (bytes, least ratio, largest ratio) by rising length; shorter and
    longer texts take the limits of the first and last entry.  A document is rejected
    when its own ratio leaves its band, or when chunks outside the band of their length
    hold more than ``bad_share`` of its bytes.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (64, 0.55, 1.40),
        (256, 0.35, 1.00),
        (1 << 10, 0.26, 0.76),
        (1 << 12, 0.20, 0.68),
        (1 << 14, 0.17, 0.64),
        (1 << 17, 0.14, 0.62),
    )
    chunk_bytes: int = 1 << 12
    bad_share: float = 0.5
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        """The least and largest ratio of a text of ``size`` bytes."""
        at = bisect_right(self.limits, size, key=lambda x: x[0])
        if at == 0 or at == len(self.limits):
            return self.limits[max(0, at - 1)][1:]
        (a, low_a, high_a), (b, low_b, high_b) = self.limits[at - 1 : at + 1]
        part = log(size / a) / log(b / a)
        return low_a + part * (low_b - low_a), high_a + part * (high_b - high_a)

    def outside(self, size: int, ratio: float) -> bool:
        low, high = self.of(size)
        return not low <= ratio <= high


def measure(raw: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks outside their band, accepted); an empty text is rejected with a ratio of 0."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(squeeze.compress(raw)) / len(raw)
    chunks = bad = bad_bytes = 0
    for at in range(0, len(raw), bands.chunk_bytes):
        chunk = raw[at : at + bands.chunk_bytes]
        own = ratio if len(chunk) == len(raw) else len(squeeze.compress(chunk)) / len(chunk)
        chunks += 1
        if bands.outside(len(chunk), own):
            bad, bad_bytes = bad + 1, bad_bytes + len(chunk)
    return ratio, chunks, bad, not bands.outside(len(raw), ratio) and bad_bytes <= bands.bad_share * len(raw)


def repeated_words(words: list[str]) -> int:
    """Words in windows of three consecutive words that occur twice or more in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    if len(often) == len(windows):
        return 0
    total, covered_to = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            total += at + 3 - max(at, covered_to)
            covered_to = at + 3
    return total


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """(words, characters of words, symbols, repeated lines, words in repeated windows, failed).

    A line counts as repeated when it holds a word and equals an earlier line.  A text
    fails with fewer than 50 words, or when over half its words are in repeated windows.
    """
    words = WORD.findall(text)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif WORD.search(line):
            seen.add(line)
    repeated = repeated_words(words)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), len(NOT_SYMBOL.sub("", text)), again, repeated, failed


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64(),
}


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rules' figures and verdict for every row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, ratio, n_chunks, n_bad_chunks.  ``kept`` is false for a text
    that fails the base rules, else the verdict of the bands.  A null text counts as
    empty: zeros, failed, not kept.  Each row is judged by itself, so repeated rows give
    repeated rows and an absent id stays absent; further columns, whatever their names,
    are not read.  An empty table gives an empty table.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_rules(text)
                ratio, chunks, bad, fine = measure(text.encode(), bands, squeeze)
                out.append((*base, fine and not base[-1], ratio, chunks, bad))
            columns = zip(*out) if out else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, COLUMNS.values()))], names=["doc_id", *COLUMNS]
            )

    sql = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {sql[t]}" for n, t in COLUMNS.items()))


def keep_prose(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all their columns unchanged.

    The text is judged in place by an Arrow function over the text column alone, so
    nothing is joined or shuffled.  Null and empty texts are dropped.
    """
    def accepted(texts: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

        def one(text: str | None) -> bool:
            text = text or ""
            return not base_rules(text)[-1] and measure(text.encode(), bands, squeeze)[-1]

        return texts.map(one).astype(bool)

    return docs.where(pandas_udf(accepted, "boolean")(docs["text"]))
