"""Benchmark decontamination by pigeonhole edit matching.

An item that may differ in k characters is cut into k + 1 pieces: whatever k edits
do, one piece stays as it is.  Tasks look for all pieces of a block of items with
one Aho-Corasick pass over each whole document, and around each piece found verify
the item with Myers' bit-parallel edit distance.  Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits allowed per character of an item.
EDIT_RATE = 0.08
#: Bounds of a block of items that is sent to the tasks at once.
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 2_000_000


def normal(text: str | None) -> str:
    """Lower case, with one blank for each run of white space and none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = EDIT_RATE) -> int:
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of near equal length, each with its offset."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def letters(item: str) -> dict[str, int]:
    """Per letter, the bits of the positions it stands at."""
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        bits[c] |= 1 << i
    return dict(bits)


def myers(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to a substring of ``text``, and where the first such ends."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, at = length, 0
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, j
        up, down = up << 1, down << 1
        reach = eq | minus
        plus = (down | ~(reach | up)) & full
        minus = up & reach & full
    return best, at


class Matcher:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, edits) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def search(self, text: str) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the normal form of ``text``) of every item found."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                starts[n].add(end + 1 - length - offset)
        out = []
        for n, at in starts.items():
            item, pattern, edits = self.items[n]
            if (exact := text.find(pattern)) >= 0:
                out.append((item, 0, exact + len(pattern)))
            elif (found := self._verify(n, text, sorted(at))) is not None:
                out.append((item, *found))
        return out

    def _verify(self, n: int, text: str, starts: list[int]) -> tuple[int, int] | None:
        """Best match near the places where a piece would put the start of the item."""
        _, pattern, edits = self.items[n]
        bits = self.bits.get(n)
        if bits is None:
            bits = self.bits[n] = letters(pattern)
        windows: list[list[int]] = []
        for s in starts:
            a, b = max(0, s - edits), s + len(pattern) + edits
            if windows and a <= windows[-1][1]:
                windows[-1][1] = b
            else:
                windows.append([a, b])
        best = None
        for a, b in windows:
            distance, end = myers(bits, len(pattern), text[a:b])
            if distance <= edits and (best is None or distance < best[0]):
                best = distance, a + end
        return best


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size; a null or empty item matches nothing."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    parts = max(1, math.ceil(2 * size["n"] / BLOCK_ITEMS), math.ceil(2 * size["c"] / BLOCK_CHARS)) if size["n"] else 0
    if size["n"] <= BLOCK_ITEMS and size["c"] <= BLOCK_CHARS:
        parts = min(parts, 1)
    dealt = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(parts or 1)))
    for b in range(parts):
        yield sorted(((r["i"], normal(r["t"])) for r in dealt.where(F.col("b") == b).collect()), key=lambda x: (str(x[0]), x[1]))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = EDIT_RATE,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, distance, match_end): one row per document row and item within the budget.

    Text is compared in its normal form (:func:`normal`), where ``match_end`` counts
    too; the budget is ``rate`` times the item's length, rounded down.  Null and
    empty texts and items match nothing; repeated rows give repeated rows; of
    several matches in a document the closest, then the first, is given.  A large
    benchmark is worked through in blocks, one pass over the documents for each.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, match_end int"
    id_type = to_arrow_type(benchmark.schema[item_id].dataType)
    out = None
    for block in blocks(benchmark, item_id, item_text):
        found = source.mapInArrow(_searcher(block, rate, id_type), schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _searcher(block: list[tuple[object, str]], rate: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in batches:
            rows, found = [], []
            for n, value in enumerate(batch.column(1)):
                for hit in matcher.search(normal(value.as_py())):
                    rows.append(n)
                    found.append(hit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([h[0] for h in found], id_type),
                    pa.array([h[1] for h in found], pa.int32()),
                    pa.array([h[2] for h in found], pa.int32()),
                ],
                names=["doc_id", "item_id", "distance", "match_end"],
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns as they are.

    Rows are judged one by one inside the scan, so documents are neither joined nor
    shuffled; a row with a null text is clean.  With several blocks of items the
    rows pass through one filter after another.
    """
    for block in blocks(benchmark, "item_id", "text"):
        docs = docs.where(F.coalesce(_free_of(block, rate)(F.col("text")), F.lit(True)))
    return docs


def _free_of(block: list[tuple[object, str]], rate: float):
    made: list[Matcher] = []

    @F.pandas_udf("boolean")
    def free(texts):
        import pandas as pd

        if not made:
            made.append(Matcher(block, rate))
        return pd.Series([not made[0].search(normal(t)) for t in texts], dtype=bool)

    return free
