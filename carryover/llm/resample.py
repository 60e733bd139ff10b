"""Importance resampling towards a target distribution.

Texts are described by hashed n-grams of words.  The counts of all documents and of
all target texts give each hash bucket a gain, the logarithm of how much likelier the
target makes it; the gains of a document's n-grams add up to its weight, and Gumbel
noise from its id turns the order of weights into a draw without replacement.

n-grams are interned in blocks: an open-addressed table of NumPy arrays is probed with
the xxhash64 of each n-gram for a whole block at once, a claimed slot names the n-gram
that owns it, and bytes are compared before an occurrence takes the slot of another.
A slot holds its bucket and its count.  Counting adds the count of each slot to its
bucket; weighing reads one gain per slot and lets the slot ids of the occurrences
gather them.  Tables live for one block, whose size is fixed in words and bytes, so a
task's memory does not depend on how long a document is.

Both passes read the texts and shuffle none of them: the first gives ten thousand sums
a task, the second one narrow row a document.  Ranks come from a range partitioning on
the score and one count per range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carryover.llm.common import keep

#: Hash buckets; words of the longest n-gram; words and bytes after which a block is interned.
BUCKETS, LONGEST, BLOCK_WORDS, BLOCK_BYTES = 10_000, 3, 120_000, 1 << 21
#: n-grams of more bytes are hashed and compared one by one.
VECTOR_BYTES = 256
#: Share drawn, as a whole number of hundredths; least words of a document that can be drawn; seed of the noise.
SHARE, LEAST_WORDS, SEED = 5, 20, 42

#: A-Z to a-z; every other ASCII character that is not a digit or a small letter to a blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

#: Fixed values of xxHash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8: letters and digits of ASCII in lower case, and everything beyond ASCII."""
    return raw.translate(_FOLD).split()


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(lane: np.ndarray) -> np.ndarray:
    return _rotate(lane * P2, 31) * P1


def xxhash64_of(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """XXH64 with seed 0 of the ``size`` bytes of ``data`` from each ``start``, all at once.

    ``data`` has at least eight bytes of padding behind the last span.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    at = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            sums = [np.full(len(start), v, np.uint64) for v in (P1 + P2, P2, np.uint64(0), np.uint64(0) - P1)]
            while at + 32 <= size:
                for k in range(4):
                    sums[k] = _rotate(sums[k] + eight[start + (at + 8 * k)] * P2, 31) * P1
                at += 32
            h = _rotate(sums[0], 1) + _rotate(sums[1], 7) + _rotate(sums[2], 12) + _rotate(sums[3], 18)
            for s in sums:
                h = (h ^ _round(s)) * P1 + P4
        else:
            h = np.full(len(start), P5, np.uint64)
        h += np.uint64(size)
        while at + 8 <= size:
            h = _rotate(h ^ _round(eight[start + at]), 27) * P1 + P4
            at += 8
        if at + 4 <= size:
            h = _rotate(h ^ (four[start + at].astype(np.uint64) * P1), 23) * P2 + P3
            at += 4
        while at < size:
            h = _rotate(h ^ (data[start + at].astype(np.uint64) * P5), 11) * P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _short(size: np.ndarray) -> np.ndarray:
    """Sizes as 16-bit numbers, which NumPy sorts by counting; all beyond the vector sizes are one."""
    return np.minimum(size, VECTOR_BYTES + 1).astype(np.uint16)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What one byte and two bytes add to a crc32, as zlib's own values for each."""
    low = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    one = low ^ low[0]  # without the constants at both ends
    two = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        two = (two >> np.uint32(8)) ^ one[two & np.uint32(255)]
    return one, two


_ONE, _TWO = _crc_tables()


def crc32_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 of every span, two bytes at a step; spans are taken by falling size, so each step is a slice."""
    order = np.argsort(VECTOR_BYTES + 1 - _short(size), kind="stable")
    at, left = start[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    pair = np.ndarray((len(data) - 1,), "<u2", data, strides=(1,))
    by_size = -np.minimum(left, VECTOR_BYTES + 1)
    first = int(np.searchsorted(by_size, -VECTOR_BYTES))  # longer ones have no part in the steps
    for k in range(0, int(left[first]) - 1 if first < len(left) else 0, 2):
        upto = int(np.searchsorted(by_size, -(k + 2), side="right"))
        some = crc[first:upto]
        crc[first:upto] = (some >> np.uint32(16)) ^ _TWO[(some ^ pair[at[first:upto] + k]) & np.uint32(0xFFFF)]
    odd = np.flatnonzero(left & 1)
    last = crc[odd]
    crc[odd] = (last >> np.uint32(8)) ^ _ONE[(last ^ data[at[odd] + left[odd] - 1]) & np.uint32(255)]
    crc ^= np.uint32(0xFFFFFFFF)
    view = memoryview(data)
    crc[:first] = [zlib.crc32(view[a : a + n]) for a, n in zip(at[:first].tolist(), left[:first].tolist())]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` equal those from ``b`` over each ``size``, by words of eight bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same = np.ones(len(a), bool)
    todo, at = np.arange(len(a)), 0
    while todo.size:
        left = np.minimum(size[todo] - at, 8)
        odd = eight[a[todo] + at] ^ eight[b[todo] + at]
        odd <<= ((8 - left) * 8).astype(np.uint64)  # bytes behind the end do not count
        same[todo[odd != 0]] = False
        at += 8
        todo = todo[(odd == 0) & (size[todo] > at)]
    return same


class Interned:
    """The n-grams of one block in an open-addressed table.

    ``slots`` is the dense slot of each occurrence; ``count`` and ``bucket`` belong to
    the slots.  Occurrences are spans (``start``, ``size``) of ``data``.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        key = self._keys(data, start, size)
        mask = (1 << max(4, int(2 * len(start)).bit_length())) - 1
        owner = np.full(mask + 1, -1, np.int64)
        place = (key & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(start))
        while todo.size:
            here = place[todo]
            free = owner[here] < 0
            owner[here[free]] = todo[free]
            holds = owner[here]
            same = (key[holds] == key[todo]) & (size[holds] == size[todo])
            others = np.flatnonzero(same & (holds != todo))
            same[others] = _equal(data, start[todo[others]], start[holds[others]], size[todo[others]])
            todo = todo[~same]
            place[todo] = (place[todo] + 1) & mask
        used = np.flatnonzero(owner >= 0)
        dense = np.empty(mask + 1, np.int64)
        dense[used] = np.arange(len(used))
        self.slots = dense[place]
        self.count = np.bincount(self.slots, minlength=len(used))
        self.bucket = crc32_of(data, start[owner[used]], size[owner[used]]).astype(np.int64) % BUCKETS

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        key = np.empty(len(start), np.uint64)
        short = _short(size)
        order = np.argsort(short, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(short[order])) + 1)
        for some in groups if len(order) else []:
            length = int(short[some[0]])
            if length <= VECTOR_BYTES:
                key[some] = xxhash64_of(data, start[some], length)
            else:
                view = memoryview(data)
                key[some] = [xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(start[some].tolist(), size[some].tolist())]
        return key


class Blocks:
    """Gathers texts into blocks and hands each to ``done(interned, owner)``.

    ``owner`` is the number of the text of each occurrence.  A long text is cut between
    words; the n-grams across the cut are taken with the first part.
    """

    def __init__(self, done):
        self.done = done
        self.parts: list[tuple[int, bytes, int, int]] = []  # text, its words, how many, n-grams that start in them
        self.words = self.bytes = 0

    def add(self, text: int, words: list[bytes]) -> None:
        joined = b" ".join(words)
        if len(words) <= BLOCK_WORDS and len(joined) <= BLOCK_BYTES:
            if self.words + len(words) > BLOCK_WORDS or self.bytes + len(joined) > BLOCK_BYTES:
                self.flush()
            self._part(text, joined, len(words), len(words))
            return
        at = 0
        while at < len(words):
            self.flush()
            room, upto = BLOCK_BYTES, at
            while upto < len(words) and upto - at < BLOCK_WORDS and room > 0:
                room -= len(words[upto]) + 1
                upto += 1
            some = words[at : upto + LONGEST - 1]
            self._part(text, b" ".join(some), len(some), upto - at)
            at = upto

    def _part(self, text: int, joined: bytes, words: int, own: int) -> None:
        if own:
            self.parts.append((text, joined, words, own))
            self.words += words
            self.bytes += len(joined)

    def flush(self) -> None:
        if not self.parts:
            return
        data = np.frombuffer(b" ".join(p[1] for p in self.parts) + b" " * 9, np.uint8)
        # the end of word i is the i-th blank; the padding ends the last word
        ends = np.flatnonzero(data == 32)[: self.words]
        starts = np.concatenate([[0], ends[:-1] + 1])
        from_, size, owner, at = [], [], [], 0
        for text, _, words, own in self.parts:
            for n in range(LONGEST):
                last = min(own, words - n)
                if last > 0:
                    from_.append(starts[at : at + last])
                    size.append(ends[at + n : at + n + last] - from_[-1])
                    owner.append((text, last))
            at += words
        texts = np.repeat(np.array([t for t, _ in owner]), [k for _, k in owner])
        self.done(Interned(data, np.concatenate(from_), np.concatenate(size)), texts)
        self.parts, self.words, self.bytes = [], 0, 0


def _raw(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many n-grams of all rows of ``texts`` (text) fall into each bucket.

    A null or empty text has none; empty buckets have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)

        def add(block: Interned, _) -> None:
            np.add.at(total, block.bucket, block.count)

        blocks = Blocks(add)
        for batch in batches:
            for raw in _raw(batch.column(0)):
                blocks.add(0, words_of(raw))
        blocks.flush()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket: thousandths of the logarithm of target share over share, both smoothed by one.

    At most :data:`BUCKETS` sums of each side come to the driver.
    """
    both = bucket_counts(docs).select(F.lit(0).alias("side"), "*").union(bucket_counts(target).select(F.lit(1).alias("side"), "*"))
    seen = [[0] * BUCKETS, [0] * BUCKETS]
    for row in both.collect():
        seen[row["side"]][row["bucket"]] = row["n"]
    s_all, t_all = sum(seen[0]), sum(seen[1])
    return [floor(1000 * log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(*seen)]


def noise(doc_id) -> int:
    """Gumbel noise of an id in thousandths; an absent id counts as empty text."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs`` (doc_id, text).

    A null or empty text has no feature and weight 0.  Each row is weighed by itself.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(len(batch), np.int64)
            n_features = np.zeros(len(batch), np.int64)
            weight = np.zeros(len(batch), np.int64)

            def add(block: Interned, texts: np.ndarray) -> None:
                first = int(texts.min())
                own = held[block.bucket][block.slots]
                at = texts - first
                cuts = np.flatnonzero(np.diff(at)) + 1
                begin = np.concatenate([[0], cuts])
                np.add.at(weight, at[begin] + first, np.add.reduceat(own, begin))
                np.add.at(n_features, at[begin] + first, np.diff(np.append(begin, len(at))))

            blocks = Blocks(add)
            for i, raw in enumerate(_raw(batch.column(1))):
                words = words_of(raw)
                n_words[i] = len(words)
                blocks.add(i, words)
            blocks.flush()
            extra = np.array([noise(i) for i in batch.column(0).to_pylist()], np.int64)
            columns = [pa.array(c) for c in (n_words, n_features, weight, weight + extra)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3... for the drawn rows by falling score, null for the others.

    Drawn are ``floor(share * N / 100)`` of the N rows with at least ``least_words``
    words; ties go to the smaller id, absent ids come last, and equal rows take
    consecutive ranks.  Rows are dealt out by ranges of (score, id) and written once, so
    that a range can be numbered from the counts of the ranges before it; only one count
    per range is brought together.
    """
    names = weighed.columns
    can = F.col("n_words") >= least_words
    order = [F.col("can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = weighed.withColumn("can", can).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = keep(dealt, "resample")
    counts = dealt.where("can").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # one row a range: as many as shuffle partitions, whatever the rows
    ahead = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("all"))
    numbered = dealt.join(F.broadcast(ahead), "range", "left")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = F.col("can") & (F.col("place") <= F.floor(F.col("all") * share / F.lit(100)))
    return numbered.withColumn("place", place).select(*names, F.when(drawn, F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``target`` (text) holds the texts to resemble.  Null and empty texts have no
    n-grams on either side; with an empty target every gain follows from the documents
    alone.  Rows with one id are drawn each by itself; an absent id has the noise of the
    empty text and comes last among ties.  Columns other than doc_id and text are not
    read.  An empty table gives an empty table.
    """
    # written once: ranges are cut from a sample of the rows, which would weigh every text twice
    return draw(keep(weigh(docs, gains(docs, target)), "weighed"), share, least_words)


def selected(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns unchanged; ids are taken as unique."""
    ranks = resample(docs, target, share, least_words).where("rank IS NOT NULL").select("doc_id")
    return docs.join(ranks, "doc_id", "left_semi")
