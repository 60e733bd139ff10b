"""Finding repeated windows of fixed length in a corpus, in Spark stages.

A *window* is a run of ``width`` consecutive letters of one text (bytes or words).
A method (``recompress``, ``suffixes``) gives every window an *anchor*: a place in
the window that depends on the window's letters alone, and a key of letters around
it that lie in the window.  Equal windows so have equal keys at the same distance.

1. reveal: keys are posted once per batch, and those that occur twice are found.
2. verify: windows under such a key are brought together and compared, as hashes or
   as their letters, and every window learns whether it occurs elsewhere or earlier.
3. apply: texts and their windows are joined by row and the covered letters removed.

A document is named by a hash of its id and text, together with its id; rows equal in
both are one document.  Texts are shuffled once, by that hash, and both joins read the
same exchange.  A key or window that many rows share is posted
once per batch of rows, so a hot one does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters worked on at once; a longer text is cut into pieces that overlap by a window.
PIECE = 1 << 21
#: Batches that may post one key before its windows are compared by hash instead of by letters.
HOT_POSTS = 5_000

U = np.uint64
#: Odd numbers for polynomial hashes modulo 2^64, and seeds of the byte tables.
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(s).integers(1, 1 << 64, 256, dtype=U) for s in (11, 12)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, at least n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        both = []
        for p in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), p, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _powers[base] = tuple(both)
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit letters."""

    def __init__(self, letters: np.ndarray, which: int = 0):
        up, self.down = powers(_P[which], len(letters) + 1)
        self.sum = np.zeros(len(letters) + 1, U)
        np.cumsum(letters * up[: len(letters)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(U))

    def every(self, size: int) -> np.ndarray:
        """Hash of each stretch of ``size`` letters, by its start."""
        n = max(0, len(self.sum) - size)
        return mix((self.sum[size : size + n] - self.sum[:n]) * self.down[:n] + U(size))


def byte_letters(raw: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLES[which][raw]


@dataclass
class Joined:
    """Letters of several pieces of texts, one after the other.

    ``starts`` are the letters at which a window starts that lies in its piece; of
    each piece ``at`` is its first letter here, ``row`` its row in the batch and
    ``base`` its first letter in the text.
    """

    letters: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    row: np.ndarray
    base: np.ndarray

    def home(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row in the batch and place in the text of letters here."""
        piece = np.searchsorted(self.at, start, "right") - 1
        return self.row[piece], start - self.at[piece] + self.base[piece]


@dataclass
class Runs:
    """Runs of neighbouring windows with one anchor: key, first window and number of windows."""

    key: np.ndarray
    start: np.ndarray
    size: np.ndarray


def runs_of(starts: np.ndarray, place: np.ndarray, key: np.ndarray) -> Runs:
    """Runs of neighbouring ``starts`` with one ``place`` (their anchor), with its key."""
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return Runs(key[first], starts[first], np.diff(np.concatenate([first, [len(place)]])))


@dataclass
class Method:
    """What a method gives: letters of a text, anchors of windows, and how windows are compared."""

    width: int
    letters: Callable[[bytes], np.ndarray]
    anchors: Callable[[np.ndarray, np.ndarray], Runs]
    #: Windows are sent as their hashes; else as the stretch of letters (bytes) of a run.
    by_hash: bool
    #: For stretches in order of place: (texts, runs) to the length of each window's longest
    #: previous factor, at most ``width``, and the window at which that factor starts earlier.
    factors: Callable[[list[bytes], list[int]], tuple[np.ndarray, np.ndarray]] | None = None


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, own, text as bytes): the name of a document, its id for order, and its text.

    A null text is an empty one, a null id comes after all ids.  Both joins on ``row``
    take exactly these columns, so that they read one exchange.
    """
    return docs.select(
        F.xxhash64(doc_id, text).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("own"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )


def _batches(batch: pa.RecordBatch, method: Method, column: int) -> Iterator[Joined]:
    """The texts of a batch, some megabytes of letters at a time; texts without a window are left out."""
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for n, value in enumerate(batch.column(column)):
        letters = method.letters(value.as_py())
        for base in range(0, len(letters) - method.width + 1, PIECE):
            parts.append((n, base, letters[base : base + PIECE + method.width - 1]))
            size += len(parts[-1][2])
            if size >= PIECE // 2:
                yield _joined(parts, method.width)
                parts, size = [], 0
    if parts:
        yield _joined(parts, method.width)


def _joined(parts: list[tuple[int, int, np.ndarray]], width: int) -> Joined:
    sizes = np.array([len(x) for *_, x in parts])
    at = np.cumsum(sizes) - sizes
    windows = sizes - width + 1
    starts = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return Joined(np.concatenate([x for *_, x in parts]), starts, at, np.array([n for n, *_ in parts]), np.array([b for _, b, _ in parts]))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), *[c[part] for c in columns]


def revealed(rows: DataFrame, method: Method) -> DataFrame:
    """(row, keys, hot): for each row the anchor keys that occur at two places, and those posted very often."""
    parts = _parts(rows)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for joined in _batches(batch, method, 1):
                out = []
                runs = method.anchors(joined.letters, joined.starts)
                key, row = runs.key, number[joined.home(runs.start)[0]]
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                first = np.concatenate([[True], key[1:] != key[:-1]])
                twice = np.concatenate([~first[1:], [False]]) & first
                local = ~first | twice
                for b, k, r, t in _by_bucket((key[first] % U(parts)).astype(np.int64), key[first], row[first], twice[first]):
                    out.append((b, _blob(k), _blob(r), _blob(t)))
                if local.any():
                    out.append((int(row[0] % parts), _blob(key[local]), _blob(row[local]), None))
                yield _table(out, [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "keys", "rows", "twice"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(k, U) for batch in batches for k, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()) if t is not None]
        key, n = np.unique(np.concatenate([np.empty(0, U), *keys]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[n > HOT_POSTS].view(np.int64))], names=["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows_, twice = [], [], []
        for batch in batches:
            for k, r, t in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                k, r = np.frombuffer(k, U), np.frombuffer(r, np.int64)
                if t is None:
                    yield _flags(k, r)
                else:
                    keys.append(k)
                    rows_.append(r)
                    twice.append(np.frombuffer(t, bool))
        if keys:
            k, r, t = np.concatenate(keys), np.concatenate(rows_), np.concatenate(twice)
            order = np.argsort(k, kind="stable")
            k, r, t = k[order], r[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.concatenate([first, [len(k)]]))
            n = np.repeat(size, size)
            known = (n > 1) | t
            yield _flags(k[known], r[known])

    posted = rows.select("row", "text").mapInArrow(post, "bucket int, keys binary, rows binary, twice binary")
    dealt = posted.repartition("bucket")
    flags = dealt.mapInArrow(find, "row long, key long")
    if method.by_hash:
        flags = flags.withColumn("hot", F.lit(False))
    else:
        # whether a key is hot must not depend on the row, or equal windows are sent in two forms; few keys are
        hot = dealt.mapInArrow(often, "key long").withColumn("hot", F.lit(True))
        flags = flags.join(F.broadcast(hot), "key", "left")
    return flags.groupBy("row").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))


def _flags(key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key.view(np.int64))], names=["row", "key"])


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _parts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_SENT = ["bucket", "kind", "key", "a", "starts", "rows", "ids"]
_SENT_KINDS = [pa.int32(), pa.int8(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_SENT_SCHEMA = "bucket int, kind byte, key long, a binary, starts binary, rows binary, ids binary"
#: Kinds of sent rows: hashes of windows, windows already known to repeat, a stretch of letters.
HASHES, KNOWN, STRETCH = 0, 1, 2
#: Ids sort before those without one.
NO_ID = (1 << 63) - 1


def repeated(rows: DataFrame, method: Method, keep_first: bool) -> DataFrame:
    """(row, owns, starts): for each name of a document the ids and the first letters of windows that occur elsewhere (earlier, with ``keep_first``).

    Earlier is by doc_id (absent ones last), then row, then place in the text.
    """
    parts = _parts(rows)
    marked = rows.join(revealed(rows, method).hint("shuffle_hash"), "row").select("row", "own", "text", "keys", "hot")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            revealed_keys, hot_keys = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in batch.columns[3:5])
            for joined in _batches(batch, method, 2):
                out = []
                stretches: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
                runs = method.anchors(joined.letters, joined.starts)
                want = np.isin(runs.key, revealed_keys)
                hash_it = want & (method.by_hash | np.isin(runs.key, hot_keys))
                n = runs.size[hash_it]
                hashed = np.repeat(runs.start[hash_it] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                as_text = want & ~hash_it
                row, start = joined.home(runs.start[as_text])
                for k, s, n, r, at in zip(*[x.tolist() for x in (runs.key[as_text], runs.start[as_text], runs.size[as_text], row, start)]):
                    stretches.setdefault((k, joined.letters[s : s + n + method.width - 1].tobytes()), []).append((r, at))
                if len(hashed):
                    h = _window_hash(joined.letters, method, hashed)
                    r, s = joined.home(hashed)
                    order = np.lexsort((s, number[r], ids[r], h))
                    h, s, r = h[order], s[order], r[order]
                    once = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (number[r[1:]] != number[r[:-1]])])
                    h, s, r = h[once], s[once], r[once]
                    first = np.concatenate([[True], h[1:] != h[:-1]])
                    many = np.concatenate([~first[1:], [False]]) & first
                    known = ~first if keep_first else ~first | many
                    for b, k, x, y in _by_bucket((h[first] % U(parts)).astype(np.int64), h[first], s[first], r[first]):
                        out.append((b, HASHES, None, _blob(k), _blob(x), _blob(number[y]), _blob(ids[y])))
                    if known.any():
                        out.append((int(number[0] % parts), KNOWN, None, None, _blob(s[known]), _blob(number[r[known]]), _blob(ids[r[known]])))
                for (key, letters), at in stretches.items():
                    r, s = np.array(at, np.int64).T
                    signed = key - (key >> 63 << 64)
                    out.append((key % parts, STRETCH, signed, letters, _blob(s), _blob(number[r]), _blob(ids[r])))
                yield _table(out, _SENT_KINDS, _SENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        h, s, r, i = [], [], [], []
        block = Block(method, keep_first)
        group: dict[bytes, list[tuple]] = {}
        current = None
        for batch in batches:
            for _, kind, key, a, starts, row, own in zip(*[c.to_pylist() for c in batch.columns]):
                starts, row = np.frombuffer(starts, np.int64), np.frombuffer(row, np.int64)
                own = np.frombuffer(own, np.int64)
                if kind == KNOWN:
                    yield _found(row, own, starts)
                elif kind == HASHES:
                    h.append(np.frombuffer(a, U))
                    s.append(starts)
                    r.append(row)
                    i.append(own)
                else:
                    if key != current:
                        yield from block.take(group)
                        group, current = {}, key
                    group.setdefault(a, []).append((row, starts, own))
        yield from block.take(group)
        yield from block.rest()
        if h:
            h, s, r, i = map(np.concatenate, (h, s, r, i))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            at = order[twice]
            yield _elsewhere(h[at], r[at], i[at], s[at], keep_first)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task has found, in one line for each slot of documents."""
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def lines() -> pa.RecordBatch:
            return _table([(slot, _blob(np.concatenate(x))) for slot, x in held.items()], [pa.int32(), pa.binary()], ["slot", "found"])

        for found in compare(batches):
            size += len(found)
            for slot, rows_ in _by_bucket(found[:, 0] % parts, found):
                held.setdefault(slot, []).append(rows_)
            if size > PIECE:
                yield lines()
                held, size = {}, 0
        yield lines()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a slot, one for each document."""
        found = [np.frombuffer(x, np.int64).reshape(-1, 4) for batch in batches for x in batch.column(1).to_pylist()]
        if found:
            yield _documents(np.concatenate(found))

    sent = marked.mapInArrow(send, _SENT_SCHEMA)
    dealt = sent.repartition("bucket")
    if not method.by_hash:
        # the stretches of one anchor come one after the other, so that a task holds one group at a time
        dealt = dealt.sortWithinPartitions("kind", "key")
    found = dealt.mapInArrow(packed, "slot int, found binary")
    return found.repartition("slot").mapInArrow(unpacked, "row long, owns binary, starts binary")


def _window_hash(letters: np.ndarray, method: Method, start: np.ndarray) -> np.ndarray:
    values = byte_letters(letters, 1) if letters.dtype == np.uint8 else mix(letters + U(1))
    return Rolling(values, 1).of(start, start + method.width)


class Block:
    """Groups of stretches under one anchor each, judged when enough of them have come."""

    def __init__(self, method: Method, keep_first: bool):
        self.method, self.keep_first = method, keep_first
        self._empty()

    def _empty(self) -> None:
        self.texts: list[bytes] = []
        self.owners: list[np.ndarray] = []
        self.bytes = 0

    def take(self, group: dict[bytes, list[tuple]]) -> Iterator[np.ndarray]:
        """Add the stretches of one anchor, each with the (rows, starts, owns) it stands at."""
        alone = len(group) == 1
        for letters, places in group.items():
            owner = _placed(*(np.concatenate(x) for x in zip(*places)))
            if not alone:
                self.texts.append(letters)
                self.owners.append(owner)
                self.bytes += len(letters)
            elif owner.shape[1] > 1:  # windows of one stretch differ: all of them repeat, at its other places
                row, start, own = owner[:, 1:] if self.keep_first else owner
                n = np.full(len(row), len(letters) - self.method.width + 1)
                yield np.stack([row, own, start, n], 1)
        if self.bytes >= PIECE // 2:
            yield from self.rest()

    def rest(self) -> Iterator[np.ndarray]:
        if self.texts:
            yield _judged(self.method, self.texts, self.owners, self.keep_first)
            self._empty()


def _placed(row: np.ndarray, start: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places in order, each once: by id, row and start."""
    if len(row) == 1:
        return np.stack([row, start, own])
    order = np.lexsort((start, row, own))
    places = np.stack([row[order], start[order], own[order]])
    once = np.concatenate([[True], (places[:, 1:] != places[:, :-1]).any(0)])
    return places[:, once]


def _judged(method: Method, texts: list[bytes], owners: list[np.ndarray], keep_first: bool) -> np.ndarray:
    """Runs of windows of stretches that have another, or an earlier, place.

    Stretches are ordered by their first places; runs of windows of one document do not
    overlap, so that windows are then in order of place.
    """
    first = np.stack([x[:, 0] for x in owners], 1)
    order = np.lexsort((first[1], first[0], first[2])).tolist()
    texts, owners = [texts[k] for k in order], [owners[k] for k in order]
    size = np.array([len(t) - method.width + 1 for t in texts])
    count = np.array([x.shape[1] for x in owners])
    length, source = method.factors(texts, size.tolist())
    again = length >= method.width
    if keep_first:
        own_runs = _whole(again, size)
        other = np.flatnonzero(count > 1)
        runs = (own_runs, np.ones(len(own_runs), np.int64)), (np.stack([other, np.zeros_like(other), size[other]], 1), None)
    else:
        again[source[again]] = True
        again |= np.repeat(count > 1, size)
        runs = ((_whole(again, size), None),)
    row, start, own = np.concatenate(owners, 1)
    at = np.cumsum(count) - count
    found = []
    for (found_runs, times), skip in zip(runs, (0, 1)):
        stretch, offset, number = found_runs.T
        n = count[stretch] - skip if times is None else times
        place = np.repeat(at[stretch] + skip - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.stack([row[place], own[place], start[place] + np.repeat(offset, n), np.repeat(number, n)], 1))
    return np.concatenate(found)


def _whole(mask: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(stretch, first window, number) of the runs of true windows; runs end with their stretch."""
    at = np.cumsum(size) - size
    edge = np.zeros(len(mask), bool)
    edge[at] = True
    before = np.concatenate([[False], mask[:-1]])
    first = np.flatnonzero(mask & (edge | ~before))
    last = np.flatnonzero(mask & np.concatenate([edge[1:] | ~mask[1:], [True]]))
    stretch = np.searchsorted(at, first, "right") - 1
    return np.stack([stretch, first - at[stretch], last - first + 1], 1)


def _elsewhere(label: np.ndarray, row: np.ndarray, own: np.ndarray, start: np.ndarray, keep_first: bool) -> np.ndarray:
    """Windows whose label another window has, or an earlier one; the same place twice is one window."""
    if not len(label):
        return np.empty((0, 4), np.int64)
    order = np.lexsort((start, row, own, label))
    label, row, own, start = label[order], row[order], own[order], start[order]
    same = label[1:] == label[:-1]
    once = np.concatenate([[True], ~same | (row[1:] != row[:-1]) | (start[1:] != start[:-1])])
    label, row, own, start = label[once], row[once], own[once], start[once]
    same = label[1:] == label[:-1]
    found = np.concatenate([[False], same])
    if not keep_first:
        found |= np.concatenate([same, [False]])
    return _found(row[found], own[found], start[found])


def _found(row: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(row, own, first, number) of each run of neighbouring window starts of a document."""
    order = np.lexsort((start, own, row))
    row, own, start = row[order], own[order], start[order]
    if not len(row):
        return np.empty((0, 4), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)]))
    size = start[np.concatenate([first[1:], [len(start)]]) - 1] - start[first] + 1
    return np.stack([row[first], own[first], start[first], size], 1)


def _documents(found: np.ndarray) -> pa.RecordBatch:
    found = found[np.argsort(found[:, 0], kind="stable")]
    cut = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0]]))
    lines = [(int(found[a, 0]), _blob(found[a:b, 1]), _blob(found[a:b, 2:])) for a, b in zip(cut, [*cut[1:], len(found)])]
    return _table(lines, [pa.int64(), pa.binary(), pa.binary()], ["row", "owns", "starts"])


def covered(own: int, owns: bytes, starts: bytes, width: int, size: int) -> np.ndarray:
    """Which of the ``size`` letters of document ``own`` lie in a listed window."""
    change = np.zeros(size + 1, np.int64)
    pairs = np.frombuffer(starts, np.int64).reshape(-1, 2)[np.frombuffer(owns, np.int64) == own]
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs.sum(1) + width - 1, -1)
    return np.cumsum(change[:-1]) > 0


def with_repeats(docs: DataFrame, method: Method, keep_first: bool, doc_id: str, text: str) -> DataFrame:
    """(own, doc_id, text as bytes, owns, starts): every row of ``docs`` with its repeated windows, null where none."""
    rows = numbered(docs, doc_id, text)
    found = rows.join(repeated(rows, method, keep_first).hint("shuffle_hash"), "row", "left")
    own = F.when(F.col("own") != NO_ID, F.col("own")).cast(docs.schema[doc_id].dataType)
    return found.select("own", own.alias("doc_id"), "text", "owns", "starts")
