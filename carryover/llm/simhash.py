"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two that differ in at most four bits differ in at
most four bytes, so they share at least four *positional* bytes.  The index posts
fingerprints under positional bytes; since a list of one byte would hold one in 256
of all fingerprints, lists are intersected three bytes at a time.  Any four of the
eight positions contain one of 20 fixed triples, so every pair that reaches the
guaranteed number of matches meets in some list.  There the shared positional
bytes of a pair are tallied, pairs below four are dropped, and the rest verified
bit by bit.  Equal fingerprints are one entry, and a list gives the links of a
spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.common import components, keep

SHINGLE, SEED, BITS_APART = 4, 42, 4
#: Least positional bytes that two linked fingerprints share.
LEAST_SHARED = 8 - BITS_APART
#: Entries of a list one task compares at once; a longer list is dealt out in pairs of blocks.
BLOCK = 20_000


def triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four of the eight contain one (Turan's construction)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for g, after in zip(groups, groups[1:] + groups[:1]):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in after]
    return sorted(out)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included.

    A-Z are lower-cased; words are what stands between ASCII white space; a text of
    fewer words than a shingle is one shingle.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, as a signed number: each set where more than half of the hashes have it; 0 of none."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", *extra: str) -> DataFrame:
    """(doc_id, fp as a signed long, then ``extra`` columns) of every whole text; a null text has fingerprint 0."""
    columns = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"), F.col(doc_id).alias("doc_id"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], names=[*batch.schema.names[1:], "fp"])

    schema = columns.drop("_t").schema.add("fp", "long")
    return columns.mapInArrow(run, schema)


def links(nodes: DataFrame, bits: int = BITS_APART, shared: int = LEAST_SHARED) -> DataFrame:
    """Links (a, b) between the ``node`` values of ``nodes`` (fp, node) that connect what is near.

    Pairs are near that share ``shared`` positional bytes and differ in at most ``bits``
    bits.  Every pair that shares four is compared in some list; of a list's links
    only a spanning forest is given, which joins the same nodes.
    """
    listed = []
    for k, positions in enumerate(triples()):
        mask = sum(0xFF << (8 * p) for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        listed.append(F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    posted = nodes.select("fp", "node", F.explode(F.array(*listed)).alias("p")).select("p.list", "p.key", "fp", "node")
    sizes = posted.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least(block, other).alias("i"), F.greatest(block, other).alias("j")))
    dealt = (
        posted.join(sizes, ["list", "key"])
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .select("list", "key", "fp", "node", F.explode(pairs).alias("pair"))
        .repartition("list", "key", "pair")
        .sortWithinPartitions("list", "key", "pair", "fp", "node")
        .select("list", "key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "fp", "node")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within runs of equal (list, key, i, j) of sorted rows; a run may go on in the next batch."""
        rest: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.int64)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            rest = rows[done:]
            if done:
                yield _batch(_runs(rows[:done], cuts, bits, shared))
        if rest is not None and len(rest):
            yield _batch(_runs(rest, np.array([len(rest)]), bits, shared))

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def _runs(rows: np.ndarray, cuts: np.ndarray, bits: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    fps, nodes = np.ascontiguousarray(rows[:, 4]), rows[:, 5]
    starts = np.concatenate([[0], cuts[:-1]])
    size = cuts - starts
    of_two = starts[size == 2]
    of_two = of_two[_near(fps[of_two], fps[of_two + 1], bits, shared)]
    a, b = [of_two], [of_two + 1]
    for s, e in zip(starts[size > 2], cuts[size > 2]):
        left, right = forest(fps[s:e], bits, shared)
        a.append(left + s)
        b.append(right + s)
    return nodes[np.concatenate(a)], nodes[np.concatenate(b)]


def _near(x: np.ndarray, y: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """Tally of shared positional bytes, then the bits of the pairs that reach the minimum."""
    apart = np.ascontiguousarray(x ^ y)
    near = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= shared
    near[near] = np.bitwise_count(apart[near].view(np.uint64)) <= bits
    return near


def forest(fps: np.ndarray, bits: int = BITS_APART, shared: int = LEAST_SHARED) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs, as positions: each tree is grown from what it reaches."""
    waiting, a, b = np.arange(len(fps)), [], []
    front: list[int] = []
    while len(waiting):
        if not front:
            front, waiting = [int(waiting[0])], waiting[1:]
        x = front.pop()
        near = _near(fps[waiting], fps[x], bits, shared)
        if near.any():
            found = waiting[near]
            a.append(np.full(len(found), x))
            b.append(found)
            front += found.tolist()
            waiting = waiting[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _batch(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], names=["a", "b"])


def groups(marked: DataFrame) -> DataFrame:
    """(fp, group): every distinct fingerprint with one of its group, the same for all of a group."""
    nodes = marked.select("fp").distinct()
    found = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links of at most four bits.
    Rows without an id take part and do not lend one: a component of such rows
    alone has a null ``component_id``.  Equal texts always share a component.
    """
    marked = keep(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    of = groups(marked)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp")
    named = least.groupBy("group").agg(F.min("least").alias("component_id"))
    return marked.join(least.select("fp", "group").join(named, "group").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: that with the
    smallest id, then text hash.

    Columns stay as they are.  Rows without an id come after those with one; null,
    empty and blank texts have fingerprint 0 and are one component; of repeated rows one
    stays.  An empty table stays empty.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marked = keep(fingerprints(named, shingle, "doc_id", "text", "h"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("h"))
    # the smallest row of each fingerprint, with how often that row is repeated
    rows = marked.groupBy("fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy("fp").agg(F.min(F.struct(order.alias("place"), "copies")).alias("w"))
    first = first.join(groups(marked), "fp").groupBy("group").agg(F.min("w").alias("w"))
    winners = first.select(F.col("w.place.doc_id").alias("_carryover_w"), F.col("w.place.h").alias("_carryover_h"), F.col("w.copies").alias("_carryover_n"))
    kept = docs.join(winners, F.col("doc_id").eqNullSafe(F.col("_carryover_w")) & (F.xxhash64("text") == F.col("_carryover_h")))
    once = kept.where("_carryover_n = 1").select(*docs.columns)
    # rows that are there several times are few: only these are compared with each other
    again = kept.where("_carryover_n > 1").dropDuplicates(["_carryover_w", "_carryover_h"]).select(*docs.columns)
    return once.unionByName(again)
