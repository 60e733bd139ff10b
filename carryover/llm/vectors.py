"""Near-duplicate vectors by product quantisation, with probes sized by the wanted angle.

Vectors are scaled to length one.  A coarse quantiser puts each in an inverted list;
the residual to the list's centre is coded by subspace.  A vector in another list is
at least as far away as the hyperplane between the two centres, so a vector need not
probe lists whose hyperplane is further off than the wanted angle reaches.  How much
of a step of that length goes towards another centre is taken from the fitted sample:
along each direction between two centres, the standard deviation of what vectors are
off their centres, and of the steps between vectors of the sample that are as near as
wanted, the larger of both.  Lists are probed up to ``SPREAD`` such deviations
(``exact=True``: up to the whole length of a step, which misses nothing).  In a list, inner products with
all entries are looked up in the table of the query's products with the codes
(asymmetric: the query is not coded); an entry is left out only when its coding
error cannot make up what is missing.  What remains is compared exactly.

Equal vectors are one entry with a count.  A list, and the queries on it, are dealt
out in blocks, so no task holds a whole list; a block gives counts and a spanning
forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.llm.common import components, keep

#: Vectors the quantisers are fitted on at most; everything is indexed.
SAMPLE_ROWS = 20_000
#: Entries a list is meant to hold, lists at most, codes and dimensions of a subspace.
LIST_ROWS, MOST_LISTS, CODES, SUB = 256, 4_096, 256, 8
#: Standard deviations of a step's part towards another centre that probes allow for.
SPREAD = 2.5
#: Steps between near vectors of the sample that tell a spread of their own.
LEAST_STEPS = 100
#: Entries and queries of one block.
BLOCK = 4_096
#: Slack of the bounds for rounding; tables are looked up in single precision.
EPS = 1e-4


@dataclass
class Quantiser:
    """Coarse centres (lists x dims) and residual codes (subspaces x codes x dims)."""

    centres: np.ndarray
    codes: np.ndarray
    #: Roots of the spreads of a step of length one, as (dims x dims) matrices.
    spreads: tuple[np.ndarray, ...] = ()

    def lists(self, x: np.ndarray) -> np.ndarray:
        return (-2 * x @ self.centres.T + (self.centres**2).sum(1)).argmin(1)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave."""
        rest = _padded(x - self.centres[at], self.codes)
        out = np.stack([(-2 * rest[:, m] @ c.T + (c**2).sum(1)).argmin(1) for m, c in enumerate(self.codes)], 1)
        back = np.stack([c[out[:, m]] for m, c in enumerate(self.codes)], 1)
        return out.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum((1, 2)))

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float, exact: bool = False) -> np.ndarray:
        """[vector, list]: lists not before the vector's own whose hyperplane a step of
        length ``reach`` gets to, or one of its likely parts towards them.

        A pair in two lists is found from the one in the earlier list.
        """
        c = self.centres
        apart = (-2 * x @ c.T + (c**2).sum(1)) - (-2 * (x * c[at]).sum(1) + (c[at] ** 2).sum(1))[:, None]
        home, own = np.unique(at, return_inverse=True)
        between = _apart(c[home], c)
        if not exact and self.spreads:
            # what is off by one deviation along the direction, times its length
            along = SPREAD * np.max([_apart(c[home] @ root, c @ root) for root in self.spreads], 0)
            between = np.minimum(between, along)
        return (apart <= 2 * reach * between[own] + EPS) & (np.arange(len(c)) >= at[:, None])

    def table(self, x: np.ndarray) -> np.ndarray:
        """[subspace, code, vector]: inner products of queries with all codes."""
        return np.matmul(self.codes, _padded(x, self.codes).transpose(1, 2, 0)).astype(np.float32)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def _spread(steps: np.ndarray) -> np.ndarray:
    """Root of the second moments of steps of any length, scaled to a mean square length of one."""
    moments = steps.T @ steps
    values, vectors = np.linalg.eigh(moments / max(np.trace(moments), 1e-300))
    return vectors * np.sqrt(np.maximum(values, 0))


def near_steps(x: np.ndarray, at: np.ndarray, least_cosine: float) -> np.ndarray:
    """Steps between vectors of one list that are as near as wanted, some for every vector."""
    out = [np.empty((0, x.shape[1]))]
    for rows in np.split(np.argsort(at, kind="stable"), np.flatnonzero(np.diff(np.sort(at))) + 1):
        rows = rows[:1024]
        near = np.triu(x[rows] @ x[rows].T >= least_cosine, 1)
        # the nearest few after each, so that one crowd does not speak for all
        i, j = np.nonzero(near & (near.cumsum(1) <= 4))
        out.append(x[rows[i]] - x[rows[j]])
    return np.concatenate(out)


def _padded(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    parts, _, sub = codes.shape
    out = np.zeros((len(x), parts * sub))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, sub)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([(-2 * x[i : i + 4096] @ c.T + (c**2).sum(1)).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, least_cosine: float | None = None) -> Quantiser:
    """Centres, codes and spreads from a bounded sample of vectors of length one."""
    centres = kmeans(sample, lists)
    parts = -(-sample.shape[1] // SUB)
    empty = np.zeros((parts, 1, SUB))
    at = Quantiser(centres, empty).lists(sample)
    rest = _padded(sample - centres[at], empty)
    codes = [kmeans(rest[:, m], CODES) for m in range(parts)]
    spreads = [_spread(sample - centres[at])]
    steps = near_steps(sample, at, least_cosine) if least_cosine is not None else sample[:0]
    if len(steps) >= LEAST_STEPS:
        spreads.append(_spread(steps / np.maximum(np.sqrt((steps**2).sum(1, keepdims=True)), 1e-12)))
    return Quantiser(centres, np.stack(codes), tuple(spreads))


def usable(embedding: F.Column) -> F.Column:
    """The vector in double precision, zeros without a sign; null if it cannot be compared.

    Usable: not null, without null, NaN or infinite components, not all zero.
    """
    values = F.transform(embedding, lambda v: v.cast("double") + F.lit(0.0))
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    return F.when(fine, values)


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(node, embedding, copies, least): one row per distinct usable vector, with its smallest id.

    ``node`` names the vector by 128 bits of hash; equal vectors are counted before the shuffle.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), usable(F.col(embedding)).alias("embedding")).where("embedding is not null")
    grouped = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return grouped.select(node(F.col("embedding")).alias("node"), "embedding", "copies", "least")


def node(embedding: F.Column) -> F.Column:
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), embedding)), 16, "0") for seed in (1, 2)])


def links(known: DataFrame, least_cosine: float, dims: int, exact: bool = False) -> DataFrame:
    """(node, found, a, b): partial counts of linked rows per node, and links that join what is linked.

    ``known`` holds (node, embedding, copies) of vectors with ``dims`` components.
    """
    spark = known.sparkSession
    total = known.count()
    sample = known.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("embedding").toPandas()
    unit = _unit(np.array(sample["embedding"].tolist(), float).reshape(len(sample), dims))
    quantiser = fit(unit, max(1, min(MOST_LISTS, total // LIST_ROWS)), least_cosine)
    shared = spark.sparkContext.broadcast(quantiser)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q: Quantiser = shared.value
        for all_rows in parts:
            for i in range(0, len(all_rows), 2048):
                rows = all_rows.iloc[i : i + 2048]
                x = _unit(np.stack(rows["embedding"].to_numpy()).astype(float))
                at = q.lists(x)
                codes, error = q.encode(x, at)
                probes = [np.flatnonzero(p).astype(np.int32) for p in q.probes(x, at, reach, exact)]
                yield pd.DataFrame({
                    "node": rows["node"], "embedding": rows["embedding"], "copies": rows["copies"], "list": at.astype(np.int32),
                    "codes": [c.tobytes() for c in codes], "error": error, "probes": probes,
                })

    placed = keep(
        known.select("node", "embedding", "copies").mapInPandas(
            assign, "node string, embedding array<double>, copies long, list int, codes binary, error double, probes array<int>"
        ),
        "vectors",
    )
    entries = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("q"))
    # one row for each list, at most MOST_LISTS
    blocks = F.broadcast(entries.join(asked, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb")))
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    asking = F.pmod(F.xxhash64("node"), F.col("qb")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entry = placed.join(blocks, "list").select("list", own.alias("i"), every("qb").alias("j"), F.lit(False).alias("asks"), "node", "embedding", "copies", F.col("list").alias("home"), "codes", "error")
    query = (
        placed.select("node", "embedding", "copies", F.col("list").alias("home"), F.explode("probes").alias("list"))
        .join(blocks, "list")
        .select("list", every("nb").alias("i"), asking.alias("j"), F.lit(True).alias("asks"), "node", "embedding", "copies", "home", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _compare(shared.value, int(key[0]), rows, least_cosine, reach)

    found = entry.unionByName(query).groupBy("list", "i", "j").applyInPandas(compare, "node string, found long, a string, b string")
    return keep(found, "vector-links")


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True, initial=1e-300)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(q: Quantiser, at: int, rows: pd.DataFrame, least: float, reach: float) -> pd.DataFrame:
    """Queries against entries of one block of list ``at``."""
    asks = rows["asks"].to_numpy()
    entry, query = rows[~asks], rows[asks]
    none = pd.DataFrame({"node": [], "found": [], "a": [], "b": []}).astype({"node": object, "found": "int64", "a": object, "b": object})
    if not len(entry) or not len(query):
        return none
    y, x = (_unit(np.stack(r["embedding"].to_numpy()).astype(float)) for r in (entry, query))
    codes = np.frombuffer(b"".join(entry["codes"]), np.uint8).reshape(len(entry), -1).astype(np.int64)
    error, centre = entry["error"].to_numpy(), q.centres[at]
    back = (y - centre) - np.concatenate([c[codes[:, m]] for m, c in enumerate(q.codes)], 1)[:, : y.shape[1]]
    # x.y = x.back-coded + x.rest, and x.rest is at most |rest|, and at most y.rest + reach |rest|
    bound = (least - np.minimum(error, (y * back).sum(1) + reach * error) - EPS).astype(np.float32)
    names = np.concatenate([entry["node"].to_numpy(), query["node"].to_numpy()])
    weight = np.concatenate([entry["copies"].to_numpy(), query["copies"].to_numpy()])
    inside = query["home"].to_numpy() == at
    left, right = [], []
    for i in range(0, len(x), 512):
        part = slice(i, i + 512)
        near = np.repeat((x[part] @ centre).astype(np.float32)[None], len(y), 0)
        for m, table in enumerate(q.table(x[part])):
            near += table[codes[:, m]]
        b, a = np.nonzero(near >= bound[:, None])
        for k in range(0, len(a), 1 << 18):
            p, e = a[k : k + (1 << 18)] + i, b[k : k + (1 << 18)]
            exact = np.einsum("ij,ij->i", x[p], y[e]) >= least
            p, e = p[exact], e[exact]
            left.append(p + len(y))
            right.append(e)
    p, e = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right))
    other = names[p] != names[e]
    p, e = p[other], e[other]
    if not len(p):
        return none
    # inside a list a pair is met from both sides, and each side counts its own
    count = np.bincount(p, weight[e], len(names)) + np.bincount(e, weight[p] * ~inside[p - len(y)], len(names))
    root = np.arange(len(names))
    first = {n: k for k, n in reversed(list(enumerate(names)))}
    root = np.array([first[n] for n in names])
    while True:
        low = np.minimum(root[p], root[e])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, e, low)
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    counted, joined = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(names)))
    joined = joined[names[joined] != names[root[joined]]]
    return pd.concat([
        pd.DataFrame({"node": names[counted], "found": count[counted].astype(np.int64), "a": None, "b": None}),
        pd.DataFrame({"node": None, "found": 0, "a": names[joined], "b": names[root[joined]]}),
    ])


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Links are pairs with a cosine of at least ``least_cosine`` in double precision, as
    the probes find them (all of them with ``exact``);
    vectors of different length, and unusable ones (:func:`usable`), link with
    nothing.  Equal vectors are all linked.  ``component_id`` is the smallest id
    reachable; rows without an id count as links and lend no id.  Repeated rows are
    vectors of their own that share an id.
    """
    known = keep(classes(vectors, vec_id, embedding), "vector-classes")
    # the lengths that occur; a table of embeddings has one or a few
    sizes = [r["d"] for r in known.select(F.size("embedding").alias("d")).distinct().orderBy("d").toLocalIterator()]
    found = None
    for d in sizes:
        part = links(known.where(F.size("embedding") == d), least_cosine, d, exact)
        found = part if found is None else found.unionAll(part)
    plain = vectors.select(F.col(vec_id).alias("vec_id"), usable(F.col(embedding)).alias("e"))
    own = plain.select("vec_id", F.when(F.col("e").isNotNull(), node(F.col("e"))).alias("node"))
    if found is None:
        info = known.select("node", "copies", "least", F.lit(0).cast("long").alias("found"), F.col("node").alias("component"))
    else:
        counts = found.where("node is not null").groupBy("node").agg(F.sum("found").alias("found"))
        joined = components(found.where("a is not null").select("a", "b"))
        info = (
            known.select("node", "copies", "least")
            .join(counts, "node", "left")
            .join(joined, "node", "left")
            .select("node", "copies", "least", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("component", "node").alias("component"))
        )
    least = info.groupBy("component").agg(F.min("least").alias("component_id"))
    named = info.join(least, "component").select("node", (F.col("found") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = own.join(named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
