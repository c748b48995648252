"""Near copies of vectors by spherical-cap filters: structured random product codes, list decoding, join on filters, exact check.

A vector is cut into two halves, each with a code of ``M`` random directions; a filter is a pair of them, so there are M x M
directions for the price of 2 M inner products. A vector belongs to the filters whose direction it exceeds a threshold
on, which list decoding finds without looking at the others: only directions of the first half that can reach the
threshold with the best of the second are paired. Vectors close to each other exceed the same
directions. M grows with the root of the number of vectors, so a filter holds about as many at any size.

Vectors of a filter are compared in double precision. A filter of more than ``TILE`` vectors is cut into tiles and every pair of
tiles is a piece of work of its own. A pair that shares several filters counts where their number is smallest.
Nothing is written per pair: a tile gives each vector's number of links and a spanning forest. A vector
belongs to ``FILTERS`` filters on average, and to more where M is so large that fewer than ``RECALL`` of the pairs at the cosine
bound would share one; both are taken from the code in use, so recall does not fall as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm.components import components
from procurelake.session import staged

COSINE = 0.93
FILTERS = 32
RECALL = 0.99
PAIRS, BEST = 2000, 128
LEAST_CODES, MOST_CODES = 32, 4096
TILE = 1024
SEED = 20240611


@lru_cache(maxsize=8)
def _codes(size: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation, and unit directions of the two halves, each scaled so that pairs have length one."""
    rng = np.random.default_rng((SEED, size, codes))
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    halves = []
    for width in (size - size // 2, size // 2):
        part = rng.standard_normal((codes, width))
        halves.append(part / np.sqrt(2) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300))
    return rotation, halves[0], halves[1]


def _quantile(size: int, share: float) -> float:
    """What a random unit vector exceeds on ``share`` of all unit directions: its sine is spread as the cosine's power size - 2."""
    angles = np.linspace(np.pi / 2, -np.pi / 2, 400_001)
    weights = np.cumsum(np.maximum(np.cos(angles), 0) ** max(size - 2, 0))
    return float(np.sin(angles[np.searchsorted(weights, share * weights[-1])]))


def _shared(size: int, codes: int, cosine: float) -> np.ndarray:
    """The highest threshold at which each of ``PAIRS`` random pairs with the cosine shares a direction, or less.

    Only the ``BEST`` directions of each half are paired, which can miss a higher one.
    """
    rotation, left, right = _codes(size, codes)
    rng = np.random.default_rng((SEED, size, codes, 1))
    u, w = rng.standard_normal((2, PAIRS, size))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= np.sum(u * w, axis=1, keepdims=True) * u
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    v = cosine * u + np.sqrt(max(0.0, 1 - cosine**2)) * w
    cut, best = size - size // 2, min(BEST, codes)
    out = np.empty(PAIRS)
    for at in range(0, PAIRS, 100):
        sides = [(x[at : at + 100] @ rotation) for x in (u, v)]
        halves = []
        for part, code in ((slice(0, cut), left), (slice(cut, size), right)):
            x, y = (side[:, part] @ code.T for side in sides)
            top = np.argpartition(-np.minimum(x, y), best - 1, axis=1)[:, :best]
            halves.append([np.take_along_axis(z, top, axis=1) for z in (x, y)])
        first, second = (halves[0][side][:, :, None] + halves[1][side][:, None, :] for side in (0, 1))
        out[at : at + 100] = np.minimum(first, second).max(axis=(1, 2))
    return out


@lru_cache(maxsize=64)
def threshold(size: int, codes: int, filters: float, cosine: float = COSINE) -> float:
    """What a random unit vector exceeds on ``filters`` of the directions on average, or less for ``RECALL`` of the pairs with the cosine."""
    bound = _quantile(size, min(0.5, filters / codes**2))
    if size < 2 or not -1 < cosine < 1:
        return bound
    return min(bound, float(np.quantile(_shared(size, codes, cosine), 1 - RECALL)))


def filters_of(vectors: np.ndarray, codes: int, filters: float, cosine: float = COSINE) -> list[np.ndarray]:
    """Filters of each unit vector, ascending; the best direction always belongs."""
    size = vectors.shape[1]
    rotation, left, right = _codes(size, codes)
    bound = threshold(size, codes, filters, cosine)
    turned = vectors @ rotation
    cut = size - size // 2
    a, b = turned[:, :cut] @ left.T, turned[:, cut:] @ right.T
    out = []
    for x, y, best_x, best_y in zip(a, b, a.max(axis=1), b.max(axis=1)):
        limit = min(bound, best_x + best_y) - 1e-9  # sums round
        rows, columns = np.flatnonzero(x >= limit - best_y), np.flatnonzero(y >= limit - best_x)
        i, j = np.nonzero(x[rows][:, None] + y[columns][None, :] >= limit)
        out.append(np.sort(rows[i] * codes + columns[j]))
    return out


def _decode(codes: int, filters: float, cosine: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                vectors = np.stack(list(rows["embedding"])).astype(np.float64)
                unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                yield pd.DataFrame({"node": rows["node"].array, "filters": filters_of(unit, codes, filters, cosine)})

    return work


def _linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each pair of rows has the cosine, in double precision; values next to it are computed pair by pair."""
    x, y = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    found = (a @ b.T) / np.outer(x, y)
    near = np.argwhere(np.abs(found - cosine) < 1e-9)
    for i, j in near:
        found[i, j] = np.dot(a[i], b[j]) / (x[i] * y[j])
    return found >= cosine


def _first_shared(filters: list[list[np.ndarray]], number: int) -> np.ndarray:
    """Pairs of rows of two lists that share no filter below ``number``."""
    lower = [[f[f < number] for f in part] for part in filters]
    names = np.intersect1d(*[np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *part])) for part in lower])
    grids = []
    for part in lower:
        grid = np.zeros((len(part), len(names)), dtype=np.float32)
        for row, f in enumerate(part):
            at = np.searchsorted(names, f)
            at = at[at < len(names)]
            grid[row, at[np.isin(names[at], f)]] = 1
        grids.append(grid)
    return (grids[0] @ grids[1].T) == 0 if len(names) else np.ones((len(lower[0]), len(lower[1])), dtype=bool)


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest row that each row of a symmetric matrix of links reaches."""
    roots = np.arange(len(links))
    while True:
        lower = np.where(links, roots[None, :], len(links)).min(axis=1, initial=len(links))
        lower = np.minimum(roots, lower)
        lower = lower[lower]
        if (lower == roots).all():
            return roots
        roots = lower


def _compare(cosine: float):
    """Rows of (label, size, filter, tile pair) come sorted; gives ``node, links`` and, as ``root``, a tree of the links."""

    def tile(rows: list[tuple]) -> pd.DataFrame:
        number = rows[0][2]
        sides = [[r for r in rows if r[5] == side] for side in (0, 1)]
        same = not sides[1]  # a tile with itself
        left = sides[0]
        right = left if same else sides[1]
        empty = pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        if not left or not right or (same and len(left) < 2):
            return empty
        a, b = (np.stack([r[8] for r in part]).astype(np.float64) for part in (left, right))
        links = _linked(a, b, cosine)
        if same:
            np.fill_diagonal(links, False)
        if not links.any():
            return empty
        x, y = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        links = links[np.ix_(x, y)]
        once = links & _first_shared([[left[i][9] for i in x], [right[j][9] for j in y]], number)
        nodes = [np.array([part[i][6] for i in at], dtype=np.int64) for part, at in ((left, x), (right, y))]
        weights = [np.array([part[i][7] for i in at], dtype=np.int64) for part, at in ((left, x), (right, y))]
        out = [pd.DataFrame({"node": nodes[0], "links": once @ weights[1], "root": nodes[0]})]
        if not same:
            out.append(pd.DataFrame({"node": nodes[1], "links": once.T @ weights[0], "root": nodes[1]}))
        every = nodes[0] if same else np.concatenate(nodes)
        whole = links if same else np.block([[np.zeros((len(x), len(x)), dtype=bool), links], [links.T, np.zeros((len(y), len(y)), dtype=bool)]])
        roots = _roots(whole)
        tree = roots != np.arange(len(roots))
        out.append(pd.DataFrame({"node": every[tree], "links": 0, "root": every[roots[tree]]}))
        return pd.concat(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["label", "size", "number", "first", "second", "side", "node", "weight", "embedding", "filters"]
        key, rows = None, []
        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                if row[:5] != key:
                    if rows:
                        yield tile(rows)
                    key, rows = row[:5], []
                rows.append(row)
        if rows:
            yield tile(rows)

    return work


def near_vectors(vectors: DataFrame, cosine: float = COSINE, filters: float = FILTERS, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Rows link if their labels are equal and not null, their vectors have the same length, and their cosine is at least
    ``cosine``. A null vector, one without or with null or non-finite components, or of norm zero, links with nothing, so its
    row is a group of its own. ``n_links`` counts other rows, equal vectors included; ``component_id`` is the smallest vec_id
    that links reach; ``kept`` is whether that is the row's own. Equal vectors of a label are compared once and
    always link. A null vec_id keeps its row and names a group only if no other id is there. An empty table
    gives an empty table; further columns are ignored.
    """
    slim = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    sound = F.coalesce(F.col("label").isNotNull() & good & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = slim.withColumn("sound", sound)
    distinct = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    reps = staged(distinct.select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("size")), "vectors")
    count = reps.count()
    codes = int(min(MOST_CODES, max(LEAST_CODES, np.ceil(np.sqrt(count)))))
    decoded = staged(reps.select("node", "embedding", "size").mapInPandas(_decode(codes, filters, cosine), "node long, filters array<long>"), "filters")

    spread = decoded.select("node", F.explode("filters").alias("number")).join(reps.select("node", "label", "size"), "node")
    sizes = spread.groupBy("label", "size", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile)
    mine = F.pmod(F.xxhash64("node"), parts)
    # a vector of tile t meets each tile u: the pair (min, max), on the side that says which of them it is in
    met = spread.join(sizes, ["label", "size", "number"]).select("node", "number", mine.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("u"))
    pairs = met.select("node", "number", F.least("t", "u").alias("first"), F.greatest("t", "u").alias("second"), F.when(F.col("t") > F.col("u"), 1).otherwise(0).alias("side"))
    full = pairs.join(reps.select("node", "label", "size", "weight", "embedding").join(decoded, "node"), "node")
    keys = ["label", "size", "number", "first", "second"]
    work = full.select(*keys, "side", "node", "weight", "embedding", "filters").repartition(*keys).sortWithinPartitions(*keys)
    found = staged(work.mapInPandas(_compare(cosine), "node long, links long, root long"), "compared")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root"), "node", "root")
    joined = reps.select("node", "label", "embedding", "low", "weight").join(totals, "node", "left").join(roots, "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    names = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    figures = joined.join(names, "root").select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.where("sound").join(figures, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
