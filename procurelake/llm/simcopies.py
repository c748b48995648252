"""Near copies by Jaccard similarity of word shingles: candidates by wide SimHash fingerprints and BK-trees, each verified on whole sets.

64 bits don't tell texts of similarity 0.8 apart from others, as a bit differs with probability 0.15 there. So the fingerprint has ``WORDS64``
words of 64 bits, the majority over the shingle set under that many hashes; at 0.8 some 38 of 256 bits differ, 128 between other texts,
and ``RADIUS`` lies far from both. No block of bits must agree within such a radius, so fingerprints meet in the BK-trees of as many drawn
blocks as ``MISS`` asks for; blocks are the wider the more texts there are, which keeps trees small. What the trees link are groups of
candidates, thin rows only. Then each text's shingle set goes once to its group, where pairs are compared exactly; a group of more than
``TILE`` texts or ``TILE_BYTES`` is cut into tiles, every pair of which is a piece of work that passes on a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.components import components
from procurelake.llm.minhash import SIMILARITY, WORDS, _sets, _verify, shingle_set
from procurelake.llm.simhash import BITS, SHARD, BKTree, _Forest
from procurelake.session import staged

WORDS64 = 4
RADIUS = 64
#: A bit's probability to differ that is counted with, and the probability of missing a pair that is then left.
DIFFERS, MISS = 0.17, 1e-3
LEAST_BITS, TREE = 6, 64
TILE, TILE_BYTES = 1024, 16 << 20
SEED = 20240612
_SLICE = 1 << 12
_TURNS, _FACTORS = (x.astype(np.uint64) for x in np.random.default_rng(SEED).integers(0, 2**64, (2, WORDS64), dtype=np.uint64))
_WORDS = [f"w{i}" for i in range(WORDS64)]


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``WORDS64`` signed words; a bit is 1 if more than half of the shingles have it under the word's hash; no shingles: zeros."""
    ones = np.zeros(WORDS64 * BITS, dtype=np.int64)
    for at in range(0, len(shingles), _SLICE):
        mixed = (shingles[at : at + _SLICE, None] ^ _TURNS) * (_FACTORS | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")


def _marks(words: int):
    @F.pandas_udf(T.StructType([T.StructField(w, T.LongType()) for w in _WORDS]))
    def marks(texts: pd.Series) -> pd.DataFrame:
        found = np.array([wide_fingerprint(shingle_set(x, words)) for x in texts], dtype=np.int64)
        return pd.DataFrame(found.reshape(-1, WORDS64), columns=_WORDS)

    return marks


def drawn_blocks(texts: int, tree: int = TREE) -> list[list[int]]:
    """Places of the bits of each block for that many texts."""
    width = max(LEAST_BITS, math.ceil(math.log2(max(1, texts / tree))))
    number = math.ceil(math.log(MISS) / math.log1p(-((1 - DIFFERS) ** width)))
    rng = np.random.default_rng(SEED)
    return [sorted(map(int, rng.choice(WORDS64 * BITS, width, replace=False))) for _ in range(number)]


def _values(blocks: list[list[int]]):
    """The number that a fingerprint's bits give in each block. A function, as plans with expressions for each bit fill the driver."""
    places = np.array(blocks)
    weights = 1 << np.arange(places.shape[1], dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def values(*words: pd.Series) -> pd.Series:
        marks = np.stack([w.to_numpy(dtype="<i8") for w in words], axis=1)
        found = []
        for at in range(0, len(marks), 1024):
            part = np.ascontiguousarray(marks[at : at + 1024])
            bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            found += list(bits[:, places].astype(np.int64) @ weights)
        return pd.Series(found, dtype=object)

    return values(*_WORDS)


def _search(radius: int):
    """Rows come sorted by shard, members of the tree before those that only probe it."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, forest, nodes = None, BKTree(), _Forest(), {}
        for batch in batches:
            links = []
            marks = np.ascontiguousarray(batch[_WORDS].to_numpy(dtype="<i8"))
            keys = batch[["block", "value", "part", "probe", "node"]].itertuples(index=False, name=None)
            for row, (block, value, part, probe, node) in enumerate(keys):
                if (block, value, part) != shard:
                    shard, tree, forest, nodes = (block, value, part), BKTree(), _Forest(), {}
                mark = int.from_bytes(marks[row].tobytes(), "little")
                for other in tree.within(mark, radius):
                    if nodes[other] != node and forest.join(node, nodes[other]):
                        links.append((node, nodes[other]))
                if not probe and mark not in nodes:
                    tree.add(mark)
                    nodes[mark] = node
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return search


def candidate_links(marks: DataFrame, texts: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(a, b)`` links that span, within every block value, the groups of fingerprints (``node`` and its words) within the radius."""
    keyed = marks.select("node", *_WORDS, F.posexplode(_values(drawn_blocks(texts))).alias("block", "value"))
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)  # reads the words only
    parts = F.ceil(F.col("n") / shard)
    own = F.pmod(F.xxhash64("node"), parts)
    rows = (
        keyed.join(sizes, ["block", "value"])
        .select("block", "value", "node", *_WORDS, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        .select("block", "value", "part", (F.col("own") != F.col("part")).alias("probe"), "node", *_WORDS)
        .repartition("block", "value", "part")
        .sortWithinPartitions("block", "value", "part", "probe", "node")
    )
    return rows.mapInPandas(_search(radius), "a long, b long")


def _tiles(groups: DataFrame, sets: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """Rows of ``_verify``: a text of tile t meets each tile u of its group, on the side that says which of them it is in."""
    members = groups.join(sets, "node").select("root", "node", "shingles")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / tile_bytes))
    met = members.join(sizes, "root").withColumn("parts", parts).withColumn("t", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = met.select("root", "node", "shingles", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("u"))
    keys = ["band", "root", "first", "second"]
    pair = (F.least("t", "u").alias("first"), F.greatest("t", "u").alias("second"), F.when(F.col("t") > F.col("u"), 1).otherwise(0).alias("side"))
    return met.select(F.lit(0).alias("band"), "root", *pair, "node", "shingles").repartition(*keys[1:]).sortWithinPartitions(*keys, "node")


def keep_one(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS, tile: int = TILE, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """``docs``, all columns, with one row of each group of texts that links of at least ``similarity`` join.

    Kept is the row of the smallest doc_id, of equals that of the smallest text hash. Similarity is the Jaccard similarity of the
    sets of shingles of ``words`` words; a shorter text is one shingle. ``radius`` and the blocks are made for 0.8 and more. Null and
    empty texts have none and are near copies of each other; a long text is compared by its whole set; a null doc_id is kept only where
    a group has no other; repeated rows are one; an empty table gives an empty table. ``docs`` has no columns ``_id``, ``_key``,
    ``_row_id``, ``_row_key``.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64(text)
    # null and empty texts have the fingerprint zero and meet in every block
    marks = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("node"), _marks(words)(text).alias("m")).select("doc_id", "node", "m.*"), "marks")
    nodes = staged(marks.dropDuplicates(["node"]).drop("doc_id"), "nodes")
    links = staged(candidate_links(nodes, nodes.count(), radius), "candidates")
    groups = staged(components(links), "groups")
    texts = docs.select(key.alias("node"), text.alias("text")).join(groups.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = staged(texts.select("node", _sets(words)("text").alias("shingles")), "sets")
    near = staged(_tiles(groups, sets, tile, tile_bytes).mapInPandas(_verify(similarity), "a long, b long"), "near")
    roots = components(near)
    grouped = marks.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "node")
    kept = grouped.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.node").alias("_key"))
    keyed = docs.withColumn("_row_id", F.col("doc_id").cast("long")).withColumn("_row_key", key)
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_row_id", "_row_key"]).drop("_row_id", "_row_key")
