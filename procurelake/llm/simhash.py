"""SimHash fingerprints of word shingles and their near copies, found with BK-trees.

A BK-tree keeps words of a discrete metric: the children of a node are keyed by their Hamming
distance to it, so a search within ``radius`` follows only edges ``d - radius .. d + radius``. One tree
over all fingerprints would neither fit a task nor prune much, hence shards: the bits are cut
into ``radius + 1`` blocks, and two fingerprints within the radius agree on one block at least. A
shard is one block value; its tree holds the fingerprints with that value and is sent, by
shuffle instead of a broadcast as trees grow with the data, to the fingerprints that may match. A
block value with more than ``SHARD`` fingerprints is split into several trees, and its fingerprints
probe each of them, so no task builds an unbounded tree and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.components import components
from procurelake.session import staged

SEED = 42
WORDS = 3
RADIUS = 2
SHARD = 4096
BITS = 64
_SLICE = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; fewer words give one shingle, none give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = [end + at for at, end in enumerate(accumulate(map(len, parts)))]
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 if more than half of the shingle hashes have it; no words: 0."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), _SLICE):
        part = values[at : at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while (far := (node[0] ^ value).bit_count()) and far in node[1]:
            node = node[1][far]
        if far:
            node[1][far] = (value, {})

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            at, children = open_nodes.pop()
            far = (at ^ value).bit_count()
            if far <= radius:
                found.append(at)
            if children:
                open_nodes += [children[d] for d in range(far - radius, far + radius + 1) if d in children]
        return found


class _Forest:
    """Links of one shard, of which a spanning forest is passed on: no row per pair."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (parent := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(parent, parent)
            x = parent
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _search(radius: int):
    """Rows come sorted by shard, members of the tree before those that only probe it."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, forest = None, BKTree(), _Forest()
        mask = (1 << BITS) - 1
        for batch in batches:
            links = []
            for block, value, part, probe, mark in batch.itertuples(index=False, name=None):
                if (block, value, part) != shard:
                    shard, tree, forest = (block, value, part), BKTree(), _Forest()
                for other in tree.within(mark & mask, radius):
                    if other != mark & mask and forest.join(mark & mask, other):
                        links.append((mark & mask, other))
                if not probe:
                    tree.add(mark & mask)
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return search


def near_links(marks: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(a, b)`` links that span every group of fingerprints (column ``mark``, distinct) within the radius."""
    width, blocks, at = BITS // (radius + 1), [], 0
    for number in range(radius + 1):
        size = width + (number < BITS % (radius + 1))
        value = F.shiftrightunsigned("mark", at).bitwiseAND(F.lit((1 << size) - 1))
        blocks.append(F.struct(F.lit(number).alias("block"), value.alias("value")))
        at += size
    keyed = marks.select("mark", F.explode(F.array(*blocks)).alias("k")).select("k.block", "k.value", "mark")
    sizes = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / shard)
    own = F.pmod(F.xxhash64("mark"), parts)
    rows = (
        keyed.join(sizes, ["block", "value"])
        .select("block", "value", "mark", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        .select("block", "value", "part", (F.col("own") != F.col("part")).alias("probe"), "mark")
        .repartition("block", "value", "part")
        .sortWithinPartitions("block", "value", "part", "probe", "mark")
    )
    return rows.mapInPandas(_search(radius), "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``doc_id, text_key, mark, root, component_id`` of each row: its fingerprint, the smallest one it reaches, and the smallest doc_id."""
    key = F.xxhash64(F.col("text").cast("string")).alias("text_key")
    marks = staged(docs.select(F.col("doc_id").cast("long"), key, _fingerprints(F.col("text").cast("string")).alias("mark")), "marks")
    lows = staged(marks.groupBy("mark").agg(F.min("doc_id").alias("low")), "lows")
    links = staged(near_links(lows.select("mark"), radius, shard), "near")
    roots = components(links)
    linked = lows.join(roots, lows["mark"] == roots["node"]).select("mark", "low", "root")
    named = linked.groupBy("root").agg(F.min("low").alias("reached"))
    linked = linked.select("mark", "root").join(named, "root").select("mark", "root", "reached")
    found = lows.join(linked, "mark", "left").select("mark", F.coalesce("root", "mark").alias("root"), F.coalesce("reached", "low").alias("component_id"))
    return marks.join(found, "mark").select("doc_id", "text_key", "mark", "root", "component_id")


def near_copies(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs`` (``doc_id``, ``text``).

    The fingerprint is 16 lower-case hex digits. ``component_id`` is the smallest doc_id that links
    of at most ``radius`` differing bits reach. A null or empty text has no words and fingerprint zero, which
    links like any other; repeated rows and equal texts share a fingerprint, so they are searched
    once; a null doc_id keeps its row and never names a group unless no other id is there; an empty
    table gives an empty table; further columns are ignored.
    """
    mark = F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint")
    return grouped(docs, radius, shard).select("doc_id", mark, "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that of the smallest doc_id, of equals the smallest text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    kept = grouped(docs, radius).groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keyed = docs.withColumn("_row_id", F.col("doc_id").cast("long")).withColumn("_row_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_row_id", "_row_key"]).drop("_row_id", "_row_key")
