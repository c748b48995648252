"""Near copies by Jaccard similarity of word shingles: candidates from bands of MinHashes, each verified on the whole shingle sets.

Fingerprints of 64 bits don't tell texts of similarity 0.8 apart from others at a radius that can be searched, so texts meet
where all ``ROWS`` MinHashes of one of ``BANDS`` bands are equal. Two texts of similarity s miss each other with probability
(1 - s^ROWS)^BANDS, which is 3e-6 at 0.8 and less above. Equal texts are one node. Shingle sets are computed again for the
texts that share a band value and compared there; a value with more than ``TILE`` texts is cut into tiles, every pair of which
is a piece of work of its own and passes on a spanning forest instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.components import components
from procurelake.llm.simhash import _Forest, shingle_hashes
from procurelake.session import staged

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
TILE = 1024
SEED = 20240612
_SLICE = 1 << 12


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    turns, factors = rng.integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    return turns, factors | np.uint64(1)


_TURNS, _FACTORS = _permutations()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed hash of the MinHashes of each band; all texts without words have the same."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), _SLICE):
        part = shingles[at : at + _SLICE, None]
        least = np.minimum(least, ((part ^ _TURNS) * _FACTORS).min(axis=0))
    digests = [xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(BANDS, ROWS)]
    return [int(x) for x in np.array(digests, dtype=np.uint64).view(np.int64)]


def _sketch(words: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([bands(shingle_set(x, words)) for x in texts], dtype=object)

    return sketch


def _sets(words: int):
    @F.pandas_udf(T.BinaryType())
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, words).tobytes() for x in texts], dtype=object)

    return sets


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets reach the Jaccard similarity; two empty ones do."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (low + high - both)


def _verify(similarity: float):
    """Rows come sorted by band, value and tile pair."""

    def tile(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sides = [[(node, np.frombuffer(data, dtype=np.uint64)) for *_, at, node, data in rows if at == side] for side in (0, 1)]
        forest = _Forest()
        same = not sides[1]  # a tile with itself
        for number, (x, a) in enumerate(sides[0]):
            for y, b in sides[0][:number] if same else sides[1]:
                if forest.find(x) != forest.find(y) and similar(a, b, similarity):
                    forest.join(x, y)
                    yield x, y

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def found() -> pd.DataFrame:
            return pd.DataFrame([*tile(rows)], columns=["a", "b"], dtype="int64")

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[:4] != key:
                    if len(rows) > 1 and (key[2] == key[3] or {r[4] for r in rows} == {0, 1}):
                        yield found()
                    key, rows = row[:4], []
                rows.append(row)
        if len(rows) > 1 and (key[2] == key[3] or {r[4] for r in rows} == {0, 1}):
            yield found()

    return work


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, tile: int = TILE) -> DataFrame:
    """``docs``, all columns, with one row of each group of texts that links of at least ``similarity`` join.

    Kept is the row of the smallest doc_id, of equals that of the smallest text hash. Similarity is the Jaccard similarity of the
    sets of shingles of ``words`` words; a shorter text is one shingle. Null and empty texts have none and are near copies
    of each other; a long text is compared by its whole set; a null doc_id is kept only where a group has no other; repeated rows are
    one; an empty table gives an empty table. ``docs`` has no columns ``_id``, ``_key``, ``_row_id``, ``_row_key``.
    """
    text = F.col("text").cast("string")
    key = F.xxhash64(text)
    marks = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), _sketch(words)(text).alias("bands")), "bands")
    spread = marks.dropDuplicates(["text_key"]).select(F.col("text_key").alias("node"), F.posexplode("bands").alias("band", "value"))
    sizes = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile)
    mine = F.pmod(F.xxhash64("node"), parts)
    # a text of tile t meets each tile u: the pair (min, max), on the side that says which of them it is in
    met = spread.join(sizes, ["band", "value"]).select("band", "value", "node", mine.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("u"))
    met = staged(met.select("band", "value", F.least("t", "u").alias("first"), F.greatest("t", "u").alias("second"), F.when(F.col("t") > F.col("u"), 1).otherwise(0).alias("side"), "node"), "met")
    texts = docs.select(key.alias("node"), text.alias("text")).join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = staged(texts.select("node", _sets(words)("text").alias("shingles")), "sets")
    keys = ["band", "value", "first", "second"]
    rows = met.join(sets, "node").select(*keys, "side", "node", "shingles").repartition(*keys).sortWithinPartitions(*keys, "node")
    roots = components(staged(rows.mapInPandas(_verify(similarity), "a long, b long"), "near"))
    grouped = marks.join(roots, marks["text_key"] == roots["node"], "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    kept = grouped.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keyed = docs.withColumn("_row_id", F.col("doc_id").cast("long")).withColumn("_row_key", key)
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_row_id", "_row_key"]).drop("_row_id", "_row_key")
