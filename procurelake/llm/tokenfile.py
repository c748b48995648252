"""Token ids in Parquet: one list column, controlled row groups, page indexes, and selective reads.

``write`` encodes texts and stores one row per document in ascending ``doc_id``: ``doc_id``, ``part`` and ``at`` (which file the row
is in, and how many ids stand before it there), ``n_tokens`` and ``ids``. Ids are dictionary-encoded, and delta-packed
where a dictionary grows too large; ``doc_id`` and ``at`` are ascending, so the row groups' statistics and the
page index let a range of documents be read without the rest, and figures without the ids.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procurelake.llm.units import UnitEncoder, groups

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Parquet writer: version 2 pages fall back from dictionary to delta encoding.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> UnitEncoder:
    return UnitEncoder(path, end_id)


def write(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and store the ids with ``end_id`` after each document.

    A null or empty text is the end id alone. Rows with equal doc_id are all kept, side by side; a null doc_id
    sorts first. A long text is a group of its own, encoded unit by unit in slices, however many distinct units it has. An
    empty table writes an empty file. Further columns are ignored. Documents are
    range-partitioned by doc_id and a hash of the text, which also splits an id that many rows share.
    """
    path = path or vocabulary_path()

    def work(batches):
        tool, part, at = encoder(path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for group in groups([text or "" for text in batch.column("text").to_pylist()]):
                ids, sizes = tool.encode(group)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                docs = batch.column("doc_id").slice(row, len(group)).cast(pa.int64())
                columns = [docs, pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends[:-1]), pa.array(sizes), lists]
                row, at = row + len(group), at + int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashed = slim.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    writer = ordered.select("doc_id", "text").mapInArrow(work, SCHEMA).write
    for key, value in LAYOUT.items():
        writer = writer.option(key, value)
    writer.parquet(target)


def read(spark: SparkSession, target: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of a written file; ``low`` and ``high`` bound doc_id and skip row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(target)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows


def starts(spark: SparkSession, target: str) -> DataFrame:
    """``part, before``: ids of all earlier files. Reads two columns; one row per file is ordered."""
    totals = read(spark, target).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _sums(batches):
    """CRC-32 of each list of ids, straight from the Arrow buffers."""
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("at"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each stored document, from the files."""
    rows = read(spark, target).mapInArrow(_sums, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, target), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
