"""Incremental loading: unseen files, changed files, hashes written once.

The stream twin keeps its file ledger in the checkpoint; every micro-batch writes
a folder of its own, named after query and batch, and compares with the hashes of all others, so that a
batch repeated after a failure replaces its own output and never loses or doubles a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from procurelake.operators import dedup
from procurelake.session import staging
from procurelake.sources import scans

STREAM, BATCH = "stream", "batch"
FILES_PER_BATCH = 1000
#: Folders of the hash ledger.
BUCKETS = 256


# ------------------------------------------------------------------ batch twin
def unseen_files(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Files of the listing that are not in the ledger of processed paths."""
    return listing.join(processed.select("path"), "path", "left_anti")


def read_unseen(listing: DataFrame, processed: DataFrame, schema: T.StructType | str, base: str, kind: str = "parquet") -> DataFrame:
    """Rows of the files that the ledger lacks; no other file is opened or even listed by the scan.

    Paths go to the scan as any list of files does, through the driver; rows don't. Partition columns come from the
    folders below ``base``.
    """
    spark = listing.sparkSession
    paths = [row.path for row in unseen_files(listing, processed).select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).format(kind).load(paths)


def changed_files(digests: DataFrame, extracted: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from the ledger's latest entry."""
    known = extracted.groupBy("key").agg(F.max_by("md5_hash", "timestamp").alias("_known"))
    return (
        digests.join(known, "key", "left")
        .where(F.col("_known").isNull() | (F.col("_known") != F.col("md5_hash")))
        .drop("_known")
    )


def changed_since(listing: DataFrame, extracted: DataFrame) -> DataFrame:
    """Files of the listing that may have changed: new ones, and those whose size or time of modification is not the one
    in the ledger's latest entry (``size_bytes``, ``modified``). No file is opened."""
    known = extracted.groupBy("key").agg(F.max_by(F.struct("size_bytes", "modified"), "timestamp").alias("_known"))
    files = listing.select(F.col("path").alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    same = F.col("_known")["size_bytes"].eqNullSafe(F.col("size_bytes")) & F.col("_known")["modified"].eqNullSafe(F.col("modified"))
    return files.join(known, "key", "left").where(~F.coalesce(same, F.lit(False))).drop("_known")


def changed_digests(listing: DataFrame, extracted: DataFrame) -> DataFrame:
    """``key, md5_hash, size_bytes, modified`` of the files that are new or whose content differs from the ledger's latest entry.

    Only files that ``changed_since`` names are opened; their paths go to the scan through the driver, their content doesn't.
    """
    spark = listing.sparkSession
    maybe = changed_since(listing, extracted)
    paths = [row.key for row in maybe.select("key").toLocalIterator()]
    fresh = scans.file_digests(spark, paths, modified=True) if paths else maybe.select("key", F.lit("").alias("md5_hash"), "size_bytes", "modified")
    known = extracted.groupBy("key").agg(F.max_by("md5_hash", "timestamp").alias("_known"))
    return fresh.join(known, "key", "left").where(~F.col("_known").eqNullSafe(F.col("md5_hash"))).drop("_known")


def pending_keys(wanted: DataFrame, extracted: DataFrame, key: str = "key") -> DataFrame:
    """Publications and years not extracted so far."""
    return wanted.join(extracted.select(key), key, "left_anti")


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ledger, empty before its first entry."""
    if not scans.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def ledger_totals(extracted: DataFrame) -> DataFrame:
    """Files and records over the latest entry of each key, and the time of the last run."""
    latest = extracted.groupBy("key").agg(
        F.max_by("record_count", "timestamp").alias("record_count"), F.max("timestamp").alias("timestamp")
    )
    return latest.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
        F.max("timestamp").alias("last_run"),
    )


# ----------------------------------------------------------------- stream twin
def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files_per_batch: int = FILES_PER_BATCH, **options) -> DataFrame:
    """Stream of the files below ``path``; files already seen are in the checkpoint of the query.

    A backlog is taken in batches of ``files_per_batch`` files.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).format(kind).load(path)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns the checkpoint; a new checkpoint has a new one."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _ledger_path(target: str) -> str:
    return f"{target.rstrip('/')}_hashes"


def _bucket(hash_column: str = "record_hash") -> Column:
    return F.pmod(F.crc32(F.col(hash_column).cast("binary")), F.lit(BUCKETS)).cast("int")


def hash_ledger(spark: SparkSession, target: str) -> DataFrame:
    """Hashes stored in ``target`` with the query and batch that stored them, in folders by bucket of the hash."""
    schema = T.StructType([
        T.StructField("record_hash", T.StringType()), T.StructField(STREAM, T.StringType()),
        T.StructField(BATCH, T.LongType()), T.StructField("bucket", T.IntegerType()),
    ])
    path = _ledger_path(target)
    if not scans.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def seen_hashes(spark: SparkSession, target: str, records: DataFrame, stream: str, batch_id: int) -> DataFrame:
    """Hashes that other batches have stored, from the buckets of ``records`` alone: at most ``BUCKETS`` numbers are fetched."""
    buckets = [row[0] for row in records.select(_bucket().alias("bucket")).distinct().collect() if row[0] is not None]
    stored = hash_ledger(spark, target).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
    return stored.where((F.col(STREAM) != stream) | (F.col(BATCH) != batch_id)).select("record_hash")


def _note_hashes(rows: DataFrame, target: str, stream: str, batch_id: int) -> None:
    """Adds a batch to the ledger, one file for each bucket it has, and marks it as noted."""
    spark = rows.sparkSession
    named = rows.where(F.col("record_hash") != "").select(
        "record_hash", F.lit(stream).alias(STREAM), F.lit(batch_id).cast("bigint").alias(BATCH), _bucket().alias("bucket")
    )
    path = _ledger_path(target)
    named.hint("rebalance", "bucket").sortWithinPartitions("bucket", "record_hash").write.mode("append").partitionBy("bucket").parquet(path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_noted/{stream}-{batch_id}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def _note_missing(spark: SparkSession, target: str) -> None:
    """Notes the batches that were stored before there was a ledger, or whose run failed before they were noted."""
    if not scans.exists(spark, target):
        return
    jvm = spark._jvm
    store = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/{STREAM}=*/{BATCH}=*")) or []
    for status in found:
        folder = status.getPath()
        stream, batch = folder.getParent().getName().split("=", 1)[1], folder.getName().split("=", 1)[1]
        if not scans.exists(spark, f"{_ledger_path(target)}/_noted/{stream}-{batch}"):
            _note_hashes(spark.read.schema("record_hash string").parquet(folder.toString()), target, stream, int(batch))


def compact_hashes(spark: SparkSession, target: str) -> None:
    """One sorted run for each bucket of the ledger instead of one file per batch. No query into the target runs meanwhile."""
    with staging(hash_ledger(spark, target).distinct()) as whole:
        ordered = whole.hint("rebalance", "bucket").sortWithinPartitions("bucket", "record_hash")
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
        writer.parquet(_ledger_path(target))


def write_once(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    order: list[Column],
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Run over all files present, then stop; each ``record_hash`` is written once over all runs.

    A folder belongs to one batch of one query, so queries with checkpoints of their own add to the same target without
    touching each other's rows, and a lost checkpoint writes nothing twice. Queries into one target run one after the other.
    Hashes are also kept in a ledger beside the target, by bucket, of which a batch reads the buckets of its own hashes. A
    batch is noted there after it was stored; one that a failure left out is noted when the next query begins.
    """
    _note_missing(stream.sparkSession, target)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = _query_id(spark, checkpoint)
        # Staged, since the comparison and the write both read the batch.
        with staging(transform(batch) if transform else batch) as records:
            fresh = dedup.new_records(records, seen_hashes(spark, target, records, query, batch_id), order)
            folder = f"{target}/{STREAM}={query}/{BATCH}={batch_id}"
            fresh.write.mode("overwrite").parquet(folder)
            _note_hashes(spark.read.schema("record_hash string").parquet(folder), target, query, batch_id)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unique_within(stream: DataFrame, event_time: str, delay: str, hash_column: str = "record_hash") -> DataFrame:
    """Pure-stream variant with bounded state: a hash is unique within ``delay`` of event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([hash_column])
