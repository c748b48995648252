"""Bronze to Silver: quality report, deduplication against what is stored, partitioned append."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake import schemas
from procurelake.operators import dedup, profile, quality
from procurelake.session import staging
from procurelake.sinks import writers
from procurelake.sources import commits, scans


# The hash covers the publication date, so equal hashes lie in the same year and month.
_STORED = "record_hash string, year string, month string"


def stored_hashes(spark, path: str, batches: list[str] | None = None) -> DataFrame:
    """Hashes already stored, with their partition: columns of the Silver table, nothing kept beside it.

    Those of all committed batches, or of some.
    """
    if not scans.exists(spark, path) or not commits.folders(spark, path):
        return spark.createDataFrame([], _STORED)
    known = commits.committed(spark, path)
    stored = spark.read.schema(_STORED).option("basePath", path).parquet(path)
    hidden = commits.hidden(spark, path, known)
    if batches is not None:
        stored = stored.where(F.col(commits.BATCH).isin(*batches))
    elif hidden:
        stored = stored.where(~F.col(commits.BATCH).isin(*hidden))
    return stored.select("record_hash", "year", "month")


def load_silver(
    records: DataFrame,
    path: str,
    order: list[Column],
    as_of: str,
    source: str,
    report_path: str | None = None,
    deduplicate: bool = True,
) -> DataFrame:
    """Append the new records of ``records`` to ``path``.

    The records are computed once and staged, since report, ledger comparison and write
    all read them. The comparison reads only the months that the records touch.

    ``order`` holds plain columns that tell all rows apart; columns named ``_…`` only serve it
    and are not stored. Returns rows per partition as written by this call. The batch folder is
    named after the run, so that it can be read back alone; the staged copy goes when it is written.

    Loads may run at the same time: a batch counts once it is in the table's commit log. If others were committed meanwhile, the rows
    of this batch whose hash they hold are taken out before it is tried again; what a load that failed has left is never read.
    """
    spark = records.sparkSession
    last = commits.begin(spark, path)
    run = _run_name()
    folder = f"{path}/{commits.BATCH}={run}"
    with staging(records) as stored:
        rows = writers.silver_rows(stored)
        if report_path:
            writers.write_report(quality.full_report(rows, as_of, source), report_path)
        fresh = rows
        months = _months_of(rows) if deduplicate else None
        if deduplicate:
            seen = stored_hashes(spark, path).where(months)
            fresh = dedup.new_records(rows, seen, order, also=("year", "month"))
        writers.write_silver(fresh.select(*[c for c in fresh.columns if not c.startswith("_")]), folder)
        while not commits.claim(spark, path, last + 1, run):
            later = commits.entries(spark, path, last)
            last = max(number for number, _ in later)
            if deduplicate:
                beaten = stored_hashes(spark, path, [batch for _, batch in later]).where(months)
                run, folder = _without(folder, path, beaten)
    written = spark.read.schema("source_country string, year string, month string").parquet(folder)
    return profile.partition_stats(written, writers.SILVER_KEYS)


def _without(folder: str, path: str, seen: DataFrame) -> tuple[str, str]:
    """A batch written anew without the rows whose hash is in ``seen``; the old folder goes."""
    spark = seen.sparkSession
    fields = [f for f in schemas.SILVER_SCHEMA.fields if f.name not in writers.SILVER_KEYS]
    kept = spark.read.schema(T.StructType(fields + [T.StructField(k, T.StringType()) for k in writers.SILVER_KEYS])).parquet(folder)
    run = _run_name()
    hashes = seen.where(F.col("record_hash") != "").select("record_hash").distinct()
    writers.write_silver(kept.join(hashes, "record_hash", "left_anti").select(*kept.columns), f"{path}/{commits.BATCH}={run}")
    scans.delete(spark, folder)
    return run, f"{path}/{commits.BATCH}={run}"


def _months_of(rows: DataFrame) -> Column:
    """The partitions that ``rows`` touch, as literals that the scan of the stored table is pruned by.

    The list is one entry per calendar month, so it is bounded by the years that publications span.
    """
    months: dict[str, list[str]] = {}
    for year, month in rows.select("year", "month").distinct().collect():
        months.setdefault(year, []).append(month)
    found = F.lit(False)
    for year, of_year in sorted(months.items()):
        found = found | ((F.col("year") == year) & F.col("month").isin(*sorted(of_year)))
    return found


def _run_name() -> str:
    """Sorts by time and is unique to the run, so that loads at the same time keep apart."""
    return f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def silver_totals(spark, path: str) -> DataFrame:
    """Files, records and size per country of a stored Silver table."""
    known = commits.committed(spark, path)
    scan = spark.read.schema("source_country string").parquet(path)
    hidden = commits.hidden(spark, path, known)
    if hidden:
        scan = scan.where(commits.counts(F.col("_metadata.file_path"), hidden))
    return profile.file_stats(scan, ["source_country"]).orderBy(F.col("source_country"))
