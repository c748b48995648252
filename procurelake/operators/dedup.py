"""Deduplication by key or record hash.

``row_number() <= k`` is planned with a group limit before the shuffle, so of a
hot key every map task sends k rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``, a total order; NULL keys are equal to each other."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def _has_hash(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def unique_records(df: DataFrame, order: list[Column], hash_column: str = "record_hash") -> DataFrame:
    """First row per hash; rows without a hash are dropped."""
    return keep_first(df.where(_has_hash(hash_column)), [hash_column], order)


def new_records(
    batch: DataFrame,
    seen: DataFrame,
    order: list[Column],
    hash_column: str = "record_hash",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of ``batch`` not in ``seen``, first per hash; rows without a hash pass.

    ``order`` holds plain columns that together tell all rows apart. ``also`` names
    columns of both sides that follow from the hash, such as the partition columns of
    ``seen``: joined as well, they let Spark skip partitions without a match.

    ``seen`` is first cut down to the hashes of the batch: with a small batch
    that is a broadcast and the large ledger is streamed without a shuffle.
    """
    keys = [hash_column, *also]
    # A row without a hash is a group of its own, so that one pass serves both kinds. The comparison is by the same column, so
    # that whole rows cross one shuffle for both steps.
    hashed = _has_hash(hash_column)
    group = F.struct(F.when(hashed, F.col(hash_column)).alias("hash"), F.when(~hashed, F.struct(*order)).alias("alone"))
    marked = batch.withColumn("_group", group)
    nothing = F.lit(None).cast(marked.schema["_group"].dataType["alone"].dataType)
    fresh = keep_first(marked, ["_group"], order)
    hashes = batch.where(hashed).select(*keys).distinct()
    known = seen.select(*keys).join(hashes, keys, "left_semi").select(hash_column).distinct()
    known = known.select(F.struct(F.col(hash_column).alias("hash"), nothing.alias("alone")).alias("_group"))
    return fresh.join(known, "_group", "left_anti").select(*batch.columns)


def new_records_stats(
    batch: DataFrame, seen: DataFrame, order: list[Column], hash_column: str = "record_hash"
) -> DataFrame:
    """total_input, new_records and duplicates_skipped as one row."""
    read = batch.select(F.lit(1).alias("read"), F.lit(0).alias("new"))
    kept = new_records(batch, seen, order, hash_column).select(F.lit(0).alias("read"), F.lit(1).alias("new"))
    return (
        read.unionAll(kept)
        .agg(F.sum("read").alias("total_input"), F.sum("new").alias("new_records"))
        .withColumn("duplicates_skipped", F.col("total_input") - F.col("new_records"))
    )


def mark_latest(
    df: DataFrame, seq: str, hash_column: str = "record_hash", stamp: str = "processing_timestamp"
) -> DataFrame:
    """Adds ``is_latest``: true on the newest row of each hash, the last one on ties.

    Winners are found by a partially aggregated maximum and marked by a join on
    the unique ``seq``, so that no task receives a whole group.
    """
    rank = F.struct(F.coalesce(F.col(stamp), F.lit("")), F.col(seq))
    winners = df.groupBy(hash_column).agg(F.max(rank).alias("_top"))
    marks = winners.select(F.col("_top")[seq].alias(seq), F.lit(True).alias("is_latest"))
    return df.join(marks, seq, "left").withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


def duplicate_groups(df: DataFrame, hash_column: str = "record_hash") -> DataFrame:
    """Hashes occurring more than once with their number of rows; rows without a hash are no group."""
    return df.where(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


def duplicate_members(df: DataFrame, hash_column: str = "record_hash") -> DataFrame:
    """Every row that belongs to a duplicate group, with the size of its group.

    Members stay rows: a group is never gathered in a list. The sizes are one row per hash, counted before the
    shuffle; adaptive execution splits the rows of a large group over several tasks of the join.
    """
    return df.where(F.col(hash_column).isNotNull()).join(duplicate_groups(df, hash_column), hash_column)


def duplicate_summary(df: DataFrame, hash_column: str = "record_hash") -> DataFrame:
    """One row: records, unique hashes, duplicate groups, surplus rows, rate. A row without a hash is unique."""
    sizes = df.groupBy(F.col(hash_column).alias("hash")).agg(F.count("*").alias("n"))
    named = F.col("hash").isNotNull()
    totals = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum(F.when(named, 1).otherwise(F.col("n"))), F.lit(0)).alias("unique_hashes"),
        F.count_if(named & (F.col("n") > 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(named & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("duplicate_records"),
    )
    rate = 1 - F.col("unique_hashes") / F.col("total_records")
    return totals.withColumn(
        "deduplication_rate", F.when(F.col("total_records") > 0, rate).otherwise(F.lit(0.0))
    )


def duplicate_report(
    df: DataFrame, order: list[Column], hash_column: str = "record_hash", groups: int = 5, members: int = 3
) -> DataFrame:
    """The largest duplicate groups with the first members of each.

    The broadcast side holds ``groups`` rows by construction.
    """
    largest = (
        duplicate_groups(df, hash_column)
        .orderBy(F.col("occurrences").desc(), F.col(hash_column))
        .limit(groups)
    )
    rows = df.join(F.broadcast(largest), hash_column)
    place = F.row_number().over(Window.partitionBy(hash_column).orderBy(*order))
    return rows.withColumn("member", place).where(F.col("member") <= members)
