"""Exact grouped median by rank selection, without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer,
and a window per group sorts it in one task. Here values are counted per (group, value), the counts are
range-partitioned once by (group, value) and stored with the number of their partition. The totals per group and
partition tell which one or two partitions of a group hold its middle ranks, and only those partitions are
read again and ranked. Partitions are of even size whatever the values are, so neither a large group nor values that lie
close together make a large task.

The counts are stored, not only shuffled, since both steps must see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.session import staged


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str = "median", times: Column | None = None) -> DataFrame:
    """One row per group of non-NULL ``keys``: the keys and the median of the present values.

    A row stands for ``times`` equal values, one by default.
    """
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, number.alias("_v"), (F.lit(1) if times is None else times).cast("bigint").alias("_n"))
    for key in [*keys, "_v"]:
        rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    stored = staged(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    totals = stored.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in_part"))
    running = Window.partitionBy(*keys).orderBy("_part")
    whole = F.sum("_in_part").over(Window.partitionBy(*keys))
    placed = totals.withColumns(
        {
            "_start": F.sum("_in_part").over(running) - F.col("_in_part"),
            "_lo": F.floor((whole + 1) / 2),
            "_hi": F.floor(whole / 2 + 1),
        }
    )
    upto = F.col("_start") + F.col("_in_part")
    held = placed.where(_covers("_lo", F.col("_start"), upto) | _covers("_hi", F.col("_start"), upto)).drop("_in_part")
    within = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = stored.join(held, [*keys, "_part"]).withColumn("_to", F.col("_start") + F.sum("_n").over(within))
    before = F.col("_to") - F.col("_n")
    return (
        ranked.groupBy(*keys)
        .agg(
            F.max(F.when(_covers("_lo", before, F.col("_to")), F.col("_v"))).alias("_a"),
            F.max(F.when(_covers("_hi", before, F.col("_to")), F.col("_v"))).alias("_b"),
        )
        .select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))
    )


def _covers(rank: str, before: Column, upto: Column) -> Column:
    return (F.col(rank) > before) & (F.col(rank) <= upto)
