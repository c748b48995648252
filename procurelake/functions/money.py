"""Sums of money that do not depend on task order.

A double sum changes in its last digits with the order of partitions and with
every retried task. Amounts are therefore added as fixed-point numbers; a group
holding an amount too large for that falls back to the double sum, so no value
is lost. Sums come in one step, or as partial sums that are stored and merged later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_POINT = "decimal(38,6)"


def money_sum(c: Column) -> Column:
    """Sum as double, 0.0 for a group without any value."""
    fixed = c.try_cast(FIXED_POINT)
    exact = F.try_sum(fixed).cast("double")
    return F.coalesce(F.when(F.count(fixed) == F.count(c), exact), F.sum(c), F.lit(0.0))


def money_avg(c: Column) -> Column:
    """Mean over the present values, NULL for none."""
    return F.when(F.count(c) > 0, money_sum(c) / F.count(c))


def money_partials(c: Column) -> list[Column]:
    """``value_sum`` in fixed point, NULL where it doesn't hold all values, ``value_double`` and ``value_count``."""
    fixed = c.try_cast(FIXED_POINT)
    whole = F.when(F.count(fixed) == F.count(c), F.try_sum(fixed))
    return [whole.alias("value_sum"), F.sum(c).alias("value_double"), F.count(c).alias("value_count")]


def merged_partials() -> list[Column]:
    """The same three columns for groups of such rows."""
    return [_exact().alias("value_sum"), F.sum("value_double").alias("value_double"), F.sum("value_count").alias("value_count")]


def _exact() -> Column:
    lost = F.count_if(F.col("value_sum").isNull() & (F.col("value_count") > 0))
    return F.when(lost == 0, F.try_sum("value_sum"))


def merged_sum() -> Column:
    """Sum as double from partial sums, 0.0 for a group without any value."""
    return F.coalesce(_exact().cast("double"), F.sum("value_double"), F.lit(0.0))


def merged_avg() -> Column:
    """Mean from partial sums, NULL for none."""
    return F.when(F.sum("value_count") > 0, merged_sum() / F.sum("value_count"))
