"""The five aggregate tables over the unified data set, all from mergeable partial aggregates.

Tenders are counted and added up once per country, year, month, category and buyer, suppliers once per country, year and name,
and values once per country and year. These facts merge: the tables follow from them without another look at the
tenders, and a year that changes replaces its own facts only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.money import merged_avg, merged_partials, merged_sum, money_partials
from procurelake.operators.median import exact_median

TOP_N = 100
TENDER_KEYS = ("source_country", "year", "month", "procurement_category_standardized", "buyer_name")
SUPPLIER_KEYS = ("source_country", "year", "supplier_name")


class Facts(NamedTuple):
    """Partial aggregates by the keys above, and ``values``: number of tenders by country, year and value."""

    tenders: DataFrame
    suppliers: DataFrame
    values: DataFrame


def amount() -> Column:
    return F.nanvl(F.col("tender_value_amount"), F.lit(None).cast("double"))


def _measures() -> list[Column]:
    return [F.count("ocid").alias("records"), *money_partials(amount())]


def _keys(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """Key columns; one that ``df`` lacks is NULL."""
    return [F.col(n) if n in df.columns else F.lit(None).cast("int" if n in ("year", "month") else "string").alias(n) for n in names]


def facts(df: DataFrame) -> Facts:
    """Facts of unified rows. Each reads its own columns of ``df``."""
    # As days, not texts: a text minimum would turn the hash aggregate into a sort.
    day = F.col("publication_date").try_cast("date")
    span = [F.min(day).alias("first_day"), F.max(day).alias("last_day")] if "publication_date" in df.columns else []
    tenders = df.groupBy(*_keys(df, TENDER_KEYS)).agg(*_measures(), *span)
    names = F.col("supplier_names") if "supplier_names" in df.columns else F.lit(None).cast("array<string>")
    named = df.select(*_keys(df, SUPPLIER_KEYS[:2]), "ocid", "tender_value_amount", F.explode(names).alias("supplier_name"))
    suppliers = named.groupBy(*SUPPLIER_KEYS).agg(*_measures())
    valued = df.select(*_keys(df, SUPPLIER_KEYS[:2]), amount().alias("value")).where(F.col("value").isNotNull())
    values = valued.groupBy("source_country", "year", "value").agg(F.count("*").alias("records"))
    return Facts(tenders, suppliers, values)


def _facts(given: DataFrame | Facts) -> Facts:
    return given if isinstance(given, Facts) else facts(given)


def _merged() -> list[Column]:
    return [F.sum("records").alias("records"), *merged_partials()]


def _value_columns(total: str = "total_value") -> list[Column]:
    return [F.sum("records").alias("total_records"), merged_sum().alias(total), merged_avg().alias("avg_value")]


def country_summary(given: DataFrame | Facts) -> DataFrame:
    """Counts, value figures, distinct buyers and suppliers, and date range per country."""
    found = _facts(given)
    known = found.tenders.where(F.col("source_country").isNotNull())
    buyers = known.groupBy("source_country", "buyer_name").agg(*_merged(), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    base = buyers.groupBy("source_country").agg(
        *_value_columns("total_value_sum"),
        F.count("buyer_name").alias("num_buyers"),
        F.min("first_day").cast("string").alias("date_range_start"),
        F.max("last_day").cast("string").alias("date_range_end"),
    )
    named = found.suppliers.select("source_country", "supplier_name").where(F.col("source_country").isNotNull() & F.col("supplier_name").isNotNull())
    suppliers = named.distinct().groupBy("source_country").agg(F.count("*").alias("_suppliers"))
    median = exact_median(found.values, ["source_country"], F.col("value"), "median_value", F.col("records"))
    return (
        base.join(median, "source_country", "left")
        .join(suppliers, "source_country", "left")
        .select(
            "source_country", "total_records", "total_value_sum", "avg_value", "median_value", "num_buyers",
            F.coalesce("_suppliers", F.lit(0)).alias("num_suppliers"),
            "date_range_start", "date_range_end",
        )
        .orderBy(F.desc("total_records"), "source_country")
    )


def monthly_trends(given: DataFrame | Facts) -> DataFrame:
    """Figures, countries and buyers per month: countries are counted beside the figures, buyers in a branch of their own,
    so that no row is multiplied for two distinct counts."""
    dated = _facts(given).tenders.where(F.col("year") > 0)
    countries = dated.groupBy("year", "month", "source_country").agg(*_merged())
    months = countries.groupBy("year", "month").agg(*_value_columns(), F.count("source_country").alias("num_countries"))
    named = dated.where(F.col("buyer_name").isNotNull()).select("year", "month", "buyer_name").distinct()
    buyers = named.groupBy("year", "month").agg(F.count("*").alias("_buyers")).withColumnsRenamed({"year": "_y", "month": "_m"})
    same = (F.col("year") == F.col("_y")) & F.col("month").eqNullSafe(F.col("_m"))
    return (
        months.join(buyers, same, "left")
        .withColumn("num_buyers", F.coalesce("_buyers", F.lit(0)))
        .drop("_buyers", "_y", "_m")
        .orderBy("year", "month")
    )


def category_analysis(given: DataFrame | Facts) -> DataFrame:
    keys = ["source_country", "procurement_category_standardized"]
    return (
        _facts(given).tenders.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*_value_columns())
        .orderBy("source_country", F.desc("total_records"), "procurement_category_standardized")
    )


def _top(rows: DataFrame, name: str, n: int) -> DataFrame:
    named = rows.where((F.col(name) != "") & F.col("source_country").isNotNull())
    grouped = named.groupBy(name, "source_country").agg(*_value_columns())
    return grouped.orderBy(F.desc("total_records"), name, "source_country").limit(n)


def top_buyers(given: DataFrame | Facts, n: int = TOP_N) -> DataFrame:
    return _top(_facts(given).tenders, "buyer_name", n)


def top_suppliers(given: DataFrame | Facts, n: int = TOP_N) -> DataFrame:
    """A tender counts once for each of its suppliers."""
    return _top(_facts(given).suppliers, "supplier_name", n)


# A new aggregate table is one more entry.
AGGREGATES = {
    "country_summary": country_summary,
    "monthly_trends": monthly_trends,
    "category_analysis": category_analysis,
    "top_buyers": top_buyers,
    "top_suppliers": top_suppliers,
}
