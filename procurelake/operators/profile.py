"""Column profiles, samples, statistics and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.operators.median import exact_median

TOP_VALUES = 5
SAMPLE_VALUES = 5
_NUMERIC = (T.NumericType, T.BooleanType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _of(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _number(name: str, dtype: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    c = c.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else c.cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def _long(df: DataFrame, columns: dict[str, Column], value: str) -> DataFrame:
    """(column, value) pairs, one per cell."""
    cells = [F.struct(F.lit(n).alias("column"), c.alias(value)) for n, c in columns.items()]
    return df.select(F.inline(F.array(*cells)))


def basic_profile(df: DataFrame) -> DataFrame:
    """Type, rows, nulls and, by kind, min/max/mean/std or first/last date: one scan."""
    fields = df.schema.fields
    nothing = F.lit(None).cast("double")
    no_text = F.lit(None).cast("string")
    aggregates, rows = [F.count("*").alias("_rows")], []
    for f in fields:
        c = F.col(f"`{f.name}`")
        numeric, dated = isinstance(f.dataType, _NUMERIC), isinstance(f.dataType, _DATES)
        v = _number(f.name, f.dataType) if numeric else c
        aggregates.append(F.count(v).alias(f"{f.name}__n"))
        if numeric:
            aggregates += [
                F.min(v).alias(f"{f.name}__min"), F.max(v).alias(f"{f.name}__max"),
                F.avg(v).alias(f"{f.name}__mean"), F.stddev_samp(v).alias(f"{f.name}__std"),
            ]
        elif dated:
            aggregates += [
                F.min(c).cast("string").alias(f"{f.name}__min"), F.max(c).cast("string").alias(f"{f.name}__max"),
            ]
        n = F.col(f"`{f.name}__n`")
        at = lambda k, name=f.name: F.col(f"`{name}__{k}`")
        nulls = F.col("_rows") - n
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                nulls.alias("null_count"),
                F.when(F.col("_rows") > 0, nulls / F.col("_rows") * 100).alias("null_percentage"),
                (at("min") if numeric else nothing).alias("min"),
                (at("max") if numeric else nothing).alias("max"),
                (at("mean") if numeric else nothing).alias("mean"),
                (F.when(n > 1, at("std")).when(n == 1, 0.0) if numeric else nothing).alias("std"),
                (at("min") if dated else no_text).alias("min_date"),
                (at("max") if dated else no_text).alias("max_date"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def column_medians(df: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = _long(df, {n: _number(n, types[n]) for n in _of(df, _NUMERIC)}, "value")
    return exact_median(cells, ["column"], F.col("value"))


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) over all text columns, in one aggregation."""
    cells = _long(df, {n: F.col(f"`{n}`") for n in _of(df, T.StringType)}, "value")
    return cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame) -> DataFrame:
    return value_counts(df).groupBy("column").agg(F.count("*").alias("unique_count"))


def top_values(df: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """The ``n`` most frequent values of each text column."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df).withColumn("place", place).where(F.col("place") <= n)


def column_profile(df: DataFrame) -> DataFrame:
    """The whole profile, one row per column."""
    profile = basic_profile(df)
    if _of(df, _NUMERIC):
        profile = profile.join(column_medians(df), "column", "left")
    if _of(df, T.StringType):
        listed = (
            top_values(df)
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("top_values"))
        )
        profile = profile.join(distinct_counts(df), "column", "left").join(listed, "column", "left")
    return profile


def capped(df: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of a result, with ``truncated``: whether there were more.

    One pass: one row more than asked for is taken, and only those rows are numbered.
    """
    taken = df.limit(max_rows + 1).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_at"))
    total = F.count(F.lit(1)).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbered = taken.withColumns({"_place": place, "truncated": total > max_rows})
    return numbered.where(F.col("_place") <= max_rows).drop("_at", "_place")


def summarize(df: DataFrame) -> dict[str, DataFrame]:
    """Number of rows, figures of the numeric columns and distinct counts of the text columns, whatever the size."""
    return {
        "total_rows": df.agg(F.count(F.lit(1)).alias("total_rows")),
        "summary_stats": numeric_summary(df),
        "unique_counts": distinct_counts(df),
    }


def numeric_summary(df: DataFrame) -> DataFrame:
    numeric = basic_profile(df.select(*[F.col(f"`{n}`") for n in _of(df, _NUMERIC)]))
    return numeric.join(column_medians(df), "column").select("column", "min", "max", "mean", "median")


def table_samples(df: DataFrame, order: list[Column], values: int = SAMPLE_VALUES) -> DataFrame:
    """Per column the first distinct values of the table in ``order``; arrays as '[array]'.

    The place of a value is the least ``order`` key of its rows, an aggregate that combines before
    the shuffle; of each column ``values`` rows a task go on to the ranking.
    """
    shown = {
        f.name: F.lit("[array]") if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`").cast("string")
        for f in df.schema.fields
    }
    at = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    cells = [F.struct(F.lit(n).alias("column"), c.alias("sample"), F.col("_at")) for n, c in shown.items()]
    seen = (
        df.withColumn("_at", at)
        .select(F.inline(F.array(*cells)))
        .where(F.col("sample").isNotNull())
        .groupBy("column", "sample")
        .agg(F.min("_at").alias("_at"))
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("_at", "sample"))
    return seen.withColumn("place", place).where(F.col("place") <= values).select("column", "place", "sample")


def describe_table(df: DataFrame) -> DataFrame:
    """Column names, types and nullability, as rows with the number of records."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"),
            F.col("_rows").alias("row_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count("*").alias("_rows")).select(F.inline(F.array(*rows)))


def gold_stats(df: DataFrame, countries: int = 10, categories: int = 5) -> DataFrame:
    """Long form (section, key, records): sources, top countries, top categories, date flags.

    One aggregation over the four-column key; each section adds up its own part of it.
    """
    keys = ["source", "source_country", "procurement_category_standardized", "date_quality_flag"]
    cube = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sections = dict(zip(("source", "country", "category", "date_flag"), keys))
    cells = [
        F.struct(F.lit(s).alias("section"), F.col(k).alias("key"), F.col("_n").alias("_n"))
        for s, k in sections.items()
    ]
    counts = (
        cube.select(F.inline(F.array(*cells)))
        .where(F.col("key").isNotNull())
        .groupBy("section", "key")
        .agg(F.sum("_n").alias("records"))
    )
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("records"), "key"))
    limit = (
        F.when(F.col("section") == "country", countries)
        .when(F.col("section") == "category", categories)
        .otherwise(F.lit(2**31 - 1))
    )
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def gold_overview(df: DataFrame) -> DataFrame:
    """One row: records, date range, countries, mean score, valid and future dates."""
    day = F.col("publication_date").try_cast("date")
    return df.agg(
        F.count("*").alias("total_records"),
        F.min(day).cast("string").alias("first_date"),
        F.max(day).cast("string").alias("last_date"),
        F.count_distinct("source_country").alias("countries"),
        F.avg(F.col("data_completeness_score").cast("decimal(20,12)")).cast("double").alias("avg_completeness"),
        F.count_if(F.col("date_quality_flag") == "valid").alias("valid_dates"),
        F.count_if("is_future_date").alias("future_dates"),
    )


def file_stats(scan: DataFrame, by: list[str]) -> DataFrame:
    """Files, records and megabytes per ``by``, read from a scan that carries ``_metadata``."""
    files = scan.groupBy(*by, F.col("_metadata.file_path").alias("_file")).agg(
        F.count("*").alias("_records"), F.max(F.col("_metadata.file_size")).alias("_bytes")
    )
    return files.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.sum("_records").alias("records"),
        F.round(F.sum("_bytes") / F.lit(1024 * 1024), 2).alias("size_mb"),
    )


def files_per_country(listing: DataFrame, expected: DataFrame, source: str) -> DataFrame:
    """``country, files, size_bytes`` of every expected country, those without files included; content is not read."""
    country = F.regexp_extract("path", rf"/{source}/(?:country=)?([^/]+)/", 1).alias("country")
    held = listing.select(country, "length").groupBy("country").agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes"))
    nothing = F.lit(0).cast("bigint")
    return expected.join(held, "country", "left").select(
        "country", F.coalesce("files", nothing).alias("files"), F.coalesce("size_bytes", nothing).alias("size_bytes")
    )


def partition_stats(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("records"))


def manifest(df: DataFrame, source: str, layer: str, kind: str = "summary") -> DataFrame:
    """One row of lineage figures; the files themselves are ``manifest_files``."""
    day = F.col("publication_date").try_cast("date")
    score = (
        F.avg(F.col("data_completeness_score").cast("decimal(20,12)")).cast("double")
        if "data_completeness_score" in df.columns
        else F.lit(None).cast("double")
    )
    return df.agg(
        F.count_distinct("source_file").alias("total_files"),
        F.count("*").alias("total_records"),
        F.min(day).cast("string").alias("min_date"),
        F.max(day).cast("string").alias("max_date"),
        score.alias("quality_score"),
    ).select(
        F.lit("1.0").alias("manifest_version"), F.lit(kind).alias("manifest_type"),
        F.lit(source).alias("source"), F.lit(layer).alias("layer"), "*",
    )


def manifest_files(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(F.count("*").alias("records"))
