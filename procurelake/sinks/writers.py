"""Writers. A partitioned write first asks for a rebalance on the partition columns:

adaptive execution then splits a large country over several tasks and merges small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions import dates
from procurelake.operators import validation
from procurelake.session import shuffles_freed

# The licences of the two public portals.
PORTAL_LICENSE = {
    "license": "Open Data License",
    "license_full_name": "dados.gov.pt Open Data License",
    "license_url": "https://dados.gov.pt/pt/datasets/ocds-portal-base-www-base-gov-pt/",
    "attribution": "IMPIC - Instituto dos Mercados Públicos, do Imobiliário e da Construção",
    "source_url": "https://www.base.gov.pt/base4",
    "portal": "dados.gov.pt",
}
PORTAL_RESTRICTIONS = ("Attribution required", "Open data - free for commercial and non-commercial use")
COMPRESSION = "snappy"
BRONZE_KEYS = ["country", "year", "month", "day"]
SILVER_KEYS = ["source_country", "year", "month"]
GOLD_KEYS = ["source_country", "year"]
GOLD_ORDER = ["tender_value_amount"]
GOLD_IDS = ["ocid", "tender_id"]
BLOOM_SIZES = 12
# Partition of relational records without a date.
NO_DATE_YEAR, NO_DATE_MONTH = 2024, 1


def _partitioned(df: DataFrame, keys: list[str], mode: str) -> DataFrameWriter:
    return df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).option("compression", COMPRESSION)


def license_column(
    extracted_at: str | Column, entries: dict[str, str] | None = None, restrictions: tuple[str, ...] = PORTAL_RESTRICTIONS
) -> Column:
    fields = [F.lit(v).alias(k) for k, v in (entries or PORTAL_LICENSE).items()]
    limits = F.array(*[F.lit(r) for r in restrictions]).alias("restrictions")
    return F.struct(*fields, limits, F.lit(extracted_at).alias("extraction_timestamp"))


def bronze_rows(releases: DataFrame, extracted_at: str | Column | None = None) -> DataFrame:
    """Dated releases with their partition columns and licence; undated ones are dropped."""
    stamp = F.lit(extracted_at) if extracted_at is not None else F.now().cast("string")
    dated = validation.releases_with_date(releases)
    parts = F.split("release_date", "-")
    return dated.withColumns(
        {
            "_metadata_license": license_column(stamp),
            "year": F.get(parts, F.lit(0)),
            "month": F.get(parts, F.lit(1)),
            "day": F.get(parts, F.lit(2)),
        }
    )


def write_bronze(
    releases: DataFrame, path: str, extracted_at: str | Column | None = None, mode: str = "append", compression: str = "none"
) -> DataFrame:
    """Releases as JSON lines by country and day; returns the number of releases per day of this call.

    What the store held before doesn't count; the count needs the date columns of ``releases`` only. ``compression`` is that
    of the files; readers of JSON lines take ``gzip`` as it is, with one task for each file of a country's day.

    Releases cross the shuffle as their JSON text, which takes less than half of what nested rows do there, and the licence, which
    is the same for all, is added behind it.
    """
    rows = bronze_rows(releases, extracted_at)
    stamp = F.col("_metadata_license.extraction_timestamp").alias("_stamp")
    body = [c for c in rows.columns if c not in (*BRONZE_KEYS, "_metadata_license")]
    slim = rows.select(*BRONZE_KEYS, F.to_json(F.struct(*[f"`{c}`" for c in body])).alias("_text"), stamp)
    kind = T.StructType([rows.schema[c] for c in body])
    whole = slim.hint("rebalance", *BRONZE_KEYS).select(*BRONZE_KEYS, F.from_json("_text", kind, {"mode": "FAILFAST"}).alias("_release"), "_stamp")
    written = whole.select("_release.*", license_column(F.col("_stamp")).alias("license"), *BRONZE_KEYS)
    with shuffles_freed(releases.sparkSession):
        written.write.mode(mode).partitionBy(*BRONZE_KEYS).option("compression", compression).json(path)
    per_day = rows.groupBy(*BRONZE_KEYS[1:]).agg(F.count("*").alias("records"))
    return per_day.select(F.concat_ws("-", *BRONZE_KEYS[1:]).alias("release_date"), "records")


def silver_rows(df: DataFrame) -> DataFrame:
    """Adds text ``year`` and ``month``, 'unknown' without a date."""
    if {"year", "month"} <= set(df.columns):
        return df
    year, month = dates.year_month(F.col("publication_date"))
    return df.withColumns({"year": year, "month": month})


def write_silver(df: DataFrame, path: str, mode: str = "append") -> None:
    with shuffles_freed(df.sparkSession):
        _partitioned(silver_rows(df), SILVER_KEYS, mode).parquet(path)


def relational_silver_rows(df: DataFrame, country: str = "PT") -> DataFrame:
    day = F.col("publication_date").cast("date")
    return df.withColumns(
        {
            "year": F.coalesce(F.year(day), F.lit(NO_DATE_YEAR)),
            "month": F.coalesce(F.month(day), F.lit(NO_DATE_MONTH)),
            "source_country": F.coalesce("source_country", F.lit(country)),
        }
    )


def write_relational_silver(df: DataFrame, path: str, mode: str = "append") -> None:
    with shuffles_freed(df.sparkSession):
        _partitioned(relational_silver_rows(df), SILVER_KEYS, mode).parquet(path)


def _overwrite_mode(dynamic: bool) -> str:
    """Dynamic: only the partitions that have rows are replaced."""
    return "dynamic" if dynamic else "static"


def write_gold(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """The unified table by country and year; ``dynamic`` replaces the partitions among the rows and leaves the others.

    Within a partition rows are ordered by value, so that a question about high values skips row groups by their
    statistics, and ids have Bloom filters, so that one about an id does.
    """
    ordered = df.hint("rebalance", *GOLD_KEYS).sortWithinPartitions(*GOLD_KEYS, *[c for c in GOLD_ORDER if c in df.columns])
    writer = ordered.write.mode(mode).partitionBy(*GOLD_KEYS).option("compression", COMPRESSION)
    # adaptive holds for all columns or none; a filter is the smallest of its candidates, from 1 MB down, that the ids fit in
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in GOLD_IDS:
        if name in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.candidates.number#{name}", BLOOM_SIZES)
    with shuffles_freed(df.sparkSession):
        writer.option("partitionOverwriteMode", _overwrite_mode(dynamic)).parquet(path)


def write_facts(df: DataFrame, path: str, dynamic: bool = False) -> None:
    """Partial aggregates by year."""
    with shuffles_freed(df.sparkSession):
        _partitioned(df, ["year"], "overwrite").option("partitionOverwriteMode", _overwrite_mode(dynamic)).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An aggregate table: one file as long as it is small, as adaptive execution sizes it."""
    with shuffles_freed(df.sparkSession):
        df.hint("rebalance").write.mode(mode).option("compression", COMPRESSION).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "append") -> None:
    df.coalesce(1).write.mode(mode).json(path)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV has no form for."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({n: F.to_json(f"`{n}`") for n in nested}) if nested else df


def export(df: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    writer = (_flat(df) if kind == "csv" else df).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export kind: {kind}")
