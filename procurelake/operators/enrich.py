"""Silver to Gold columns: categories, countries, calendar parts, flags, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake import schemas
from procurelake.functions import dates, lookups
from procurelake.operators import dedup

# Fields and weights of the completeness score, bounds of valid dates.
REQUIRED_WEIGHT, REQUIRED_FIELDS = 1.0, (
    "ocid", "publication_date", "tender_title", "buyer_name", "source_country",
)
IMPORTANT_WEIGHT, IMPORTANT_FIELDS = 0.5, (
    "tender_value_amount", "procurement_category", "procurement_method", "tender_status",
)
FIRST_VALID, LAST_VALID = "2000-01-01", "2030-12-31"

# Source tags in the order in which duplicates are decided.
SOURCE_PRIORITY = ("ocp", "ted", "base_portugal", "partner")

# Columns that Gold stores as 'yyyy-MM-dd' text when a source has them.
DATE_TEXTS = (
    "publication_date", "deadline_date", "award_date",
    "contract_start_date", "contract_end_date", "extraction_date",
)
DEDUP_KEYS = ["ocid", "source_publication_id"]


def unify(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of all sources by name; absent columns are NULL, ``source`` tags each row."""
    parts = []
    for tag, df in sources.items():
        stamps = [
            f.name for f in df.schema.fields
            if f.name in DATE_TEXTS and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        ]
        texts = {n: F.date_format(F.col(n), "yyyy-MM-dd") for n in stamps}
        parts.append(df.withColumns(texts | {"source": F.lit(tag)}))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _filled(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(c > 0 if name in schemas.SILVER_AMOUNTS else c != "", F.lit(False))


def completeness_score() -> Column:
    weights = [(n, REQUIRED_WEIGHT) for n in REQUIRED_FIELDS] + [(n, IMPORTANT_WEIGHT) for n in IMPORTANT_FIELDS]
    reached = sum((F.when(_filled(n), w).otherwise(0.0) for n, w in weights), F.lit(0.0))
    return reached / F.lit(sum(w for _, w in weights))


def enrich(df: DataFrame, as_of: str | Column, first: str = FIRST_VALID, last: str = LAST_VALID) -> DataFrame:
    """Adds the ten derived columns beside ``source``; ``as_of`` is the day that counts as today."""
    today = F.lit(as_of).cast("date")
    normalised = df.withColumns(
        {
            "source_country": lookups.standard_country(F.col("source_country")),
            "procurement_category_original": F.col("procurement_category"),
            "procurement_category_standardized": lookups.standard_category(F.col("procurement_category")),
            "_day": dates.gold_day(F.col("publication_date")),
        }
    )
    day = F.col("_day")
    positive = lambda n: F.coalesce(F.nanvl(F.col(n), F.lit(0.0)) > 0, F.lit(False))
    has_award = positive("award_amount") if "award_amount" in df.columns else F.lit(False)
    return normalised.withColumns(
        {
            "year": dates.or_zero(F.year(day)),
            "month": dates.or_zero(F.month(day)),
            "quarter": dates.or_zero(F.quarter(day)),
            "date_quality_flag": dates.quality_flag(day, first, last),
            "is_future_date": F.coalesce(day > today, F.lit(False)),
            "has_value": positive("tender_value_amount"),
            "has_award": has_award,
            "data_completeness_score": completeness_score(),
        }
    ).drop("_day")


def iso_dates(df: DataFrame) -> DataFrame:
    """Date texts that cannot be read become NULL, the rest 'yyyy-MM-dd'."""
    return df.withColumns(
        {n: dates.gold_day(F.col(n)).cast("string") for n in DATE_TEXTS if n in df.columns}
    )


def source_rank(tags: tuple[str, ...] = SOURCE_PRIORITY, source: str = "source") -> Column:
    rank = F.lit(len(tags))
    for place, tag in enumerate(tags):
        rank = F.when(F.col(source) == tag, F.lit(place)).otherwise(rank)
    return rank


def drop_duplicates(df: DataFrame, tie: list[Column], by: str = "source") -> DataFrame:
    """One row per (ocid, source_publication_id).

    ``by='source'`` keeps the row of the first source, ``by='completeness'`` the
    most complete one; ``tie`` makes the order total.
    """
    lead = F.col("data_completeness_score").desc() if by == "completeness" else source_rank()
    order = [lead, source_rank(), *tie] if by == "completeness" else [lead, *tie]
    return dedup.keep_first(df, DEDUP_KEYS, order)


def to_gold(df: DataFrame, as_of: str | Column, tie: list[Column], by: str = "source") -> DataFrame:
    """Deduplicated and enriched. Where the order allows it duplicates go first, so that the
    shuffle carries no derived column."""
    if by == "completeness":
        return drop_duplicates(enrich(df, as_of), tie, by)
    return enrich(drop_duplicates(df, tie, by), as_of)


def gold_columns(df: DataFrame) -> DataFrame:
    """The 38 Gold columns in order, then whatever else the sources carry."""
    present = [f if f.name in df.columns else None for f in schemas.GOLD_SCHEMA.fields]
    columns = [
        F.col(f.name) if have else F.lit(None).cast(f.dataType).alias(f.name)
        for f, have in zip(schemas.GOLD_SCHEMA.fields, present)
    ]
    extras = [F.col(n) for n in df.columns if n not in schemas.GOLD_COLUMNS and not n.startswith("_")]
    return df.select(*columns, *extras)


def unmapped_categories(df: DataFrame) -> DataFrame:
    """Categories without a standard name, with their number of rows."""
    open_ = (F.col("procurement_category") != "") & (F.col("procurement_category_standardized") == "")
    return df.where(open_).groupBy("procurement_category").agg(F.count("*").alias("records"))
