"""Relational extract (tenders, buyers, lots and two link tables) to Silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions import keys, text
from procurelake.operators import dedup, validation

SOURCE = "partner"
COUNTRY, CURRENCY = "PT", "EUR"
REQUIRED = ["tender_id", "tender_title", "publication_date"]
# Defaults of columns that the whole extract lacks.
DEFAULT_STATUS, DEFAULT_CATEGORY = "ANNOUNCED", "SUPPLIES"
LOT_COLUMNS = ["lot_status", "lot_estimatedPrice", "cpv_code", "estimated_value"]


def _with_suffix(df: DataFrame, taken: list[str], suffix: str, keep: list[str]) -> DataFrame:
    """Rename the columns of ``df`` that the left side already has."""
    clash = [c for c in df.columns if c in taken and c not in keep]
    return df.withColumnsRenamed({c: c + suffix for c in clash})


def first_lots(links: DataFrame, order: list[Column]) -> DataFrame:
    """The first linked lot per tender; partial aggregation, no sort of whole groups."""
    named = links.where(F.col("tender_id").isNotNull() & F.col("lot_id").isNotNull())
    return named.groupBy("tender_id").agg(F.min_by("lot_id", F.struct(*order)).alias("lot_id"))


def merge(tables: dict[str, DataFrame | None], lot_order: list[Column] | None = None) -> DataFrame:
    """Left joins: tenders to buyers through their links, and to the first lot of each.

    A missing table leaves out its step. Link columns named ``_…`` only carry
    row order and are kept out of the result.
    """
    merged = tables["tenders"]
    links, buyers = tables.get("tender_buyer"), tables.get("buyers")
    if links is not None and buyers is not None:
        merged = merged.join(links, "tender_id", "left")
        details = _with_suffix(buyers, merged.columns, "_buyer", ["buyer_id"])
        # rows without a buyer match nothing; keys of their own keep them from meeting in one task
        lone = F.concat(F.lit("\u0000"), F.xxhash64("tender_id").cast("string"))
        merged = merged.withColumn("_buyer_key", F.coalesce(F.col("buyer_id").cast("string"), lone))
        keyed = details.withColumn("_buyer_key", F.col("buyer_id").cast("string")).drop("buyer_id")
        merged = merged.join(keyed, "_buyer_key", "left").drop("_buyer_key")
    links, lots = tables.get("tender_lot"), tables.get("lots")
    if links is not None and lots is not None:
        chosen = first_lots(links, lot_order or [F.col("lot_id")]).join(lots, "lot_id", "left")
        details = chosen.select("tender_id", *[c for c in LOT_COLUMNS if c in lots.columns])
        merged = merged.join(_with_suffix(details, merged.columns, "_lot", ["tender_id"]), "tender_id", "left")
    return merged


def _text(name: str | None = None) -> Column:
    return (F.lit(None) if name is None else F.col(name)).cast("string")


def project(merged: DataFrame, source: str = SOURCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Merged rows to the Silver columns of this source.

    A fallback is chosen by whether a column exists, not by whether a cell is filled.
    """
    have = merged.columns

    def first_column(*names: str, default: Column) -> Column:
        return next((F.col(n) for n in names if n in have), default)

    day = lambda n: first_column(n, default=F.lit(None)).cast("timestamp_ntz")
    return merged.select(
        F.col("tender_id"),
        F.concat(F.lit(f"ocds-{source}-"), F.coalesce(F.col("tender_id").cast("string"), F.lit(keys.NULL_TEXT))).alias(
            "ocid"
        ),
        F.coalesce(F.col("tender_id").cast("string"), F.lit(keys.NULL_TEXT)).alias("source_publication_id"),
        F.lit(source).alias("source"),
        F.lit(COUNTRY).alias("source_country"),
        F.col("tender_title"),
        first_column("tender_supplyType", default=_text()).alias("tender_description"),
        first_column("lot_status", default=F.lit(DEFAULT_STATUS)).alias("tender_status"),
        first_column("estimated_value", "tender_estimatedPrice", default=F.lit(0.0)).alias("tender_value_amount"),
        F.lit(CURRENCY).alias("tender_value_currency"),
        day("publication_date").alias("publication_date"),
        day("tender_bidDeadline").alias("deadline_date"),
        _text().alias("award_date"),
        _text().alias("contract_start_date"),
        _text().alias("contract_end_date"),
        first_column("buyer_id", default=_text()).alias("buyer_id"),
        first_column("buyer_name", default=_text()).alias("buyer_name"),
        first_column("buyer_buyerType", default=_text()).alias("buyer_type"),
        _text().alias("supplier_id"),
        _text().alias("supplier_name"),
        _text().alias("supplier_country"),
        first_column("tender_procedureType", default=_text()).alias("procurement_method"),
        first_column("main_nature", default=F.lit(DEFAULT_CATEGORY)).alias("procurement_category"),
        first_column("cpv_code_lot", "tender_mainCpv", default=_text()).alias("cpv_code"),
        _text().alias("cpv_description"),
        first_column("tender_supplyType", default=_text()).alias("contract_type"),
        F.lit(False).alias("is_framework_agreement"),
        F.lit(None).cast("bigint").alias("number_of_offers"),
        first_column("ingestion_timestamp", default=F.localtimestamp()).cast("timestamp_ntz").alias("extraction_date"),
        *[F.col(k) for k in keep],
    )


def clean(df: DataFrame, order: list[Column]) -> DataFrame:
    """Required fields present, one row per tender, value as a number."""
    whole = dedup.keep_first(validation.require(df, REQUIRED), ["tender_id"], order)
    is_text = dict(whole.dtypes)["tender_value_amount"] == "string"
    value = F.col("tender_value_amount")
    return whole.withColumn("tender_value_amount", text.clean_amount(value) if is_text else text.clean_number(value))


def transform(
    tables: dict[str, DataFrame | None],
    order: list[Column],
    lot_order: list[Column] | None = None,
    source: str = SOURCE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The whole step; ``order`` decides which row of a tender is its first and may use ``keep`` columns."""
    return clean(project(merge(tables, lot_order), source, keep), order)
