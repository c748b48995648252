"""Nested procurement notices (arrays of authorities and contractors) to Silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions import dates, keys, lookups, text
from procurelake.operators import cleaning, validation

OCID_PREFIX = "ocds-ted"


def _number(name: str) -> Column:
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def _texts(field: str) -> Column:
    values = F.transform(F.col("contractors"), lambda c: c[field].cast("string"))
    return F.coalesce(F.filter(values, lambda v: v != ""), text.empty_strings())


def _urls() -> Column:
    both = F.array("procurement_documents_url", "source_url")
    return F.filter(both, lambda u: u != "")


def map_notices(notices: DataFrame, processed_at: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clean Silver records with their hash; not yet validated."""
    stamp = F.lit(processed_at) if processed_at is not None else F.date_format(F.now(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    buyer = F.get("contracting_authorities", F.lit(0))
    contractors = F.coalesce(F.size("contractors"), F.lit(0)).cast("bigint")
    mapped = notices.select(
        keys.prefixed_id(OCID_PREFIX, F.col("source_id")).alias("ocid"),
        F.col("source_id").alias("source_publication_id"),
        F.col("source_id").alias("tender_id"),
        F.col("contract_object").alias("tender_title"),
        F.coalesce(_number("contract_price"), _number("effective_total_price")).alias("tender_value_amount"),
        F.col("currency").alias("tender_value_currency"),
        F.col("state").alias("tender_status"),
        F.coalesce("publication_date", "contract_date", "closing_date").alias("publication_date"),
        F.col("contract_date").alias("tender_start_date"),
        F.coalesce("closing_date", "execution_deadline").alias("tender_end_date"),
        F.col("contract_date").alias("award_date"),
        F.col("procedure_type").alias("procurement_method"),
        F.get("contract_types", F.lit(0)).alias("procurement_category"),
        buyer["nipc"].alias("buyer_id"),
        buyer["name"].alias("buyer_name"),
        _texts("nipc").alias("supplier_ids"),
        _texts("name").alias("supplier_names"),
        F.coalesce(_number("effective_total_price"), _number("contract_price")).alias("award_amount"),
        F.col("currency").alias("award_currency"),
        F.lit(0).cast("bigint").alias("num_lots"),
        contractors.alias("num_tenderers"),
        contractors.alias("num_awards"),
        _urls().alias("document_urls"),
        lookups.notice_country(
            buyer["country"], F.col("execution_location"), F.col("source"), buyer["name"]
        ).alias("source_country"),
        (F.col("source_file") if "source_file" in notices.columns else F.lit("")).alias("source_file"),
        stamp.alias("processing_timestamp"),
        *[F.col(k) for k in keep],
    )
    cleaned = cleaning.clean_record(mapped, keep, dates.clean_date_or_duration)
    return cleaned.withColumn("record_hash", keys.record_hash())


def transform_notices(notices: DataFrame, **options) -> DataFrame:
    return validation.accepted(map_notices(notices, **options))
