"""Acceptance of Silver records and of raw releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions import dates

OCID_PREFIX = "ocds-"
REASON = "reject_reason"


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def reject_reason() -> Column:
    """Why a record is refused, NULL when it is valid."""
    return (
        F.when(_blank("ocid"), "missing ocid")
        .when(_blank("publication_date"), "missing publication_date")
        .when(~F.col("ocid").startswith(OCID_PREFIX), "invalid ocid")
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(reject_reason().isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.withColumn(REASON, reject_reason()).where(F.col(REASON).isNotNull())


def release_date() -> Column:
    """Publication date of a raw release: the first usable of four places."""
    return dates.first_date(
        [
            F.col("date"),
            F.col("publishedDate"),
            F.col("tender.tenderPeriod.startDate"),
            F.col("tender.datePublished"),
        ]
    )


def releases_with_date(releases: DataFrame, name: str = "release_date") -> DataFrame:
    """Releases whose publication date is known; the others are dropped."""
    return releases.withColumn(name, release_date()).where(F.col(name).isNotNull())


def releases_of_year(releases: DataFrame, year: int) -> DataFrame:
    return releases.where(F.year(release_date().cast("date")) == year)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
