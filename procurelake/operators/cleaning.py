"""Raw Silver-shaped columns to clean, typed Silver columns, in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake import schemas
from procurelake.functions import dates, text


def _clean(name: str, c: Column, dtype: T.DataType, date_cleaner: Callable[[Column], Column]) -> Column:
    if name in schemas.SILVER_DATES:
        return date_cleaner(c.cast("string"))
    if name in schemas.SILVER_AMOUNTS:
        return text.clean_amount(c) if isinstance(dtype, T.StringType) else text.clean_number(c)
    if name in schemas.SILVER_CURRENCIES:
        return text.clean_currency(c)
    if name in schemas.SILVER_ARRAYS:
        return text.clean_array(c) if isinstance(dtype, T.ArrayType) else text.as_array(c)
    if name in schemas.SILVER_COUNTS:
        return text.clean_count(c)
    return text.clean_string(c)


def _absent(name: str) -> Column:
    if name in schemas.SILVER_DATES:
        return F.lit(None).cast("string")
    if name in schemas.SILVER_AMOUNTS:
        return F.lit(0.0)
    if name in schemas.SILVER_ARRAYS:
        return text.empty_strings()
    if name in schemas.SILVER_COUNTS:
        return F.lit(0).cast("bigint")
    return F.lit("")


def clean_record(
    df: DataFrame,
    keep: tuple[str, ...] = (),
    date_cleaner: Callable[[Column], Column] = dates.clean_date,
) -> DataFrame:
    """All 27 Silver columns in write order, cleaned by field group, plus ``keep`` untouched."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns = [
        (_clean(n, F.col(n), fields[n], date_cleaner) if n in fields else _absent(n)).alias(n)
        for n in schemas.SILVER_COLUMNS
    ]
    return df.select(*columns, *[F.col(k) for k in keep])
