"""Flat contract rows to nested releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions import dates, keys, text

# Header variants, in the order in which they are tried.
ID_COLUMNS = ("idcontrato", "ID do Contrato", "Identificador")
DATE_COLUMNS = ("dataPublicacao", "Data Publicação", "Data de Publicação", "Data")
TITLE_COLUMNS = ("objectoContrato", "descContrato", "Objeto do Contrato")
BUYER_COLUMNS = ("adjudicante", "Adjudicante")
SUPPLIER_COLUMNS = ("adjudicatarios", "Adjudicatários")
PRICE_COLUMNS = ("precoContratual", "Preço Contratual", "Valor")
PAID_COLUMNS = ("PrecoTotalEfetivo", "precoContratual", "Preço Contratual")
STATUS, CURRENCY = "active", "EUR"


def contracts_to_releases(rows: DataFrame, year: Column | int) -> DataFrame:
    """One release per row that has an id; ``year`` is that of the extract."""
    of_year = F.lit(year) if isinstance(year, int) else year

    def first_filled(names: tuple[str, ...]) -> Column:
        present = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in rows.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    def optional(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit("")

    def value(names: tuple[str, ...]) -> Column:
        return F.struct(
            text.parse_eu_amount(first_filled(names)).cast("string").alias("amount"), F.lit(CURRENCY).alias("currency")
        )

    contract = first_filled(ID_COLUMNS)
    year_start = F.concat(of_year.cast("string"), F.lit("-01-01"))
    raw_dates = [F.col(f"`{n}`") for n in DATE_COLUMNS if n in rows.columns]
    published = dates.first_date(raw_dates, year_start) if raw_dates else year_start
    # What is used more than once is a column of its own, so that it is computed once.
    parsed = rows.where(contract.isNotNull()).withColumns(
        {"_published": published, "_suppliers": text.party_list(first_filled(SUPPLIER_COLUMNS))}
    )
    award = F.struct(
        F.col("_published").alias("date"), value(PAID_COLUMNS).alias("value"), F.col("_suppliers").alias("suppliers")
    )
    none = F.array().cast(
        "array<struct<date:string,value:struct<amount:string,currency:string>,"
        "suppliers:array<struct<id:string,name:string>>>>"
    )
    return parsed.select(
        keys.prefixed_id("ocds-base-pt", of_year, contract).alias("ocid"),
        F.col("_published").alias("date"),
        F.struct(
            contract.alias("id"),
            F.coalesce(first_filled(TITLE_COLUMNS), F.lit("")).alias("title"),
            F.lit(STATUS).alias("status"),
            value(PRICE_COLUMNS).alias("value"),
            optional("tipoContrato").alias("procurement_category"),
            optional("tipoprocedimento").alias("procurement_method"),
        ).alias("tender"),
        text.party(first_filled(BUYER_COLUMNS)).alias("buyer"),
        F.when(F.size("_suppliers") > 0, F.array(award)).otherwise(none).alias("awards"),
    )
