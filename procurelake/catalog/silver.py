"""Queries for cleaning, mapping, validation and the three source shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.catalog import query
from procurelake.catalog.tenders import (
    WITH_SILVER, currency_sql, date_sql, hash_sql, raw, silver, table, text_sql,
)
from procurelake.functions import dates, keys, lookups, paths, text
from procurelake.operators import mapping, notices, relational, validation
from procurelake.sources import contracts

_SPACE = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


# ----------------------------------------------------------- field by field
@query(
    "clean_dates",
    f"""{WITH_SILVER}, d AS (SELECT seq, publication_date AS raw_date, {date_sql("publication_date")} AS clean_date FROM raw)
      SELECT seq, raw_date, clean_date,
        CASE WHEN lower(raw_date) LIKE '% dia%' THEN NULL ELSE clean_date END AS clean_date_or_duration,
        CASE WHEN clean_date NOT IN ('1900-01-01', '1970-01-01') THEN clean_date END AS real_date,
        coalesce(split_part(clean_date, '-', 1), 'unknown') AS year,
        coalesce(split_part(clean_date, '-', 2), 'unknown') AS month FROM d""",
)
def clean_dates(spark, sf_dir):
    c = F.col("publication_date")
    cleaned = raw(spark, sf_dir).select(
        "seq", c.alias("raw_date"), dates.clean_date(c).alias("clean_date"),
        dates.clean_date_or_duration(c).alias("clean_date_or_duration"),
    )
    year, month = dates.year_month(F.col("clean_date"))
    return cleaned.withColumns(
        {"real_date": dates.drop_placeholder(F.col("clean_date")), "year": year, "month": month}
    )


# Amounts as texts, good and bad; one text for both engines.
_AMOUNT_TEXT = """CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN NULL
  WHEN o_orderkey % 17 = 0 THEN '1.234,56' WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN '-5'
  WHEN o_orderkey % 29 = 0 THEN ' 12.5 ' WHEN o_orderkey % 31 = 0 THEN '1e3' WHEN o_orderkey % 2 = 0
  THEN CAST(o_custkey AS STRING) || ',50 €' ELSE CAST(o_custkey AS STRING) || '.25' END"""
_NUMERIC_SQL = "coalesce(CASE WHEN regexp_matches({0}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST({0} AS DOUBLE) END, 0.0e0)"


@query(
    "clean_amounts",
    f"""WITH a AS (SELECT o_orderkey, {_AMOUNT_TEXT} AS raw_amount FROM orders)
      SELECT o_orderkey, {_NUMERIC_SQL.format("raw_amount")} AS amount,
        {_NUMERIC_SQL.format("replace(replace(replace(raw_amount, '€', ''), ' ', ''), ',', '.')")} AS eu_amount,
        coalesce(CASE WHEN regexp_matches(raw_amount, '^[+-]?\\d+$') THEN TRY_CAST(raw_amount AS BIGINT) END, 0) AS whole
      FROM a""",
)
def clean_amounts(spark, sf_dir):
    amounts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_AMOUNT_TEXT).alias("raw_amount"))
    c = F.col("raw_amount")
    return amounts.select(
        "o_orderkey", text.clean_amount(c).alias("amount"), text.parse_eu_amount(c).alias("eu_amount"),
        text.clean_count(c).alias("whole"),
    )


_SYMBOLS_SQL = "CASE trim(tender_value_currency) WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '$' THEN 'USD' ELSE tender_value_currency END"


@query(
    "clean_currency",
    f"""{WITH_SILVER}, s AS (SELECT seq, tender_value_currency AS raw_currency, {currency_sql("tender_value_currency")} AS currency,
        {_SYMBOLS_SQL} AS named FROM raw)
      SELECT seq, raw_currency, currency, {currency_sql("named")} AS currency_with_symbols FROM s""",
)
def clean_currency(spark, sf_dir):
    c = F.col("tender_value_currency")
    return raw(spark, sf_dir).select(
        "seq", c.alias("raw_currency"), text.clean_currency(c).alias("currency"),
        text.clean_currency(text.currency_from_symbol(c)).alias("currency_with_symbols"),
    )


@query(
    "clean_text",
    f"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS clean, trim(source) AS source FROM documents",
)
def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", text.clean_string(F.col("text")).alias("clean"), text.clean_id(F.col("source")).alias("source")
    )


_DECODED = "html"
for _entity, _char in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"


@query("decode_entities", f"SELECT page_id, md5({_DECODED}) AS digest, length({_DECODED}) AS chars FROM pages")
def decode_entities(spark, sf_dir):
    decoded = text.decode_entities(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.md5(decoded).alias("digest"), F.length(decoded).cast("bigint").alias("chars")
    )


@query(
    "record_hash",
    f"""{WITH_SILVER} SELECT seq, record_hash, 'ocds-base-pt-2025-' || tender_id AS contract_ocid FROM silver""",
)
def record_hash(spark, sf_dir):
    return silver(spark, sf_dir).select(
        "seq", "record_hash", keys.prefixed_id("ocds-base-pt", F.lit(2025), F.col("tender_id")).alias("contract_ocid")
    )


_SILVER_LIST = ", ".join(n for n in schemas.SILVER_COLUMNS if n not in schemas.SILVER_ARRAYS)


@query(
    "silver_clean",
    f"""{WITH_SILVER} SELECT seq, {_SILVER_LIST}, array_to_string(supplier_ids, '|') AS supplier_ids,
      array_to_string(supplier_names, '|') AS supplier_names FROM silver""",
)
def silver_clean(spark, sf_dir):
    joined = {n: F.array_join(n, "|") for n in ("supplier_ids", "supplier_names")}
    return silver(spark, sf_dir).withColumns(joined).drop("document_urls", "source")


_REASON = """CASE WHEN coalesce(ocid, '') = '' THEN 'missing ocid'
  WHEN coalesce(publication_date, '') = '' THEN 'missing publication_date'
  WHEN NOT starts_with(ocid, 'ocds-') THEN 'invalid ocid' END"""


@query(
    "validate_silver",
    f"{WITH_SILVER} SELECT seq, ocid, publication_date, record_hash FROM silver WHERE ({_REASON}) IS NULL",
)
def validate_silver(spark, sf_dir):
    good = validation.accepted(silver(spark, sf_dir))
    return good.select("seq", "ocid", "publication_date", "record_hash")


@query(
    "silver_rejects",
    f"{WITH_SILVER} SELECT seq, ocid, {_REASON} AS reject_reason FROM silver WHERE ({_REASON}) IS NOT NULL",
)
def silver_rejects(spark, sf_dir):
    return validation.rejected(silver(spark, sf_dir)).select("seq", "ocid", "reject_reason")


# ------------------------------------------------------------------- paths
@query(
    "json_paths",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS first_of_list FROM events""",
)
def json_paths(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"), F.col("props").alias("text")
    )
    listed = parsed.withColumn("list", F.array(F.col("props")))
    typed = paths.scalar_path(listed.schema, "list.0.k").column
    beyond = paths.scalar_path(listed.schema, "list.7.k").column
    return listed.select(
        "event_id", F.get_json_object("text", "$.k").cast("bigint").alias("k"),
        beyond.cast("string").alias("missing"), typed.alias("first_of_list"),
    )


# Pages of one site are nested below it, so that a wildcard gathers them again.
@query(
    "path_country",
    r"""SELECT page_id, nullif(regexp_extract(url, '(?:^|/)(?:[^/]+\.example\.[a-z]+)/([^/]+)/', 1), '') AS segment FROM pages""",
)
def path_country(spark, sf_dir):
    from procurelake.sources.scans import country_of_path

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", country_of_path(F.col("url"), r"(?:[^/]+\.example\.[a-z]+)").alias("segment"))


# ------------------------------------------------------------ release shapes
def releases(spark, sf_dir: str) -> DataFrame:
    """Tenders as nested releases in the shapes of three countries and of one without a mapping."""
    tenders = raw(spark, sf_dir)
    # a column of its own: it stands in five places below and is made once
    tenders = tenders.withColumn("flat", F.transform(
        F.arrays_zip("supplier_ids", "supplier_names"),
        lambda s: F.struct(s["supplier_ids"].alias("id"), s["supplier_names"].alias("name")),
    ))
    flat = F.col("flat")
    nested = F.transform(flat, lambda s: F.struct(s.alias("party")))
    value = F.struct(F.col("award_amount").cast("string").alias("amount"), F.col("award_currency").alias("currency"))
    numbered = lambda n: F.transform(
        F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.struct(i.cast("string").alias("id"))
    )

    def awards(suppliers):
        first = F.struct(F.col("award_date").alias("date"), value.alias("value"), suppliers.alias("suppliers"))
        again = F.struct(
            F.lit("2000-01-01").alias("date"), value.alias("value"), F.slice(suppliers, 1, 1).alias("suppliers")
        )
        return F.when(F.col("num_lots").isNotNull(), F.array(first, again))

    country = F.expr(
        "CASE WHEN seq % 50 = 7 THEN 'atlantis' WHEN seq % 3 = 0 THEN 'kosovo' WHEN seq % 3 = 1 THEN 'uk' ELSE 'portugal' END"
    )
    shaped = tenders.withColumn("country", country)
    is_kosovo = F.col("country") == "kosovo"
    buyer = F.struct(F.col("buyer_id").alias("id"), F.col("buyer_name").alias("name"))
    return shaped.select(
        "seq",
        "country",
        "source_file",
        "ocid",
        F.col("tender_id").alias("id"),
        F.col("publication_date").alias("date"),
        F.lit(None).cast("string").alias("publishedDate"),
        F.struct(
            F.when(F.col("seq") % 9 != 0, F.col("tender_id")).alias("id"),
            F.col("tender_title").alias("title"),
            F.col("tender_status").alias("status"),
            F.lit(None).cast("string").alias("datePublished"),
            F.struct(
                F.col("tender_value_amount").cast("string").alias("amount"),
                F.col("tender_value_currency").alias("currency"),
            ).alias("value"),
            F.struct(
                F.col("tender_start_date").alias("startDate"), F.col("tender_end_date").alias("endDate")
            ).alias("tenderPeriod"),
            F.col("procurement_method").alias("procurementMethod"),
            F.col("procurement_category").alias("mainProcurementCategory"),
            F.when(F.col("seq") % 2 == 0, F.lit("direct")).alias("procurement_method"),
            F.col("num_tenderers").alias("numberOfTenderers"),
            flat.alias("tenderers"),
            F.struct(buyer.alias("party")).alias("procuringEntity"),
            numbered(F.col("num_lots")).alias("lots"),
            F.array(
                F.struct(F.concat(F.lit("http://d/"), F.col("tender_id")).alias("url")),
                F.struct(F.lit(None).cast("string").alias("url")),
            ).alias("documents"),
        ).alias("tender"),
        F.when(~is_kosovo & (F.col("seq") % 4 != 0), buyer).alias("buyer"),
        F.when(~is_kosovo, F.array(buyer)).alias("parties"),
        F.when(~is_kosovo, awards(flat)).alias("awards"),
        F.when(is_kosovo, awards(nested)).alias("award"),
        F.struct(numbered(F.col("num_lots")).alias("statistics")).alias("bids"),
    )


_MAPPED_SCALARS = (
    "ocid", "source_country", "tender_id", "tender_title", "tender_status", "publication_date", "tender_start_date",
    "tender_end_date", "tender_value_amount", "tender_value_currency", "procurement_method", "procurement_category",
    "buyer_id", "buyer_name", "award_date", "award_amount", "award_currency", "num_lots", "num_tenderers", "num_awards",
)
_MAPPED_SQL = f"""{WITH_SILVER}, named AS (
    SELECT *, CASE WHEN seq % 50 = 7 THEN 'atlantis' WHEN seq % 3 = 0 THEN 'kosovo' WHEN seq % 3 = 1 THEN 'uk'
      ELSE 'portugal' END AS country FROM raw),
  mapped AS (
    SELECT seq, country AS source_country, {text_sql("ocid")} AS ocid, tender_id, {text_sql("tender_title")} AS tender_title,
      {text_sql("tender_status")} AS tender_status,
      {", ".join(f"{date_sql(c)} AS {c}" for c in schemas.SILVER_DATES)},
      coalesce(tender_value_amount, 0) AS tender_value_amount, {currency_sql("tender_value_currency")} AS tender_value_currency,
      CASE WHEN country = 'portugal' AND seq % 2 = 0 THEN 'direct' ELSE procurement_method END AS procurement_method,
      procurement_category,
      CASE WHEN country = 'uk' AND seq % 4 = 0 THEN '' ELSE buyer_id END AS buyer_id,
      CASE WHEN country = 'uk' AND seq % 4 = 0 THEN '' ELSE buyer_name END AS buyer_name,
      coalesce(award_amount, 0) AS award_amount, CASE WHEN num_lots IS NULL THEN '' ELSE award_currency END AS award_currency,
      coalesce(num_lots, 0) AS num_lots,
      coalesce(CASE country WHEN 'kosovo' THEN len(supplier_ids) WHEN 'uk' THEN num_lots ELSE num_tenderers END, 0)
        AS num_tenderers,
      CAST(CASE WHEN num_lots IS NULL THEN 0 ELSE 2 END AS BIGINT) AS num_awards,
      coalesce(array_to_string(CASE WHEN country = 'portugal' THEN supplier_ids || supplier_ids[1:1] ELSE supplier_ids END, '|'), '')
        AS supplier_ids,
      coalesce(array_to_string(CASE WHEN country = 'portugal' THEN supplier_names || supplier_names[1:1] ELSE supplier_names END, '|'), '')
        AS supplier_names,
      'http://d/' || tender_id AS document_urls
    FROM named WHERE country <> 'atlantis'),
  hashed AS (SELECT *, {hash_sql("ocid", "tender_id", "publication_date", "buyer_name")} AS record_hash FROM mapped)"""
_MAPPED_LIST = ", ".join(("seq", *_MAPPED_SCALARS, "supplier_ids", "supplier_names", "document_urls", "record_hash"))


def _flat(mapped: DataFrame, *keep: str) -> DataFrame:
    joined = {n: F.array_join(n, "|") for n in schemas.SILVER_ARRAYS}
    return mapped.withColumns(joined).select(
        *keep, *_MAPPED_SCALARS, "supplier_ids", "supplier_names", "document_urls", "record_hash"
    )


@query("map_releases", f"{_MAPPED_SQL} SELECT {_MAPPED_LIST} FROM hashed")
def map_releases(spark, sf_dir):
    return _flat(mapping.map_releases(releases(spark, sf_dir), keep=("seq",)), "seq")


@query(
    "transform_releases",
    f"{_MAPPED_SQL} SELECT seq, ocid, publication_date, record_hash FROM hashed WHERE ({_REASON}) IS NULL",
)
def transform_releases(spark, sf_dir):
    kept = mapping.transform_releases(releases(spark, sf_dir), keep=("seq",))
    return kept.select("seq", "ocid", "publication_date", "record_hash")


@query(
    "wildcard_suppliers",
    f"""{WITH_SILVER} SELECT seq, supplier FROM (
      SELECT seq, unnest(CASE WHEN seq % 50 <> 7 AND seq % 3 = 0 THEN CAST([] AS VARCHAR[])
        ELSE supplier_names || supplier_names[1:1] END) AS supplier FROM raw WHERE supplier_names IS NOT NULL)""",
)
def wildcard_suppliers(spark, sf_dir):
    nested = releases(spark, sf_dir)
    names = paths.wildcard_path(nested.schema, "awards.*.suppliers.*.name")
    return nested.select("seq", F.explode(names).alias("supplier"))


@query(
    "release_dates",
    f"""{WITH_SILVER} SELECT seq, coalesce({date_sql("publication_date")}, tender_start_date) AS release_date FROM raw""",
)
def release_dates(spark, sf_dir):
    return validation.releases_with_date(releases(spark, sf_dir)).select("seq", "release_date")


@query(
    "releases_of_year",
    f"""{WITH_SILVER} SELECT seq, ocid FROM raw
      WHERE year(CAST(coalesce({date_sql("publication_date")}, tender_start_date) AS DATE)) = 2024""",
)
def releases_of_year(spark, sf_dir):
    return validation.releases_of_year(releases(spark, sf_dir), 2024).select("seq", "ocid")


# ------------------------------------------------------------ nested notices
# Variants of where a notice names its country; one text for both engines.
_CODE = "CASE WHEN seq % 6 = 0 THEN 'DEU' WHEN seq % 6 = 1 THEN 'XYZ' END"
_PLACE = "CASE WHEN seq % 6 = 2 THEN 'Portugal, Aveiro' WHEN seq % 6 = 3 AND seq % 4 = 1 THEN 'Lisboa, Portugal ' WHEN seq % 6 = 4 THEN 'Paris' END"
_ORIGIN = "CASE WHEN seq % 6 = 3 THEN 'BASE.gov.pt' ELSE 'TED' END"
_BUYER = "CASE WHEN seq % 6 = 4 THEN 'Câmara de ' || buyer_name ELSE buyer_name END"
_PAID = "CASE WHEN seq % 10 = 0 THEN NULL ELSE award_amount END"


def _notices(spark, sf_dir: str) -> DataFrame:
    party = F.transform(
        F.arrays_zip("supplier_ids", "supplier_names"),
        lambda s: F.struct(s["supplier_ids"].alias("nipc"), s["supplier_names"].alias("name")),
    )
    return raw(spark, sf_dir).select(
        "seq",
        F.col("tender_id").alias("source_id"),
        F.expr(_ORIGIN).alias("source"),
        F.col("tender_title").alias("contract_object"),
        F.col("tender_value_amount").alias("contract_price"),
        F.expr(_PAID).alias("effective_total_price"),
        F.col("tender_value_currency").alias("currency"),
        F.col("tender_status").alias("state"),
        F.col("publication_date"),
        F.col("award_date").alias("contract_date"),
        F.when(F.col("seq") % 5 != 0, F.col("tender_end_date")).alias("closing_date"),
        F.lit("30 dias").alias("execution_deadline"),
        F.col("procurement_method").alias("procedure_type"),
        F.when(F.col("seq") % 8 != 0, F.array("procurement_category", F.lit("x"))).alias("contract_types"),
        F.array(
            F.struct(
                F.col("buyer_id").alias("nipc"), F.expr(_BUYER).alias("name"), F.expr(_CODE).alias("country")
            )
        ).alias("contracting_authorities"),
        party.alias("contractors"),
        F.expr(_PLACE).alias("execution_location"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("http://p/"), F.col("tender_id"))).alias("procurement_documents_url"),
        F.concat(F.lit("http://s/"), F.col("tender_id")).alias("source_url"),
        "source_file",
    )


_COUNTRY_TIERS = f"""CASE WHEN seq % 6 = 0 THEN 'germany' WHEN seq % 6 = 1 THEN 'xyz' WHEN seq % 6 = 2 THEN 'portugal'
  WHEN seq % 6 = 3 THEN 'portugal' WHEN seq % 6 = 4 THEN 'portugal' ELSE 'unknown' END"""
_NO_DURATION = "CASE WHEN lower({0}) NOT LIKE '% dia%' THEN {1} END"
_RAW_PUBLISHED = "coalesce(publication_date, award_date, CASE WHEN seq % 5 <> 0 THEN tender_end_date END)"


_NOTICES_SQL = f"""{WITH_SILVER}, m AS (SELECT seq, 'ocds-ted-' || tender_id AS ocid, {_COUNTRY_TIERS} AS source_country, tender_id,
        tender_id AS source_publication_id, {text_sql("tender_title")} AS tender_title,
        {_NO_DURATION.format(_RAW_PUBLISHED, date_sql(_RAW_PUBLISHED))} AS publication_date,
        award_date AS tender_start_date, award_date,
        CASE WHEN seq % 5 <> 0 THEN tender_end_date END AS tender_end_date,
        coalesce(tender_value_amount, {_PAID}, 0) AS tender_value_amount,
        coalesce({_PAID}, tender_value_amount, 0) AS award_amount,
        {currency_sql("tender_value_currency")} AS tender_value_currency, {currency_sql("tender_value_currency")} AS award_currency,
        procurement_method, CASE WHEN seq % 8 = 0 THEN '' ELSE procurement_category END AS procurement_category,
        buyer_id, {text_sql(_BUYER)} AS buyer_name, {text_sql("tender_status")} AS tender_status,
        CAST(0 AS BIGINT) AS num_lots, coalesce(len(supplier_ids), 0) AS num_tenderers,
        coalesce(len(supplier_ids), 0) AS num_awards,
        coalesce(array_to_string(supplier_ids, '|'), '') AS supplier_ids,
        coalesce(array_to_string(supplier_names, '|'), '') AS supplier_names,
        CASE WHEN seq % 2 = 0 THEN 'http://p/' || tender_id || '|' ELSE '' END || 'http://s/' || tender_id AS document_urls
      FROM raw)"""
_NOTICES_LIST = f"""{_MAPPED_LIST.replace(", record_hash", "")},
        {hash_sql("ocid", "tender_id", "publication_date", "buyer_name")} AS record_hash"""


@query("map_notices", f"{_NOTICES_SQL} SELECT {_NOTICES_LIST} FROM m")
def map_notices(spark, sf_dir):
    return _flat(notices.map_notices(_notices(spark, sf_dir), keep=("seq",)), "seq")


@query(
    "country_tiers",
    f"{WITH_SILVER} SELECT {_COUNTRY_TIERS} AS country, COUNT(*) AS records FROM raw GROUP BY 1",
)
def country_tiers(spark, sf_dir):
    buyer = F.get("contracting_authorities", F.lit(0))
    found = lookups.notice_country(buyer["country"], F.col("execution_location"), F.col("source"), buyer["name"])
    return _notices(spark, sf_dir).groupBy(found.alias("country")).agg(F.count("*").alias("records"))


# ------------------------------------------------------------- contract rows
_BUYER_TEXT = "CASE WHEN seq % 3 = 0 THEN buyer_name ELSE buyer_id || ' - ' || buyer_name || ' - x' END"


def _contract_rows(spark, sf_dir: str) -> DataFrame:
    pairs = F.transform(
        F.arrays_zip("supplier_ids", "supplier_names"),
        lambda s: F.concat(s["supplier_ids"], F.lit(" - "), s["supplier_names"]),
    )
    return raw(spark, sf_dir).select(
        "seq",
        F.expr("CASE WHEN seq % 21 = 0 THEN NULL ELSE tender_id END").alias("idcontrato"),
        F.expr("CASE WHEN seq % 22 = 0 THEN '' ELSE tender_title END").alias("objectoContrato"),
        F.lit("desc").alias("descContrato"),
        F.expr(_BUYER_TEXT).alias("adjudicante"),
        F.array_join(pairs, "; ").alias("adjudicatarios"),
        F.concat(F.col("buyer_id"), F.lit(",50 €")).alias("precoContratual"),
        F.expr("CASE WHEN seq % 4 = 0 THEN NULL ELSE buyer_id || '.75' END").alias("PrecoTotalEfetivo"),
        F.col("publication_date").alias("dataPublicacao"),
        F.col("procurement_category").alias("tipoContrato"),
        F.col("procurement_method").alias("tipoprocedimento"),
    )


@query(
    "party_split",
    f"""{WITH_SILVER}, b AS (SELECT seq, {_BUYER_TEXT} AS t, seq % 3 <> 0 AS split FROM raw)
      SELECT seq, CASE WHEN split THEN regexp_extract(t, '^(.*?) - ', 1) ELSE '' END AS id,
        CASE WHEN split THEN trim(regexp_replace(t, '^.*? - ', '')) ELSE t END AS name FROM b""",
)
def party_split(spark, sf_dir):
    return _contract_rows(spark, sf_dir).select("seq", text.party(F.col("adjudicante")).alias("p")).select("seq", "p.*")


@query(
    "party_list",
    f"{WITH_SILVER} SELECT seq, unnest(supplier_ids) AS id, unnest(supplier_names) AS name FROM raw",
)
def party_list(spark, sf_dir):
    rows = _contract_rows(spark, sf_dir)
    return rows.select("seq", F.explode(text.party_list(F.col("adjudicatarios"))).alias("p")).select("seq", "p.*")


@query(
    "contracts_to_silver",
    f"""{WITH_SILVER}, c AS (SELECT *, {_BUYER_TEXT} AS b, {date_sql("publication_date")} AS d,
        CASE WHEN seq % 21 = 0 THEN NULL ELSE tender_id END AS contract FROM raw)
      SELECT 'ocds-base-pt-2025-' || tender_id AS ocid, tender_id, coalesce(d, '2025-01-01') AS publication_date,
        CASE WHEN coalesce({text_sql("CASE WHEN seq % 22 = 0 THEN '' ELSE tender_title END")}, '') = ''
          THEN 'desc' ELSE {text_sql("tender_title")} END AS tender_title,
        CAST(buyer_id AS DOUBLE) + 0.5e0 AS tender_value_amount,
        CASE WHEN seq % 3 = 0 THEN '' ELSE buyer_id END AS buyer_id,
        {text_sql("CASE WHEN seq % 3 = 0 THEN b ELSE regexp_replace(b, '^.*? - ', '') END")} AS buyer_name,
        CASE WHEN num_lots IS NULL THEN 0.0e0 WHEN seq % 4 = 0 THEN CAST(buyer_id AS DOUBLE) + 0.5e0
          ELSE CAST(buyer_id AS DOUBLE) + 0.75e0 END AS award_amount,
        coalesce(array_to_string(supplier_names, '|'), '') AS supplier_names, procurement_method, procurement_category,
        CAST(CASE WHEN num_lots IS NULL THEN 0 ELSE 1 END AS BIGINT) AS num_awards FROM c WHERE contract IS NOT NULL""",
)
def contracts_to_silver(spark, sf_dir):
    return _contracts_silver(_contract_rows(spark, sf_dir))


def _contracts_silver(rows: DataFrame) -> DataFrame:
    nested = contracts.contracts_to_releases(rows, 2025)
    portugal = mapping.default_registry().only("portugal")  # contract rows have one shape
    kept = mapping.transform_releases(nested.withColumn("country", F.lit("portugal")), registry=portugal)
    return kept.withColumn("supplier_names", F.array_join("supplier_names", "|")).select(
        "ocid", "tender_id", "publication_date", "tender_title", "tender_value_amount", "buyer_id", "buyer_name",
        "award_amount", "supplier_names", "procurement_method", "procurement_category", "num_awards",
    )


# --------------------------------------------------------- relational extract
def relational_tables(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as tenders, customers as buyers, line items as lots, with both link tables."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lot = F.concat_ws("-", "l_orderkey", "l_linenumber")
    key = F.col("o_orderkey").cast("string")
    return {
        "tenders": orders.select(
            key.alias("tender_id"),
            F.expr("CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END").alias("tender_title"),
            F.col("o_orderstatus").alias("tender_supplyType"),
            F.col("o_totalprice").alias("tender_estimatedPrice"),
            F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END").alias("publication_date"),
            F.col("o_orderdate").alias("tender_bidDeadline"),
            F.lit("open").alias("tender_procedureType"),
            F.lit("works").alias("main_nature"),
            F.col("o_orderpriority").alias("tender_mainCpv"),
            F.col("o_orderdate").alias("ingestion_timestamp"),
        ),
        "buyers": table(spark, sf_dir, "customer").select(
            F.col("c_custkey").cast("string").alias("buyer_id"), F.col("c_name").alias("buyer_name"),
            F.col("c_mktsegment").alias("buyer_buyerType"),
        ),
        "tender_buyer": orders.select(
            key.alias("tender_id"), F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS STRING) END").alias("buyer_id")
        ),
        "lots": lines.groupBy(lot.alias("lot_id")).agg(
            F.max("l_linestatus").alias("lot_status"), F.max("l_extendedprice").alias("lot_estimatedPrice"),
            F.max("l_returnflag").alias("cpv_code"), F.max("l_extendedprice").alias("estimated_value"),
        ),
        "tender_lot": lines.select(
            F.col("l_orderkey").cast("string").alias("tender_id"), lot.alias("lot_id"), F.col("l_linenumber").alias("_lot_row")
        ),
    }


@query(
    "relational_merge",
    """WITH lots AS (SELECT l_orderkey, l_linenumber, MAX(l_linestatus) AS lot_status, MAX(l_extendedprice) AS value
        FROM lineitem GROUP BY ALL),
      first AS (SELECT * FROM lots QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1),
      tenders AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
          CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS title,
          CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published,
          CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS buyer FROM orders)
      SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, 'ocds-partner-' || o_orderkey AS ocid, 'PT' AS source_country,
        title AS tender_title, o_orderstatus AS tender_description, lot_status AS tender_status,
        coalesce(value, 0) AS tender_value_amount, strftime(published, '%Y-%m-%d') AS publication_date,
        CAST(buyer AS VARCHAR) AS buyer_id, c_name AS buyer_name, o_orderpriority AS cpv_code
      FROM tenders LEFT JOIN first ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = buyer
      WHERE title IS NOT NULL AND published IS NOT NULL""",
)
def relational_merge(spark, sf_dir):
    merged = relational.transform(
        relational_tables(spark, sf_dir), order=[F.col("buyer_id")], lot_order=[F.col("_lot_row"), F.col("lot_id")]
    )
    return merged.select(
        "tender_id", "ocid", "source_country", "tender_title", "tender_description", "tender_status",
        "tender_value_amount", F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"),
        "buyer_id", "buyer_name", "cpv_code",
    )
