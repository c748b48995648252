"""The given order tables seen as raw tenders, and the same view in the check dialect.

Orders are tenders, customers are buyers, nations are countries, line items give
lots, awards and suppliers. Arithmetic on the order key only decides which *variant*
of a value a row carries (a malformed date, a missing amount); no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.operators import cleaning, enrich
from procurelake.session import scratch_path
from procurelake.sinks import writers
from procurelake.sources import scans

AS_OF = "2025-03-15"
TABLES = ("orders", "customer", "nation", "lineitem", "supplier")

_DAY = "CAST(CAST(o.o_orderdate AS DATE) + INTERVAL '24' YEAR AS DATE)"
_ISO = f"CAST({_DAY} AS STRING)"
_KEY = "CAST(o.o_orderkey AS STRING)"

# One text for both engines; only the arrays differ.
_RAW = f"""
WITH lines AS (
  SELECT l.l_orderkey,
         {{parties}} AS parties,
         MIN(l.l_shipdate) AS first_shipped,
         CAST(SUM(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS award_amount,
         COUNT(*) AS num_lots
  FROM {{lineitem}} l JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey
  GROUP BY l.l_orderkey
)
SELECT
  o.o_orderkey AS seq,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'bad-' || {_KEY}
       WHEN o.o_orderkey % 19 = 0 THEN 'ocds-t-' || CAST(o.o_orderkey - 1 AS STRING)
       ELSE 'ocds-t-' || {_KEY} END AS ocid,
  {_KEY} AS tender_id,
  CASE WHEN o.o_orderkey % 19 IN (0, 18) THEN 'P' ELSE o.o_orderstatus END AS source_publication_id,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'ocp' WHEN 1 THEN 'ted' WHEN 2 THEN 'base_portugal' ELSE 'partner' END AS source,
  CASE c.c_nationkey WHEN 0 THEN 'PT' WHEN 1 THEN 'GB' WHEN 2 THEN 'LTu' WHEN 3 THEN ' ES ' WHEN 4 THEN 'germany'
       WHEN 5 THEN 'united_kingdom' WHEN 6 THEN 'IT' WHEN 7 THEN 'HR' WHEN 8 THEN 'XK' WHEN 9 THEN 'AL'
       WHEN 10 THEN 'PT' WHEN 11 THEN 'Portugal' WHEN 12 THEN NULL ELSE n.n_name END AS source_country,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE c.c_mktsegment || '   ' || o.o_orderpriority || ' ' END AS tender_title,
  CASE WHEN o.o_orderkey % 31 = 0 THEN NULL WHEN o.o_orderkey % 7 = 0 THEN 0.0e0 WHEN o.o_orderkey % 101 = 0 THEN -5.0e0
       ELSE o.o_totalprice END AS tender_value_amount,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN ' eur' WHEN 2 THEN ' gbp ' WHEN 3 THEN '€' ELSE 'EURO' END
    AS tender_value_currency,
  CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
       WHEN o.o_orderkey % 59 = 0 THEN '30 dias'
       WHEN o.o_orderkey % 61 = 0 THEN '2025-02-30'
       WHEN o.o_orderkey % 67 = 0 THEN CAST(CAST(o.o_orderdate AS DATE) AS STRING)
       WHEN o.o_orderkey % 71 = 0 THEN CAST(CAST({_DAY} + INTERVAL '10' YEAR AS DATE) AS STRING)
       WHEN o.o_orderkey % 5 = 1 THEN {_ISO} || 'T10:00:00Z'
       WHEN o.o_orderkey % 5 = 2 THEN {_ISO} || 'T10:30:00.123456+01:00'
       WHEN o.o_orderkey % 5 = 3 THEN {_ISO} || ' 16:31:02.112T12:00:00Z'
       ELSE {_ISO} END AS publication_date,
  CAST(CAST({_DAY} - INTERVAL '10' DAY AS DATE) AS STRING) AS tender_start_date,
  CASE WHEN o.o_orderkey % 23 = 0 THEN CAST(CAST({_DAY} - INTERVAL '20' DAY AS DATE) AS STRING)
       ELSE CAST(CAST({_DAY} + INTERVAL '30' DAY AS DATE) AS STRING) END AS tender_end_date,
  CAST(CAST(CAST(t.first_shipped AS DATE) + INTERVAL '24' YEAR AS DATE) AS STRING) AS award_date,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Aquisição de serviços' WHEN '2-HIGH' THEN 'Radovi'
       WHEN '3-MEDIUM' THEN 'Mallra' WHEN '4-NOT SPECIFIED' THEN 'goods' ELSE 'Consultoria' END AS procurement_category,
  c.c_mktsegment AS procurement_method,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderstatus END AS tender_status,
  CAST(c.c_custkey AS STRING) AS buyer_id,
  CASE WHEN c.c_custkey % 11 = 0 THEN '' ELSE c.c_name END AS buyer_name,
  {{names}} AS supplier_names, {{ids}} AS supplier_ids,
  t.award_amount, 'EUR' AS award_currency,
  t.num_lots, CAST({{size}} AS BIGINT) AS num_awards, CAST({{size}} AS BIGINT) AS num_tenderers,
  'part-' || CAST(o.o_orderkey % 16 AS STRING) AS source_file,
  {_ISO} || 'T00:00:00Z' AS processing_timestamp
FROM {{orders}} o
JOIN {{customer}} c ON c.c_custkey = o.o_custkey
JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
LEFT JOIN lines t ON t.l_orderkey = o.o_orderkey
"""


def _dialect(**texts: str) -> str:
    filled = _RAW
    for name, value in texts.items():
        filled = filled.replace("{" + name + "}", value)
    return filled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tenders, one per order, with ``seq`` as their order and ``source`` as their origin."""
    text = _dialect(
        parties="sort_array(collect_set(struct(s.s_name AS name, CAST(l.l_suppkey AS STRING) AS id)))",
        names="t.parties.name", ids="t.parties.id", size="size(t.parties)",
    )
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES})


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean tenders with their hash, ``seq`` and ``source``."""
    from procurelake.functions import keys

    return cleaning.clean_record(raw(spark, sf_dir), keep=("seq", "source")).withColumn(
        "record_hash", keys.record_hash()
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean tenders with the Gold columns, duplicates included."""
    return enrich.enrich(silver(spark, sf_dir), AS_OF)


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table: enriched tenders, one per (ocid, source_publication_id)."""
    return enrich.to_gold(silver(spark, sf_dir), AS_OF, [F.col("seq")])


_STORED: dict[tuple[str, str], str] = {}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table as it is stored by country and year: written once per application and folder, then read by all questions."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{scratch_path(spark, 'unified')}/gold"
        writers.write_gold(unified(spark, sf_dir), path)
        _STORED[key] = path
    return scans.gold(spark, _STORED[key])


# ------------------------------------------------------------- check dialect
def date_sql(c: str) -> str:
    repaired = rf"regexp_replace({c}, ' (\d{{2}}:\d{{2}}:\d{{2}}\.\d+)T\d{{2}}:\d{{2}}:\d{{2}}', 'T\1')"
    bare = rf"replace(regexp_replace({repaired}, '[+-]\d{{2}}:\d{{2}}$', ''), 'Z', '')"
    formats = ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
    tries = ", ".join(f"try_strptime({bare}, '{f}')" for f in formats)
    return f"strftime(coalesce({tries}), '%Y-%m-%d')"


def text_sql(c: str) -> str:
    return rf"coalesce(trim(regexp_replace({c}, '[\s\x{{A0}}]+', ' ', 'g')), '')"


def currency_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(upper(trim({c})), '^[A-Z]{{3}}$') THEN upper(trim({c})) ELSE '' END"


def country_sql(c: str) -> str:
    bare = f"trim(coalesce({c}, 'None'))"
    names = {
        "PT": "portugal", "GB": "uk", "LTu": "lithuania", "ES": "spain", "IT": "italy", "HR": "croatia",
        "XK": "kosovo", "AL": "albania", "united_kingdom": "uk",
    }
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {bare} {whens} ELSE lower({bare}) END"


def hash_sql(*columns: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce({c}, 'None')" for c in columns) + ")"


def money_sql(c: str = "tender_value_amount") -> str:
    return f"CAST(coalesce(SUM(CAST({c} AS DECIMAL(18, 2))), 0) AS DOUBLE)"


def mean_sql(c: str = "tender_value_amount") -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE) / COUNT({c})"


_CHECK_RAW = _dialect(
    parties="list_sort(list(DISTINCT {'name': s.s_name, 'id': CAST(l.l_suppkey AS STRING)}))",
    names="CASE WHEN t.parties IS NOT NULL THEN [p.name for p in t.parties] END",
    ids="CASE WHEN t.parties IS NOT NULL THEN [p.id for p in t.parties] END",
    size="len(t.parties)",
)
for _t in TABLES:
    _CHECK_RAW = _CHECK_RAW.replace("{" + _t + "}", _t)

_STRINGS = (
    "ocid", "source_country", "source_publication_id", "tender_id", "tender_title", "tender_status",
    "procurement_method", "procurement_category", "buyer_id", "buyer_name", "source_file", "processing_timestamp",
)
_CHECK_CLEAN = f"""
SELECT seq, source,
  {", ".join(f"{date_sql(c)} AS {c}" for c in ("publication_date", "tender_start_date", "tender_end_date", "award_date"))},
  {", ".join(f"{text_sql(c)} AS {c}" for c in _STRINGS)},
  coalesce(tender_value_amount, 0) AS tender_value_amount, coalesce(award_amount, 0) AS award_amount,
  {currency_sql("tender_value_currency")} AS tender_value_currency, award_currency,
  coalesce(supplier_ids, []) AS supplier_ids, coalesce(supplier_names, []) AS supplier_names,
  CAST([] AS VARCHAR[]) AS document_urls,
  coalesce(num_lots, 0) AS num_lots, coalesce(num_tenderers, 0) AS num_tenderers, coalesce(num_awards, 0) AS num_awards
FROM raw
"""
_FILLED = " + ".join(
    [f"CASE WHEN coalesce({c}, '') <> '' THEN 1.0e0 ELSE 0.0e0 END" for c in enrich.REQUIRED_FIELDS]
    + ["CASE WHEN tender_value_amount > 0 THEN 0.5e0 ELSE 0.0e0 END"]
    + [f"CASE WHEN coalesce({c}, '') <> '' THEN 0.5e0 ELSE 0.0e0 END" for c in enrich.IMPORTANT_FIELDS[1:]]
)
_CATEGORY_SQL = (
    "CASE procurement_category WHEN 'Aquisição de serviços' THEN 'services' WHEN 'Radovi' THEN 'works' "
    "WHEN 'Mallra' THEN 'goods' WHEN 'goods' THEN 'goods' ELSE '' END"
)
_CHECK_ENRICHED = f"""
SELECT *, ({_FILLED}) / 7.0e0 AS data_completeness_score
FROM (
  SELECT * EXCLUDE (source_country),
    {country_sql("source_country")} AS source_country,
    procurement_category AS procurement_category_original,
    {_CATEGORY_SQL} AS procurement_category_standardized,
    CAST(coalesce(year(CAST(publication_date AS DATE)), 0) AS INTEGER) AS year,
    CAST(coalesce(month(CAST(publication_date AS DATE)), 0) AS INTEGER) AS month,
    CAST(coalesce(quarter(CAST(publication_date AS DATE)), 0) AS INTEGER) AS quarter,
    CASE WHEN publication_date IS NULL THEN 'missing' WHEN publication_date > '2030-12-31' THEN 'future'
         WHEN publication_date < '2000-01-01' THEN 'past' ELSE 'valid' END AS date_quality_flag,
    coalesce(publication_date > '{AS_OF}', false) AS is_future_date,
    tender_value_amount > 0 AS has_value,
    award_amount > 0 AS has_award
  FROM silver)
"""
_RANK = "CASE source WHEN 'ocp' THEN 0 WHEN 'ted' THEN 1 WHEN 'base_portugal' THEN 2 ELSE 3 END"
_CHECK_GOLD = f"""
SELECT * FROM enriched
QUALIFY row_number() OVER (PARTITION BY ocid, source_publication_id ORDER BY {_RANK}, seq) = 1
"""

WITH_SILVER = (
    f"WITH raw AS ({_CHECK_RAW}), clean AS ({_CHECK_CLEAN}), "
    f"silver AS (SELECT *, {hash_sql('ocid', 'tender_id', 'publication_date', 'buyer_name')} AS record_hash FROM clean)"
)
WITH_ENRICHED = f"{WITH_SILVER}, enriched AS ({_CHECK_ENRICHED})"
WITH_GOLD = f"{WITH_ENRICHED}, gold AS ({_CHECK_GOLD})"
