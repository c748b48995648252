"""Queries over the unified table: enrichment, deduplication, aggregates, SQL questions, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake.catalog import query
from procurelake.catalog.tenders import (
    AS_OF, WITH_ENRICHED, WITH_GOLD, WITH_SILVER, country_sql, enriched, gold, mean_sql, money_sql, silver, unified,
)
from procurelake.functions import lookups
from procurelake.operators import aggregates, enrich, profile
from procurelake.plans import questions
from procurelake.session import staged

_VALUES = f"COUNT(ocid) AS total_records, {money_sql()} AS total_value, {mean_sql()} AS avg_value"
_GOLD_COLUMNS = (
    "ocid", "source_publication_id", "source", "source_country", "tender_id", "publication_date", "year", "month",
    "quarter", "procurement_category_original", "procurement_category_standardized", "is_future_date", "has_value",
    "has_award", "data_completeness_score", "date_quality_flag", "tender_value_amount", "award_amount",
)
_LIST = ", ".join(_GOLD_COLUMNS)


@query("unified_enriched", f"{WITH_ENRICHED} SELECT {_LIST} FROM enriched")
def unified_enriched(spark, sf_dir):
    """All sources as frames of their own, united by name and enriched."""
    tenders = staged(silver(spark, sf_dir), "silver")
    sources = {tag: tenders.where(F.col("source") == tag).drop("source") for tag in enrich.SOURCE_PRIORITY}
    whole = enrich.enrich(enrich.unify(sources), AS_OF)
    return whole.select(*_GOLD_COLUMNS)


@query("unified_dedup", f"{WITH_GOLD} SELECT {_LIST} FROM gold")
def unified_dedup(spark, sf_dir):
    return unified(spark, sf_dir).select(*_GOLD_COLUMNS)


_BY_SCORE = """
SELECT ocid, source_publication_id, tender_id, data_completeness_score FROM enriched
QUALIFY row_number() OVER (PARTITION BY ocid, source_publication_id
  ORDER BY data_completeness_score DESC,
           CASE source WHEN 'ocp' THEN 0 WHEN 'ted' THEN 1 WHEN 'base_portugal' THEN 2 ELSE 3 END, seq) = 1
"""


@query("dedup_by_completeness", f"{WITH_ENRICHED} {_BY_SCORE}")
def dedup_by_completeness(spark, sf_dir):
    best = enrich.drop_duplicates(enriched(spark, sf_dir), [F.col("seq")], by="completeness")
    return best.select("ocid", "source_publication_id", "tender_id", "data_completeness_score")


@query(
    "dictionary_lookup",
    f"""{WITH_SILVER}
    SELECT {country_sql("source_country")} AS country, procurement_category,
      CASE procurement_category WHEN 'Aquisição de serviços' THEN 'services' WHEN 'Radovi' THEN 'works'
        WHEN 'Mallra' THEN 'goods' WHEN 'goods' THEN 'goods' ELSE '' END AS category, COUNT(*) AS records
    FROM silver GROUP BY ALL""",
)
def dictionary_lookup(spark, sf_dir):
    tenders = silver(spark, sf_dir)
    # Counting raw values first leaves the lookups to a handful of rows.
    counted = tenders.groupBy("source_country", "procurement_category").agg(F.count("*").alias("n"))
    return (
        counted.groupBy(
            lookups.standard_country(F.col("source_country")).alias("country"),
            "procurement_category",
            lookups.standard_category(F.col("procurement_category")).alias("category"),
        )
        .agg(F.sum("n").alias("records"))
    )


@query(
    "country_summary",
    f"""{WITH_GOLD},
    base AS (
      SELECT source_country, COUNT(ocid) AS total_records, {money_sql()} AS total_value_sum, {mean_sql()} AS avg_value,
             round(median(tender_value_amount), 4) AS median_value, COUNT(DISTINCT buyer_name) AS num_buyers,
             MIN(publication_date) AS date_range_start, MAX(publication_date) AS date_range_end
      FROM gold GROUP BY source_country),
    sup AS (
      SELECT source_country, COUNT(DISTINCT s) AS n
      FROM (SELECT source_country, unnest(supplier_names) AS s FROM gold) GROUP BY source_country)
    SELECT base.*, coalesce(sup.n, 0) AS num_suppliers FROM base LEFT JOIN sup USING (source_country)""",
)
def country_summary(spark, sf_dir):
    summary = aggregates.country_summary(gold(spark, sf_dir))
    return summary.withColumn("median_value", F.round("median_value", 4))


@query(
    "monthly_trends",
    f"""{WITH_GOLD} SELECT year, month, {_VALUES}, COUNT(DISTINCT source_country) AS num_countries,
      COUNT(DISTINCT buyer_name) AS num_buyers FROM gold WHERE year > 0 GROUP BY year, month ORDER BY year, month""",
)
def monthly_trends(spark, sf_dir):
    return aggregates.monthly_trends(gold(spark, sf_dir))


@query(
    "category_analysis",
    f"""{WITH_GOLD} SELECT source_country, procurement_category_standardized, {_VALUES} FROM gold
      GROUP BY source_country, procurement_category_standardized""",
)
def category_analysis(spark, sf_dir):
    return aggregates.category_analysis(gold(spark, sf_dir))


@query(
    "top_buyers",
    f"""{WITH_GOLD} SELECT buyer_name, source_country, {_VALUES} FROM gold WHERE buyer_name <> ''
      GROUP BY buyer_name, source_country ORDER BY total_records DESC, buyer_name, source_country LIMIT 100""",
)
def top_buyers(spark, sf_dir):
    return aggregates.top_buyers(gold(spark, sf_dir))


@query(
    "top_suppliers",
    f"""{WITH_GOLD}, x AS (SELECT *, unnest(supplier_names) AS supplier_name FROM gold)
      SELECT supplier_name, source_country, {_VALUES} FROM x WHERE supplier_name <> ''
      GROUP BY supplier_name, source_country ORDER BY total_records DESC, supplier_name, source_country LIMIT 100""",
)
def top_suppliers(spark, sf_dir):
    return aggregates.top_suppliers(gold(spark, sf_dir))


@query(
    "unmapped_categories",
    f"""{WITH_ENRICHED} SELECT procurement_category, COUNT(*) AS records FROM enriched
      WHERE procurement_category <> '' AND procurement_category_standardized = '' GROUP BY procurement_category""",
)
def unmapped_categories(spark, sf_dir):
    return enrich.unmapped_categories(enriched(spark, sf_dir))


# ------------------------------------------------------------- SQL questions
@query("sql_total", f"{WITH_GOLD} SELECT COUNT(*) AS total_tenders FROM gold")
def sql_total(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.TOTAL)


_TOP = f"""SELECT source_country, COUNT(*) AS tender_count, {money_sql()} AS total_value, {mean_sql()} AS avg_value
  FROM gold WHERE {{}} GROUP BY source_country ORDER BY tender_count DESC, source_country LIMIT 10"""


@query("sql_top_countries", f"{WITH_GOLD} {_TOP.format('source_country IS NOT NULL')}")
def sql_top_countries(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.TOP_COUNTRIES, condition="source_country IS NOT NULL")


@query("sql_top_countries_valued", f"{WITH_GOLD} {_TOP.format('tender_value_amount > 0')}")
def sql_top_countries_valued(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.TOP_COUNTRIES, condition="tender_value_amount > 0")


@query(
    "sql_source_split",
    f"""{WITH_GOLD} SELECT source, COUNT(*) AS tender_count FROM gold WHERE source_country = 'portugal'
      GROUP BY source ORDER BY source""",
)
def sql_source_split(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.SOURCE_SPLIT)


_MONTHS = f"""SELECT year, month, COUNT(*) AS tender_count, {money_sql()} AS total_value FROM gold
  WHERE year IN (2024, 2025) AND {{}} GROUP BY year, month ORDER BY year, month"""


@query("sql_month_trend", f"{WITH_GOLD} {_MONTHS.format('publication_date IS NOT NULL')}")
def sql_month_trend(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.MONTHS, condition="publication_date IS NOT NULL")


_VALID = "date_quality_flag = 'valid'"


@query("sql_month_trend_valid", f"{WITH_GOLD} {_MONTHS.format(_VALID)}")
def sql_month_trend_valid(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.MONTHS, condition="date_quality_flag = 'valid'")


@query(
    "sql_year_totals",
    f"""{WITH_GOLD} SELECT source_country, {money_sql()} AS total_value, COUNT(*) AS tender_count FROM gold
      WHERE year = 2025 AND tender_value_amount IS NOT NULL GROUP BY source_country""",
)
def sql_year_totals(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.YEAR_TOTALS)


@query(
    "sql_month_average",
    f"""{WITH_GOLD} SELECT year, month, {mean_sql()} AS avg_value, COUNT(*) AS tender_count FROM gold
      WHERE year = 2025 AND tender_value_amount IS NOT NULL GROUP BY year, month""",
)
def sql_month_average(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.MONTH_AVERAGE)


@query(
    "sql_high_value",
    f"""{WITH_GOLD} SELECT tender_id, tender_title, buyer_name, source_country, tender_value_amount,
      tender_value_currency, publication_date FROM gold
      WHERE tender_value_amount > 300000 AND tender_value_currency = 'EUR' AND tender_title IS NOT NULL
      ORDER BY tender_value_amount DESC, tender_id LIMIT 100""",
)
def sql_high_value(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.HIGH_VALUE, floor=300000, rows=100)


@query(
    "sql_country_sizes",
    f"""{WITH_GOLD} SELECT CASE WHEN COUNT(*) > (SELECT COUNT(*) * 0.1 FROM gold) THEN 'large' ELSE 'small' END AS kind,
      source_country, COUNT(*) AS tender_count FROM gold GROUP BY source_country""",
)
def sql_country_sizes(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.COUNTRY_SIZES, share=0.1)


@query(
    "sql_keyword_search",
    f"""{WITH_GOLD} SELECT tender_id, tender_title, buyer_name, publication_date, tender_value_amount FROM gold
      WHERE lower(tender_title) LIKE '%machinery%' OR lower(tender_title) LIKE '%urgent%'
         OR lower(tender_title) LIKE '%high%'
      ORDER BY publication_date DESC NULLS LAST, tender_id LIMIT 50""",
)
def sql_keyword_search(spark, sf_dir):
    words = questions.keyword_condition(["machinery", "urgent", "high"])
    return questions.ask(gold(spark, sf_dir), questions.KEYWORDS, condition=words, rows=50)


@query(
    "sql_recent_window",
    f"""{WITH_GOLD} SELECT tender_id, tender_title, publication_date, tender_value_amount, tender_value_currency
      FROM gold WHERE source_country = 'portugal'
        AND CAST(publication_date AS DATE) >= CAST('{AS_OF}' AS DATE) - INTERVAL '1' MONTH
      ORDER BY publication_date DESC, tender_id LIMIT 100""",
)
def sql_recent_window(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.LAST_MONTH, as_of=AS_OF)


@query(
    "sql_category_share",
    f"""{WITH_GOLD} SELECT procurement_category_standardized, COUNT(*) AS tender_count,
      ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS percentage FROM gold
      WHERE procurement_category_standardized <> '' GROUP BY procurement_category_standardized""",
)
def sql_category_share(spark, sf_dir):
    return questions.ask(gold(spark, sf_dir), questions.CATEGORY_SHARE)


# ---------------------------------------------------------------- statistics
def _section(name: str, key: str, limit: int) -> str:
    return f"""SELECT '{name}' AS section, {key} AS key, COUNT(*) AS records,
      row_number() OVER (ORDER BY COUNT(*) DESC, {key}) AS place
      FROM gold GROUP BY {key} QUALIFY place <= {limit}"""


@query(
    "gold_stats",
    f"""{WITH_GOLD} {_section("source", "source", 100)}
      UNION ALL {_section("country", "source_country", 10)}
      UNION ALL {_section("category", "procurement_category_standardized", 5)}
      UNION ALL {_section("date_flag", "date_quality_flag", 100)}""",
)
def gold_stats(spark, sf_dir):
    return profile.gold_stats(gold(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(
    "gold_overview",
    f"""{WITH_GOLD} SELECT COUNT(*) AS total_records, MIN(publication_date) AS first_date,
      MAX(publication_date) AS last_date, COUNT(DISTINCT source_country) AS countries,
      round(AVG(data_completeness_score), 6) AS avg_completeness,
      COUNT(*) FILTER (date_quality_flag = 'valid') AS valid_dates,
      COUNT(*) FILTER (is_future_date) AS future_dates FROM gold""",
)
def gold_overview(spark, sf_dir):
    row = profile.gold_overview(gold(spark, sf_dir))
    return row.withColumn("avg_completeness", F.round("avg_completeness", 6))


@query(
    "partition_stats",
    f"""{WITH_GOLD} SELECT source_country, year, month, COUNT(*) AS records FROM gold GROUP BY ALL""",
)
def partition_stats(spark, sf_dir):
    return profile.partition_stats(gold(spark, sf_dir), ["source_country", "year", "month"])


@query(
    "manifest_summary",
    f"""{WITH_GOLD} SELECT '1.0' AS manifest_version, 'summary' AS manifest_type, 'all' AS source, 'gold' AS layer,
      COUNT(DISTINCT source_file) AS total_files, COUNT(*) AS total_records, MIN(publication_date) AS min_date,
      MAX(publication_date) AS max_date, round(AVG(data_completeness_score), 6) AS quality_score FROM gold""",
)
def manifest_summary(spark, sf_dir):
    row = profile.manifest(gold(spark, sf_dir), "all", "gold")
    return row.withColumn("quality_score", F.round("quality_score", 6))


@query(
    "manifest_files",
    f"{WITH_GOLD} SELECT source_file, COUNT(*) AS records FROM gold GROUP BY source_file",
)
def manifest_files(spark, sf_dir):
    return profile.manifest_files(gold(spark, sf_dir))
