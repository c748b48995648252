"""The SQL questions asked of the unified table. Spark parses and plans the text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame

from procurelake.functions.money import FIXED_POINT

_SUM = f"CAST(SUM(CAST(tender_value_amount AS {FIXED_POINT})) AS DOUBLE)"
_AVG = f"{_SUM} / COUNT(tender_value_amount)"

TOTAL = "SELECT COUNT(*) AS total_tenders FROM {unified}"

TOP_COUNTRIES = f"""
SELECT source_country, COUNT(*) AS tender_count, {_SUM} AS total_value, {_AVG} AS avg_value
FROM {{unified}} WHERE {{condition}}
GROUP BY source_country ORDER BY tender_count DESC, source_country LIMIT 10
"""

SOURCE_SPLIT = """
SELECT source, COUNT(*) AS tender_count FROM {unified}
WHERE source_country = 'portugal' GROUP BY source ORDER BY source
"""

MONTHS = f"""
SELECT year, month, COUNT(*) AS tender_count, {_SUM} AS total_value
FROM {{unified}} WHERE year IN (2024, 2025) AND {{condition}}
GROUP BY year, month ORDER BY year, month
"""

YEAR_TOTALS = f"""
SELECT source_country, {_SUM} AS total_value, COUNT(*) AS tender_count
FROM {{unified}} WHERE year = 2025 AND tender_value_amount IS NOT NULL
GROUP BY source_country ORDER BY total_value DESC, source_country
"""

MONTH_AVERAGE = f"""
SELECT year, month, {_AVG} AS avg_value, COUNT(*) AS tender_count
FROM {{unified}} WHERE year = 2025 AND tender_value_amount IS NOT NULL
GROUP BY year, month ORDER BY year, month
"""

HIGH_VALUE = """
SELECT tender_id, tender_title, buyer_name, source_country, tender_value_amount, tender_value_currency,
       publication_date
FROM {unified}
WHERE tender_value_amount > {floor} AND tender_value_currency = 'EUR' AND tender_title IS NOT NULL
ORDER BY tender_value_amount DESC, tender_id LIMIT {rows}
"""

KEYWORDS = """
SELECT tender_id, tender_title, buyer_name, publication_date, tender_value_amount
FROM {unified}
WHERE {condition}
ORDER BY publication_date DESC NULLS LAST, tender_id LIMIT {rows}
"""

LAST_MONTH = """
SELECT tender_id, tender_title, publication_date, tender_value_amount, tender_value_currency
FROM {unified}
WHERE source_country = 'portugal'
  AND CAST(publication_date AS DATE) >= CAST('{as_of}' AS DATE) - INTERVAL '1' MONTH
ORDER BY publication_date DESC, tender_id LIMIT 100
"""

# Countries above and below a share of the whole: a common table expression, subqueries and a union.
COUNTRY_SIZES = """
WITH large AS (
  SELECT source_country, COUNT(*) AS tender_count FROM {unified} GROUP BY source_country
  HAVING COUNT(*) > (SELECT COUNT(*) * {share} FROM {unified}))
SELECT 'large' AS kind, source_country, tender_count FROM large
UNION ALL
SELECT 'small' AS kind, source_country, COUNT(*) AS tender_count FROM {unified}
WHERE source_country NOT IN (SELECT source_country FROM large) GROUP BY source_country
"""

# The share needs the grand total: a window over the few grouped rows, not over the table.
CATEGORY_SHARE = """
SELECT procurement_category_standardized, COUNT(*) AS tender_count,
       ROUND(CAST(COUNT(*) AS DOUBLE) * 100 / SUM(COUNT(*)) OVER (), 2) AS percentage
FROM {unified}
WHERE procurement_category_standardized <> ''
GROUP BY procurement_category_standardized
ORDER BY tender_count DESC, procurement_category_standardized
"""


def _fill(text: str, **values: object) -> str:
    for name, value in values.items():
        text = text.replace("{" + name + "}", str(value))
    return text


def ask(unified: DataFrame, text: str, **values: object) -> DataFrame:
    """Run one question; ``values`` fill its constants."""
    return unified.sparkSession.sql(_fill(text, **values), unified=unified)


def keyword_condition(words: list[str], columns: tuple[str, ...] = ("tender_title",)) -> str:
    """Whether any of the columns holds any of the words; no character of a word is a wildcard."""
    escaped = [w.lower().replace("\\", "\\\\").replace("'", "\\'") for w in words]
    return " OR ".join(f"CONTAINS(LOWER({c}), '{w}')" for c in columns for w in escaped)
