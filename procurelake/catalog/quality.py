"""Queries for quality reports, deduplication by hash, and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.catalog import query
from procurelake.catalog.tenders import (
    AS_OF, WITH_GOLD, WITH_SILVER, gold, hash_sql, raw, silver, table,
)
from procurelake.functions import keys
from procurelake.operators import dedup, profile, quality

# Raw tenders whose numbers are texts, some of them unreadable; one text for both engines.
_AS_TEXTS = {
    "tender_value_amount": "CASE WHEN seq % 41 = 0 THEN 'abc' ELSE CAST(tender_value_amount AS STRING) END",
    "num_lots": "CASE WHEN seq % 43 = 0 THEN 'x' WHEN seq % 44 = 0 THEN '-1' ELSE CAST(num_lots AS STRING) END",
}
_ABSENT = ("record_hash", "document_urls")


def _texts(spark, sf_dir):
    return raw(spark, sf_dir).withColumns({n: F.expr(t) for n, t in _AS_TEXTS.items()})


_WITH_TEXTS = (
    f"{WITH_SILVER}, texts AS (SELECT * REPLACE ("
    + ", ".join(f"{t} AS {n}" for n, t in _AS_TEXTS.items())
    + ") FROM raw)"
)


def _field_conditions(name: str) -> dict[str, str]:
    """Null, empty, mismatch and range conditions of a field, in SQL."""
    if name in _ABSENT:
        return {"null_count": "true", "empty_count": "false", "type_mismatches": "false", "out_of_range": "false"}
    kind = schemas.SILVER_CHECK_TYPES[name]
    null, empty, mismatch, beyond = f"{name} IS NULL", "false", "false", "false"
    if kind == "string":
        empty = f"coalesce({name} = '', false)"
    number = f"TRY_CAST({name} AS {'BIGINT' if kind == 'int' else 'DOUBLE'})"
    if kind in ("int", "float"):
        mismatch = f"{number} IS NULL"
        beyond = f"coalesce(TRY_CAST({name} AS DOUBLE) < 0, true)"
    if name.endswith("_date"):
        day = f"CAST(try_strptime(substr({name}, 1, 10), '%Y-%m-%d') AS DATE)"
        beyond = f"coalesce({day} > CAST(CAST('{AS_OF}' AS DATE) + INTERVAL '12' MONTH AS DATE), true)"
    checked = f"NOT ({null}) AND NOT ({empty})"
    return {
        "null_count": null, "empty_count": empty,
        "type_mismatches": f"{checked} AND {mismatch}", "out_of_range": f"{checked} AND {beyond}",
    }


def _field_sql(name: str) -> str:
    counts = {k: f"COUNT(*) FILTER ({c})" for k, c in _field_conditions(name).items()}
    broken = ["type_mismatches", "out_of_range"]
    if name in quality.REQUIRED_FIELDS:
        broken += ["null_count", "empty_count"]
    listed = ", ".join(f"{c} AS {k}" for k, c in counts.items())
    passed = " + ".join(counts[k] for k in broken)
    return f"SELECT '{name}' AS field, {listed}, ({passed}) = 0 AS passed FROM texts"


@query("quality_fields", f"{_WITH_TEXTS} " + " UNION ALL ".join(_field_sql(n) for n in schemas.SILVER_COLUMNS))
def quality_fields(spark, sf_dir):
    return quality.field_report(_texts(spark, sf_dir), AS_OF)


_RULE_SQL = {
    "invalid_ocid_format": "CASE WHEN ocid <> '' AND NOT starts_with(ocid, 'ocds-') THEN 1 ELSE 0 END",
    "invalid_currency_code": " + ".join(
        f"CASE WHEN {c} <> '' AND NOT regexp_matches({c}, '^\\pL{{3}}$') THEN 1 ELSE 0 END"
        for c in ("tender_value_currency", "award_currency")
    ),
    "end_date_before_start_date": "CASE WHEN tender_start_date <> '' AND tender_end_date <> '' "
    "AND tender_start_date > tender_end_date THEN 1 ELSE 0 END",
    "award_date_before_tender_date": "CASE WHEN publication_date <> '' AND award_date <> '' "
    "AND award_date < publication_date THEN 1 ELSE 0 END",
    "negative_amounts": "CASE WHEN TRY_CAST(tender_value_amount AS DOUBLE) < 0 OR TRY_CAST(award_amount AS DOUBLE) < 0 "
    "THEN 1 ELSE 0 END",
}


@query(
    "quality_rules",
    f"{_WITH_TEXTS} "
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(SUM({e}) AS BIGINT) AS violations FROM texts" for r, e in _RULE_SQL.items()),
)
def quality_rules(spark, sf_dir):
    return quality.rule_report(_texts(spark, sf_dir))


def _row_fails() -> str:
    parts = []
    for name in schemas.SILVER_COLUMNS:
        c = _field_conditions(name)
        parts.append(c["type_mismatches"])
        if name in quality.REQUIRED_FIELDS:
            parts += [c["null_count"], c["empty_count"]]
    return " OR ".join(f"({p})" for p in parts)


_FILLED_CELLS = " + ".join(
    f"CASE WHEN {n} IS NOT NULL{'' if n in schemas.SILVER_ARRAYS else f' AND CAST({n} AS VARCHAR) <> chr(0)'} THEN 1 ELSE 0 END"
    if schemas.SILVER_CHECK_TYPES[n] != "string"
    else f"CASE WHEN {n} <> '' THEN 1 ELSE 0 END"
    for n in schemas.SILVER_COLUMNS
    if n not in _ABSENT
)


@query(
    "quality_summary",
    f"""{_WITH_TEXTS}, m AS (
      SELECT COUNT(*) AS total_records, COUNT(*) FILTER (NOT ({_row_fails()})) AS validation_passed,
        COUNT(*) FILTER ({_row_fails()}) AS validation_failed, SUM({_FILLED_CELLS}) AS cells,
        {", ".join(f"CAST(SUM({e}) AS BIGINT) AS {r}" for r, e in _RULE_SQL.items())} FROM texts)
    SELECT total_records, validation_passed, validation_failed, {", ".join(_RULE_SQL)},
      round(CAST(cells AS DOUBLE) / 27 / total_records, 6) AS completeness_score,
      round(CAST(validation_passed AS DOUBLE) / total_records, 6) AS pass_rate,
      round(CAST(validation_failed AS DOUBLE) / total_records, 6) AS fail_rate,
      {" + ".join(_RULE_SQL)} AS total_business_violations,
      CAST(cells AS DOUBLE) / 27 / total_records >= 0.80 AND CAST(validation_failed AS DOUBLE) / total_records <= 0.15
        AS quality_check_passed FROM m""",
)
def quality_summary(spark, sf_dir):
    row = quality.summary_report(_texts(spark, sf_dir), AS_OF).drop("warnings")
    return row.withColumns({n: F.round(n, 6) for n in ("completeness_score", "pass_rate", "fail_rate")})


@query(
    "quality_warnings",
    f"""{_WITH_TEXTS}, m AS (SELECT COUNT(*) FILTER ({_row_fails()}) AS failed, COUNT(*) AS n,
        {", ".join(f"CAST(SUM({e}) AS BIGINT) AS {r}" for r, e in _RULE_SQL.items())} FROM texts)
    SELECT 'High failure rate: ' || printf('%.2f%%', CAST(failed AS DOUBLE) / n * 100) || ' (maximum: 15.00%)' AS warning
      FROM m WHERE CAST(failed AS DOUBLE) / n > 0.15 """
    + " ".join(
        f"UNION ALL SELECT 'Business rule violation ''{r}'': ' || {r} || ' occurrences' FROM m WHERE {r} > 0"
        for r in _RULE_SQL
    ),
)
def quality_warnings(spark, sf_dir):
    report = quality.full_report(_texts(spark, sf_dir), AS_OF, "all")
    return report.select(F.explode("warnings").alias("warning"))


@query(
    "gold_dedup_report",
    f"""{WITH_GOLD} SELECT COUNT(*) AS total_records, COUNT(DISTINCT ocid) AS unique_ocids,
      COUNT(*) - COUNT(DISTINCT ocid) AS duplicate_ocids,
      1 - CAST(COUNT(DISTINCT ocid) AS DOUBLE) / COUNT(*) AS deduplication_rate FROM gold""",
)
def gold_dedup_report(spark, sf_dir):
    return quality.identity_report(gold(spark, sf_dir))


def _coverage_sql(name: str) -> str:
    if name in schemas.SILVER_ARRAYS:
        filled = f"len({name}) > 0"
    elif dict((f.name, f.dataType.simpleString()) for f in schemas.GOLD_SCHEMA.fields)[name] == "string":
        filled = f"{name} <> ''"
    else:
        filled = f"{name} IS NOT NULL"
    count = f"COUNT(*) FILTER ({filled})"
    return (
        f"SELECT '{name}' AS field, COUNT({name}) AS non_null, {count} AS non_empty, "
        f"round(CAST({count} AS DOUBLE) / COUNT(*) * 100, 2) AS completeness_pct FROM gold"
    )


@query("gold_coverage", f"{WITH_GOLD} " + " UNION ALL ".join(_coverage_sql(n) for n in schemas.GOLD_COLUMNS))
def gold_coverage(spark, sf_dir):
    return quality.coverage_report(gold(spark, sf_dir).select(*schemas.GOLD_COLUMNS))


_METRICS = {
    **{f"flag:{f}": f"date_quality_flag = '{f}'" for f in ("valid", "missing", "past", "future")},
    quality.EXCELLENT: "data_completeness_score > 0.9e0",
    quality.GOOD: "data_completeness_score >= 0.7e0 AND data_completeness_score <= 0.9e0",
    quality.FAIR: "data_completeness_score >= 0.5e0 AND data_completeness_score < 0.7e0",
    quality.POOR: "data_completeness_score < 0.5e0",
    "records_with_value": "has_value",
    "records_with_award": "has_award",
    "future_dates": "is_future_date",
    "total_records": "true",
}


@query(
    "gold_validation",
    f"{WITH_GOLD} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(COUNT(*) FILTER ({c}) AS DOUBLE) AS value FROM gold" for m, c in _METRICS.items()
    )
    + " UNION ALL SELECT 'avg_completeness_score', round(AVG(data_completeness_score), 4) FROM gold",
)
def gold_validation(spark, sf_dir):
    return quality.validation_report(gold(spark, sf_dir))


# --------------------------------------------------------- duplicates by hash
def _lines(spark, sf_dir):
    """Line items keyed by order and line number: many share a key."""
    lines = table(spark, sf_dir, "lineitem")
    columns = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber")]
    # No column orders the lines, so all of them together do.
    seq = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.select(
        keys.record_hash(columns).alias("record_hash"), seq.alias("seq"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").cast("string").alias("processing_timestamp"),
    )


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.md5("text").alias("record_hash"), "doc_id", "lang", "source", F.length("text").alias("chars")
    )


_DOCS = "WITH docs AS (SELECT md5(text) AS record_hash, doc_id, lang, source, length(text) AS chars FROM documents)"


@query(
    "dup_groups",
    f"{_DOCS} SELECT record_hash, COUNT(*) AS occurrences FROM docs GROUP BY record_hash HAVING COUNT(*) > 1",
)
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(_documents(spark, sf_dir))


@query(
    "dup_members",
    f"{_DOCS} SELECT * FROM (SELECT record_hash, doc_id, source, COUNT(*) OVER (PARTITION BY record_hash) AS occurrences "
    "FROM docs) WHERE occurrences > 1",
)
def dup_members(spark, sf_dir):
    return dedup.duplicate_members(_documents(spark, sf_dir)).select("record_hash", "doc_id", "source", "occurrences")


def _summary_sql(source: str) -> str:
    return f"""SELECT CAST(SUM(n) AS BIGINT) AS total_records, COUNT(*) AS unique_hashes,
      COUNT(*) FILTER (n > 1) AS duplicate_groups, CAST(SUM(n - 1) AS BIGINT) AS duplicate_records,
      1 - CAST(COUNT(*) AS DOUBLE) / SUM(n) AS deduplication_rate
      FROM (SELECT record_hash, COUNT(*) AS n FROM {source} GROUP BY record_hash)"""


@query("dup_summary", f"{_DOCS} {_summary_sql('docs')}")
def dup_summary(spark, sf_dir):
    return dedup.duplicate_summary(_documents(spark, sf_dir))


_LINES = f"""WITH lines AS (SELECT {hash_sql("CAST(l_orderkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)")} AS record_hash,
  l_orderkey, l_linenumber FROM lineitem)"""


@query("dup_summary_lines", f"{_LINES} {_summary_sql('lines')}")
def dup_summary_lines(spark, sf_dir):
    return dedup.duplicate_summary(_lines(spark, sf_dir))


@query(
    "dup_report",
    f"""{_DOCS}, big AS (SELECT record_hash, COUNT(*) AS occurrences FROM docs GROUP BY record_hash HAVING COUNT(*) > 1
        ORDER BY occurrences DESC, record_hash LIMIT 5)
      SELECT record_hash, occurrences, doc_id, CAST(row_number() OVER (PARTITION BY record_hash ORDER BY doc_id) AS INTEGER)
        AS member FROM docs JOIN big USING (record_hash) QUALIFY member <= 3""",
)
def dup_report(spark, sf_dir):
    report = dedup.duplicate_report(_documents(spark, sf_dir), [F.col("doc_id")])
    return report.select("record_hash", "occurrences", "doc_id", "member")


@query(
    "mark_latest",
    f"""{WITH_SILVER}, k AS (SELECT *, md5(buyer_name || '|' || ocid) AS h FROM silver)
      SELECT seq, h AS record_hash, processing_timestamp,
        row_number() OVER (PARTITION BY h ORDER BY processing_timestamp DESC, seq DESC) = 1 AS is_latest FROM k""",
)
def mark_latest(spark, sf_dir):
    tenders = silver(spark, sf_dir).withColumn("record_hash", F.md5(F.concat("buyer_name", F.lit("|"), "ocid")))
    marked = dedup.mark_latest(tenders.select("seq", "record_hash", "processing_timestamp"), "seq")
    return marked.select("seq", "record_hash", "processing_timestamp", "is_latest")


@query(
    "unique_records",
    f"{_DOCS} SELECT record_hash, MIN(doc_id) AS doc_id FROM docs GROUP BY record_hash",
)
def unique_records(spark, sf_dir):
    return dedup.unique_records(_documents(spark, sf_dir), [F.col("doc_id")]).select("record_hash", "doc_id")


@query(
    "unique_lines",
    f"{_LINES} SELECT DISTINCT record_hash, l_orderkey, l_linenumber FROM lines",
)
def unique_lines(spark, sf_dir):
    first = dedup.unique_records(_lines(spark, sf_dir), [F.col("seq")])
    return first.select("record_hash", "l_orderkey", "l_linenumber")


# The documents of one source have been stored before; those of all others arrive now.
_ARRIVING = f"""{_DOCS}, seen AS (SELECT record_hash FROM docs WHERE lang = 'en'),
  batch AS (SELECT * FROM docs)"""


@query(
    "new_records_anti",
    f"""{_ARRIVING} SELECT record_hash, MIN(doc_id) AS doc_id FROM batch
      WHERE record_hash NOT IN (SELECT record_hash FROM seen) GROUP BY record_hash""",
)
def new_records_anti(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    new = dedup.new_records(docs, docs.where(F.col("lang") == "en"), [F.col("doc_id")])
    return new.select("record_hash", "doc_id")


@query(
    "new_records_stats",
    f"""{_ARRIVING}, n AS (SELECT COUNT(DISTINCT record_hash) AS new_records FROM batch
        WHERE record_hash NOT IN (SELECT record_hash FROM seen))
      SELECT (SELECT COUNT(*) FROM batch) AS total_input, new_records,
        (SELECT COUNT(*) FROM batch) - new_records AS duplicates_skipped FROM n""",
)
def new_records_stats(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return dedup.new_records_stats(docs, docs.where(F.col("lang") == "en"), [F.col("doc_id")])


# ------------------------------------------------------------------- profiles
_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
_TEXTS = ("o_orderstatus", "o_orderpriority")


def _numeric_sql(c: str) -> str:
    kind = "double" if c == "o_totalprice" else "bigint"
    return f"""SELECT '{c}' AS column, '{kind}' AS type, COUNT(*) - COUNT({c}) AS null_count,
      CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100 AS null_percentage, CAST(MIN({c}) AS DOUBLE) AS min,
      CAST(MAX({c}) AS DOUBLE) AS max, round(AVG({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
      round(median(CAST({c} AS DOUBLE)), 4) AS median, CAST(NULL AS BIGINT) AS unique_count,
      CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date FROM orders"""


def _text_sql(c: str) -> str:
    return f"""SELECT '{c}', 'string', COUNT(*) - COUNT({c}), CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100,
      NULL, NULL, NULL, NULL, NULL, COUNT(DISTINCT {c}), NULL, NULL FROM orders"""


@query(
    "column_profile",
    " UNION ALL ".join([*[_numeric_sql(c) for c in _NUMERIC], *[_text_sql(c) for c in _TEXTS]])
    + """ UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', COUNT(*) - COUNT(o_orderdate), 0.0e0, NULL, NULL, NULL, NULL,
      NULL, NULL, CAST(MIN(o_orderdate) AS VARCHAR), CAST(MAX(o_orderdate) AS VARCHAR) FROM orders""",
)
def column_profile(spark, sf_dir):
    rows = profile.column_profile(table(spark, sf_dir, "orders")).drop("top_values")
    return rows.withColumns({n: F.round(n, 4) for n in ("mean", "std", "median")})


@query(
    "column_top_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column, {c} AS value, COUNT(*) AS n,
          CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS INTEGER) AS place FROM orders GROUP BY {c}) WHERE place <= 5"""
        for c in _TEXTS
    ),
)
def column_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"))


@query(
    "dataset_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
          round(AVG({c}), 4) AS mean, round(median(CAST({c} AS DOUBLE)), 4) AS median FROM orders"""
        for c in _NUMERIC
    ),
)
def dataset_summary(spark, sf_dir):
    rows = profile.numeric_summary(table(spark, sf_dir, "orders"))
    return rows.withColumns({n: F.round(n, 4) for n in ("mean", "median")})


@query(
    "dataset_unique_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) AS unique_count FROM orders" for c in _TEXTS),
)
def dataset_unique_counts(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "orders"))


_SAMPLED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query(
    "table_samples",
    "WITH f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, CAST(row_number() OVER (ORDER BY MIN(nth)) AS INTEGER) AS place,
          CAST({c} AS VARCHAR) AS sample FROM f GROUP BY {c} QUALIFY place <= 5"""
        for c in _SAMPLED
    ),
)
def table_samples(spark, sf_dir):
    return profile.table_samples(table(spark, sf_dir, "customer").select(*_SAMPLED), [F.col("c_custkey")])


@query(
    "table_description",
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column, '{t}' AS type, true AS nullable, COUNT(*) AS row_count FROM customer"
        for i, (c, t) in enumerate(
            [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
             ("c_mktsegment", "string")]
        )
    ),
)
def table_description(spark, sf_dir):
    return profile.describe_table(table(spark, sf_dir, "customer"))
