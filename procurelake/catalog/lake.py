"""Queries that go through files: written from the given tables, then read back by the sources.

Each run writes below the shared folder of the session, in a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.catalog import CHECKS, QUERIES, query
from procurelake.catalog import quality as _quality  # noqa: F401
from procurelake.catalog.silver import (
    _MAPPED_LIST, _MAPPED_SQL, _NOTICES_LIST, _NOTICES_SQL, _REASON, _contract_rows, _contracts_silver, _flat, _notices, releases,
    relational_tables,
)
from procurelake.catalog.tenders import AS_OF, WITH_GOLD, WITH_SILVER, date_sql, gold, mean_sql, money_sql, silver, table
from procurelake.functions import keys
from procurelake.functions.money import money_sum
from procurelake.operators import aggregates, enrich, mapping, notices, profile, relational, validation
from procurelake.plans import gold as gold_plan
from procurelake.plans import silver as silver_plan
from procurelake.session import scratch_path, shuffles_freed, staged
from procurelake.sinks import writers
from procurelake.sources import scans
from procurelake.streaming import incremental

_RELEASE_DAY = "coalesce({0}, {1})".format(date_sql("publication_date"), date_sql("tender_start_date"))
_COUNTRY = """CASE WHEN seq % 50 = 7 THEN 'atlantis' WHEN seq % 3 = 0 THEN 'kosovo' WHEN seq % 3 = 1 THEN 'uk'
  ELSE 'portugal' END"""


# ------------------------------------------------------------ Bronze and back
@query(
    "bronze_days",
    f"""{WITH_SILVER} SELECT {_RELEASE_DAY} AS release_date, COUNT(*) AS records FROM raw GROUP BY 1""",
)
def bronze_days(spark, sf_dir):
    """Releases written by country and day; the number per day as written."""
    rows = releases(spark, sf_dir).drop("seq")
    return writers.write_bronze(rows, scratch_path(spark, "bronze"), "2025-03-15T00:00:00Z", compression="gzip")


@query(
    "bronze_append",
    f"""{WITH_SILVER} SELECT {_RELEASE_DAY} AS release_date, COUNT(*) AS records FROM raw GROUP BY 1""",
)
def bronze_append(spark, sf_dir):
    """A second call into the same store counts its own releases only."""
    path = scratch_path(spark, "bronze")
    rows = releases(spark, sf_dir).drop("seq")
    writers.write_bronze(rows, path, "2025-03-15T00:00:00Z", compression="gzip")
    return writers.write_bronze(rows, path, "2025-03-16T00:00:00Z", compression="gzip")


@query(
    "bronze_license",
    f"""{WITH_SILVER} SELECT 'dados.gov.pt' AS portal, 2 AS restrictions, '2025-03-15T00:00:00Z' AS extracted, COUNT(*) AS records
      FROM raw WHERE {_RELEASE_DAY} IS NOT NULL""",
)
def bronze_license(spark, sf_dir):
    """The licence block of stored releases, read back."""
    path = scratch_path(spark, "bronze")
    writers.write_bronze(releases(spark, sf_dir).drop("seq"), path, "2025-03-15T00:00:00Z", compression="gzip")
    stored = spark.read.schema("license struct<portal:string,restrictions:array<string>,extraction_timestamp:string>").json(path)
    return stored.groupBy(
        F.col("license.portal").alias("portal"), F.size("license.restrictions").alias("restrictions"),
        F.col("license.extraction_timestamp").alias("extracted"),
    ).agg(F.count("*").alias("records"))


@query(
    "bronze_files_per_country",
    f"""{WITH_SILVER}, held AS (SELECT DISTINCT {_COUNTRY} AS country FROM raw)
      SELECT w.country, held.country IS NOT NULL AS has_files, true AS as_read, true AS bytes_as_read
      FROM (VALUES ('atlantis'), ('kosovo'), ('uk'), ('portugal'), ('nowhere')) w(country) LEFT JOIN held USING (country)""",
)
def bronze_files_per_country(spark, sf_dir):
    """Files and bytes per expected country, those without any included. Their number depends on the writer, so it is held against
    the files that a scan of the content reports."""
    path = scratch_path(spark, "bronze")
    releases(spark, sf_dir).select("country", "ocid").hint("rebalance", "country").write.mode("overwrite").partitionBy("country").json(path)
    expected = spark.createDataFrame([(c,) for c in ("atlantis", "kosovo", "uk", "portugal", "nowhere")], "country string")
    listing = scans.file_listing(spark, path, "*.json")
    found = profile.files_per_country(listing, expected, path.rsplit("/", 1)[1])
    scan = spark.read.schema("ocid string, country string").json(path)
    per_file = scan.groupBy("country", F.col("_metadata.file_path")).agg(F.max("_metadata.file_size").alias("n"))
    read = per_file.groupBy("country").agg(F.count("*").alias("read"), F.sum("n").alias("bytes"))
    nothing = F.lit(0).cast("bigint")
    return found.join(read, "country", "left").select(
        "country", (F.col("files") > 0).alias("has_files"), (F.col("files") == F.coalesce("read", nothing)).alias("as_read"),
        (F.col("size_bytes") == F.coalesce("bytes", nothing)).alias("bytes_as_read"),
    )


_ROWS_SQL = f"{_MAPPED_SQL} SELECT {_MAPPED_LIST.removeprefix('seq, ')} FROM hashed WHERE ({_REASON}) IS NULL"


@query("release_lines_to_silver", _ROWS_SQL)
def release_lines_to_silver(spark, sf_dir):
    """JSON lines below country folders, read with the release schema, mapped and validated: all rows."""
    path = scratch_path(spark, "lines")
    rows = releases(spark, sf_dir).drop("seq", "source_file")
    with shuffles_freed(spark):
        rows.write.mode("overwrite").partitionBy("country").option("compression", "gzip").json(path)
    lines = scans.good_lines(scans.release_lines(spark, path, even=True))
    named = lines.withColumn("country", scans.country_of_path(F.col("source_file"), path.rsplit("/", 1)[1]))
    return _flat(mapping.transform_releases(named))


@query(
    "release_line_rejects",
    """WITH lines AS (SELECT o_orderkey, 'ocds-' || o_orderkey AS ocid, o_orderkey % 9 = 4 AS broken FROM orders),
        counts AS (SELECT COUNT(*) FILTER (NOT broken) AS good, COUNT(*) FILTER (broken) AS bad FROM lines)
      SELECT CASE WHEN broken THEN 'bad' ELSE 'good' END AS side, CASE WHEN broken THEN '{"ocid": "' || ocid || '", ' ELSE ocid END AS content,
        CASE WHEN broken THEN bad ELSE good END AS of_side FROM lines, counts""",
)
def release_line_rejects(spark, sf_dir):
    """Good, broken and blank lines in compressed files: both sides, and how many rows each has, from one pass."""
    path = scratch_path(spark, "lines") + "/files"
    ocid = F.concat(F.lit("ocds-"), F.col("o_orderkey").cast("string"))
    start = F.concat(F.lit('{"ocid": "'), ocid, F.lit('", '))
    line = F.when(F.col("o_orderkey") % 9 == 4, start).otherwise(F.concat(start, F.lit('"id": "1"}')))
    blank = F.when(F.col("o_orderkey") % 5 == 0, F.array(line, F.lit("  "), F.lit(""))).otherwise(F.array(line))
    table(spark, sf_dir, "orders").select(F.explode(blank).alias("value")).write.option("compression", "gzip").text(path)
    good, bad, counts = scans.split_lines(scans.release_lines(spark, path))
    sides = good.select(F.lit("good").alias("side"), F.col("ocid").alias("content")).unionAll(bad.select(F.lit("bad"), scans.BAD_LINE))
    return sides.withColumn("of_side", F.when(F.col("side") == "good", F.lit(counts["good"])).otherwise(F.lit(counts["bad"])).cast("bigint"))


# How many records an envelope file has, about: a reader that takes a file as one object holds all of it.
ENVELOPE_RECORDS = 10_000


def _write_envelopes(spark, sf_dir: str, path: str, records: int = ENVELOPE_RECORDS) -> None:
    """Files by country and month, each one envelope of many records, indented by two blanks.

    A month has one file for about ``records`` releases, dealt by their order. A file is never one value: its records are written one after the
    other, the first one with the opening of the envelope before it, the last one with the closing behind it.
    """
    rows = releases(spark, sf_dir)
    release = F.struct(*[n for n in schemas.RELEASE_SCHEMA.names if n in rows.columns])
    month = F.coalesce(F.substring(F.col("tender.tenderPeriod.startDate"), 1, 7), F.lit("none"))
    body = F.concat(F.lit("    {\n      "), F.regexp_replace(F.to_json(release), r"^\{|\}$", ""), F.lit("\n    }"))
    # as many rows as there are folders
    sizes = rows.groupBy("country", month.alias("month")).agg(F.ceil(F.count("*") / F.lit(records)).alias("files"))
    files = F.broadcast(sizes)
    keys = ["country", "month", "part"]
    texts = rows.select("country", month.alias("month"), F.coalesce("seq", F.lit(0)).alias("seq"), body.alias("body")).join(files, ["country", "month"])
    dealt = texts.select("country", "month", F.pmod(F.xxhash64("seq"), "files").alias("part"), "seq", "body")
    same, place = Window.partitionBy(*keys), F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    counted = dealt.withColumns({"place": place, "n": F.count("*").over(same)})
    opening = F.when(F.col("place") == 1, F.lit('{\n  "records": [\n')).otherwise("")
    closing = F.when(F.col("place") == F.col("n"), F.concat(F.lit('\n  ],\n  "count": '), F.col("n").cast("string"), F.lit("\n}"))).otherwise(",")
    # the order that the writer asks for and keeps, with the place in it
    text = counted.sortWithinPartitions(*keys, "place").select(*keys, F.concat(opening, "body", closing).alias("value"))
    with shuffles_freed(spark):
        text.write.mode("overwrite").partitionBy(*keys).option("compression", "gzip").text(path)


@query("envelopes_to_silver", _ROWS_SQL)
def envelopes_to_silver(spark, sf_dir):
    """Files of one envelope with many records below country folders, cut at their records, mapped and validated: all rows."""
    path = scratch_path(spark, "envelopes")
    _write_envelopes(spark, sf_dir, path)
    records = scans.envelope_records(spark, path, path.rsplit("/", 1)[1], glob="*.txt.gz")
    return _flat(mapping.transform_releases(scans.good_lines(records).drop("source_file", "_row")))


@query("envelope_objects_to_silver", _ROWS_SQL)
def envelope_objects_to_silver(spark, sf_dir):
    """The same files, each read as one object."""
    path = scratch_path(spark, "envelopes")
    _write_envelopes(spark, sf_dir, path)
    found = scans.envelopes(spark, path, path.rsplit("/", 1)[1], glob="*.txt.gz")
    return _flat(mapping.transform_releases(found.drop("source_file", "_row")))


@query(
    "envelope_lines_to_silver",
    f"""{WITH_SILVER} SELECT {_COUNTRY} AS country, ocid FROM raw""",
)
def envelope_lines_to_silver(spark, sf_dir):
    """Envelopes below country folders, one per line, exploded into their releases."""
    path = scratch_path(spark, "envelopes")
    rows = releases(spark, sf_dir)
    release = F.struct(*[n for n in schemas.RELEASE_SCHEMA.names if n in rows.columns])
    lines = rows.select("country", F.array(release).alias("records"), F.lit(1).alias("count"))
    with shuffles_freed(spark):
        lines.write.mode("overwrite").partitionBy("country").option("compression", "gzip").json(path)
    return scans.envelopes(spark, path, path.rsplit("/", 1)[1], glob="*.json.gz", per_line=True).select("country", "ocid")


@query("notices_to_silver", f"{_NOTICES_SQL} SELECT {_NOTICES_LIST.removeprefix('seq, ')} FROM m")
def notices_to_silver(spark, sf_dir):
    """Nested Parquet notices written, scanned with their schema and mapped: all rows."""
    path = scratch_path(spark, "ted")
    _notices(spark, sf_dir).drop("seq", "source_file").write.mode("overwrite").parquet(path)
    return _flat(notices.map_notices(scans.notices(spark, path)))


@query(
    "contract_files_to_silver",
    CHECKS["contracts_to_silver"],
)
def contract_files_to_silver(spark, sf_dir):
    """Contract rows as CSV files of two headers in one folder, with quotes and line breaks in a text, read and mapped."""
    path = scratch_path(spark, "contracts") + "/files"
    rows = _contract_rows(spark, sf_dir).withColumn("descContrato", F.when(F.col("objectoContrato") == "", "desc").otherwise('a "b",\n c'))
    for half, columns in ((0, sorted(rows.columns)), (1, [c for c in rows.columns if c != "descContrato"])):
        title = F.when(F.col("objectoContrato") == "", "desc").otherwise(F.col("objectoContrato"))
        part = rows if half == 0 else rows.withColumn("objectoContrato", title)
        part.where(F.col("seq") % 2 == half).select(*[c for c in columns if c != "seq"]).write.mode("append").option("header", True).option(
            "escape", '"'
        ).option("emptyValue", "").csv(path)
    return _contracts_silver(scans.contract_rows(spark, path))


@query("relational_load", CHECKS["relational_merge"])
def relational_load(spark, sf_dir):
    """The five tables as files, merged, written by country, year and month and read back: all rows, each in its own month."""
    folder, target = scratch_path(spark, "relational"), scratch_path(spark, "silver")
    for name, df in relational_tables(spark, sf_dir).items():
        columns = [F.col(f.name).cast(f.dataType) for f in schemas.RELATIONAL_SCHEMAS[name].fields]
        # the first lot of a tender is that of its first link in the file
        ordered = df.orderBy("tender_id", "_lot_row", "lot_id") if name == "tender_lot" else df
        ordered.select(*columns).write.mode("overwrite").parquet(f"{folder}/{scans.RELATIONAL_FILES[name]}")
    tables = scans.relational_tables(spark, folder)
    merged = relational.transform(
        tables, order=[F.col("_tender_row"), F.col("_buyer_row")], lot_order=[F.col("_lot_row")],
        keep=("_tender_row", "_buyer_row"),
    ).drop("_tender_row", "_buyer_row")
    writers.write_relational_silver(merged, target, mode="overwrite")
    written = spark.read.parquet(target)
    named = written.where((F.col("year") == F.year("publication_date")) & (F.col("month") == F.month("publication_date")))
    return named.select(
        "tender_id", "ocid", "source_country", "tender_title", "tender_description", "tender_status", "tender_value_amount",
        F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), "buyer_id", "buyer_name", "cpv_code",
    )


# ------------------------------------------------------------ Silver and Gold
@query(
    "silver_load",
    f"""{WITH_SILVER}, kept AS (SELECT * FROM silver WHERE ({_REASON}) IS NULL
        QUALIFY row_number() OVER (PARTITION BY record_hash ORDER BY seq) = 1)
      SELECT 1 AS run, source AS source_country, split_part(publication_date, '-', 1) AS year,
        split_part(publication_date, '-', 2) AS month, COUNT(*) AS records
      FROM kept GROUP BY ALL""",
)
def silver_load(spark, sf_dir):
    """Two runs over the same records: rows per partition of the first, none of the second."""
    path, reports = scratch_path(spark, "silver"), scratch_path(spark, "reports")
    records = validation.accepted(silver(spark, sf_dir)).withColumn("source_country", F.col("source")).drop("source")
    runs = [
        silver_plan.load_silver(records, path, [F.col("seq")], AS_OF, "all", f"{reports}/run={n}").withColumn(
            "run", F.lit(n)
        )
        for n in (1, 2)
    ]
    return runs[0].unionByName(runs[1])


@query(
    "silver_stored_rows",
    f"""{WITH_SILVER}, kept AS (SELECT * FROM silver WHERE ({_REASON}) IS NULL
        QUALIFY row_number() OVER (PARTITION BY record_hash ORDER BY seq) = 1)
      SELECT source AS source_country, record_hash, ocid, tender_id, publication_date, tender_title, tender_value_amount, buyer_name,
        array_to_string(supplier_names, '|') AS suppliers, num_lots FROM kept""",
)
def silver_stored_rows(spark, sf_dir):
    """Three loads, the second of known rows only, read back from the committed batches: all rows."""
    root = scratch_path(spark, "silver")
    records = staged(validation.accepted(silver(spark, sf_dir)).withColumn("source_country", F.col("source")).drop("source"), "records")
    ordered = records.withColumn("_order", F.col("seq")).drop("seq")
    early = ordered.where("publication_date < '2018'")
    for part in (early, early, ordered):
        silver_plan.load_silver(part, f"{root}/all", [F.col("_order")], AS_OF, "all")
    stored = scans.silver(spark, root, "all", schemas.SILVER_SCHEMA)
    return stored.select(
        "source_country", "record_hash", "ocid", "tender_id", "publication_date", "tender_title", "tender_value_amount", "buyer_name",
        F.array_join("supplier_names", "|").alias("suppliers"), "num_lots",
    )


def _write_silver_sources(spark, sf_dir: str, root: str) -> None:
    tenders = staged(silver(spark, sf_dir), "silver")
    for folder, tag in gold_plan.SOURCE_FOLDERS.items():
        tenders.where(F.col("source") == tag).drop("source").write.mode("overwrite").parquet(f"{root}/{folder}")


@query(
    "gold_build",
    f"""{WITH_GOLD} SELECT source, source_country, year, COUNT(*) AS records, {money_sql()} AS total_value,
      COUNT(DISTINCT date_quality_flag) AS flags FROM gold GROUP BY source, source_country, year""",
)
def gold_build(spark, sf_dir):
    """Four Silver folders to the stored unified table, partitioned by country and year."""
    root, path = scratch_path(spark, "silver"), scratch_path(spark, "gold")
    _write_silver_sources(spark, sf_dir, root)
    built = gold_plan.build_unified(spark, root, path, AS_OF)
    return built.groupBy("source", "source_country", "year").agg(
        F.count("*").alias("records"), money_sum(F.col("tender_value_amount")).alias("total_value"),
        F.count_distinct("date_quality_flag").alias("flags"),
    )


_SUMS = f"COUNT(ocid) AS total_records, {money_sql()} AS total_value, {mean_sql()} AS avg_value"


@query(
    "gold_tables",
    f"""{WITH_GOLD}, suppliers AS (SELECT *, unnest(supplier_names) AS supplier FROM gold),
      named AS (SELECT source_country, COUNT(DISTINCT supplier) AS n FROM suppliers GROUP BY 1)
      SELECT 'country_summary' AS name, source_country AS a, '' AS b, {_SUMS}, round(median(tender_value_amount), 4) AS median,
        COUNT(DISTINCT buyer_name) AS buyers, any_value(coalesce(n, 0)) AS others, MIN(publication_date) AS first_day, MAX(publication_date) AS last_day
        FROM gold LEFT JOIN named USING (source_country) GROUP BY source_country
      UNION ALL SELECT 'monthly_trends', CAST(year AS VARCHAR), CAST(month AS VARCHAR), {_SUMS}, NULL, COUNT(DISTINCT buyer_name),
        COUNT(DISTINCT source_country), NULL, NULL FROM gold WHERE year > 0 GROUP BY year, month
      UNION ALL SELECT 'category_analysis', source_country, procurement_category_standardized, {_SUMS}, NULL, NULL, NULL, NULL, NULL
        FROM gold GROUP BY source_country, procurement_category_standardized
      UNION ALL (SELECT 'top_buyers', buyer_name, source_country, {_SUMS}, NULL, NULL, NULL, NULL, NULL FROM gold WHERE buyer_name <> ''
        GROUP BY buyer_name, source_country ORDER BY total_records DESC, buyer_name, source_country LIMIT 100)
      UNION ALL (SELECT 'top_suppliers', supplier, source_country, {_SUMS}, NULL, NULL, NULL, NULL, NULL FROM suppliers WHERE supplier <> ''
        GROUP BY supplier, source_country ORDER BY total_records DESC, supplier, source_country LIMIT 100)""",
)
def gold_tables(spark, sf_dir):
    """The five aggregate tables, written from the stored unified table and read back: all rows and values."""
    path, folder = scratch_path(spark, "gold"), scratch_path(spark, "aggregates")
    writers.write_gold(enrich.gold_columns(gold(spark, sf_dir)), path)
    return _five_tables(spark, gold_plan.build_aggregates(scans.gold(spark, path), folder))


def _five_tables(spark, paths: dict[str, str]) -> DataFrame:
    """All tables in one shape."""
    shape = {
        "country_summary": ("source_country", None, "total_value_sum", "num_buyers", "num_suppliers"),
        "monthly_trends": ("year", "month", "total_value", "num_buyers", "num_countries"),
        "category_analysis": ("source_country", "procurement_category_standardized", "total_value", None, None),
        "top_buyers": ("buyer_name", "source_country", "total_value", None, None),
        "top_suppliers": ("supplier_name", "source_country", "total_value", None, None),
    }
    whole = None
    for name, path in paths.items():
        rows = spark.read.parquet(path)
        a, b, total, buyers, others = shape[name]
        some = lambda c, kind, rows=rows: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)
        part = rows.select(
            F.lit(name).alias("name"), F.col(a).cast("string").alias("a"), (F.col(b).cast("string") if b else F.lit("")).alias("b"),
            "total_records", F.col(total).alias("total_value"), "avg_value", F.round(some("median_value", "double"), 4).alias("median"),
            some(buyers, "bigint").alias("buyers"), some(others, "bigint").alias("others"),
            some("date_range_start", "string").alias("first_day"), some("date_range_end", "string").alias("last_day"),
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


_ALL_SQL = f"{WITH_GOLD} SELECT * EXCLUDE (seq, supplier_ids, supplier_names, document_urls), array_to_string(supplier_names, '|') AS names FROM gold"


@query("gold_refresh", _ALL_SQL)
def gold_refresh(spark, sf_dir):
    """The unified table built from the first Silver batches and refreshed with the others: all rows as from one build."""
    root, path = scratch_path(spark, "silver"), f"{scratch_path(spark, 'gold')}/unified"
    tenders = staged(silver(spark, sf_dir), "silver")
    for batch, condition in (("1", "seq % 4 IN (1, 2, 3) OR seq % 5 = 0"), ("2", "seq % 4 = 0 AND seq % 5 <> 0")):
        for folder, tag in gold_plan.SOURCE_FOLDERS.items():
            part = tenders.where((F.col("source") == tag) & F.expr(condition)).drop("source", "seq")
            part.write.parquet(f"{root}/{folder}/batch={batch}")
        gold_plan.refresh_unified(spark, root, path, AS_OF)
    stored = scans.gold(spark, path)
    return stored.withColumn("names", F.array_join("supplier_names", "|")).drop("supplier_ids", "supplier_names", "document_urls")


def _report(spark, sf_dir: str, name: str, schema: str) -> DataFrame:
    paths = gold_plan.build_reports(staged(enrich.gold_columns(gold(spark, sf_dir).drop("seq")), "gold"), scratch_path(spark, "reports"))
    return spark.read.schema(schema).json(paths[name])


@query(
    "gold_reports",
    f"""{WITH_GOLD} SELECT COUNT(*) AS total_records, COUNT(DISTINCT source_country) AS countries, MIN(publication_date) AS first_date,
      MAX(publication_date) AS last_date, round(AVG(data_completeness_score), 6) AS avg_completeness,
      COUNT(*) FILTER (date_quality_flag = 'valid') AS valid_dates, COUNT(*) FILTER (is_future_date) AS future_dates FROM gold""",
)
def gold_reports(spark, sf_dir):
    """The overview report as written to JSON, read back."""
    schema = "total_records bigint, countries bigint, first_date string, last_date string, avg_completeness double, valid_dates bigint, future_dates bigint"
    return _report(spark, sf_dir, "overview", schema).withColumn("avg_completeness", F.round("avg_completeness", 6))


@query("gold_reports_coverage", CHECKS["gold_coverage"])
def gold_reports_coverage(spark, sf_dir):
    """The coverage report as written to JSON, read back."""
    built = gold_plan.build_reports(staged(enrich.gold_columns(gold(spark, sf_dir).drop("seq")), "gold"), scratch_path(spark, "reports"))
    return spark.read.schema(QUERIES["gold_coverage"](spark, sf_dir).schema).json(built["coverage"])


@query("gold_reports_validation", CHECKS["gold_validation"])
def gold_reports_validation(spark, sf_dir):
    """The validation report as written to JSON, read back."""
    return _report(spark, sf_dir, "validation", "metric string, value double")


@query(
    "gold_reports_deduplication",
    f"""{WITH_GOLD} SELECT COUNT(*) AS total_records, COUNT(DISTINCT ocid) AS unique_ocids, COUNT(*) - COUNT(DISTINCT ocid) AS duplicate_ocids,
      1 - CAST(COUNT(DISTINCT ocid) AS DOUBLE) / COUNT(*) AS deduplication_rate FROM gold""",
)
def gold_reports_deduplication(spark, sf_dir):
    """The identity report as written to JSON, read back."""
    schema = "total_records bigint, unique_ocids bigint, duplicate_ocids bigint, deduplication_rate double"
    return _report(spark, sf_dir, "deduplication", schema)


@query(
    "file_stats",
    f"""{WITH_SILVER} SELECT source AS source_country, COUNT(*) AS records, true AS files_as_listed, true AS size_as_listed FROM silver GROUP BY source""",
)
def file_stats(spark, sf_dir):
    """Files, records and size per partition of a stored table; files and sizes depend on the writer, so they are held
    against a listing, sizes to a hundredth of a megabyte."""
    path = scratch_path(spark, "silver")
    tenders = silver(spark, sf_dir).withColumn("source_country", F.col("source")).drop("source")
    writers.write_silver(tenders, path, mode="overwrite")
    country = F.regexp_extract("path", "/source_country=([^/]+)/", 1)
    listed = scans.file_listing(spark, path, "*.parquet").groupBy(country.alias("source_country")).agg(
        F.count("*").alias("listed"), F.sum("length").alias("bytes")
    )
    close = F.abs(F.col("size_mb") - F.col("bytes") / F.lit(1024 * 1024)) < 0.01
    return silver_plan.silver_totals(spark, path).join(listed, "source_country").select(
        "source_country", "records", (F.col("files") == F.col("listed")).alias("files_as_listed"), close.alias("size_as_listed")
    )


@query(
    "export_csv",
    f"""{WITH_GOLD} SELECT year, month, COUNT(ocid) AS total_records, {money_sql()} AS total_value
      FROM gold WHERE year > 0 GROUP BY year, month""",
)
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    trends = aggregates.monthly_trends(gold(spark, sf_dir))
    writers.export(trends.select("year", "month", "total_records", "total_value"), path, "csv")
    return spark.read.schema("year int, month int, total_records bigint, total_value double").option("header", True).csv(path)


@query(
    "export_json",
    f"""{WITH_GOLD} SELECT source, ocid, source_publication_id, tender_value_amount, array_to_string(supplier_names, '|') AS suppliers FROM gold""",
)
def export_json(spark, sf_dir):
    """Rows with arrays as JSON lines, read back."""
    path = scratch_path(spark, "export")
    writers.export(gold(spark, sf_dir).select("source", "ocid", "source_publication_id", "tender_value_amount", "supplier_names"), path, "json")
    schema = "source string, ocid string, source_publication_id string, tender_value_amount double, supplier_names array<string>"
    return spark.read.schema(schema).json(path).withColumn("suppliers", F.array_join("supplier_names", "|")).drop("supplier_names")


@query(
    "row_cap",
    """SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) > 1000 AS truncated FROM orders
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""",
)
def row_cap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return profile.capped(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 1000)


@query("parquet_limit", "SELECT least(1000, COUNT(*)) AS records FROM lineitem")
def parquet_limit(spark, sf_dir):
    """A capped Parquet read: which rows is open, their number is not."""
    return scans.parquet(spark, f"{sf_dir}/lineitem.parquet", 1000).agg(F.count("*").alias("records"))


@query(
    "export_csv_arrays",
    f"""{WITH_GOLD} SELECT ocid, '[' || array_to_string(list_transform(supplier_names, lambda x: '"' || replace(x, '"', '\\"') || '"'), ',') || ']' AS suppliers
      FROM gold""",
)
def export_csv_arrays(spark, sf_dir):
    """Array columns as JSON text in CSV, read back."""
    path = scratch_path(spark, "export")
    rows = gold(spark, sf_dir)
    writers.export(rows.select("ocid", F.col("supplier_names").alias("suppliers")), path, "csv")
    return spark.read.schema("ocid string, suppliers string").option("header", True).option("escape", '"').csv(path)


# ---------------------------------------------------------------- incremental
def _event_records(events: DataFrame) -> DataFrame:
    # An event counts as seen when its user, type and payload were seen.
    columns = [F.col("user_id").cast("string"), F.col("event_type"), F.col("props")]
    return events.select("event_id", "user_id", "event_type", keys.record_hash(columns).alias("record_hash"))


@query(
    "incremental_files",
    "SELECT event_type, COUNT(*) AS records FROM events WHERE event_type <> 'click' GROUP BY event_type",
)
def incremental_files(spark, sf_dir):
    """Only files that the ledger does not list are read."""
    path, ledger = scratch_path(spark, "events"), scratch_path(spark, "ledger") + "/files"
    events = table(spark, sf_dir, "events")
    events.write.mode("overwrite").partitionBy("event_type").parquet(path)
    listing = scans.file_listing(spark, path, "*.parquet")
    done = listing.where(F.col("path").contains("event_type=click/"))
    incremental.append_ledger(done.select("path", F.now().alias("processed_at")), ledger)
    processed = incremental.read_ledger(spark, ledger, schemas.PROCESSED_FILES_SCHEMA)
    rows = incremental.read_unseen(listing, processed, "event_id bigint, event_type string", path)
    return rows.groupBy("event_type").agg(F.count("*").alias("records"))


@query(
    "changed_files",
    """SELECT event_type, event_type <> 'view' AS opened_for_content, true AS digest_is_of_content FROM (SELECT DISTINCT event_type FROM events)
      WHERE event_type NOT IN ('click', 'view')""",
)
def changed_files(spark, sf_dir):
    """Files whose digest is new or differs from the ledger's latest one. Of what the ledger holds with the same size and time
    (clicks) nothing is read; with another time, but the same content (views), nothing is reported."""
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events")
    events.hint("rebalance", "event_type").write.mode("overwrite").partitionBy("event_type").parquet(path)
    listing = scans.file_listing(spark, path, "*.parquet")
    whole = scans.file_digests(spark, path, "*.parquet", modified=True)
    kind = lambda name: F.col("key").contains(f"event_type={name}/")
    extracted = whole.where(kind("click") | kind("view")).select(
        "key", "md5_hash", "size_bytes", F.when(kind("click"), F.col("modified")).alias("modified"), F.lit("2025-01-01").alias("timestamp")
    )
    changed = incremental.changed_digests(listing, extracted)
    same = changed.join(whole.select("key", F.col("md5_hash").alias("_md5")), "key")
    name = F.regexp_extract("key", "event_type=([^/]+)/", 1).alias("event_type")
    return same.groupBy(name).agg(F.lit(True).alias("opened_for_content"), F.every(F.col("md5_hash") == F.col("_md5")).alias("digest_is_of_content"))


@query(
    "pending_keys",
    """SELECT source || '/' || lang AS key FROM (SELECT DISTINCT source, lang FROM documents)
      WHERE lang NOT IN (SELECT lang FROM documents WHERE lang = 'en')""",
)
def pending_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("key"), "lang")
    wanted = docs.select("key").distinct()
    return incremental.pending_keys(wanted, docs.where(F.col("lang") == "en").select("key").distinct())


@query(
    "ledger_totals",
    """WITH per AS (SELECT source, lang, COUNT(*) AS n, MAX(doc_id) AS last FROM documents GROUP BY ALL),
      latest AS (SELECT source, arg_max(n, lang) AS n, MAX(lang) AS lang FROM per GROUP BY source)
      SELECT COUNT(*) AS total_files, CAST(SUM(n) AS BIGINT) AS total_records, MAX(lang) AS last_run FROM latest""",
)
def ledger_totals(spark, sf_dir):
    """One ledger entry per source and language; the latest entry of a source counts."""
    docs = table(spark, sf_dir, "documents")
    entries = docs.groupBy(F.col("source").alias("key"), F.col("lang").alias("timestamp")).agg(
        F.count("*").alias("record_count")
    )
    return incremental.ledger_totals(entries)


@query(
    "stream_hash_dedup",
    """SELECT user_id, event_type, COUNT(DISTINCT props) AS records FROM events GROUP BY user_id, event_type""",
)
def stream_hash_dedup(spark, sf_dir):
    """Two runs of the stream over the same files; each hash is stored once."""
    target, checkpoint = scratch_path(spark, "once"), scratch_path(spark, "checkpoint")
    fields = table(spark, sf_dir, "events").schema
    for _ in range(2):
        stream = incremental.file_stream(spark, sf_dir, fields, "parquet", pathGlobFilter="events.parquet")
        incremental.write_once(stream, target, checkpoint, [F.col("event_id")], _event_records).awaitTermination()
    stored = spark.read.schema("user_id bigint, event_type string, record_hash string").parquet(target)
    return stored.groupBy("user_id", "event_type").agg(F.count("record_hash").alias("records"))


@query(
    "stream_two_checkpoints",
    """SELECT user_id, event_type, COUNT(DISTINCT props) AS records FROM events GROUP BY user_id, event_type""",
)
def stream_two_checkpoints(spark, sf_dir):
    """Two sources with checkpoints of their own, then a lost checkpoint, into one target: each hash once, none erased."""
    target, folder = scratch_path(spark, "once"), scratch_path(spark, "events")
    events = table(spark, sf_dir, "events")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.parquet(f"{folder}/{half}")
    for half in (0, 1, 1):
        stream = incremental.file_stream(spark, f"{folder}/{half}", events.schema, "parquet", files_per_batch=1)
        checkpoint = scratch_path(spark, "checkpoint")
        incremental.write_once(stream, target, checkpoint, [F.col("event_id")], _event_records).awaitTermination()
    stored = spark.read.schema("user_id bigint, event_type string, record_hash string").parquet(target)
    return stored.groupBy("user_id", "event_type").agg(F.count("record_hash").alias("records"))


@query(
    "stream_unique_within",
    """SELECT event_type, COUNT(DISTINCT md5(coalesce(CAST(user_id AS VARCHAR), 'None') || '|' || event_type || '|' || props))
      AS records FROM events GROUP BY event_type""",
)
def stream_unique_within(spark, sf_dir):
    """Bounded-state variant: unique within the watermark, here longer than the data."""
    target, checkpoint = scratch_path(spark, "within"), scratch_path(spark, "checkpoint")
    fields = table(spark, sf_dir, "events").schema
    stream = incremental.file_stream(spark, sf_dir, fields, "parquet", pathGlobFilter="events.parquet")
    columns = [F.col("user_id").cast("string"), F.col("event_type"), F.col("props")]
    hashed = stream.withColumn("record_hash", keys.record_hash(columns)).withColumn("at", F.col("ts").cast("timestamp"))
    unique = incremental.unique_within(hashed, "at", "60 days")
    run = (
        unique.select("event_type", "record_hash").writeStream.format("parquet")
        .option("path", f"{target}/rows").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    stored = spark.read.schema("event_type string, record_hash string").parquet(f"{target}/rows")
    return stored.groupBy("event_type").agg(F.count("*").alias("records"))
