"""Benchmark: one JSON line with seconds per query.

The ``gold:`` entries follow the layered lake: the unified table is built and stored once
(``gold:build``), the questions and aggregate tables then read the stored table. The
other entries run registered queries from the given tables to their last row.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from procurelake import catalog
from procurelake.catalog import tenders
from procurelake.operators import aggregates, quality
from procurelake.plans import gold as gold_plan
from procurelake.plans import questions
from procurelake.session import build_session
from procurelake.sources import scans

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "unified_enriched", "unified_dedup", "country_summary", "monthly_trends", "category_analysis", "top_buyers",
    "top_suppliers", "dictionary_lookup", "sql_total", "sql_top_countries", "sql_month_trend", "sql_high_value",
    "sql_category_share", "quality_fields", "quality_summary", "gold_coverage", "gold_validation", "dup_summary_lines",
    "dup_members", "mark_latest", "new_records_anti", "column_profile", "silver_clean", "map_releases", "map_notices",
    "contracts_to_silver", "relational_merge", "clean_text",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    seconds: dict[str, float] = {}

    def measure(name, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        root, path = f"{folder}/silver", f"{folder}/gold"
        silver = tenders.silver(spark, SF_DIR).persist()
        for name, tag in gold_plan.SOURCE_FOLDERS.items():
            silver.where(F.col("source") == tag).drop("source").write.parquet(f"{root}/{name}")
        measure("gold:build", lambda: gold_plan.build_unified(spark, root, path, tenders.AS_OF))
        gold = scans.gold(spark, path)
        tables = f"{folder}/tables"
        found: list[aggregates.Facts] = []
        measure("gold:facts", lambda: found.append(gold_plan.build_facts(gold, tables)))
        for name, build in aggregates.AGGREGATES.items():
            measure(f"gold:{name}", lambda build=build: drain(build(found[0])))
        measure("gold:all_tables", lambda: gold_plan.build_aggregates(gold, f"{folder}/again"))
        batch = silver.where("seq % 100 = 0").withColumn("tender_id", F.concat("tender_id", F.lit("-new")))
        batch.where("source = 'ted'").withColumn("source_publication_id", F.lit("new")).drop("source").write.mode("append").parquet(f"{root}/ted")
        measure("gold:refresh", lambda: gold_plan.refresh_unified(spark, root, path, tenders.AS_OF))
        gold = scans.gold(spark, path)
        ask = lambda *a, **k: drain(questions.ask(gold, *a, **k))
        measure("gold:count", lambda: ask(questions.TOTAL))
        measure("gold:top_countries", lambda: ask(questions.TOP_COUNTRIES, condition="source_country IS NOT NULL"))
        measure("gold:months", lambda: ask(questions.MONTHS, condition="date_quality_flag = 'valid'"))
        measure("gold:year_totals", lambda: ask(questions.YEAR_TOTALS))
        measure("gold:high_value", lambda: ask(questions.HIGH_VALUE, floor=300000, rows=100))
        measure("gold:category_share", lambda: ask(questions.CATEGORY_SHARE))
        measure("gold:year_filter", lambda: drain(gold.where("year = 2024").groupBy("source_country").count()))
        lookup = f"{folder}/country_summary.parquet"
        aggregates.country_summary(found[0]).write.parquet(lookup)
        measure("gold:lookup", lambda: drain(spark.read.parquet(lookup).orderBy("source_country")))
        measure("gold:coverage", lambda: drain(quality.coverage_report(gold)))
        measure("gold:validation", lambda: drain(quality.validation_report(gold)))
        for name in QUERIES:
            measure(name, lambda name=name: drain(catalog.QUERIES[name](spark, SF_DIR)))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
