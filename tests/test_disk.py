"""What queries leave on disk while they run, and how much of it one task holds."""

import gzip
import json
import os
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_clusters import ROWS

import __spark_entry__ as entry
from procurelake.catalog import lake
from procurelake.operators import dedup
from procurelake.session import shuffles_freed, staged
from procurelake.sinks import writers
from procurelake.sources import scans


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, sql in ROWS.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{path}/{name}.parquet'")
    return str(path)


def data_files(path) -> list[Path]:
    return [f for f in Path(path).rglob("part-*") if not f.name.endswith(".crc")]


@pytest.mark.parametrize("name", ["bronze_append", "bronze_days", "bronze_license", "release_lines_to_silver", "envelope_lines_to_silver"])
def test_stored_texts_are_compressed(spark, folder, monkeypatch, tmp_path, name):
    monkeypatch.setattr(lake, "scratch_path", lambda spark, label: str(tmp_path / label))
    assert entry.queries()[name](spark, folder).count() > 0
    files = data_files(tmp_path)
    assert files and all(f.name.endswith(".json.gz") for f in files)


@pytest.mark.parametrize("extracted_at", ["2025-03-15T00:00:00Z", "of the row", None])
def test_bronze_text_is_that_of_the_rows(spark, tmp_path, extracted_at):
    """Nested and missing values, numbers, quotes and line breaks come out as the JSON writer would write the rows themselves."""
    schema = """ocid string, date string, publishedDate string, country string, n bigint, x double, days array<date>, `a.b` string,
      tender struct<tenderPeriod:struct<startDate:string>,datePublished:string,lots:array<struct<id:string>>>, m map<string,decimal(9,2)>"""
    rows = [
        ("o-1", "2025-01-15", None, "uk", 1, 0.1, [], 'q"\n\\', ((None,), None, [("1",), None, (None,)]), {"b": Decimal("1.50"), "a": None}),
        ("o-2", None, "2025-01-16T01:00:00Z", "uk", None, None, None, None, None, None),
        ("o-3", "2025-01-15", None, "kosovo", -(2**63), float("inf"), None, "", (("2025-01-01",), "é ", []), {}),
        ("o-4", "never", None, "uk", 1, 1.0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    extracted_at = F.concat("ocid", F.lit("-at")) if extracted_at == "of the row" else extracted_at
    counts = writers.write_bronze(df, str(tmp_path / "new"), extracted_at)
    assert {r.release_date: r.records for r in counts.collect()} == {"2025-01-15": 2, "2025-01-16": 1}
    plain = writers.bronze_rows(df, extracted_at).withColumnRenamed("_metadata_license", "license")
    plain.write.partitionBy(*writers.BRONZE_KEYS).json(str(tmp_path / "old"))

    def lines(side):
        found = [(str(f.parent.relative_to(tmp_path / side)), line) for f in data_files(tmp_path / side) for line in f.read_text().split("\n") if line]
        if extracted_at is None:  # now, which differs
            found = [(day, line.split('"extraction_timestamp"')[0]) for day, line in found]
        return sorted(found)

    assert len(lines("new")) == 3 and lines("new") == lines("old")


def test_envelopes_have_a_bounded_number_of_records(spark, folder, tmp_path):
    path = str(tmp_path / "envelopes")
    lake._write_envelopes(spark, folder, path, records=5)
    whole = [json.loads(gzip.open(f, "rt").read()) for f in data_files(path)]
    ids = Counter(record["ocid"] for envelope in whole for record in envelope["records"])
    want = Counter(r.ocid for r in lake.releases(spark, folder).select("ocid").collect())
    assert ids == want and all(envelope["count"] == len(envelope["records"]) > 0 for envelope in whole)
    # rows are dealt by hash, so a file may have some more
    assert max(len(envelope["records"]) for envelope in whole) <= 20 < len(whole)
    for read in (scans.envelopes, scans.envelope_records):
        assert Counter(r.ocid for r in read(spark, path, "envelopes", glob="*.txt.gz").select("ocid").collect()) == want


def test_envelopes_with_repeated_orders(spark, folder, tmp_path):
    for name in ROWS:
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/t/{name}.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey < 40")
    orders.unionByName(orders).unionByName(orders).write.mode("overwrite").parquet(f"{tmp_path}/t/orders.parquet")
    path = str(tmp_path / "envelopes")
    lake._write_envelopes(spark, f"{tmp_path}/t", path, records=4)
    got = scans.envelopes(spark, path, "envelopes", glob="*.txt.gz")
    assert got.count() == 120 and {r.n for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()} == {3}


def test_small_gold_files_have_small_filters(spark, tmp_path):
    df = spark.range(200).select(F.lit("uk").alias("source_country"), F.lit(2024).alias("year"), F.col("id").cast("string").alias("ocid"), F.col("id").cast("string").alias("tender_id"))
    writers.write_gold(df, str(tmp_path / "gold"))
    files = data_files(tmp_path / "gold")
    assert files and sum(os.path.getsize(f) for f in files) < 50_000
    assert scans.gold(spark, str(tmp_path / "gold")).where("ocid = '7'").count() == 1


def shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def test_shuffle_files_go_with_their_write(spark):
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    df = spark.range(0, 5000, 1, 7).repartition(9, "id")
    with shuffles_freed(spark):
        assert staged(df).count() == 5000 and spark.conf.get(name) == "true"
    assert spark.conf.get(name, "false") == "false"
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    # what the count left, but none of the files of the staged rows
    assert shuffle_files(spark) < before + 7


def test_new_records_send_whole_rows_once(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "", "x"), (5, "b", "x"), (6, None, None), (7, "c", "y"), (7, "c", "y"), (8, None, "z")]
    batch = spark.createDataFrame(rows, "seq bigint, record_hash string, wide string")
    seen = spark.createDataFrame([("b",), (None,), ("",)], "record_hash string")
    # a cluster's ledger is too large for a broadcast
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = dedup.new_records(batch, seen, [F.col("seq")])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, fresh.collect())) == sorted(map(str, batch.where("seq IN (1, 3, 4, 6, 8)").collect() + batch.where("seq = 7").limit(1).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one shuffle of whole rows and one of the known hashes; rows went by hash and order first and by hash again before
    assert sum("hashpartitioning(_group" in line and "Exchange" in line for line in plan.split("\n")) == 2
    assert not any("Exchange hashpartitioning(record_hash" in line and "wide" in line for line in plan.split("\n"))
