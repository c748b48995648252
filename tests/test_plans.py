"""Layer steps, incremental loading and streams."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.functions import keys
from procurelake.operators import cleaning
from procurelake.plans import gold as gold_plan
from procurelake.plans import questions
from procurelake.plans import silver as silver_plan
from procurelake.session import scratch_path, shared_folder
from procurelake.sinks import writers
from procurelake.sources import commits, scans
from procurelake.streaming import incremental


def records(spark, numbers, source="x", country="PT"):
    rows = [(f"ocds-{n}", f"p{n}", str(n), f"2025-0{1 + n % 3}-10", country, float(n), f"b{n}") for n in numbers]
    raw = spark.createDataFrame(
        rows, "ocid string, source_publication_id string, tender_id string, publication_date string, "
        "source_country string, tender_value_amount double, buyer_name string"
    )
    return cleaning.clean_record(raw).withColumns(
        {"record_hash": keys.record_hash(), "source_file": F.lit(source), "tender_status": F.lit(source)}
    )


def test_silver_load_never_writes_twice(spark, tmp_path):
    path, reports = str(tmp_path / "silver"), str(tmp_path / "reports")
    order = [F.col("tender_id")]
    with_row = records(spark, range(5)).withColumn("_row", F.lit(1))
    first = silver_plan.load_silver(with_row, path, [*order, F.col("_row")], "2025-01-10", "x", reports)
    assert "_row" not in spark.read.option("recursiveFileLookup", True).parquet(path).columns
    assert sum(r["records"] for r in first.collect()) == 5
    again = silver_plan.load_silver(records(spark, range(5)), path, order, "2025-01-10", "x", reports)
    assert again.count() == 0
    more = silver_plan.load_silver(records(spark, range(3, 8)), path, order, "2025-01-10", "x", reports)
    assert sum(r["records"] for r in more.collect()) == 3
    assert spark.read.schema("record_hash string").option("recursiveFileLookup", True).parquet(path).distinct().count() == 8
    assert spark.read.json(reports).count() == 3
    assert [(r["source_country"], r["records"]) for r in silver_plan.silver_totals(spark, path).collect()] == [("PT", 8)]


def test_gold_from_four_folders(spark, tmp_path):
    root, path = str(tmp_path / "silver"), str(tmp_path / "gold")
    records(spark, range(4), "ocp").write.parquet(f"{root}/open_contracting_partnership/a")
    records(spark, range(2, 6), "ted", "").write.parquet(f"{root}/ted/b")
    records(spark, [9], "ted").write.parquet(f"{root}/ted/quality_reports")
    partner = spark.sql(
        "SELECT 'ocds-partner-1' ocid, '1' source_publication_id, 'PT' source_country, TIMESTAMP_NTZ'2024-02-03 00:00:00' "
        "publication_date, 3.0D tender_value_amount, 'works' procurement_category, 't' tender_title, 'b' buyer_name, "
        "'open' procurement_method, 'on' tender_status, 'kind' buyer_type, CAST(NULL AS STRING) award_date"
    )
    partner.write.parquet(f"{root}/partner")
    built = gold_plan.build_unified(spark, root, path, "2025-03-15")
    rows = {r["ocid"]: r for r in built.collect()}
    assert set(rows) == {f"ocds-{n}" for n in range(6)} | {"ocds-partner-1"}
    assert (rows["ocds-3"]["source"], rows["ocds-5"]["source"], rows["ocds-5"]["source_country"]) == ("ocp", "ted", "")
    assert (rows["ocds-partner-1"]["publication_date"], rows["ocds-partner-1"]["buyer_type"]) == ("2024-02-03", "kind")
    assert rows["ocds-partner-1"]["has_award"] is False
    assert set(schemas.GOLD_COLUMNS) <= set(built.columns)
    tables = gold_plan.build_aggregates(built, str(tmp_path / "aggregates"))
    counted = {n: spark.read.parquet(p).count() for n, p in tables.items()}
    assert (counted["country_summary"], counted["monthly_trends"]) == (2, 4)
    assert spark.read.json(gold_plan.build_reports(built, str(tmp_path / "reports"))["coverage"]).count() == len(built.columns)


def test_loaded_silver_keeps_its_countries(spark, tmp_path):
    root, path = str(tmp_path / "silver"), str(tmp_path / "gold")
    names = ["a+b c/d%e", "", "PT"]
    rows = None
    for n, name in enumerate(names):
        part = records(spark, [n], country=name)
        rows = part if rows is None else rows.unionByName(part)
    silver_plan.load_silver(rows, f"{root}/ted", [F.col("tender_id")], "2025-01-10", "ted")
    built = gold_plan.build_unified(spark, root, path, "2025-03-15")
    found = {r["ocid"]: r["source_country"] for r in built.collect()}
    assert found == {"ocds-0": "a+b c/d%e", "ocds-1": "", "ocds-2": "portugal"}


def test_year_filter_prunes_partitions(spark, tmp_path):
    root, path = str(tmp_path / "silver"), str(tmp_path / "gold")
    records(spark, range(4)).write.parquet(f"{root}/ted")
    built = gold_plan.build_unified(spark, root, path, "2025-03-15")
    asked = questions.ask(built, questions.MONTHS, condition="publication_date IS NOT NULL")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "year" in scan.split("PartitionFilters")[1].split("]")[0]
    assert sum(r["tender_count"] for r in asked.collect()) == 4


def test_no_silver_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        gold_plan.build_unified(spark, str(tmp_path), str(tmp_path / "gold"), "2025-01-01")


def test_file_ledger(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(name)
    listing = scans.file_listing(spark, str(tmp_path), "*.txt")
    ledger = str(tmp_path / "ledger")
    empty = incremental.read_ledger(spark, ledger, schemas.PROCESSED_FILES_SCHEMA)
    assert incremental.unseen_files(listing, empty).count() == 2
    incremental.append_ledger(listing.select("path", F.now().alias("processed_at")), ledger)
    (tmp_path / "c.txt").write_text("c")
    done = incremental.read_ledger(spark, ledger, schemas.PROCESSED_FILES_SCHEMA)
    fresh = incremental.unseen_files(scans.file_listing(spark, str(tmp_path), "*.txt"), done)
    assert [r["path"].rsplit("/", 1)[1] for r in fresh.collect()] == ["c.txt"]


def test_changed_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(name)
    digests = scans.file_digests(spark, str(tmp_path), "*.txt")
    stamps = lambda t: digests.select("key", "md5_hash", F.lit(5).alias("record_count"), "size_bytes", F.lit(t).alias("timestamp"))
    ledger = str(tmp_path / "ledger")
    incremental.append_ledger(stamps("2025-01-01"), ledger)
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("new")
    known = spark.read.parquet(ledger)
    changed = incremental.changed_files(scans.file_digests(spark, str(tmp_path), "*.txt"), known)
    assert sorted(r["key"].rsplit("/", 1)[1] for r in changed.collect()) == ["a.txt", "c.txt"]
    totals = incremental.ledger_totals(known.unionByName(known.withColumn("timestamp", F.lit("2025-02-02")))).first()
    assert (totals["total_files"], totals["total_records"], totals["last_run"]) == (2, 10, "2025-02-02")


def _run_stream(spark, source, target, checkpoint):
    stream = incremental.file_stream(spark, source, records(spark, []).schema, "parquet")
    incremental.write_once(stream, target, checkpoint, [F.col("tender_id")]).awaitTermination()


def test_stream_writes_each_hash_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    hashes = lambda: [r["record_hash"] for r in spark.read.parquet(target).collect()]
    records(spark, [1, 2, 2]).write.mode("append").parquet(source)
    _run_stream(spark, source, target, checkpoint)
    assert len(hashes()) == len(set(hashes())) == 2
    _run_stream(spark, source, target, checkpoint)
    assert len(hashes()) == 2
    records(spark, [2, 3]).write.mode("append").parquet(source)
    _run_stream(spark, source, target, checkpoint)
    assert len(hashes()) == len(set(hashes())) == 3


def test_repeated_batch_replaces_its_output(spark, tmp_path):
    """A batch whose commit is lost runs again; its own folder is not taken for history."""
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    records(spark, [1, 2, 3]).write.parquet(source)
    _run_stream(spark, source, target, checkpoint)
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    _run_stream(spark, source, target, checkpoint)
    hashes = [r["record_hash"] for r in spark.read.parquet(target).collect()]
    assert len(hashes) == len(set(hashes)) == 3


def test_second_and_lost_checkpoints_erase_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    for number, ids in enumerate(([1, 2], [3, 4], [3, 4, 5])):
        records(spark, ids).write.parquet(str(tmp_path / f"in{number}"))
        _run_stream(spark, str(tmp_path / f"in{number}"), target, str(tmp_path / f"checkpoint{number}"))
    hashes = [r["record_hash"] for r in spark.read.parquet(target).collect()]
    assert len(hashes) == len(set(hashes)) == 5


def test_ledger_scan_reads_the_months_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "silver")
    stored = spark.createDataFrame([(f"h{m}", "2024", f"{m:02d}") for m in range(1, 13)], "record_hash string, year string, month string")
    stored.write.partitionBy("year", "month").parquet(f"{path}/batch=a")
    seen = silver_plan.stored_hashes(spark, path).where(silver_plan._months_of(stored.where("month IN ('02', '03')")))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "month" in filters.split("PartitionFilters:")[1].split("]")[0] and "02" in filters
    assert sorted(r["record_hash"] for r in seen.collect()) == ["h2", "h3"]


def test_only_unseen_files_are_scanned(spark, tmp_path):
    for name in "ab":
        spark.range(3).write.parquet(str(tmp_path / f"kind={name}"))
    listing = scans.file_listing(spark, str(tmp_path), "*.parquet")
    done = listing.where(F.col("path").contains("kind=a/")).select("path")
    rows = incremental.read_unseen(listing, done, "id bigint, kind string", str(tmp_path))
    assert rows.count() == 3 and all("kind=b/" in f for f in rows.inputFiles())
    assert incremental.read_unseen(listing, listing, "id bigint, kind string", str(tmp_path)).count() == 0

def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(shared_folder(spark))


def _folder_times(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def _same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    show = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert show(a) == show(b)


@pytest.mark.parametrize("by", ["source", "completeness"])
def test_gold_refresh_rewrites_touched_partitions_only(spark, tmp_path, by):
    root, path, folder = str(tmp_path / "silver"), str(tmp_path / "gold"), str(tmp_path / "tables")
    records(spark, range(6), "ted").write.parquet(f"{root}/ted/batch=1")
    records(spark, [20, 21], "ted", "DE").write.parquet(f"{root}/ted/batch=1b")
    records(spark, range(30, 33), "ted", "FR").write.parquet(f"{root}/ted/batch=1c")
    assert gold_plan.refresh(spark, root, path, folder, "2025-03-15", by)
    before = _folder_times(tmp_path / "gold")
    assert {k.split("/")[0] for k in before} == {"source_country=pt", "source_country=de", "source_country=fr"} or len({k.split("/")[0] for k in before}) == 3
    # nothing new: nothing written
    assert gold_plan.refresh_unified(spark, root, path, "2025-03-15", by) == []
    assert _folder_times(tmp_path / "gold") == before
    # the better source takes both rows of DE away, a known row comes again, one row is new
    records(spark, [20, 21, 3], "ocp", "ES").withColumn("tender_title", F.lit("named")).write.parquet(f"{root}/open_contracting_partnership/batch=2")
    records(spark, [30, 40], "ted", "FR").write.parquet(f"{root}/ted/batch=2")
    touched = gold_plan.refresh_unified(spark, root, path, "2025-03-15", by)
    after = _folder_times(tmp_path / "gold")
    stored = scans.gold(spark, path)
    whole = gold_plan.build_unified(spark, root, str(tmp_path / "whole"), "2025-03-15", by)
    if by == "source":
        assert {c for c, _ in touched} == {c for c in {r["source_country"] for r in whole.collect()} | {"germany", "de"} if c in {x for x, _ in touched}}
    changed = {k.split("/")[0] for k in before.keys() ^ after.keys()}
    assert changed == {f"source_country={c}" for c, _ in touched}
    assert not any("source_country=de" in k for k in after)
    _same_rows(stored, whole)
    gold_plan.build_aggregates(stored, folder, sorted({y for _, y in touched}))
    again = str(tmp_path / "again")
    for name, where in gold_plan.build_aggregates(whole, again).items():
        _same_rows(spark.read.parquet(f"{folder}/{name}.parquet"), spark.read.parquet(where))
    # a batch that was written but not noted is taken again without a change
    seen = spark.read.parquet(f"{path}_files").where(~F.col("path").contains("batch=2")).collect()
    spark.createDataFrame(seen, schemas.PROCESSED_FILES_SCHEMA).write.mode("overwrite").parquet(f"{path}_files")
    gold_plan.refresh_unified(spark, root, path, "2025-03-15", by)
    _same_rows(scans.gold(spark, path), whole)
    # a later day: rows that were in the future no longer are
    records(spark, [50], "ted").withColumn("publication_date", F.lit("2025-06-01")).write.parquet(f"{root}/ted/batch=3")
    gold_plan.refresh_unified(spark, root, path, "2025-03-15", by)
    assert scans.gold(spark, path).where("is_future_date").count() == 1
    assert len(gold_plan.refresh_unified(spark, root, path, "2025-07-01", by)) == 1
    assert scans.gold(spark, path).where("is_future_date").count() == 0


def test_facts_follow_years_that_vanish(spark, tmp_path):
    root, path, folder = str(tmp_path / "silver"), str(tmp_path / "gold"), str(tmp_path / "tables")
    old = records(spark, range(3), "ted").withColumn("publication_date", F.lit("2019-02-03"))
    old.write.parquet(f"{root}/ted/a")
    gold_plan.refresh(spark, root, path, folder, "2025-03-15")
    records(spark, range(3), "ocp").write.parquet(f"{root}/open_contracting_partnership/b")
    paths = gold_plan.refresh(spark, root, path, folder, "2025-03-15")
    assert {r["year"] for r in spark.read.parquet(paths["monthly_trends"]).collect()} == {2025}
    assert scans.gold(spark, path).count() == 3


def test_tables_from_facts_have_no_expand(spark):
    gold = gold_plan.unified({"ted": records(spark, range(5)).withColumns({"_file": F.lit("a"), "_row": F.col("tender_id").cast("long")})}, "2025-03-15", [F.col("_row")])
    from procurelake.operators import aggregates

    for build in aggregates.AGGREGATES.values():
        assert "Expand" not in build(gold)._jdf.queryExecution().executedPlan().toString()


def test_two_loads_at_once_store_each_hash_once(spark, tmp_path, monkeypatch):
    path, order = str(tmp_path / "silver" / "ted"), [F.col("tender_id")]
    silver_plan.load_silver(records(spark, range(2)), path, order, "2025-01-10", "x")
    claim, inner = commits.claim, []

    def second_first(spark_, path_, number, batch):
        if not inner:
            inner.append(True)  # the other load began earlier than this one's commit, and is faster
            silver_plan.load_silver(records(spark, range(1, 6)), path, order, "2025-01-10", "x")
            unseen = commits.folders(spark, path) - commits.committed(spark, path)
            assert len(unseen) == 1
            visible = scans.silver(spark, str(tmp_path / "silver"), "ted", schemas.SILVER_SCHEMA)
            assert visible.count() == 6 and sum(r["records"] for r in silver_plan.silver_totals(spark, path).collect()) == 6
        return claim(spark_, path_, number, batch)

    monkeypatch.setattr(commits, "claim", second_first)
    mine = silver_plan.load_silver(records(spark, range(4, 9)), path, order, "2025-01-10", "x")
    monkeypatch.setattr(commits, "claim", claim)
    assert sum(r["records"] for r in mine.collect()) == 3
    stored = scans.silver(spark, str(tmp_path / "silver"), "ted", schemas.SILVER_SCHEMA)
    assert sorted(r["ocid"] for r in stored.collect()) == [f"ocds-{n}" for n in range(9)]
    assert [n for n, _ in commits.entries(spark, path)] == [1, 2, 3]
    # a folder that a failed load has left is not read, neither by readers nor by the next load
    records(spark, range(20, 25)).write.parquet(f"{path}/batch=left/source_country=PT/year=2025/month=01")
    assert scans.silver(spark, str(tmp_path / "silver"), "ted", schemas.SILVER_SCHEMA).count() == 9
    more = silver_plan.load_silver(records(spark, range(20, 22)), path, order, "2025-01-10", "x")
    assert sum(r["records"] for r in more.collect()) == 2
    assert gold_plan._listed(spark, str(tmp_path / "silver")).where(F.col("path").contains("batch=left")).count() == 0


def test_table_without_a_log_gets_one(spark, tmp_path):
    path, order = str(tmp_path / "silver"), [F.col("tender_id")]
    records(spark, range(3)).drop("source_country").write.parquet(f"{path}/batch=old/source_country=PT/year=2025/month=01")
    assert silver_plan.load_silver(records(spark, range(5)), path, order, "2025-01-10", "x").agg(F.sum("records")).first()[0] >= 2
    assert [b for _, b in commits.entries(spark, path)][0] == "old"
    assert commits.claim(spark, path, 1, "late") is False


def _scanned(df, metric="numOutputRows"):
    """A figure of the file scan of a query, once it has run: rows that it gave."""
    df.collect()
    open_, rows = [df._jdf.queryExecution().executedPlan()], None
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            rows = node.metrics().apply(metric).value()
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_questions_skip_row_groups(spark, tmp_path):
    """High values and ids are found without decoding the row groups that can't hold them."""
    path = str(tmp_path / "gold")
    gold = records(spark, range(20_000)).withColumn("year", F.lit(2025))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        writers.write_gold(gold.orderBy(F.rand(3)), path)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    stored = scans.gold(spark, path)
    high = stored.where("tender_value_amount > 19000").select("ocid", "tender_value_amount")
    assert 0 < _scanned(high) < 12_000 and high.count() == 999
    one = stored.where("ocid = 'ocds-77777'").select("tender_id")
    assert _scanned(one) == 0


def _stream_rows(numbers):
    def transform(batch):
        return batch.select("id", F.md5(F.col("id").cast("string")).alias("record_hash"))

    return transform


def test_micro_batch_reads_only_its_buckets(spark, tmp_path):
    """A batch of three hashes opens the ledger files of their buckets; a target without a ledger gets one first."""
    source, target = tmp_path / "in", str(tmp_path / "target")
    source.mkdir()

    def run(name, numbers, checkpoint):
        spark.createDataFrame([(n,) for n in numbers], "id long").coalesce(1).write.json(str(source / name))
        stream = incremental.file_stream(spark, str(source), "id long", "json", recursiveFileLookup=True)
        incremental.write_once(stream, target, str(tmp_path / checkpoint), [F.col("id")], _stream_rows(numbers)).awaitTermination()
        return sorted(r["id"] for r in spark.read.schema("id long").option("recursiveFileLookup", True).parquet(target).collect())

    assert run("a", range(2000), "c") == list(range(2000))
    ledger = incremental.hash_ledger(spark, target)
    assert ledger.count() == 2000 and ledger.select("bucket").distinct().count() == incremental.BUCKETS
    few = spark.createDataFrame([("x",), ("y",), ("z",)], "record_hash string")
    seen = incremental.seen_hashes(spark, target, few, "another", 0)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert _scanned(seen, "numPartitions") <= 3
    # rows that came before again, and new ones
    assert run("b", [5, 6, 2000, 2001], "c") == list(range(2002))
    # the checkpoint is lost: all files come again, nothing is stored twice
    assert run("c", [2002], "d") == list(range(2003))
    # a batch that was stored without its hashes being noted: the next run notes them
    lost = tmp_path / "target_hashes"
    for done in (lost / "_noted").iterdir():
        done.unlink()
    for bucket in lost.glob("bucket=*"):
        for file in bucket.iterdir():
            file.unlink()
    assert run("d", [2003, 7], "e") == list(range(2004))
    before = len(list(lost.glob("bucket=*/*.parquet")))
    incremental.compact_hashes(spark, target)
    assert incremental.hash_ledger(spark, target).select("record_hash").distinct().count() == 2004
    assert len(list(lost.glob("bucket=*/*.parquet"))) < before
    assert run("e", [2003, 2004], "f") == list(range(2005))


def test_unchanged_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(name)
    listing = lambda: scans.file_listing(spark, str(folder), "*.txt")
    empty = spark.createDataFrame([], "key string, md5_hash string, size_bytes bigint, modified timestamp, timestamp string")
    first = incremental.changed_digests(listing(), empty)
    assert first.count() == 3
    ledger = spark.createDataFrame(first.withColumn("timestamp", F.lit("1")).collect(), empty.schema)
    assert incremental.changed_digests(listing(), ledger).count() == 0
    assert "content" not in incremental.changed_since(listing(), ledger)._jdf.queryExecution().executedPlan().toString()
    (folder / "a.txt").write_text("longer")  # another size
    os.utime(folder / "b.txt", (1, 1))  # another time, the same content
    (folder / "d.txt").write_text("d")
    assert {k.rsplit("/", 1)[1] for (k,) in incremental.changed_since(listing(), ledger).select("key").collect()} == {"a.txt", "b.txt", "d.txt"}
    os.chmod(folder / "c.txt", 0)  # must not be read
    changed = {r["key"].rsplit("/", 1)[1]: r["md5_hash"] for r in incremental.changed_digests(listing(), ledger).collect()}
    assert changed == {"a.txt": hashlib.md5(b"longer").hexdigest(), "d.txt": hashlib.md5(b"d").hexdigest()}
