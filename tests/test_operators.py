"""Operators against brute force on small frames."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.operators import aggregates, cleaning, dedup, enrich, profile, quality, relational, validation
from procurelake.operators.median import exact_median


def test_exact_median_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for key in "abcde":
        for _ in range(rng.choice([1, 2, 7, 200, 501])):
            value = rng.choice([0.0, -3.5, 1e-9, 1e12, rng.uniform(-100, 100), round(rng.lognormvariate(8, 3), 2)])
            rows.append((key, value))
    # One group holds most rows and most of them are one value.
    rows += [("hot", 42.0)] * 3000 + [("hot", float(i)) for i in range(500)] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    found = {r["k"]: r["median"] for r in exact_median(df, ["k"], F.col("v")).collect()}
    for key in {k for k, _ in rows}:
        present = [v for k, v in rows if k == key and v is not None and v == v]
        assert found[key] == pytest.approx(statistics.median(present), rel=1e-15)


def test_median_of_infinite_values(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("inf"))], "k string, v double")
    assert exact_median(df, ["k"], F.col("v")).first()["median"] == float("inf")


def test_keep_first_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None, "x", 2), (None, "x", 1), ("a", None, 3), ("a", None, 4)], "a string, b string, n int")
    kept = dedup.keep_first(df, ["a", "b"], [F.col("n")])
    assert sorted(r["n"] for r in kept.collect()) == [1, 3]


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = dedup.keep_first(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


RECORDS = [
    ("h1", 1, "2025-01-02"), ("h1", 2, "2025-01-02"), ("h1", 3, "2025-01-01"), ("h2", 4, None), ("h3", 5, "x"),
    ("h3", 6, "y"), (None, 7, "z"), (None, 8, "z"), ("", 9, "z"),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(RECORDS, "record_hash string, seq int, processing_timestamp string")


def test_mark_latest_takes_the_last_of_ties(records):
    found = {r["seq"] for r in dedup.mark_latest(records, "seq").where("is_latest").collect()}
    assert found == {2, 4, 6, 8, 9}
    assert dedup.mark_latest(records, "seq").count() == len(RECORDS)


def test_unique_and_new_records(spark, records):
    order = [F.col("seq")]
    assert {r["seq"] for r in dedup.unique_records(records, order).collect()} == {1, 4, 5}
    seen = spark.createDataFrame([("h2",), ("h9",), (None,)], "record_hash string")
    assert {r["seq"] for r in dedup.new_records(records, seen, order).collect()} == {1, 5, 7, 8, 9}
    stats = dedup.new_records_stats(records, seen, order).first()
    assert (stats["total_input"], stats["new_records"], stats["duplicates_skipped"]) == (9, 5, 4)


def test_duplicate_members(records):
    found = sorted((r["seq"], r["occurrences"]) for r in dedup.duplicate_members(records).collect())
    assert found == [(1, 3), (2, 3), (3, 3), (5, 2), (6, 2)]


def test_duplicate_summary_and_report(records):
    row = dedup.duplicate_summary(records).first()
    sizes = Counter(("without", n) if h is None else h for n, (h, _, _) in enumerate(RECORDS))  # a record without a hash stands alone
    assert row["unique_hashes"] == len(sizes)
    assert row["duplicate_records"] == sum(n - 1 for n in sizes.values() if n > 1)
    assert row["deduplication_rate"] == pytest.approx(1 - len(sizes) / len(RECORDS))
    report = dedup.duplicate_report(records, [F.col("seq")], groups=1, members=2).collect()
    assert sorted((r["record_hash"], r["seq"]) for r in report) == [("h1", 1), ("h1", 2)]
    empty = dedup.duplicate_summary(records.limit(0)).first()
    assert (empty["total_records"], empty["deduplication_rate"]) == (0, 0.0)


def test_validation_reasons(spark):
    rows = [("ocds-1", "2025-01-01"), ("", "2025-01-01"), ("bad-1", "2025-01-01"), ("ocds-2", None), (None, None)]
    df = spark.createDataFrame(rows, "ocid string, publication_date string")
    assert validation.accepted(df).count() == 1
    reasons = [r["reject_reason"] for r in validation.rejected(df).orderBy("ocid").collect()]
    assert sorted(reasons) == ["invalid ocid", "missing ocid", "missing ocid", "missing publication_date"]


def _tender(**values):
    base = {
        "ocid": "ocds-1", "publication_date": "2025-01-10", "tender_title": "t", "buyer_name": "b", "source_country": "PT",
        "tender_value_amount": 10.0, "procurement_category": "works", "procurement_method": "open", "tender_status": "on",
        "award_amount": 0.0, "source_publication_id": "p",
    }
    return base | values


TENDER = (
    "ocid string, publication_date string, tender_title string, buyer_name string, source_country string, "
    "tender_value_amount double, procurement_category string, procurement_method string, tender_status string, "
    "award_amount double, source_publication_id string"
)


def _frame(spark, rows, schema=TENDER):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.mark.parametrize(
    "values,score",
    [
        ({}, 1.0),
        ({"tender_value_amount": 0.0}, 6.5 / 7),
        ({"tender_title": None}, 6.0 / 7),
        ({"tender_value_amount": None, "procurement_category": "", "procurement_method": None, "tender_status": ""}, 5.0 / 7),
        ({"tender_value_amount": -1.0}, 6.5 / 7),
    ],
)
def test_completeness_score(spark, values, score):
    row = enrich.enrich(_frame(spark, [_tender(**values)]), "2025-01-10").first()
    assert row["data_completeness_score"] == pytest.approx(score, abs=1e-15)


def test_enrich_never_gives_null_flags(spark):
    rows = [
        _tender(publication_date=None, tender_value_amount=float("nan"), award_amount=None, source_country=None),
        _tender(publication_date="2025-01-11", award_amount=1.0),
    ]
    first, second = sorted(enrich.enrich(_frame(spark, rows), "2025-01-10").collect(), key=lambda r: r["year"])
    assert (first["year"], first["month"], first["quarter"], first["date_quality_flag"]) == (0, 0, 0, "missing")
    assert (first["has_value"], first["has_award"], first["is_future_date"], first["source_country"]) == (False, False, False, "none")
    assert (second["year"], second["quarter"], second["has_award"], second["is_future_date"]) == (2025, 1, True, True)


def test_unify_keeps_every_row_and_dates_as_text(spark):
    left = _frame(spark, [_tender()])
    right = spark.sql("SELECT 'ocds-2' ocid, TIMESTAMP_NTZ'2025-02-03 10:00:00' publication_date, 'x' buyer_type")
    whole = enrich.unify({"ocp": left, "partner": right})
    assert whole.count() == 2
    row = whole.where("source = 'partner'").first()
    assert (row["publication_date"], row["buyer_type"], row["tender_title"]) == ("2025-02-03", "x", None)


def test_duplicates_follow_source_order_or_score(spark):
    rows = [
        (_tender(tender_title=None, tender_status="first"), "ocp", 1),
        (_tender(tender_status="second"), "ted", 2),
    ]
    df = None
    for values, tag, seq in rows:
        part = _frame(spark, [values]).withColumns({"source": F.lit(tag), "seq": F.lit(seq)})
        df = part if df is None else df.unionByName(part)
    by_source = enrich.to_gold(df, "2025-01-10", [F.col("seq")]).first()
    by_score = enrich.to_gold(df, "2025-01-10", [F.col("seq")], by="completeness").first()
    assert (by_source["tender_status"], by_score["tender_status"]) == ("first", "second")


def test_aggregates_on_gold(spark):
    rows = [
        _tender(ocid=f"ocds-{i}", buyer_name="" if i == 0 else f"b{i % 2}", tender_value_amount=float(i) if i else None)
        for i in range(5)
    ]
    gold = enrich.enrich(_frame(spark, rows), "2025-01-10").withColumn(
        "supplier_names", F.when(F.col("ocid") != "ocds-1", F.array(F.lit("s1"), F.col("ocid")))
    )
    summary = aggregates.country_summary(gold).first()
    assert (summary["total_records"], summary["total_value_sum"], summary["avg_value"]) == (5, 10.0, 2.5)
    assert (summary["median_value"], summary["num_buyers"], summary["num_suppliers"]) == (2.5, 3, 5)
    assert sum(r["total_records"] for r in aggregates.category_analysis(gold).collect()) == 5
    top = aggregates.top_suppliers(gold, 1).first()
    assert (top["supplier_name"], top["total_records"], top["total_value"]) == ("s1", 4, 9.0)
    assert [r["buyer_name"] for r in aggregates.top_buyers(gold).collect()] == ["b0", "b1"]


def test_all_null_sum_is_zero(spark):
    gold = enrich.enrich(_frame(spark, [_tender(tender_value_amount=None)]), "2025-01-10")
    row = aggregates.category_analysis(gold).first()
    assert (row["total_value"], row["avg_value"]) == (0.0, None)


def test_huge_amounts_are_not_lost(spark):
    rows = [_tender(ocid="ocds-a", tender_value_amount=1e36), _tender(ocid="ocds-b", tender_value_amount=2e36)]
    row = aggregates.category_analysis(enrich.enrich(_frame(spark, rows), "2025-01-10")).first()
    assert row["total_value"] == pytest.approx(3e36)


def test_clean_record_fills_absent_columns(spark):
    df = spark.createDataFrame([(" a ", "12", None, "x")], "ocid string, num_lots string, supplier_ids array<string>, document_urls string")
    row = cleaning.clean_record(df).first()
    assert row.__fields__ == schemas.SILVER_COLUMNS
    assert (row["ocid"], row["num_lots"], row["supplier_ids"], row["document_urls"]) == ("a", 12, [], ["x"])
    assert (row["publication_date"], row["award_amount"], row["tender_title"]) == (None, 0.0, "")


QUALITY = (
    "ocid string, publication_date string, tender_start_date string, tender_end_date string, award_date string, "
    "tender_value_amount string, award_amount double, tender_value_currency string, award_currency string, "
    "supplier_ids array<string>, num_lots bigint"
)
QUALITY_ROWS = [
    ("ocds-1", "2025-01-10", "2025-01-01", "2025-02-01", "2025-01-20", "5.5", 1.0, "EUR", "EUR", ["a"], 1),
    ("bad-2", "2027-01-10", "2025-03-01", "2025-02-01", "2024-01-20", "abc", -1.0, "EURO", "12", [None], -1),
    ("", None, None, "", None, None, None, "", None, None, None),
]


def test_quality_counters(spark):
    df = spark.createDataFrame(QUALITY_ROWS, QUALITY)
    schema = {n.split()[0]: schemas.SILVER_CHECK_TYPES[n.split()[0]] for n in QUALITY.split(", ")}
    fields = {r["field"]: r for r in quality.field_report(df, "2025-01-10", schema=schema).collect()}
    counts = lambda n: tuple(fields[n][k] for k in ("null_count", "empty_count", "type_mismatches", "out_of_range", "passed"))
    assert counts("ocid") == (0, 1, 0, 0, False)
    assert counts("publication_date") == (1, 0, 0, 1, False)
    assert counts("tender_end_date") == (0, 1, 0, 0, True)
    assert counts("tender_value_amount") == (1, 0, 1, 1, False)
    assert counts("award_amount") == (1, 0, 0, 1, False)
    assert counts("supplier_ids") == (1, 0, 1, 0, False)
    assert counts("num_lots") == (1, 0, 0, 1, False)
    rules = {r["rule"]: r["violations"] for r in quality.rule_report(df).collect()}
    assert rules == {
        "invalid_ocid_format": 1, "invalid_currency_code": 2, "end_date_before_start_date": 1,
        "award_date_before_tender_date": 1, "negative_amounts": 1,
    }
    row = quality.summary_report(df, "2025-01-10", schema=schema).first()
    assert (row["validation_passed"], row["validation_failed"], row["quality_check_passed"]) == (1, 2, False)
    assert row["completeness_score"] == pytest.approx(22 / 33)
    assert row["warnings"][0] == "Low completeness score: 66.67% (minimum: 80.00%)"
    assert row["warnings"][1] == "High failure rate: 66.67% (maximum: 15.00%)"
    full = quality.full_report(df, "2025-01-10", "s", schema=schema).first()
    assert full["total_business_violations"] == 6 and len(full["fields"]) == len(schema)


def test_quality_of_nothing_fails(spark):
    row = quality.summary_report(spark.createDataFrame([], QUALITY), "2025-01-10").first()
    assert (row["total_records"], row["quality_check_passed"], row["warnings"]) == (0, False, ["No records to validate"])


def test_score_buckets_add_up(spark):
    rows = [_tender(ocid=f"ocds-{i}", tender_title=None if i % 2 else "t", tender_status=None if i % 3 else "s") for i in range(9)]
    report = {r["metric"]: r["value"] for r in quality.validation_report(enrich.enrich(_frame(spark, rows), "2025-01-10")).collect()}
    assert sum(report[b] for b in (quality.EXCELLENT, quality.GOOD, quality.FAIR, quality.POOR)) == report["total_records"] == 9


def test_column_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (2, "a", False), (None, None, None), (4, "b", True)], "n int, s string, b boolean"
    )
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (rows["n"]["null_count"], rows["n"]["null_percentage"], rows["n"]["median"]) == (1, 25.0, 2.0)
    assert rows["n"]["std"] == pytest.approx(statistics.stdev([1, 2, 4]))
    assert rows["b"]["mean"] == pytest.approx(2 / 3)
    assert (rows["s"]["unique_count"], [tuple(v) for v in rows["s"]["top_values"]]) == (2, [(1, "a", 2), (2, "b", 1)])
    single = profile.basic_profile(df.limit(1)).where("column = 'n'").first()
    assert single["std"] == 0.0


def test_caps_and_summaries(spark):
    df = spark.range(150).withColumn("s", F.col("id").cast("string"))
    rows = profile.capped(df, 100).collect()
    assert (len(rows), {r["truncated"] for r in rows}) == (100, {True})
    assert {r["truncated"] for r in profile.capped(df, 150).collect()} == {False}
    summary = profile.summarize(df)
    assert summary["total_rows"].first()[0] == 150
    assert summary["unique_counts"].first()["unique_count"] == 150
    samples = profile.table_samples(df.withColumn("late", F.when(F.col("id") > 120, "x")), [F.col("id")]).where("column = 'late'")
    assert [r["sample"] for r in samples.collect()] == ["x"]


# ------------------------------------------------------- relational extract
def _tables(spark):
    tender = lambda i, title, price, day: (i, title, "s", price, day, None, "open", "works", "cpv", None)
    import datetime as dt

    day = dt.datetime(2025, 1, 2)
    schema = schemas.RELATIONAL_SCHEMAS
    return {
        "tenders": spark.createDataFrame(
            [tender("1", "two lots", 5.0, day), tender("2", "none", 7.0, day), tender("3", None, 1.0, day),
             tender("4", "two buyers", 2.0, day), tender("5", "no day", 2.0, None)], schema["tenders"]
        ),
        "buyers": spark.createDataFrame([("b1", "B1", "t"), ("b2", "B2", "t")], schema["buyers"]),
        "lots": spark.createDataFrame(
            [("l1", "open", 1.0, "c1", 11.0), ("l2", "shut", 2.0, "c2", 22.0)], schema["lots"]
        ),
        "tender_buyer": spark.createDataFrame([("1", "b1"), ("4", "b2"), ("4", "b1")], schema["tender_buyer"]),
        "tender_lot": spark.createDataFrame([("1", "l2"), ("1", "l1")], schema["tender_lot"]).withColumn(
            "_lot_row", F.when(F.col("lot_id") == "l2", 0).otherwise(1)
        ),
    }


def test_relational_merge(spark):
    tables = _tables(spark)
    rows = {
        r["tender_id"]: r
        for r in relational.transform(tables, order=[F.col("buyer_id")], lot_order=[F.col("_lot_row")]).collect()
    }
    assert set(rows) == {"1", "2", "4"}
    assert (rows["1"]["tender_status"], rows["1"]["tender_value_amount"], rows["1"]["buyer_name"]) == ("shut", 22.0, "B1")
    assert (rows["2"]["tender_value_amount"], rows["2"]["buyer_id"], rows["2"]["cpv_code"]) == (0.0, None, "cpv")
    assert (rows["4"]["buyer_id"], rows["4"]["ocid"], rows["4"]["source_country"]) == ("b1", "ocds-partner-4", "PT")


def test_relational_fallbacks_follow_columns_not_cells(spark):
    tables = _tables(spark) | {"lots": None, "buyers": None}
    rows = {r["tender_id"]: r for r in relational.transform(tables, order=[F.col("tender_id")]).collect()}
    assert (rows["2"]["tender_value_amount"], rows["2"]["tender_status"], rows["2"]["buyer_name"]) == (7.0, "ANNOUNCED", None)


def test_median_of_close_and_of_equal_values(spark):
    """Large numbers in sequence, one repeated price, and a few far ones; no ordered slice is large."""
    rnd = random.Random(3)
    values = {"ids": [1_000_000_000 + i for i in range(20_001)], "price": [9.99] * 5000 + [1.0], "two": [1e9, 1e9 + 1], "mixed": [rnd.gauss(0, 1e6) for _ in range(4000)] + [1e300]}
    rows = [(k, float(v)) for k, many in values.items() for v in many]
    got = {r["k"]: r["median"] for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v")).collect()}
    assert got == {k: statistics.median(many) for k, many in values.items()}
