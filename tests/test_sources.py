"""Scans, mappings and writers on fixture files."""

import datetime as dt
import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.functions import paths
from procurelake.operators import mapping, notices, validation
from procurelake.sinks import writers
from procurelake.sources import contracts, scans

STAMP = "2025-01-01T00:00:00Z"


def release(**changes):
    base = {
        "ocid": "ocds-1", "id": "r1", "date": "2025-01-15T10:30:00Z",
        "tender": {
            "id": "t1", "title": " A\t\xa0title ", "status": "active", "value": {"amount": 12.5, "currency": " eur "},
            "tenderPeriod": {"startDate": "2025-01-01", "endDate": "2025-02-01"}, "procurementMethod": "open",
            "mainProcurementCategory": "works", "lots": [{"id": "1"}, {"id": "2"}, {"id": "3"}],
            "documents": [{"url": "http://d/1"}, {"url": None}],
        },
        "buyer": {"id": "b1", "name": "Buyer"},
        "awards": [
            {"id": "a1", "date": "2025-03-01", "value": {"amount": 9.0, "currency": "EUR"},
             "suppliers": [{"id": "s1", "name": "S1"}, {"name": "S2"}]},
            {"id": "a2", "suppliers": [{"id": "s3", "name": "S3"}]},
        ],
    }
    return base | changes


KOSOVO = {
    "ocid": "ocds-k", "date": "2025-01-15",
    "tender": {
        "id": "k1", "procuringEntity": {"party": {"id": "kb", "name": "Komuna"}},
        "tenderers": [{"id": "1"}, {"id": "2"}],
    },
    "award": [{"date": "2025-02-02", "value": {"amount": "7", "currency": "EUR"},
               "suppliers": [{"party": {"id": "x", "name": "X"}}, {"party": {"id": None, "name": "Y"}}]}],
}


@pytest.fixture
def bronze(tmp_path):
    root = tmp_path / "open_contracting_partnership"
    for country, records in {
        "uk": [release(), release(ocid="bad", awards=None), release(ocid="ocds-2", date=None)],
        "kosovo": [KOSOVO],
        "atlantis": [release()],
    }.items():
        folder = root / country / "2025" / "01" / "15"
        folder.mkdir(parents=True)
        body = {"records": records, "count": len(records), "country": country, "publication_date": "2025-01-15"}
        (folder / "records_20250115.json").write_text(json.dumps(body, indent=2), encoding="utf-8")
        (folder / "extraction_state.json").write_text("{}", encoding="utf-8")
    return str(root)


def test_envelopes_to_silver(spark, bronze):
    raw = scans.envelopes(spark, bronze, "open_contracting_partnership")
    assert {r["country"]: r["n"] for r in raw.groupBy("country").agg(F.count("*").alias("n")).collect()} == {
        "uk": 3, "kosovo": 1, "atlantis": 1,
    }
    mapped = mapping.map_releases(raw, processed_at=STAMP)
    assert mapped.columns == schemas.SILVER_COLUMNS
    rows = {(r["source_country"], r["ocid"]): r for r in mapped.collect()}
    assert len(rows) == 4  # no mapping, no rows
    uk = rows["uk", "ocds-1"]
    assert (uk["tender_title"], uk["tender_value_amount"], uk["tender_value_currency"]) == ("A title", 12.5, "EUR")
    assert (uk["supplier_ids"], uk["supplier_names"]) == (["s1"], ["S1", "S2"])
    assert (uk["num_lots"], uk["num_awards"], uk["num_tenderers"], uk["document_urls"]) == (3, 2, 0, ["http://d/1"])
    assert (rows["uk", "bad"]["num_awards"], rows["uk", "bad"]["award_amount"], rows["uk", "bad"]["award_date"]) == (0, 0.0, None)
    kosovo = rows["kosovo", "ocds-k"]
    assert (kosovo["buyer_name"], kosovo["supplier_names"], kosovo["supplier_ids"]) == ("Komuna", ["X", "Y"], ["x"])
    assert (kosovo["award_amount"], kosovo["num_tenderers"], kosovo["num_awards"], kosovo["tender_title"]) == (7.0, 2, 1, "")
    kept = validation.accepted(mapped)
    assert {r["ocid"] for r in kept.collect()} == {"ocds-1", "ocds-k"}


def test_envelopes_read_only_mapped_leaves(spark, bronze):
    plan = mapping.map_releases(scans.envelopes(spark, bronze, "open_contracting_partnership"), processed_at=STAMP)
    assert "PythonUDF" not in plan._jdf.queryExecution().executedPlan().toString()


def test_no_generated_method_is_too_long_for_the_jvm_to_compile(spark):
    schema = schemas.RELEASE_SCHEMA
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = mapping.map_releases(spark.range(3).select(F.from_json(F.lit("{}"), schema).alias("r"), F.lit("uk").alias("country")).repartition(2).select("r.*", "country"), processed_at=STAMP)
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        text = debug.codegenString(plan._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


def test_first_filled_alternative(spark):
    df = spark.read.schema("a array<struct<v:bigint,w:array<struct<v:string>>>>, b array<string>").json(
        spark.sparkContext.parallelize(['{"a": [{"v": 1}, null, {"v": null, "w": [{"v": "x"}, {}]}], "b": ["p", null]}', '{"a": [], "b": ["p"]}', '{"a": [{"v": null}]}', "{}"])
    )
    pick = lambda *names: [r[0] for r in df.select(mapping._array(df.schema, list(names))).collect()]
    assert pick("a.*.v") == [["1"], [], [], []] and pick("b.*", "a.*.v") == [["p"], ["p"], [], []]
    assert pick("a.*.v", "b.*") == [["1"], ["p"], [], []] and pick("a.*.w.*.v", "b.*") == [["x"], ["p"], [], []]
    assert pick("a.*.none", "c.*") == [[]] * 4


def test_portugal_alternatives(spark):
    row = release(buyer=None, parties=[{"id": "p0", "name": "Party"}])
    row["tender"] = row["tender"] | {"procurement_method": "direct", "numberOfTenderers": 4}
    df = spark.read.schema(schemas.RELEASE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(row)]))
    found = mapping.map_releases(df.withColumn("country", F.lit("Portugal")), processed_at=STAMP).first()
    assert (found["buyer_id"], found["buyer_name"], found["procurement_method"]) == ("p0", "Party", "direct")
    assert (found["supplier_names"], found["num_tenderers"]) == (["S1", "S2", "S3"], 4)


def test_new_country_by_registry(spark):
    registry = mapping.default_registry()
    registry.register("Norway", mapping.STANDARD)
    df = spark.read.schema(schemas.RELEASE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(release())]))
    rows = mapping.map_releases(df.withColumn("country", F.lit("norway")), registry=registry, processed_at=STAMP)
    assert rows.first()["buyer_name"] == "Buyer"


def test_release_lines_keep_rejects(spark, tmp_path):
    lines = [json.dumps(release()), "", '{"ocid": "ocds-9", ', json.dumps(KOSOVO), "   "]
    with gzip.open(tmp_path / "2025.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write("\n".join(lines))
    scan = scans.release_lines(spark, str(tmp_path))
    assert {r["ocid"] for r in scans.good_lines(scan).collect()} == {"ocds-1", "ocds-k"}
    assert [r[scans.BAD_LINE] for r in scans.bad_lines(scan).collect()] == ['{"ocid": "ocds-9", ']
    assert scans.spread(scans.good_lines(scan)).count() == 2


def test_paths(spark):
    df = spark.createDataFrame(
        [([[{"x": 1}]], {"m": "v"}, (("1", "2"),))], "a array<array<map<string,int>>>, m map<string,string>, s struct<p:struct<q:string,r:string>>"
    )
    pick = lambda p: df.select(paths.scalar_path(df.schema, p).column).first()[0]
    assert (pick("a.0.0.x"), pick("a.5.0.x"), pick("m.m"), pick("m.none"), pick("s.p.r")) == (1, None, "v", None, "2")
    assert paths.scalar_path(df.schema, "s.none") is None and paths.scalar_path(df.schema, "none") is None
    assert paths.wildcard_path(df.schema, "s.p") is None
    every = df.select(paths.wildcard_path(df.schema, "s.p.*"), paths.wildcard_path(df.schema, "m.*")).first()
    assert (every[0], every[1]) == (["1", "2"], ["v"])


def test_release_dates_and_years(spark):
    rows = [
        release(), release(date="x", publishedDate="2024-05-05"), release(date=None),
        release(date=None, tender={"datePublished": "2023-01-01"}), release(date=None, tender=None),
    ]
    df = spark.read.schema(schemas.RELEASE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    found = sorted(r["release_date"] for r in validation.releases_with_date(df).collect())
    assert found == ["2023-01-01", "2024-05-05", "2025-01-01", "2025-01-15"]
    assert validation.releases_of_year(df, 2025).count() == 2


def test_bronze_layout_and_counts(spark, tmp_path):
    rows = [release(), release(ocid="ocds-2"), release(date="2024-12-31"), release(date=None, tender=None)]
    df = spark.read.schema(schemas.RELEASE_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    path = str(tmp_path / "bronze")
    counts = writers.write_bronze(df.withColumn("country", F.lit("uk")), path, STAMP)
    assert {r["release_date"]: r["records"] for r in counts.collect()} == {"2025-01-15": 2, "2024-12-31": 1}
    assert list((tmp_path / "bronze" / "country=uk" / "year=2025" / "month=01" / "day=15").glob("*.json"))
    stored = spark.read.json(path)
    assert stored.where("license.portal = 'dados.gov.pt' AND size(license.restrictions) = 2").count() == 3


def test_notices(spark, tmp_path):
    auth = [{"nipc": "500", "name": "Câmara X", "country": None}]
    base = {
        "source_id": "n1", "source": "TED", "contract_object": "o", "contract_price": None, "effective_total_price": 5.0,
        "currency": "eur", "publication_date": None, "contract_date": "2025-01-02", "closing_date": None,
        "execution_deadline": "30 dias", "contract_types": ["services", "goods"], "contracting_authorities": auth,
        "contractors": [{"nipc": "1", "name": "A"}, {"nipc": None, "name": ""}], "source_url": "http://s",
    }
    schema = schemas.NOTICE_SCHEMA
    rows = [tuple((base | c).get(f.name) for f in schema.fields) for c in ({}, {"source_id": "n2", "contract_date": "30 dias"})]
    path = str(tmp_path / "ted")
    spark.createDataFrame(rows, schema).write.parquet(path)
    mapped = {r["tender_id"]: r for r in notices.map_notices(scans.notices(spark, path), processed_at=STAMP).collect()}
    one = mapped["n1"]
    assert (one["ocid"], one["publication_date"], one["tender_end_date"]) == ("ocds-ted-n1", "2025-01-02", None)
    assert (one["tender_value_amount"], one["award_amount"], one["num_awards"], one["supplier_names"]) == (5.0, 5.0, 2, ["A"])
    assert (one["source_country"], one["procurement_category"], one["document_urls"]) == ("portugal", "services", ["http://s"])
    assert mapped["n2"]["publication_date"] is None
    assert notices.transform_notices(scans.notices(spark, path)).count() == 1


def test_contract_rows(spark, tmp_path):
    lines = [
        ",".join(schemas.CONTRACT_COLUMNS),
        '7,,desc,500 - Câmara X,1 - A; 2 - B,"1000,50 €",,2025-01-02,goods,direct',
        '8,title,,No Id,,"1.234,56",3,,goods,direct',
        ",lost,,,,,,,,",
    ]
    (tmp_path / "rows.csv").write_text("\n".join(lines), encoding="utf-8")
    nested = contracts.contracts_to_releases(scans.contract_rows(spark, str(tmp_path)), 2024)
    rows = {r["ocid"]: r for r in nested.collect()}
    assert set(rows) == {"ocds-base-pt-2024-7", "ocds-base-pt-2024-8"}
    seven, eight = rows["ocds-base-pt-2024-7"], rows["ocds-base-pt-2024-8"]
    assert (seven["tender"]["title"], seven["tender"]["value"]["amount"], seven["buyer"]["id"]) == ("desc", "1000.5", "500")
    assert [s["name"] for s in seven["awards"][0]["suppliers"]] == ["A", "B"]
    assert seven["awards"][0]["value"]["amount"] == "1000.5"
    assert (eight["date"], eight["tender"]["value"]["amount"], eight["buyer"]["name"], eight["awards"]) == (
        "2024-01-01", "0.0", "No Id", [],
    )
    silver = mapping.transform_releases(nested.withColumn("country", F.lit("portugal")))
    assert sorted(r["num_awards"] for r in silver.collect()) == [0, 1]


def test_relational_files_may_be_missing(spark, tmp_path):
    day = dt.datetime(2025, 1, 2)
    row = ("1", "t", "s", 5.0, day, None, "open", "works", "cpv", None)
    spark.createDataFrame([row], schemas.RELATIONAL_SCHEMAS["tenders"]).write.parquet(str(tmp_path / "tenders.parquet"))
    tables = scans.relational_tables(spark, str(tmp_path))
    assert [n for n, t in tables.items() if t is not None] == ["tenders"]
    from procurelake.operators import relational

    out = relational.transform(tables, order=[F.col("_tender_row")], keep=("_tender_row",)).drop("_tender_row")
    target = str(tmp_path / "silver")
    writers.write_relational_silver(out, target)
    assert (tmp_path / "silver" / "source_country=PT" / "year=2025" / "month=1").exists()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    writers.export(df, str(tmp_path / "csv"), "csv")
    writers.export(df, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.schema("n int, s string").json(str(tmp_path / "json")).orderBy("n").first()["s"] == "a"
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "x"), "xml")


@pytest.mark.parametrize("indent", [2, None])
def test_envelope_files_are_cut_at_records(spark, tmp_path, indent):
    """Texts that look like borders stay texts, and a file is read by more than one task."""
    records = [release(ocid=f"ocds-{i}", tender={"id": str(i), "title": 'a\n    {\n "ocid": {"ocid": "x"} },\n    {\n' + "x" * (i % 300)}) for i in range(400)]
    folder = tmp_path / "s" / "uk"
    folder.mkdir(parents=True)
    start = scans.RECORD_START if indent else '{"ocid": '
    (folder / "records_1.json").write_text(json.dumps({"records": records, "count": 400}, indent=indent), encoding="utf-8")
    (folder / "records_2.json").write_text(json.dumps({"records": [], "count": 0}, indent=indent), encoding="utf-8")
    (folder / "records_3.json").write_text(json.dumps({"records": records[:1], "count": 1, "note": "end"}, indent=indent), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cut = scans.envelope_records(spark, str(tmp_path / "s"), "s", record_start=start)
        assert cut.where(F.col("source_file").contains("records_1")).rdd.getNumPartitions() > 3
        whole = scans.envelopes(spark, str(tmp_path / "s"), "s")
        columns = [c for c in whole.columns if c != "_row"]
        show = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert scans.bad_lines(cut).count() == 0
        assert show(cut) == show(whole) and cut.count() == 401
        ordered = [r["ocid"] for r in cut.where(F.col("source_file").contains("records_1")).orderBy("_row").select("ocid").collect()]
        assert ordered == [f"ocds-{i}" for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_record_of_an_envelope(spark, tmp_path):
    body = json.dumps({"records": [release(), release(ocid="ocds-2")]}, indent=2).replace('"ocid": "ocds-2"', '"ocid": ocds-2')
    (tmp_path / "records_1.json").write_text(body, encoding="utf-8")
    cut = scans.envelope_records(spark, str(tmp_path), "s", country="uk")
    assert [r["ocid"] for r in scans.good_lines(cut).collect()] == ["ocds-1"]
    assert "ocds-2" in scans.bad_lines(cut).first()[scans.BAD_LINE]


def test_split_lines_counts_both_sides(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(release()), "", "{", "  ", json.dumps(KOSOVO), "no"]), encoding="utf-8")
    good, bad, counts = scans.split_lines(scans.release_lines(spark, str(tmp_path)))
    assert counts == {"good": 2, "bad": 2} and good.count() == 2 and sorted(r[scans.BAD_LINE] for r in bad.collect()) == ["no", "{"]


def test_contract_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('idcontrato,descContrato,adjudicante\n1,"x\n""y"", z",A\n2,,B\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("adjudicante,idcontrato,Extra\nC,3,e\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text('idcontrato,descContrato,adjudicante\n4,q,D\n', encoding="utf-8")
    rows = {r["idcontrato"]: r for r in scans.contract_rows(spark, str(tmp_path)).collect()}
    assert set(rows) == set("1234")
    assert (rows["1"]["descContrato"], rows["1"]["adjudicante"], rows["3"]["adjudicante"]) == ('x\n"y", z', "A", "C")
    assert (rows["3"]["descContrato"], rows["3"]["Extra"], rows["4"]["Extra"], rows["4"]["descContrato"]) == (None, "e", None, "q")
