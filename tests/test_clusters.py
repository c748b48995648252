"""Queries on the master of a cluster whose checkpoint folder is a mount of each machine, against their SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402
from procurelake.catalog import tenders  # noqa: E402

# findings of the round in their order
NAMES = (
    "bronze_days",
    "bronze_files_per_country",
    "bronze_license",
    "category_analysis",
    "changed_files",
    "column_profile",
    "contract_files_to_silver",
    "country_summary",
    "dataset_summary",
    "envelope_lines_to_silver",
    "envelope_objects_to_silver",
    "envelopes_to_silver",
    "export_csv",
    "export_csv_arrays",
    "export_json",
    "file_stats",
    "gold_build",
    "gold_coverage",
    "gold_dedup_report",
    "gold_overview",
    "gold_refresh",
    "gold_reports",
)
ROWS = {
    "nation": "SELECT CAST(i AS INTEGER) AS n_nationkey, 'NATION ' || i AS n_name, 0 AS n_regionkey FROM range(25) t(i)",
    "customer": """SELECT i AS c_custkey, 'Customer ' || i AS c_name, CAST(i % 25 AS INTEGER) AS c_nationkey, i * 1.5e0 AS c_acctbal,
      'SEGMENT' AS c_mktsegment FROM range(30) t(i)""",
    "supplier": "SELECT i AS s_suppkey, 'Supplier ' || i AS s_name, CAST(i % 25 AS INTEGER) AS s_nationkey, 2.5e0 AS s_acctbal FROM range(8) t(i)",
    "orders": """SELECT i AS o_orderkey, i % 30 AS o_custkey, CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS o_orderstatus, 100.25e0 * (i % 40) AS o_totalprice,
      TIMESTAMP '1996-01-10' + INTERVAL 1 DAY * (i % 20) AS o_orderdate, CASE WHEN i % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority
      FROM range(120) t(i)""",
    "lineitem": """SELECT i % 110 AS l_orderkey, i % 5 AS l_partkey, i % 8 AS l_suppkey, CAST(i // 110 AS INTEGER) AS l_linenumber, 1.0e0 AS l_quantity,
      10.5e0 * (i % 9 + 1) AS l_extendedprice, 0.05e0 AS l_discount, 0.0e0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus,
      TIMESTAMP '1996-03-01' + INTERVAL 1 DAY * (i % 30) AS l_shipdate FROM range(250) t(i)""",
    "events": """SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * i AS ts, i % 7 AS user_id,
      CASE i % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS event_type, i * 0.5e0 AS value, '{"k": ' || i % 4 || '}' AS props
      FROM range(90) t(i)""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, sql in ROWS.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{path}/{name}.parquet'")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster_with_a_mount(spark, folder, monkeypatch, tmp_path, name):
    kind = type(spark.conf)
    told = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": f"file://{tmp_path}"}
    monkeypatch.setattr(kind, "get", lambda self, key, *rest, get=kind.get: told[key] if key in told else get(self, key, *rest))
    monkeypatch.setattr(tenders, "_STORED", {})
    assert check.compare(entry.queries()[name](spark, folder), check.connect(folder), entry.oracle_sql()[name]) == ""
    assert any(tmp_path.iterdir())
