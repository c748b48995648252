"""Cleaning expressions, branch by branch."""

import hashlib

import pytest
from pyspark.sql import functions as F

from procurelake.functions import dates, keys, lookups, text


def apply(spark, values, build, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


DATES = [
    ("2025-01-15", "2025-01-15"),
    ("2025-1-5", "2025-01-05"),
    ("2025-01-15T10:30:00", "2025-01-15"),
    ("2025-01-15T10:30:00Z", "2025-01-15"),
    ("2025-01-15T10:30:00+01:00", "2025-01-15"),
    ("2025-01-15T10:30:00.123456", "2025-01-15"),
    ("2025-01-15T10:30:00.1234567", None),
    ("2025-07-14 16:31:02.112T12:00:00Z", "2025-07-14"),
    ("2025-01-15-05:00", "2025-01-15"),
    ("Z2025-01-15", "2025-01-15"),
    ("2025-02-30", None),
    ("2024-02-29", "2024-02-29"),
    ("2025-13-01", None),
    ("2025-01-15T24:00:00", None),
    ("2025-01-15T10:30", None),
    ("15/01/2025", None),
    ("2025", None),
    ("2025-01", None),
    ("2025-01-1 ", None),
    (" 2025-01-1", None),
    ("2025-01-1T", None),
    ("0000-01-01", None),
    ("30 dias", None),
    ("", None),
    (None, None),
]


def test_clean_date(spark):
    assert apply(spark, [d for d, _ in DATES], dates.clean_date) == [e for _, e in DATES]


def test_durations_are_no_dates(spark):
    values = ["2025-01-15", "30 dias", "1 DIA", None]
    assert apply(spark, values, dates.clean_date_or_duration) == ["2025-01-15", None, None, None]


def test_placeholders_and_parts(spark):
    assert apply(spark, ["1900-01-01", "1970-01-01", "2025-01-02"], dates.drop_placeholder) == [None, None, "2025-01-02"]
    pair = lambda c: F.concat_ws("/", *dates.year_month(c))
    assert apply(spark, ["2025-01-02", "", None, "x"], pair) == [
        "2025/01", "unknown/unknown", "unknown/unknown", "unknown/unknown",
    ]


@pytest.mark.parametrize(
    "day,flag",
    [(None, "missing"), ("1999-12-31", "past"), ("2000-01-01", "valid"), ("2030-12-31", "valid"), ("2031-01-01", "future"),
     ("0202-05-01", "missing")],
)
def test_quality_flag(spark, day, flag):
    build = lambda c: dates.quality_flag(dates.gold_day(c), "2000-01-01", "2030-12-31")
    assert apply(spark, [day], build) == [flag]


def test_clean_string(spark):
    values = [
        "  a\t b  c \n", "plain", "a  b", "\x1fa", "\xa0\u00e9\u2003\u3000\u00e8\u2028", "e\xa0f", None, "", " ",
    ]
    expected = [" ".join(v.split()) if v is not None else "" for v in values]
    assert apply(spark, values, text.clean_string) == expected


def test_clean_id_strips_only(spark):
    assert apply(spark, [" a  b ", " x\t", None], text.clean_id) == ["a  b", "x", ""]


def test_amounts(spark):
    values = ["1.5", "abc", "-5", None, "", " 12 ", "1e3", "1.0d", "0x10", "1,5", "inf", "5.", ".5", "nan"]
    assert apply(spark, values, text.clean_amount) == [
        1.5, 0.0, -5.0, 0.0, 0.0, 12.0, 1000.0, 0.0, 0.0, 0.0, float("inf"), 5.0, 0.5, 0.0,
    ]
    assert apply(spark, [1.5, float("nan"), None], text.clean_number, "v double") == [1.5, 0.0, 0.0]
    euros = ["1000,50 €", "1.234,56", "12", None, "€ 7"]
    assert apply(spark, euros, text.parse_eu_amount) == [1000.5, 0.0, 12.0, 0.0, 7.0]
    assert apply(spark, ["7", "7.0", "x", None], text.clean_count) == [7, 0, 0, 0]


def test_currency(spark):
    values = [" eur ", "EURO", "gbp", "€", "e1r", None, "", " usd"]
    assert apply(spark, values, text.clean_currency) == ["EUR", "", "GBP", "", "", "", "", "USD"]
    named = lambda c: text.clean_currency(text.currency_from_symbol(c))
    assert apply(spark, ["€", " £", "$", "chf"], named) == ["EUR", "GBP", "USD", "CHF"]


def test_entities_are_decoded_once(spark):
    assert apply(spark, ["&amp;lt; &quot;a&quot; &lt;"], text.decode_entities) == ['&lt; "a" <']


def test_party(spark):
    values = ["500 - Câmara X", "no separator", "1 - A - B", " - C", None, ""]
    found = [tuple(p) for p in apply(spark, values, text.party)]
    assert found == [("500", "Câmara X"), ("", "no separator"), ("1", "A - B"), ("", "C"), ("", ""), ("", "")]


def test_party_list(spark):
    found = apply(spark, ["1 - A; 2 - B", "A", "; ;3 - C", "4 - ", None], text.party_list)
    assert [[tuple(p) for p in entry] for entry in found] == [
        [("1", "A"), ("2", "B")], [("", "A")], [("3", "C")], [], [],
    ]


def test_record_hash_spells_out_nulls(spark):
    row = spark.createDataFrame([("ocds-1", None, "2025-01-01", "")], "ocid string, tender_id string, publication_date string, buyer_name string")
    expected = hashlib.md5(b"ocds-1|None|2025-01-01|").hexdigest()
    assert row.select(keys.record_hash()).first()[0] == expected


def test_countries_and_categories(spark):
    values = ["PT", " ES ", "GB", "united_kingdom", "Portugal", "LTu", "Wonderland", None, ""]
    assert apply(spark, values, lookups.standard_country) == [
        "portugal", "spain", "uk", "uk", "portugal", "lithuania", "wonderland", "none", "",
    ]
    values = ["Aquisição de serviços", "Radovi", "supplies", "Works", "", None]
    assert apply(spark, values, lookups.standard_category) == ["services", "works", "goods", "", "", ""]


def test_notice_country_tiers(spark):
    rows = [
        ("DEU", None, None, None, "germany"),
        ("XYZ", "Portugal, Aveiro", None, None, "xyz"),
        (None, "Portugal, Aveiro, Espinho", None, None, "portugal"),
        (None, "Lisboa, Portugal", None, None, "portugal"),
        ("", "Paris, France", "x BASE.gov.pt x", None, "portugal"),
        (None, None, "TED", "CÂMARA Municipal", "portugal"),
        (None, None, None, "Stadt Wien", "unknown"),
        (None, None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "code string, place string, origin string, buyer string, expected string")
    found = df.select("expected", lookups.notice_country(F.col("code"), F.col("place"), F.col("origin"), F.col("buyer")))
    assert all(a == b for a, b in found.collect())
