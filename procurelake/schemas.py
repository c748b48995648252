"""Explicit schemas of every layer; nothing is inferred at scan time."""

from __future__ import annotations

from pyspark.sql import types as T

# The Silver columns in write order, and the roles they play.
SILVER_DATES = ["publication_date", "tender_start_date", "tender_end_date", "award_date"]
SILVER_AMOUNTS = ["tender_value_amount", "award_amount"]
SILVER_CURRENCIES = ["tender_value_currency", "award_currency"]
SILVER_STRINGS = [
    "ocid", "source_country", "source_publication_id", "tender_id", "tender_title",
    "tender_status", "procurement_method", "procurement_category", "buyer_id",
    "buyer_name", "record_hash", "source_file", "processing_timestamp",
]
SILVER_ARRAYS = ["supplier_ids", "supplier_names", "document_urls"]
SILVER_COUNTS = ["num_lots", "num_tenderers", "num_awards"]
SILVER_COLUMNS = (
    SILVER_DATES + SILVER_AMOUNTS + SILVER_CURRENCIES + SILVER_STRINGS + SILVER_ARRAYS + SILVER_COUNTS
)

STRINGS = T.ArrayType(T.StringType())


def silver_type(name: str) -> T.DataType:
    if name in SILVER_AMOUNTS:
        return T.DoubleType()
    if name in SILVER_ARRAYS:
        return STRINGS
    if name in SILVER_COUNTS:
        return T.LongType()
    return T.StringType()


SILVER_SCHEMA = T.StructType([T.StructField(n, silver_type(n)) for n in SILVER_COLUMNS])

# Logical type names used by the field checks of the quality report.
SILVER_CHECK_TYPES = {
    name: {"double": "float", "bigint": "int", "array<string>": "list[string]"}.get(
        silver_type(name).simpleString(), "string"
    )
    for name in SILVER_COLUMNS
}

# The eleven columns that Gold adds.
GOLD_DERIVED = [
    ("source", T.StringType()),
    ("year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("quarter", T.IntegerType()),
    ("procurement_category_original", T.StringType()),
    ("procurement_category_standardized", T.StringType()),
    ("is_future_date", T.BooleanType()),
    ("has_value", T.BooleanType()),
    ("has_award", T.BooleanType()),
    ("data_completeness_score", T.DoubleType()),
    ("date_quality_flag", T.StringType()),
]
GOLD_COLUMNS = SILVER_COLUMNS + [n for n, _ in GOLD_DERIVED]
GOLD_SCHEMA = T.StructType(SILVER_SCHEMA.fields + [T.StructField(n, t) for n, t in GOLD_DERIVED])

STRING, LONG, DOUBLE, STAMP = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    """Built from types: parsing DDL text would need a running session at import."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _texts(*names: str) -> T.StructType:
    return _struct(**dict.fromkeys(names, STRING))


# ---------------------------------------------------------------- raw releases
_ID_NAME = _texts("id", "name")
_VALUE = _texts("amount", "currency")
_AWARD = _struct(
    id=STRING,
    date=STRING,
    value=_VALUE,
    suppliers=T.ArrayType(_struct(party=_ID_NAME, id=STRING, name=STRING)),
)
RELEASE_SCHEMA = _struct(
    ocid=STRING,
    id=STRING,
    date=STRING,
    publishedDate=STRING,
    tender=_struct(
        id=STRING,
        title=STRING,
        status=STRING,
        datePublished=STRING,
        value=_VALUE,
        tenderPeriod=_texts("startDate", "endDate"),
        procurementMethod=STRING,
        mainProcurementCategory=STRING,
        procurement_method=STRING,
        procurement_category=STRING,
        numberOfTenderers=LONG,
        tenderers=T.ArrayType(_ID_NAME),
        procuringEntity=_struct(party=_ID_NAME),
        lots=T.ArrayType(_texts("id")),
        documents=T.ArrayType(_texts("url")),
    ),
    buyer=_ID_NAME,
    parties=T.ArrayType(_ID_NAME),
    awards=T.ArrayType(_AWARD),
    award=T.ArrayType(_AWARD),
    bids=_struct(statistics=T.ArrayType(_texts("id"))),
)
ENVELOPE_SCHEMA = _struct(records=T.ArrayType(RELEASE_SCHEMA), count=LONG, publication_date=STRING, country=STRING)

# ------------------------------------------------------------- nested parquet
NOTICE_SCHEMA = _struct(
    source_id=STRING,
    source=STRING,
    contract_object=STRING,
    contract_price=DOUBLE,
    effective_total_price=DOUBLE,
    currency=STRING,
    state=STRING,
    publication_date=STRING,
    contract_date=STRING,
    closing_date=STRING,
    execution_deadline=STRING,
    procedure_type=STRING,
    contract_types=STRINGS,
    contracting_authorities=T.ArrayType(_texts("nipc", "name", "country")),
    contractors=T.ArrayType(_texts("nipc", "name")),
    execution_location=STRING,
    procurement_documents_url=STRING,
    source_url=STRING,
)

# ----------------------------------------------------------- relational tables
RELATIONAL_SCHEMAS = {
    "tenders": _struct(
        tender_id=STRING,
        tender_title=STRING,
        tender_supplyType=STRING,
        tender_estimatedPrice=DOUBLE,
        publication_date=STAMP,
        tender_bidDeadline=STAMP,
        tender_procedureType=STRING,
        main_nature=STRING,
        tender_mainCpv=STRING,
        ingestion_timestamp=STAMP,
    ),
    "buyers": _texts("buyer_id", "buyer_name", "buyer_buyerType"),
    "lots": _struct(
        lot_id=STRING, lot_status=STRING, lot_estimatedPrice=DOUBLE, cpv_code=STRING, estimated_value=DOUBLE
    ),
    "tender_buyer": _texts("tender_id", "buyer_id"),
    "tender_lot": _texts("tender_id", "lot_id"),
}

# --------------------------------------------------------------- contract rows
CONTRACT_COLUMNS = [
    "idcontrato", "objectoContrato", "descContrato", "adjudicante", "adjudicatarios",
    "precoContratual", "PrecoTotalEfetivo", "dataPublicacao", "tipoContrato", "tipoprocedimento",
]
CONTRACT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in CONTRACT_COLUMNS])

# ------------------------------------------------------------------- ledgers
EXTRACTED_FILES_SCHEMA = _struct(key=STRING, md5_hash=STRING, record_count=LONG, size_bytes=LONG, timestamp=STRING)
PROCESSED_FILES_SCHEMA = _struct(path=STRING, processed_at=T.TimestampType())
