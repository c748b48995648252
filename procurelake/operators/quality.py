"""Quality reports. Every metric is a counter in one wide aggregate, so a report is one scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake import schemas
from procurelake.functions import text

# Required fields, gate limits, rule names in report order.
REQUIRED_FIELDS = ("ocid", "publication_date")
MIN_SCORE = 0.80
MAX_FAIL_RATE = 0.15
RULES = (
    "invalid_ocid_format",
    "invalid_currency_code",
    "end_date_before_start_date",
    "award_date_before_tender_date",
    "negative_amounts",
)
NO_RECORDS = "No records to validate"
_COUNTERS = ("null_count", "empty_count", "type_mismatches", "out_of_range")


@dataclass(frozen=True)
class Check:
    """Per-row conditions on one field; none of them is ever NULL."""

    name: str
    required: bool
    null_count: Column
    empty_count: Column
    type_mismatches: Column
    out_of_range: Column

    def row_fails(self) -> Column:
        if self.required:
            return self.null_count | self.empty_count | self.type_mismatches
        return self.type_mismatches


def _never() -> Column:
    return F.lit(False)


def _mismatch(c: Column, actual: T.DataType, expected: str) -> Column:
    if expected == "string":
        return _never() if isinstance(actual, T.StringType) else F.lit(True)
    if expected == "list[string]":
        if isinstance(actual, T.ArrayType) and isinstance(actual.elementType, T.StringType):
            return F.exists(c, lambda x: x.isNull())
        return F.lit(True)
    if isinstance(actual, T.StringType):
        parsed = c.try_cast("bigint") if expected == "int" else text.number_or_null(c)
        return parsed.isNull()
    whole = isinstance(actual, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if expected == "int":
        return _never() if whole else F.lit(True)
    fraction = isinstance(actual, (T.FloatType, T.DoubleType, T.DecimalType))
    return _never() if whole or fraction else F.lit(True)


def _beyond(name: str, c: Column, actual: T.DataType, limit: Column) -> Column:
    checks = []
    if name.endswith("_amount") or name.startswith("num_"):
        number = text.number_or_null(c) if isinstance(actual, T.StringType) else c.cast("double")
        checks.append(F.coalesce(number < 0, F.lit(True)))
    if name.endswith("_date") and isinstance(actual, T.StringType):
        day = F.when(F.substring(c, 1, 10).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.substring(c, 1, 10).try_cast("date"))
        checks.append(F.coalesce(day > limit, F.lit(True)))
    return reduce(lambda a, b: a | b, checks) if checks else _never()


def field_checks(
    df: DataFrame, as_of: str, schema: dict[str, str] | None = None, required: tuple[str, ...] = REQUIRED_FIELDS
) -> list[Check]:
    """Conditions per schema field. A null or empty value is not checked any further."""
    limit = F.add_months(F.lit(as_of).cast("date"), 12)
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = []
    for name, expected in (schema or schemas.SILVER_CHECK_TYPES).items():
        if name not in types:
            checks.append(Check(name, name in required, F.lit(True), _never(), _never(), _never()))
            continue
        c, actual = F.col(name), types[name]
        null = c.isNull()
        blank = expected == "string" and isinstance(actual, T.StringType)
        empty = F.coalesce(c == "", F.lit(False)) if blank else _never()
        checked = ~null & ~empty
        beyond = _beyond(name, c, actual, limit)
        mismatch = _mismatch(c, actual, expected)
        checks.append(
            Check(
                name, name in required, null, empty,
                F.when(checked, mismatch).otherwise(False),
                F.when(checked, beyond).otherwise(False),
            )
        )
    return checks


def _rule_counts(df: DataFrame) -> dict[str, Column]:
    """Violations of one row per rule; currency counts each field, amounts once."""
    have = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    ocid = have("ocid").cast("string")
    bad_code = lambda c: one(filled(c) & ~c.rlike(r"^\p{L}{3}$"))
    start, end = have("tender_start_date"), have("tender_end_date")
    published, awarded = have("publication_date"), have("award_date")
    number = lambda n: have(n).try_cast("double")
    return {
        RULES[0]: one(filled(ocid) & ~ocid.startswith("ocds-")),
        RULES[1]: bad_code(have("tender_value_currency")) + bad_code(have("award_currency")),
        RULES[2]: one(filled(start) & filled(end) & (start > end)),
        RULES[3]: one(filled(published) & filled(awarded) & (awarded < published)),
        RULES[4]: one((number("tender_value_amount") < 0) | (number("award_amount") < 0)),
    }


def _cells_filled(df: DataFrame, fields: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    flags = []
    for name in fields:
        if name not in types:
            continue
        c = F.col(name)
        filled = F.coalesce(c != "", F.lit(False)) if isinstance(types[name], T.StringType) else c.isNotNull()
        flags.append(filled.cast("int"))
    return reduce(lambda a, b: a + b, flags)


def _counted(checks: list[Check]) -> list[Column]:
    return [F.count_if(getattr(c, k)).alias(f"{c.name}__{k}") for c in checks for k in _COUNTERS]


def _field_struct(c: Check) -> Column:
    n = {k: F.col(f"{c.name}__{k}") for k in _COUNTERS}
    broken = n["type_mismatches"] + n["out_of_range"]
    if c.required:
        broken = broken + n["null_count"] + n["empty_count"]
    return F.struct(
        F.lit(c.name).alias("field"), *[n[k].alias(k) for k in _COUNTERS], (broken == 0).alias("passed")
    )


def field_report(df: DataFrame, as_of: str, **options) -> DataFrame:
    """One row per field: nulls, empties, type mismatches, values out of range, passed."""
    checks = field_checks(df, as_of, **options)
    wide = df.agg(*_counted(checks))
    return wide.select(F.inline(F.array(*[_field_struct(c) for c in checks])))


def rule_report(df: DataFrame) -> DataFrame:
    """One row per business rule with its number of violations."""
    rules = _rule_counts(df)
    wide = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(r) for r, c in rules.items()])
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules]
    return wide.select(F.inline(F.array(*pairs)))


def _percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


# The texts of the warnings.
def _warnings(min_score: float, max_fail_rate: float) -> Column:
    entries = [
        F.when(
            F.col("completeness_score") < min_score,
            F.concat(
                F.lit("Low completeness score: "), _percent(F.col("completeness_score")),
                F.lit(f" (minimum: {min_score:.2%})"),
            ),
        ),
        F.when(
            F.col("fail_rate") > max_fail_rate,
            F.concat(
                F.lit("High failure rate: "), _percent(F.col("fail_rate")), F.lit(f" (maximum: {max_fail_rate:.2%})")
            ),
        ),
    ]
    entries += [
        F.when(
            F.col(r) > 0,
            F.concat(F.lit(f"Business rule violation '{r}': "), F.col(r).cast("string"), F.lit(" occurrences")),
        )
        for r in RULES
    ]
    found = F.filter(F.array(*entries), lambda w: w.isNotNull())
    return F.when(F.col("total_records") > 0, found).otherwise(F.array(F.lit(NO_RECORDS)))


def _measures(df: DataFrame, checks: list[Check], schema: dict[str, str]) -> list[Column]:
    fails = reduce(lambda a, b: a | b, [c.row_fails() for c in checks])
    return [
        F.count("*").alias("total_records"),
        F.count_if(~fails).alias("validation_passed"),
        F.count_if(fails).alias("validation_failed"),
        F.coalesce(F.sum(_cells_filled(df, list(schema)).cast("bigint")), F.lit(0)).alias("_cells"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(r) for r, c in _rule_counts(df).items()],
    ]


def _summarised(wide: DataFrame, fields: int, min_score: float, max_fail_rate: float) -> DataFrame:
    share = lambda c: F.when(F.col("total_records") > 0, c / F.col("total_records"))
    rated = wide.withColumns(
        {
            "completeness_score": F.coalesce(share(F.col("_cells") / fields), F.lit(0.0)),
            "pass_rate": F.coalesce(share(F.col("validation_passed")), F.lit(0.0)),
            "fail_rate": F.coalesce(share(F.col("validation_failed")), F.lit(0.0)),
            "total_business_violations": reduce(lambda a, b: a + b, [F.col(r) for r in RULES]),
        }
    )
    gate = (
        (F.col("total_records") > 0)
        & (F.col("completeness_score") >= min_score)
        & (F.col("fail_rate") <= max_fail_rate)
    )
    return rated.withColumn("quality_check_passed", gate).withColumn("warnings", _warnings(min_score, max_fail_rate))


def summary_report(
    df: DataFrame, as_of: str, min_score: float = MIN_SCORE, max_fail_rate: float = MAX_FAIL_RATE, **options
) -> DataFrame:
    """One row: passed and failed records, completeness, rule violations, gate, warnings."""
    schema = options.get("schema") or schemas.SILVER_CHECK_TYPES
    wide = df.agg(*_measures(df, field_checks(df, as_of, **options), schema))
    return _summarised(wide, len(schema), min_score, max_fail_rate).drop("_cells")


def full_report(
    df: DataFrame, as_of: str, source: str, min_score: float = MIN_SCORE, max_fail_rate: float = MAX_FAIL_RATE,
    **options,
) -> DataFrame:
    """Summary and field counters in one row from one scan; ``fields`` is an array of structs."""
    schema = options.get("schema") or schemas.SILVER_CHECK_TYPES
    checks = field_checks(df, as_of, **options)
    wide = df.agg(*_measures(df, checks, schema), *_counted(checks))
    counters = [f"{c.name}__{k}" for c in checks for k in _COUNTERS]
    return (
        _summarised(wide, len(schema), min_score, max_fail_rate)
        .withColumn("fields", F.array(*[_field_struct(c) for c in checks]))
        .withColumn("source", F.lit(source))
        .drop("_cells", *counters)
    )


# ---------------------------------------------------------------- Gold reports
# Names and bounds of the score buckets.
EXCELLENT, GOOD, FAIR, POOR = "excellent (>0.9)", "good (0.7-0.9)", "fair (0.5-0.7)", "poor (<0.5)"


def identity_report(df: DataFrame) -> DataFrame:
    """Records, distinct OCIDs, surplus records and rate."""
    totals = df.agg(F.count("*").alias("total_records"), F.count_distinct("ocid").alias("unique_ocids"))
    rate = 1 - F.col("unique_ocids") / F.col("total_records")
    return totals.withColumns(
        {
            "duplicate_ocids": F.col("total_records") - F.col("unique_ocids"),
            "deduplication_rate": F.when(F.col("total_records") > 0, rate).otherwise(F.lit(0.0)),
        }
    )


def coverage_report(df: DataFrame) -> DataFrame:
    """One row per column: non-null, non-empty, percentage of rows that are filled."""
    columns = [f for f in df.schema.fields if not f.name.startswith("_")]

    def non_empty(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            return F.count_if(F.size(c) > 0)
        if isinstance(f.dataType, T.StringType):
            return F.count_if(c != "")
        return F.count(c)

    wide = df.agg(
        F.count("*").alias("_rows"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"{f.name}__non_null") for f in columns],
        *[non_empty(f).alias(f"{f.name}__non_empty") for f in columns],
    )
    percent = lambda n: F.when(
        F.col("_rows") > 0, F.round(F.col(f"{n}__non_empty") / F.col("_rows") * 100, 2)
    ).otherwise(F.lit(0.0))
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.col(f"{f.name}__non_null").alias("non_null"),
            F.col(f"{f.name}__non_empty").alias("non_empty"),
            percent(f.name).alias("completeness_pct"),
        )
        for f in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def validation_report(df: DataFrame) -> DataFrame:
    """Long form (metric, value): date flags, score buckets and record counts, from one scan."""
    score = F.col("data_completeness_score")
    flags = ("valid", "missing", "past", "future")
    counters: dict[str, Column] = {f"flag:{f}": F.count_if(F.col("date_quality_flag") == f) for f in flags}
    counters |= {
        EXCELLENT: F.count_if(score > 0.9),
        GOOD: F.count_if((score >= 0.7) & (score <= 0.9)),
        FAIR: F.count_if((score >= 0.5) & (score < 0.7)),
        POOR: F.count_if(score < 0.5),
        "records_with_value": F.count_if("has_value"),
        "records_with_award": F.count_if("has_award"),
        "future_dates": F.count_if("is_future_date"),
        "total_records": F.count("*"),
    }
    # The score takes few values (multiples of 1/14), so its mean is exact in fixed point.
    mean = F.round(F.avg(score.cast("decimal(20,12)")).cast("double"), 4)
    wide = df.agg(*[c.alias(n) for n, c in counters.items()], mean.alias("avg_completeness_score"))
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("value"))
        for n in [*counters, "avg_completeness_score"]
    ]
    return wide.select(F.inline(F.array(*pairs)))
