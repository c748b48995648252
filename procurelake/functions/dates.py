"""Date cleaning: one shape check by regex, one cast, no per-format parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The malformed shape 'date hh:mm:ss.fffThh:mm:ssZ', the offset
# suffix, and the accepted shapes date / date-time / date-time with fraction.
_DOUBLE_TIME = r" (\d{2}:\d{2}:\d{2}\.\d+)T\d{2}:\d{2}:\d{2}"
_OFFSET = r"[+-]\d{2}:\d{2}$"
_DAY = r"(?!0000)\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"(?:2[0-3]|[01]?\d):[0-5]?\d:[0-5]?\d(?:\.\d{1,6})?"
_ACCEPTED = rf"^({_DAY})(?:[Tt]{_CLOCK})?$"
# The usual shapes: the same with at most one offset or Z at the end.
_USUAL = rf"^({_DAY})(?:[Tt]{_CLOCK})?(?:Z|[+-]\d{{2}}:\d{{2}})?$"
PLACEHOLDER_DATES = ("1900-01-01", "1970-01-01")
DURATION_MARK = " dia"
# Days that a nanosecond timestamp can hold; others count as missing.
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"


def _plain_day(c: Column) -> Column:
    """True for 'dddd-..-.d': ten characters that the cast alone can settle."""
    at = lambda i: F.substring(c, i, 1)
    digit = at(10).between("0", "9")
    return (F.length(c) == 10) & (at(5) == "-") & (at(8) == "-") & digit & ~c.startswith("0000")


def to_day(c: Column) -> Column:
    """Raw date text to DATE, NULL when it is none of the accepted shapes.

    Plain days need a cast only, date-times one search; repairs are evaluated for the rest.
    The cast refuses what no calendar holds, such as February 30.
    """
    repaired = F.regexp_replace(c, _DOUBLE_TIME, "T$1")
    bare = F.replace(F.regexp_replace(repaired, _OFFSET, ""), F.lit("Z"), F.lit(""))
    usual = F.regexp_extract(c, _USUAL, 1).try_cast("date")
    general = F.coalesce(usual, F.regexp_extract(bare, _ACCEPTED, 1).try_cast("date"))
    return F.when(_plain_day(c), c.try_cast("date")).otherwise(general)


def clean_date(c: Column) -> Column:
    """Raw date text to 'yyyy-MM-dd' or NULL."""
    return to_day(c).cast("string")


def clean_date_or_duration(c: Column) -> Column:
    """As ``clean_date``, but durations such as '30 dias' are never dates."""
    return F.when(~F.lower(c).contains(DURATION_MARK), clean_date(c))


def drop_placeholder(c: Column) -> Column:
    """Clean dates that stand for 'unknown' become NULL."""
    return F.when(~c.isin(*PLACEHOLDER_DATES), c)


def first_date(columns: list[Column], default: Column | None = None) -> Column:
    """The first of several raw texts that is a date."""
    candidates = [clean_date(c) for c in columns]
    return F.coalesce(*(candidates if default is None else candidates + [default]))


def year_month(c: Column) -> tuple[Column, Column]:
    """Year and month text of a clean date, 'unknown' where there is none."""
    parts = F.split(c, "-")
    known = (c != "") & (F.size(parts) >= 2)
    pick = lambda i: F.coalesce(F.when(known, F.get(parts, F.lit(i))), F.lit("unknown"))
    return pick(0), pick(1)


def gold_day(c: Column) -> Column:
    """Silver date text to DATE; days outside the nanosecond range are missing."""
    day = c.try_cast("date")
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), day)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def quality_flag(day: Column, first: str, last: str) -> Column:
    return (
        F.when(day.isNull(), "missing")
        .when(day > F.lit(last).cast("date"), "future")
        .when(day < F.lit(first).cast("date"), "past")
        .otherwise("valid")
    )


