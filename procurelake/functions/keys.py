"""Record keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hashed fields, in order, and the text standing for NULL.
HASH_FIELDS = ("ocid", "tender_id", "publication_date", "buyer_name")
NULL_TEXT = "None"


def record_hash(columns: list[Column] | None = None) -> Column:
    """md5 over 'a|b|c|d'. ``concat_ws`` would skip NULLs, so each is spelled out."""
    parts = [F.coalesce(c.cast("string"), F.lit(NULL_TEXT)) for c in columns or [F.col(n) for n in HASH_FIELDS]]
    pieces: list[Column] = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("|"), part]
    return F.md5(F.concat(*pieces))


def prefixed_id(prefix: str, *parts: Column) -> Column:
    """'<prefix>-a-b'; a missing part is an empty text."""
    pieces: list[Column] = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit("-"), F.coalesce(part.cast("string"), F.lit(""))]
    return F.concat(*pieces)
