"""Cleaning expressions for strings, numbers, currencies and party lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as blanks.
# Java's \s is ASCII only, and its Unicode mode leaves out \x1c-\x1f.
# The intersection lets a letter fail on one range instead of on each wide blank.
_BLANK = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
_BLANKS = rf"{_BLANK}+"
_EDGES = rf"^{_BLANK}+|{_BLANK}+$"
_CONTROLS = r"[\x00-\x1f]"
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
NO_STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(NO_STRINGS)


def _rare_blanks(c: Column) -> Column:
    """True where a blank other than the plain space is possible: a control or non-ASCII character."""
    return (F.octet_length(c) != F.char_length(c)) | c.rlike(_CONTROLS)


def strip(c: Column) -> Column:
    return F.when(_rare_blanks(c), F.regexp_replace(c, _EDGES, "")).otherwise(F.trim(c))


def _maybe_untidy(c: Column) -> Column:
    """False only for ASCII text without double, outer or control blanks, which is most text."""
    return c.contains("  ") | c.startswith(" ") | c.endswith(" ") | _rare_blanks(c)


def clean_string(c: Column) -> Column:
    """Collapse every run of blanks, trim, NULL becomes ''."""
    c = c.cast("string")
    tidied = F.trim(F.regexp_replace(c, _BLANKS, " "))
    return F.coalesce(F.when(_maybe_untidy(c), tidied).otherwise(c), F.lit(""))


def clean_id(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def number_or_null(c: Column) -> Column:
    """Text to double; text that is no plain decimal number gives NULL."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def clean_amount(c: Column) -> Column:
    """Text amount to double, 0.0 where it is missing or no number."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def clean_number(c: Column) -> Column:
    """Numeric amount: NULL and NaN become 0.0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def clean_count(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_currency(c: Column) -> Column:
    """Upper-case code of exactly three letters, else ''."""
    code = F.upper(strip(c))
    general = F.when(code.rlike(r"^\p{L}{3}$"), code).otherwise(F.lit(""))
    return F.when(c.rlike("^[A-Z]{3}$"), c).otherwise(general)


def clean_array(c: Column) -> Column:
    """Elements as text, NULL becomes an empty array.

    ``transform`` also keeps a projection of all cleaned columns out of whole-stage code: there it is one method of
    more than the 8,000 bytes up to which the JVM compiles, and ran interpreted.
    """
    return F.coalesce(F.transform(c, lambda v: v.cast("string")), empty_strings())


def as_array(c: Column) -> Column:
    """A single value becomes a one-element array, NULL an empty one."""
    return F.when(c.isNull(), empty_strings()).otherwise(F.array(c.cast("string")))


# Currency symbols and HTML entities that may be decoded first.
CURRENCY_SYMBOLS = {"€": "EUR", "£": "GBP", "$": "USD"}
HTML_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}


def currency_from_symbol(c: Column) -> Column:
    """Replace a bare currency symbol by its ISO code; other text is kept."""
    bare = strip(c)
    result = c
    for symbol, code in CURRENCY_SYMBOLS.items():
        result = F.when(bare == symbol, F.lit(code)).otherwise(result)
    return result


def decode_entities(c: Column) -> Column:
    """Decode the common HTML entities; the ampersand comes last, so no text is decoded twice."""
    for entity, text in HTML_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def parse_eu_amount(c: Column) -> Column:
    """'1000,50 €' to 1000.5; two separators make the text invalid, hence 0.0."""
    bare = F.translate(c, ",€ ", ".")
    return clean_amount(bare)


def party(c: Column) -> Column:
    """Split 'NIF - Name' at the first ' - '; without it the text is the name."""
    at = F.instr(c, " - ")
    ident = strip(F.substring_index(c, " - ", 1))
    name = strip(c.substr(at + 3, F.length(c)))
    return F.struct(
        F.when(at > 0, ident).otherwise(F.lit("")).alias("id"),
        F.when(at > 0, name).otherwise(F.coalesce(c, F.lit(""))).alias("name"),
    )


def party_list(c: Column) -> Column:
    """Split 'A; B' into parties and drop those without a name."""

    # Two steps, so that an entry is stripped once and not wherever its text is used.
    entries = F.transform(
        F.split(c, ";"),
        lambda raw: F.struct(strip(raw).alias("bare"), raw.contains(" - ").alias("has_id")),
    )

    def split_entry(entry: Column) -> Column:
        bare, has_id = entry["bare"], entry["has_id"]
        at = F.instr(bare, " - ")
        ident = F.when(has_id, strip(F.substring_index(bare, " - ", 1))).otherwise(F.lit(""))
        tail = F.when(at > 0, strip(bare.substr(at + 3, F.length(bare)))).otherwise(F.lit(""))
        return F.struct(ident.alias("id"), F.when(has_id, tail).otherwise(bare).alias("name"))

    parties = F.transform(entries, split_entry)
    return F.coalesce(
        F.filter(parties, lambda p: p["name"] != ""),
        F.array().cast("array<struct<id:string,name:string>>"),
    )
