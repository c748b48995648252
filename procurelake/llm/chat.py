"""Chat template with a grammar that reads back exactly what was written. DataFrame functions only.

A conversation is rendered turn by turn: ``[INST]user[/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>`` and, for any
other role, ``[ROLE]role[/ROLE]text[/TEXT]``. The parser takes segments from left to right and refuses content
that holds a control string, so a text has one reading. Rendering starts without escapes; where
the turns read back differ from the source, every control string inside a text or role gets a backslash
after its bracket (one more, if it has some already), which the parser takes off again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn, by role; the last entry is for any other role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, ROLE_END, TEXT_END = "[ROLE]", "[/ROLE]", "[/TEXT]"
_TAILS = r"(s>|INST\]|SYS>>|ROLE\]|TEXT\])"
CONTROL = r"([<\[]/?)(\\*)" + _TAILS
ESCAPED = r"([<\[]/?)\\(\\*)" + _TAILS
_SEGMENT = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\].*?\[/TEXT\]"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _render(turn: Column, guard) -> Column:
    """One turn as its runs of text: mark, content, mark."""
    text = guard(turn["text"])
    out = F.struct(F.concat(F.lit(ROLE), guard(turn["role"]), F.lit(ROLE_END)).alias("open"), text.alias("body"), F.lit(TEXT_END).alias("close"))
    for role, (before, after) in MARKS.items():
        out = F.when(turn["role"] == role, F.struct(F.lit(before).alias("open"), text.alias("body"), F.lit(after).alias("close"))).otherwise(out)
    return out


def _joined(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["open"], r["body"], r["close"])), "")


def _inside(segment: Column, before: str, after: str) -> Column:
    return F.substring(segment, F.lit(len(before) + 1), F.length(segment) - len(before) - len(after))


def _read(segment: Column) -> Column:
    """Role and text of a segment, still escaped."""
    rest = _inside(segment, ROLE, TEXT_END)
    role = F.substring_index(rest, ROLE_END, 1)
    text = F.substring(rest, F.length(role) + len(ROLE_END) + 1, F.length(rest))
    out = F.struct(role.alias("role"), text.alias("text"))
    for name, (before, after) in MARKS.items():
        known = F.struct(F.lit(name).alias("role"), _inside(segment, before, after).alias("text"))
        out = F.when(segment.startswith(before), known).otherwise(out)
    return out


def _parsed(frame: DataFrame, source: str, out: str) -> DataFrame:
    """Adds the turns of a rendered text, null where the grammar doesn't cover all of it or content holds a control string."""
    plain = CONTROL.replace(r"(\\*)", "")
    raw = frame.withColumn("_segments", F.regexp_extract_all(source, F.lit(_SEGMENT), F.lit(0)))
    raw = raw.withColumn("_raw", F.transform("_segments", _read))
    whole = F.array_join("_segments", "") == F.col(source)
    clean = ~F.exists("_raw", lambda t: t["role"].rlike(plain) | t["text"].rlike(plain))
    turns = F.transform("_raw", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return raw.withColumn(out, F.when(whole & clean, turns)).drop("_segments", "_raw")


def parse(frame: DataFrame, source: str = "formatted") -> DataFrame:
    """``frame`` with ``turns``, an array of role and text; null where the text isn't of the grammar."""
    return _parsed(frame, source, "turns")


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Returns ``conv_id``, ``formatted``, ``turns`` (read back from ``formatted`` by the parser; array of role and text),
    ``mask`` (runs that cover ``formatted``: ``chars`` code points, ``loss`` whether a model is trained on them) and ``escaped``.
    A conversation that could not be read back would fail the job.

    Turns are ordered by turn, then role, then text, which also settles ties; a null turn comes first; repeated rows
    are repeated turns. A null role or text is empty. Rows with a null conv_id form one conversation.
    An empty table gives an empty table; further columns are ignored. A conversation is one value of the result,
    so its turns meet in one row and may have 2 GB together; conversations are spread over tasks.
    """
    slim = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    source = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = grouped.select("conv_id", source.alias("_source"))
    plain = plain.withColumn("_runs", F.transform("_source", lambda t: _render(t, lambda x: x)))
    tried = _parsed(plain.withColumn("_plain", _joined(F.col("_runs"))), "_plain", "_first")
    same = F.coalesce(F.col("_first") == F.col("_source"), F.lit(False))
    guarded = F.transform("_source", lambda t: _render(t, escape))
    chosen = tried.withColumn("escaped", ~same).withColumn("_runs", F.when(same, F.col("_runs")).otherwise(guarded))
    done = _parsed(chosen.withColumn("formatted", _joined(F.col("_runs"))), "formatted", "turns")
    kept = F.coalesce(F.col("turns") == F.col("_source"), F.lit(False))
    checked = F.when(kept, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    runs = F.transform(
        F.arrays_zip(F.col("_runs").alias("r"), F.col("_source").alias("s")),
        lambda z: F.array(
            F.struct(F.length(z["r"]["open"]).alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(z["r"]["body"]).alias("chars"), (z["s"]["role"] == LOSS_ROLE).alias("loss")),
            F.struct(F.length(z["r"]["close"]).alias("chars"), F.lit(False).alias("loss")),
        ),
    )
    return done.select("conv_id", "formatted", checked.alias("turns"), F.flatten(runs).alias("mask"), "escaped")


def digests(chats: DataFrame) -> DataFrame:
    """Figures of formatted chats: turn and loss digests, from the turns read back."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("_turns"), loss.alias("_loss"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("_turns", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
