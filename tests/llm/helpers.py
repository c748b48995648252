"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeats, extra columns."""

import random

from pyspark.sql import functions as F

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def prose(rnd: random.Random, words: int) -> str:
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(words))


def documents(spark, rows):
    """``rows`` of (doc_id, text), with further columns, some of them named like the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in ("mark", "h", "part", "component_id", "text_key", "lang", "ids", "n_words", "score")])


def as_set(df):
    return sorted(map(str, df.collect()))
