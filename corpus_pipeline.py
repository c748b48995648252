"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near copies stays, repeated passages are cut out, documents that hold
benchmark items go, and what is left is encoded. All but the last stage return the columns of ``documents``; others are ignored.
Null and empty texts stay apart from the rest as the operators say: never toxic or leaking, one of them kept as near copies of each
other, encoded as no token. Repeated rows are near copies. A null doc_id goes where its group has another. Long texts are worked on
whole. Empty documents give an empty result; empty labels or benchmark drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm import bpe, decontaminate, simcopies, substring, toxicity
from procurelake.llm.shipping import ship
from procurelake.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    ship(spark)
    return toxicity.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by a similarity of 0.8 of their five-word shingles."""
    ship(spark)
    return simcopies.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words covered by a window that an earlier document has; n_chars follows the text."""
    ship(spark)
    kept = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"), verbatim=True)
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", length.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ship(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of each document."""
    ship(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL expresses neither the models nor the merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
