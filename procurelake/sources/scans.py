"""Readers. Row order within and across files is kept as ``_file`` and ``_row`` where first-wins matters."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake import schemas
from procurelake.session import staged
from procurelake.sources import commits

RELEASE_FILES = "records_*.json"
# Fixed value: how a record begins in an envelope file of two blanks of indentation.
RECORD_START = "\n    {\n"
BAD_LINE = "_bad_line"
# What Spark calls a folder without files of the kind.
_ABSENT = ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND")
# Path parts of files that hold no Silver records.
_SIDE_FILES = ("processing_state", "quality")
# File names of the relational extract.
RELATIONAL_FILES = {
    "tenders": "tenders.parquet",
    "buyers": "buyers.parquet",
    "lots": "lots.parquet",
    "tender_buyer": "tender_buyer_relationships.parquet",
    "tender_lot": "tender_lot_relationships.parquet",
}


def file_path() -> Column:
    return F.col("_metadata.file_path")


def country_of_path(path: Column, source: str) -> Column:
    """The path segment after the source name: .../<source>/<country>/..., NULL when there is none."""
    found = F.regexp_extract(path, rf"(?:^|/){source}/([^/]+)/", 1)
    return F.when(found != "", F.regexp_replace(found, "^country=", ""))


def envelopes(
    spark: SparkSession,
    path: str,
    source: str,
    country: str | None = None,
    glob: str = RELEASE_FILES,
    per_line: bool = False,
) -> DataFrame:
    """Releases out of envelopes: one JSON object per file, or per line of a file.

    A file with one object cannot be split, one with an envelope per line can.
    """
    files = (
        spark.read.schema(schemas.ENVELOPE_SCHEMA)
        .option("multiLine", not per_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(path)
    )
    named = F.lit(country) if country else country_of_path(file_path(), source)
    return files.select(
        named.alias("country"), file_path().alias("source_file"), F.posexplode("records").alias("_row", "_release")
    ).select("_release.*", "country", "source_file", "_row")


def envelope_records(
    spark: SparkSession, path: str, source: str, country: str | None = None, glob: str = RELEASE_FILES, record_start: str = RECORD_START
) -> DataFrame:
    """Releases out of files that hold one envelope each; a large file is read by many tasks.

    The text is cut where a record begins, and every piece is parsed by itself. ``record_start`` is what the writer puts there and
    nowhere else: for indented files a line break, the record's indentation and its brace, which no quoted text can hold, as line
    breaks are escaped in it; for compact files the brace with a record's first key, which stands unescaped at records only.
    Records that are no JSON keep their text in ``_bad_line``. ``_row`` orders the records of a file.
    """
    fields = schemas.RELEASE_SCHEMA.fields + [T.StructField(BAD_LINE, T.StringType())]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    pieces = (
        spark.read.option("lineSep", record_start).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    )
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    named = F.lit(country) if country else country_of_path(file_path(), source)
    placed = pieces.select("value", named.alias("country"), file_path().alias("source_file"), place.alias("_row"))
    # what stands before the first record is the beginning of the envelope
    records = placed.where(~F.ltrim("value").startswith("{"))
    opening = record_start[record_start.index("{") :]
    # an indented record ends at its brace; what follows a compact one, the parser leaves alone
    ended = F.substring_index("value", record_start.rstrip("\n").replace("{", "}"), 1) if record_start.startswith("\n") else F.col("value")
    whole = F.concat(F.lit(opening), ended, F.lit("\n}" if record_start.startswith("\n") else ""))
    parsed = records.withColumn("_release", F.from_json(whole, T.StructType(fields), options))
    return parsed.select("_release.*", "country", "source_file", "_row")


def release_lines(spark: SparkSession, path: str, even: bool = False) -> DataFrame:
    """One release per line, gzip or not. Lines that are no JSON keep their text in ``_bad_line``.

    Lines are parsed by an expression: the JSON scan refuses queries that need the bad lines only.
    A gzip file is one task; with ``even`` the lines are ``spread`` before they are parsed, as texts take less of a shuffle
    than nested rows do.
    """
    fields = schemas.RELEASE_SCHEMA.fields + [T.StructField(BAD_LINE, T.StringType())]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = F.from_json("value", T.StructType(fields), options)
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", file_path().alias("source_file"))
    return (spread(lines) if even else lines).select(parsed.alias("_release"), "source_file").select("_release.*", "source_file")


def good_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_lines(lines: DataFrame) -> DataFrame:
    """The side output: rejected lines."""
    return lines.where(F.col(BAD_LINE).isNotNull()).select("source_file", BAD_LINE)


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good lines, rejected ones, and how many there are of each, from one pass over the files.

    The parse is staged, since both sides and the counts come from it; counts are observed while it is written.
    """
    seen = Observation()
    bad = F.col(BAD_LINE).isNotNull()
    parsed = staged(lines.observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad")), "lines")
    return good_lines(parsed), bad_lines(parsed), dict(seen.get)


def spread(df: DataFrame) -> DataFrame:
    """Even partitions after an unsplittable scan; the number is left to adaptive execution."""
    return df.hint("rebalance")


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Nested Parquet notices, all files below ``path``."""
    scan = (
        spark.read.schema(schemas.NOTICE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )
    return scan.withColumn("source_file", file_path())


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder. One that begins with a scheme is taken as an encoded address, as file paths of rows are."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if re.match("[a-z0-9+.-]+:", path) else path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def relational_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The five tables; a missing file gives None. Link tables carry ``_row`` for first-wins."""
    tables: dict[str, DataFrame | None] = {}
    for name, file in RELATIONAL_FILES.items():
        path = f"{folder}/{file}"
        if not exists(spark, path):
            tables[name] = None
            continue
        scan = spark.read.schema(schemas.RELATIONAL_SCHEMAS[name]).parquet(path)
        mark = {"tenders": "_tender_row", "tender_buyer": "_buyer_row", "tender_lot": "_lot_row"}.get(name)
        if mark:
            place = F.struct(file_path().alias("file"), F.col("_metadata.row_index").alias("row"))
            scan = scan.withColumn(mark, place)
        tables[name] = scan
    return tables


def _folder_value(path: Column, key: str) -> Column:
    """The value of a ``key=value`` folder, '' for the default one, NULL without such a folder."""
    raw = F.regexp_extract(path, rf"/{key}=([^/]*)/", 1)
    # File paths are percent-encoded once more than the folder names they show.
    once = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    value = once(once(raw))
    return F.when(value == "__HIVE_DEFAULT_PARTITION__", "").when(raw != "", value)


def _below(root: str) -> Column:
    """The path of a file below ``root``, whatever scheme either is written with; the whole path where it isn't below."""
    bare = re.sub(r"^[a-z0-9+.-]+:/*", "/", root.rstrip("/")) + "/"
    found = F.instr(file_path(), F.lit(bare))
    return F.when(found > 0, F.substr(file_path(), found + F.lit(len(bare)))).otherwise(file_path())


def files_without_rows(spark: SparkSession, root: str, source: str, rows: DataFrame) -> DataFrame:
    """Side table of ``silver`` with ``skip_unreadable``: ``path`` of the files that gave no row."""
    bare = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    listed = file_listing(spark, f"{root}/{source}", "*.parquet").select("path")
    read = rows.select(bare(F.col("_file")).alias("_read")).distinct()
    return listed.join(read, bare(F.col("path")) == F.col("_read"), "left_anti")


def silver(
    spark: SparkSession, root: str, source: str, schema: T.StructType | None = None, skip_unreadable: bool = False,
    files: list[str] | None = None,
) -> DataFrame | None:
    """All Parquet files of one source, or those listed, without state and quality files; None if the source has none.

    Folders of batches that are not in the table's commit log, if it has one, are left out.
    An unreadable file fails the job unless ``skip_unreadable`` is set; ``files_without_rows`` then lists what gave nothing.

    Folders may be laid out as ``key=value`` or not; a country that only stands in the folder
    name is read from there. Without a ``schema`` the footers of all files are merged.
    """
    path = f"{root}/{source}"
    if not exists(spark, path):
        return None
    known = commits.committed(spark, path)
    reader = spark.read.option("ignoreCorruptFiles", skip_unreadable)
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
    try:
        scan = reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(*(files or [path]))
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return None
        raise
    data = scan
    for part in _SIDE_FILES:
        data = data.where(~_below(path).contains(part))
    hidden = commits.hidden(spark, path, known)
    if hidden:
        data = data.where(commits.counts(file_path(), hidden))
    marked = data.withColumns({"_file": file_path(), "_row": F.col("_metadata.row_index")})
    country = _folder_value(F.col("_file"), "source_country")
    if "source_country" in marked.columns:
        country = F.coalesce("source_country", country)
    return marked.withColumn("source_country", country)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """The unified table. '' as a partition value comes back as NULL and is restored here."""
    scan = spark.read.parquet(path)
    if not isinstance(scan.schema["source_country"].dataType, T.StringType):
        # Folder names that look like numbers were taken for numbers.
        fields = [T.StructField("source_country", T.StringType()) if f.name == "source_country" else f for f in scan.schema]
        scan = spark.read.schema(T.StructType(fields)).parquet(path)
    return scan.withColumn("source_country", F.coalesce("source_country", F.lit("")))


def parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    scan = spark.read.parquet(path)
    return scan if limit is None else scan.limit(limit)


def contract_rows(spark: SparkSession, path: str) -> DataFrame:
    """Contract rows from CSV files, by the names in their header: all columns as text, known ones without a column as NULL.

    Files of one folder may have headers that differ in order or in columns; those with the same header are one scan. Headers are read
    as the first line of each file, one row per file. Quoted texts may hold line breaks.
    """
    place = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    heads = lines.select(file_path().alias("file"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("head"))
    kinds: dict[str, list[str]] = {}
    for row in heads.withColumn("nth", place).where("nth = 1").orderBy("file").toLocalIterator():
        kinds.setdefault(row.head, []).append(_plain_path(spark, row.file))
    parts = []
    for files in kinds.values():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        absent = [f for f in schemas.CONTRACT_SCHEMA.fields if f.name not in rows.columns]
        parts.append(rows.withColumns({f.name: F.lit(None).cast("string") for f in absent}) if absent else rows)
    if not parts:
        return spark.createDataFrame([], schemas.CONTRACT_SCHEMA)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _plain_path(spark: SparkSession, address: str) -> str:
    """The path that an encoded file address names."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(address)).toString()


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and modification time of files; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def file_digests(spark: SparkSession, path: str | list[str], glob: str = "*", modified: bool = False) -> DataFrame:
    """md5 of every file's content, computed where the file is read. A file is one value, so it may have 2 GB at most."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    when = [F.col("modificationTime").alias("modified")] if modified else []
    return files.select(
        F.col("path").alias("key"), F.md5("content").alias("md5_hash"), F.col("length").alias("size_bytes"), *when
    )
