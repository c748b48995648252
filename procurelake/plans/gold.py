"""Silver to Gold: unified table, aggregate tables, quality reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake import schemas
from procurelake.operators import aggregates, enrich, profile, quality
from procurelake.session import staged, staging
from procurelake.sinks import writers
from procurelake.sources import commits, scans
from procurelake.streaming import incremental

# Source folder to source tag, in order of priority.
SOURCE_FOLDERS = {
    "open_contracting_partnership": "ocp",
    "ted": "ted",
    "base_portugal": "base_portugal",
    "partner": "partner",
}
# Sources whose Silver columns differ from the fixed ones.
OWN_COLUMNS = ("partner",)


def unified(
    sources: dict[str, DataFrame], as_of: str | Column, tie: list[Column], by: str = "source"
) -> DataFrame:
    """All sources, enriched and free of duplicates: one projection and one shuffle."""
    return enrich.gold_columns(enrich.iso_dates(enrich.to_gold(enrich.unify(sources), as_of, tie, by)))


def silver_sources(
    spark: SparkSession, root: str, folders: dict[str, str] | None = None, files: dict[str, list[str]] | None = None
) -> dict[str, DataFrame]:
    """Sources with the fixed Silver columns are read with them; the relational one brings its own.

    With ``files``, only those files of each source are read.
    """
    found = {}
    for name, tag in (folders or SOURCE_FOLDERS).items():
        fixed = None if tag in OWN_COLUMNS else schemas.SILVER_SCHEMA
        if files is None or files.get(name):
            found[tag] = scans.silver(spark, root, name, fixed, files=files[name] if files else None)
    return {tag: df for tag, df in found.items() if df is not None}


def build_unified(spark: SparkSession, silver_root: str, path: str, as_of: str, by: str = "source") -> DataFrame:
    """Read all Silver sources, write the unified table, return a scan of what was written.

    The files that were there when it began are noted beside the table, for ``refresh_unified``.
    """
    listed = _listed(spark, silver_root)
    sources = silver_sources(spark, silver_root)
    if not sources:
        raise ValueError(f"no Silver source below {silver_root}")
    writers.write_gold(unified(sources, as_of, [F.col(c) for c in _TIE], by), path)
    _note(listed, path, "overwrite")
    return scans.gold(spark, path)


_TIE = ("_file", "_row")
_PARTS = writers.GOLD_KEYS


def _ledger(path: str) -> str:
    return f"{path.rstrip('/')}_files"


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``name, path`` of all Silver files that count. Files are listed when this is called, not when it is read."""
    whole = spark.createDataFrame([], "name string, path string")
    for name in SOURCE_FOLDERS:
        folder = f"{root}/{name}"
        if scans.exists(spark, folder):
            known = commits.committed(spark, folder)
            files = scans.file_listing(spark, folder, "*.parquet")
            files = files.where(commits.counts(F.col("path"), commits.hidden(spark, folder, known)))
            whole = whole.unionByName(files.select(F.lit(name).alias("name"), "path"))
    return whole


def _note(files: DataFrame, path: str, mode: str = "append") -> None:
    files.select("path", F.now().alias("processed_at")).coalesce(1).write.mode(mode).parquet(_ledger(path))


def refresh_unified(spark: SparkSession, silver_root: str, path: str, as_of: str, by: str = "source") -> list[tuple[str, int]]:
    """Bring the unified table up to date with the Silver files it has not seen; returns the partitions that changed.

    A new row meets the stored row of its key, if there is one: the better source, or the more complete row, stays, and the
    stored one on ties, as its file came earlier. Only partitions that gain or lose a row are written anew, each as a whole, and
    those whose rows are no longer in the future on ``as_of``. Of the stored table all keys are read, but whole rows only in these
    partitions. Files are noted last: after a failure the same files are taken again, and rows that had
    been written already meet themselves. Without a stored table, or with columns that it lacks, all is built.
    """
    listed = _listed(spark, silver_root)
    if not scans.exists(spark, path):
        built = build_unified(spark, silver_root, path, as_of, by)
        return _pairs(built)
    seen = incremental.read_ledger(spark, _ledger(path), schemas.PROCESSED_FILES_SCHEMA)
    unseen = staged(incremental.unseen_files(listed, seen), "unseen")
    files: dict[str, list[str]] = {}
    for name, file in unseen.select("name", "path").toLocalIterator():
        files.setdefault(name, []).append(file)
    sources = silver_sources(spark, silver_root, files=files)
    stored = scans.gold(spark, path)
    if sources:
        fresh = unified(sources, as_of, [F.col(c) for c in _TIE], by)
        if set(fresh.columns) - set(stored.columns):
            return _pairs(build_unified(spark, silver_root, path, as_of, by))
    else:
        fresh = stored.limit(0)
    with staging(fresh, "fresh") as fresh:
        met = staged(_meetings(stored, fresh, by), "met")
        lost = [F.col(k).eqNullSafe(F.col(f"lost_{k}")) for k in enrich.DEDUP_KEYS]
        names = [F.col(k).alias(f"lost_{k}") for k in enrich.DEDUP_KEYS]
        winners = fresh.join(met.where("stays").select(*names), lost, "left_anti")
        gone = met.where("NOT stays")
        now = F.lit(as_of).cast("date")
        late = stored.where(F.col("is_future_date") & (F.col("publication_date").try_cast("date") <= now))
        gaining, losing = _pairs(winners), _pairs(gone)
        touched = sorted({*gaining, *losing, *_pairs(late)})
        if touched:
            keys = [*lost, *(F.col(c).eqNullSafe(F.col(f"lost_{c}")) for c in ("source", *_PARTS))]
            beaten = gone.select(*names, *(F.col(c).alias(f"lost_{c}") for c in ("source", *_PARTS)))
            kept = stored.where(_within(touched)).join(beaten, keys, "left_anti")
            future = F.coalesce(F.col("publication_date").try_cast("date") > now, F.lit(False))
            rows = kept.unionByName(winners, allowMissingColumns=True).select(*stored.columns).withColumn("is_future_date", future)
            emptied = sorted(set(losing) - set(gaining) - set(_pairs(kept))) if losing else []
            writers.write_gold(rows, path, dynamic=True)
            folders = gone.where(_within(emptied)).select("folder").distinct() if emptied else gone.limit(0)
            for row in folders.toLocalIterator():
                scans.delete(spark, row.folder)
    if files:
        _note(unseen, path)
    spark.catalog.refreshByPath(path)
    return touched


def _meetings(stored: DataFrame, fresh: DataFrame, by: str) -> DataFrame:
    """Stored rows whose key is among the fresh ones, by key, source and partition, and whether they stay."""
    place = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("folder")
    score = "data_completeness_score"
    old = stored.select(*enrich.DEDUP_KEYS, "source", *_PARTS, score, place)
    new = fresh.select(*[F.col(c).alias(f"new_{c}") for c in (*enrich.DEDUP_KEYS, "source", score)])
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in enrich.DEDUP_KEYS]
    before = enrich.source_rank() <= enrich.source_rank(source="new_source")
    if by == "completeness":
        before = (F.col(score) > F.col(f"new_{score}")) | ((F.col(score) == F.col(f"new_{score}")) & before)
    return old.join(new, same).select(*enrich.DEDUP_KEYS, "source", *_PARTS, "folder", before.alias("stays"))


def _pairs(rows: DataFrame) -> list[tuple[str, int]]:
    """Partitions of rows: as many as the table has folders, which the driver lists anyway."""
    return [(row[0], row[1]) for row in rows.select(F.coalesce(_PARTS[0], F.lit("")), _PARTS[1]).distinct().toLocalIterator()]


def _within(pairs: list[tuple[str, int]]) -> Column:
    """Condition on partition columns alone, which prunes the scan."""
    found, years = F.lit(False), {}
    for country, year in pairs:
        years.setdefault(year, []).append(country)
    for year, countries in years.items():
        found = found | ((F.col("year") == year) & F.col("source_country").isin(*countries))
    return found


def build_facts(gold: DataFrame, folder: str, years: list[int] | None = None) -> aggregates.Facts:
    """Write the partial aggregates by year, all or those of some years; returns scans of the whole. They don't need each other,
    so their jobs run side by side."""
    spark = gold.sparkSession
    rows = gold if years is None else gold.where(F.col("year").isin(*years))
    left = None if years is None else {row[0] for row in rows.select("year").distinct().toLocalIterator()}

    def write(name: str, fact: DataFrame) -> DataFrame:
        path = f"{folder}/facts/{name}"
        writers.write_facts(fact, path, dynamic=years is not None)
        for year in sorted(set(years or ()) - (left or set())):
            scans.delete(spark, f"{path}/year={year}")
        return spark.read.schema(fact.schema).parquet(path)

    return aggregates.Facts(*_side_by_side([(write, name, fact) for name, fact in aggregates.facts(rows)._asdict().items()]))


def _side_by_side(calls: list[tuple]) -> list:
    """Results of calls that each run Spark jobs, in order."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(call, *given) for call, *given in calls]]


def build_aggregates(gold: DataFrame, folder: str, years: list[int] | None = None) -> dict[str, str]:
    """Write the facts, all or those of ``years``, and from them the aggregate tables."""
    found = build_facts(gold, folder, years)
    paths = {name: f"{folder}/{name}.parquet" for name in aggregates.AGGREGATES}
    _side_by_side([(lambda build, path: writers.write_table(build(found), path), build, paths[name]) for name, build in aggregates.AGGREGATES.items()])
    return paths


def refresh(spark: SparkSession, silver_root: str, path: str, folder: str, as_of: str, by: str = "source") -> dict[str, str]:
    """Unified table and aggregate tables brought up to date; facts are computed for the years that changed."""
    touched = refresh_unified(spark, silver_root, path, as_of, by)
    whole = not scans.exists(spark, f"{folder}/facts/values")
    return build_aggregates(scans.gold(spark, path), folder, None if whole else sorted({year for _, year in touched}))


def build_reports(gold: DataFrame, folder: str) -> dict[str, str]:
    """Write identity, coverage and validation reports as JSON."""
    reports = {
        "deduplication": quality.identity_report(gold),
        "coverage": quality.coverage_report(gold),
        "validation": quality.validation_report(gold),
        "overview": profile.gold_overview(gold),
    }
    paths = {}
    for name, report in reports.items():
        paths[name] = f"{folder}/{name}"
        writers.write_report(report, paths[name], mode="overwrite")
    return paths
