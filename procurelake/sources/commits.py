"""Commit log of a table that is written in batch folders, for loads that may run at the same time.

Entry ``n`` of the log is a file that is created only if it is not there yet: of two loads that want to be the next one, one is, and
the other looks again. A batch folder counts once its entry is there. The store must rename without
overwriting in one step, as HDFS does; where it can't, loads into one table run one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOG, BATCH = "_commits", "batch"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/{LOG}"


def _names(spark: SparkSession, path: str) -> list[str]:
    store = _store(spark, path)
    return [s.getPath().getName() for s in store.listStatus(_path(spark, path))] if store.exists(_path(spark, path)) else []


def folders(spark: SparkSession, path: str) -> set[str]:
    """Batches that have a folder, committed or not."""
    return {n.removeprefix(f"{BATCH}=") for n in _names(spark, path) if n.startswith(f"{BATCH}=")}


def entries(spark: SparkSession, path: str, after: int = 0) -> list[tuple[int, str]]:
    """Number and batch of the entries past ``after``, in order: one per load."""
    numbers = sorted(int(n) for n in _names(spark, _log(path)) if n.isdigit() and int(n) > after)
    found = []
    for number in numbers:
        stream = _store(spark, path).open(_path(spark, f"{_log(path)}/{number:010d}"))
        try:
            found.append((number, bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
    return found


def begin(spark: SparkSession, path: str) -> int:
    """Number of the last entry. A table without a log gets one, in which its batches so far are committed."""
    if not _store(spark, path).exists(_path(spark, _log(path))):
        before = folders(spark, path)
        _store(spark, path).mkdirs(_path(spark, _log(path)))
        for number, batch in enumerate(sorted(before), 1):
            claim(spark, path, number, batch)
    return max((number for number, _ in entries(spark, path)), default=0)


def claim(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Whether ``batch`` became entry ``number``; not if another load was faster."""
    target, own = _path(spark, f"{_log(path)}/{number:010d}"), _path(spark, f"{_log(path)}/.{batch}")
    store = _store(spark, path)
    # the entry appears with its content: a file of its own is renamed, which fails where one is there
    out = store.create(own, True)
    out.write(bytearray(batch.encode()))
    out.close()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(own, target, options)
        return True
    except Exception as error:
        store.delete(own, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise


def committed(spark: SparkSession, path: str) -> set[str] | None:
    """Batches in the log; None for a table without one, of which all files count. Ask before the files are listed."""
    if not _store(spark, path).exists(_path(spark, _log(path))):
        return None
    return {batch for _, batch in entries(spark, path)}


def hidden(spark: SparkSession, path: str, known: set[str] | None) -> list[str]:
    """Batches with a folder that were not committed. Ask after the files are listed."""
    return [] if known is None else sorted(folders(spark, path) - known)


def counts(file: Column, hidden_: list[str]) -> Column:
    """Whether a file counts, by its path."""
    return ~F.regexp_extract(file, f"/{BATCH}=([^/]+)/", 1).isin(*hidden_) if hidden_ else F.lit(True)
