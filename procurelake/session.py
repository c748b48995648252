"""Session builder and the shared scratch folder used for written intermediates."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Of what is written to be read again soon, the disk it takes counts.
STAGED_COMPRESSION = "zstd"
_LOCAL_FOLDERS: dict[str, str] = {}
_TRIED: set[tuple[str, str]] = set()
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


def build_session(app: str = "procurelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if (master or "").startswith("local"):
        # Without its native library Hadoop starts a process for each local file it makes, so side files with checksums
        # double the price of every written partition; stores of a cluster are not concerned.
        builder = builder.config("spark.hadoop.fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    On a cluster it may be a path of the machines' file systems, such as a mount they share; whether they do
    is tried once, and a folder that is each machine's own is refused. A local session without that setting
    gets a temporary folder; a cluster session without it is refused, since executors could not read a local one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        folder = configured.rstrip("/")
        if not spark.conf.get("spark.master", "").startswith("local") and _is_local(spark, folder):
            _try_shared(spark, folder)
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="procurelake-")
    return _LOCAL_FOLDERS[app]


def _is_local(spark: SparkSession, path: str) -> bool:
    """Whether a path, one without a scheme on the default file system, lies on the machine's own disk."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return store.getUri().getScheme() == "file"


def _try_shared(spark: SparkSession, folder: str) -> None:
    """Refuse a folder that loses rows which executors write for the driver and for each other; once per application."""
    tried = (spark.sparkContext.applicationId, folder)
    if tried in _TRIED:
        return
    path, tasks = f"{folder}/trial-{uuid.uuid4().hex}", 2 * max(2, spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        if spark.read.schema("id bigint").parquet(path).count() != tasks:
            raise RuntimeError("spark.checkpoint.dir is a folder of each machine; executors of a cluster need a shared one")
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _TRIED.add(tried)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    filesystem = target.getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.mkdirs(target)
    filesystem.deleteOnExit(target)
    return path


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside the block go when that write is done, not when the driver happens to collect its garbage.

    What was written is read from its files afterwards, so nothing needs them. Blocks of several threads may overlap.
    """
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        users, before = _FREEING.get(session, (0, spark.conf.get(_FREE_SHUFFLES, "false")))
        _FREEING[session] = users + 1, before
        spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _LOCK:
            users, before = _FREEING.pop(session)
            if users > 1:
                _FREEING[session] = users - 1, before
            else:
                spark.conf.set(_FREE_SHUFFLES, before)


def staged(df: DataFrame, label: str = "staged", **options: str) -> DataFrame:
    """``df`` written once below the shared folder, with ``options`` of the writer, and read back.

    For inputs that several steps read and that are dear to compute, such as parsed
    JSON. The written table outlives lost executors, and each step reads its columns only.
    """
    path = f"{scratch_path(df.sparkSession, label)}/rows"
    with shuffles_freed(df.sparkSession):
        df.write.options(**({"compression": STAGED_COMPRESSION} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staging(df: DataFrame, label: str = "staged") -> Iterator[DataFrame]:
    """``df`` staged for the steps inside the block; its folder goes when the block ends, done or failed."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        with shuffles_freed(spark):
            df.write.option("compression", STAGED_COMPRESSION).parquet(f"{path}/rows")
        yield spark.read.schema(df.schema).parquet(f"{path}/rows")
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
