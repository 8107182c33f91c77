"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CODEC = "zstd"  # of a warehouse: half the size of its tables is ids, which the default codec hardly makes smaller
_local_scratch: dict[str, str] = {}
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_removing: Counter = Counter()
_were: dict[str, str | None] = {}
_lock = Lock()


def local_session(cpus: int | str = "*", app: str = "depotlens", memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    partitions = str(cpus) if str(cpus).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost a round trip per column
        .config("spark.sql.shuffle.partitions", partitions)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it (tests); a cluster that names no shared
    folder is an error, since a machine-local one would not survive a lost executor.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="depotlens-")
    return _local_scratch[app]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries planned in this block go when their query ends.

    Without it they stay until the driver happens to collect its garbage, which may be after all queries of a long job.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _removing[session]:
            _were[session] = spark.conf.get(REMOVE_SHUFFLES, None)
            spark.conf.set(REMOVE_SHUFFLES, "true")
        _removing[session] += 1
    try:
        yield
    finally:
        with _lock:
            _removing[session] -= 1
            if not _removing[session]:
                was = _were.pop(session)
                spark.conf.unset(REMOVE_SHUFFLES) if was is None else spark.conf.set(REMOVE_SHUFFLES, was)


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` is read from; None if any of it is of unknown size (a query of a database, an RDD)."""
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return None if any(n >= unknown for n in sizes) else sum(sizes)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as a table in the scratch folder, for results that a plan needs several times.

    Computed once, and read back from shared storage when an executor is lost.
    """
    path = f"{scratch_dir(df.sparkSession)}/step-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p, store = _folder(spark, path)
    return store.exists(p)


def folder_names(spark: SparkSession, path: str, start: str = "") -> list[str]:
    """Names in a folder that begin with ``start``; none if there is no folder."""
    p, store = _folder(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(p)] if store.exists(p) else []
    return sorted(n for n in names if n.startswith(start))


def remove_folder(spark: SparkSession, path: str) -> None:
    p, store = _folder(spark, path)
    store.delete(p, True)


def text_once(spark: SparkSession, path: str, text: str) -> str:
    """The text of a small file, which is created with ``text`` by the first who asks."""
    p, store = _folder(spark, path)
    if not store.exists(p):
        try:
            out = store.create(p, False)
        except Exception:  # another was first
            if not store.exists(p):
                raise
        else:
            out.write(bytearray(text.encode()))
            out.close()
    kept = store.open(p)
    try:
        return bytes(kept.readAllBytes()).decode()
    finally:
        kept.close()
