"""Build, gate, publish and open a warehouse folder.

Every build is a folder of its own, numbered, below ``builds``; nothing that was written
is overwritten, so a served build stays whole while the next is made. The verdict lies
in the build it is about. Readers get the newest build whose verdict is ok.

Order lines, deliveries, returns and inventory are partitioned by month, so a period
reads its months only. Rows are rebalanced by month before the write: adaptive execution
splits a month that outgrows a file and merges small ones, so a month with a third of all
rows is written by many tasks. Order lines and deliveries are bucketed by order as well
(``copartition``), and sums by month are kept for the metrics (``monthly``).

A large fact is written slice by slice, and the shuffle files of a slice go before the next
begins: a build then needs disk for its tables and a few slices, not for all shuffles of all
tables. The sources of a sliced fact are read once per slice, so only files are sliced.
"""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from threading import Lock
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import dates as D
from ..operators import quality
from ..session import CODEC, file_bytes, folder_exists, shuffles_removed, written_once
from . import copartition, monthly
from .star import BUCKETED, DIMENSION_TABLES, FACT_TABLES, LAYOUT, SCHEMAS, LazyStar, Slice, Sources, StoredStar

MONTH_OF = {
    "fact_order_lines": "order_date",
    "fact_deliveries": "dispatch_datetime",
    "fact_returns": "return_date",
    "fact_freight": "invoice_date",
    "fact_inventory_snapshot": "snapshot_date",
}
BUILDS, VERDICT, REPORT, CLAIM, OBSERVED = "builds", "_verdict", "_quality_report", "_claimed", "_observed"
OBSERVED_COLUMNS = "table_name string, aggregates string, observed map<string, bigint>"
CONCURRENT_WRITES, CONCURRENT_CHECKS = 4, 2

# Facts written in slices: the key that deals out their rows and orders their files, and the sources cut by it. A slice of order lines or
# deliveries holds whole buckets if it can. Slices are of SLICE_BYTES of files, at most MOST_SLICES.
SLICED = {
    "fact_order_lines": ("order_id", ("order_lines", "orders")),
    "fact_deliveries": ("order_id", ("deliveries", "orders")),
    "fact_returns": ("order_line_id", ("returns_credit_notes", "order_lines")),
    "fact_freight": ("invoice_id", ("freight",)),
    "fact_inventory_snapshot": ("snapshot_id", ("inventory_snapshots",)),
}
SLICE_BYTES, MOST_SLICES = 8 << 20, 8


class WarehouseNotChecked(Exception):
    """No build of the warehouse went through its gate and passed."""


def write_table(
    df: DataFrame, path: str, day: str | None = None, seen: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "error",
    order: str | None = None,
) -> None:
    """Write one table, partitioned by the month of ``day`` if given, with the files of a month ordered by ``order``.

    ``seen`` may observe the rows as they are written.
    """
    if day is None:
        seen(df).write.mode(mode).parquet(path, compression=CODEC)
        return
    month = f"{day}_month"
    placed = seen(df.withColumn(month, D.month_key(F.col(day))).hint("rebalance", F.col(month)))
    # The writer orders rows by month in any case; near ids share their first digits, so a file of ids in order is smaller.
    placed = placed if order is None else placed.sortWithinPartitions(month, order)
    placed.write.mode(mode).partitionBy(month).parquet(path, compression=CODEC)


def write_observed(parts: list[DataFrame], path: str, name: str, order_buckets: int, **bounds) -> quality.Observed:
    """Write one table of the star, part after part; what the gate counts in it is counted by the writing tasks.

    The rows are observed behind the last shuffle, where Spark takes the count of each task once, however often it ran.
    """
    aggregates = quality.table_aggregates(name, **bounds)
    total: Counter = Counter()
    for i, df in enumerate(parts):
        observation, mode = Observation(), "append" if i else "error"

        def seen(placed: DataFrame) -> DataFrame:
            return placed.observe(observation, *aggregates)

        if name in BUCKETED and order_buckets:
            copartition.write(df, path, BUCKETED[name], order_buckets, seen=seen, mode=mode)
        else:
            write_table(df, path, MONTH_OF.get(name), seen, mode, SLICED[name][0] if name in SLICED else None)
        total.update(observation.get)  # all of them counts, so parts add up
    return quality.Observed(quality.text_of(aggregates), dict(total))


def slices(landed: Sources, name: str, most: int = MOST_SLICES) -> int:
    """How many slices a fact is written in: a power of two, 1 where a source is no file or keys differ in type."""
    if name not in SLICED:
        return 1
    key, sources = SLICED[name]
    found = [df for df in (getattr(landed, s) for s in sources) if df is not None]
    sizes = [file_bytes(df) for df in found]
    if not found or None in sizes or len({df.schema[key].dataType.simpleString() for df in found}) > 1:
        return 1
    n = 1
    while n < most and n * SLICE_BYTES < max(sizes):
        n *= 2
    return n


def _parts(landed: Sources, name: str, whole: DataFrame, **star_options) -> list[DataFrame]:
    n = slices(landed, name)
    if n == 1:
        return [whole]
    key, sources = SLICED[name]
    return [LazyStar(Slice(landed, sources, key, n, i), **star_options).table(name) for i in range(n)]


def _numbers(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the builds below ``out``, newest first."""
    base = f"{out.rstrip('/')}/{BUILDS}"
    if not folder_exists(spark, base):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit()), reverse=True)


def _claimed(spark: SparkSession, out: str) -> str:
    """The folder of a new build. Its claim file is created by one builder only; others take the next number."""
    number = max(_numbers(spark, out), default=0)
    while True:
        number += 1
        folder = f"{out.rstrip('/')}/{BUILDS}/{number:08d}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{CLAIM}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(p):
            return folder


def build(landed: Sources, out: str, order_buckets: int = 4, bounds: dict | None = None, **star_options) -> StoredStar:
    """Write every table of the star as a new build below ``out``. It is not served before ``gate``.

    ``order_buckets`` should be about the number of tasks that a join of all lines deserves; 0 leaves the buckets out.
    ``bounds`` are those the gate will be given; under others it counts again the tables that they concern.
    """
    with shuffles_removed(landed.spark):
        return _build(landed, out, order_buckets, bounds, **star_options)


def _build(landed: Sources, out: str, order_buckets: int, bounds: dict | None, **star_options) -> StoredStar:
    spark = landed.spark
    lazy = LazyStar(landed, **star_options)
    base = _claimed(spark, out)
    names = DIMENSION_TABLES + FACT_TABLES
    frames = {name: lazy.table(name) for name in names}
    parts = {name: _parts(landed, name, frames[name], **star_options) for name in names}
    one_sliced = Lock()

    def write(name: str) -> quality.Observed:
        with one_sliced if len(parts[name]) > 1 else nullcontext():
            return write_observed(parts[name], f"{base}/{name}", name, order_buckets, **(bounds or {}))

    # The tables do not depend on each other; a few writes at a time keep the cluster busy through the tail of each.
    # Tables large enough for slices do so by themselves and go one after another, which is less on disk at a time.
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        seen = list(pool.map(write, names))
    observed = [(n, o.aggregates, o.values) for n, o in zip(names, seen)]
    spark.createDataFrame(observed, OBSERVED_COLUMNS).coalesce(1).write.parquet(f"{base}/{OBSERVED}")  # one row per table
    # A partitioned table without rows holds no file that could tell its columns.
    schemas = [(n, _stored_schema(frames[n], MONTH_OF.get(n)).json()) for n in names]
    spark.createDataFrame(schemas, "table_name string, schema string").coalesce(1).write.parquet(f"{base}/{SCHEMAS}")
    star = StoredStar(spark, base)
    if order_buckets:
        shares = [copartition.largest_share(star.table(n), order_buckets).withColumn("table_name", F.lit(n)) for n in BUCKETED]
        shares = shares[0].unionByName(shares[1]).withColumn("buckets", F.lit(order_buckets))
        shares.coalesce(1).write.parquet(f"{base}/{LAYOUT}")  # one row per table
        star = StoredStar(spark, base)
    monthly.refresh(star, f"{out.rstrip('/')}/{monthly.FOLDER}")
    return star


def _stored_schema(df: DataFrame, day: str | None):
    return df.schema if day is None else df.withColumn(f"{day}_month", D.month_key(F.col(day))).schema


def tables_found(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The expected tables that exist below ``path`` (a listing, no job)."""
    return tuple(n for n in quality.EXPECTED_TABLES if folder_exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS"))


def observed_of(star: StoredStar) -> dict[str, quality.Observed]:
    """What was counted of each table while the build was written; nothing for builds that did not count."""
    if not folder_exists(star.spark, f"{star.path}/{OBSERVED}/_SUCCESS"):
        return {}
    rows = star.spark.read.parquet(f"{star.path}/{OBSERVED}").collect()  # one row per table
    return {r["table_name"]: quality.Observed(r["aggregates"], r["observed"]) for r in rows}


def report(star: StoredStar, **bounds) -> DataFrame:
    """The checks of a build. Counts, NULL keys, ranges and domains are those its writes observed."""
    return quality.report(star, tables=tables_found(star.spark, star.path), observed=observed_of(star), **bounds)


def gate(star: StoredStar, landed: Sources | None = None, **bounds) -> DataFrame:
    """Check the tables of a build (and the sources, if given), write its verdict, return the report.

    Keys and references are checked a few at a time, as each shuffles the keys of a table.
    """
    with shuffles_removed(star.spark):
        parts = quality.report_parts(star, tables=tables_found(star.spark, star.path), observed=observed_of(star), **bounds)
        if landed is not None:
            rejected = quality.rejected_report(landed)
            parts += quality.source_parts(landed) + ([] if rejected is None else [rejected])
        with ThreadPoolExecutor(CONCURRENT_CHECKS) as pool:
            rows = [r for found in pool.map(DataFrame.collect, parts) for r in found]  # one row per check
    report_path = f"{star.path}/{REPORT}"
    star.spark.createDataFrame(rows, parts[0].schema).coalesce(1).write.mode("overwrite").parquet(report_path)
    checks = star.spark.read.parquet(report_path)
    quality.verdict(checks).write.mode("overwrite").parquet(f"{star.path}/{VERDICT}")
    return checks


def verdict_of(spark: SparkSession, build_path: str) -> tuple[str, str]:
    """Status and failed checks of a build; ``missing`` if it never went through the gate."""
    if not folder_exists(spark, f"{build_path}/{VERDICT}/_SUCCESS"):
        return "missing", "the build never went through its gate"
    row = spark.read.parquet(f"{build_path}/{VERDICT}").first()
    return row["status"], row["failed_checks"]


def open_checked(spark: SparkSession, path: str) -> StoredStar:
    """The newest build below ``path`` whose verdict is ok; refused if there is none."""
    seen = []
    for number in _numbers(spark, path):
        folder = f"{path.rstrip('/')}/{BUILDS}/{number:08d}"
        status, detail = verdict_of(spark, folder)
        if status == "ok":
            return StoredStar(spark, folder)
        seen.append(f"build {number} {status} ({detail})")
    raise WarehouseNotChecked(f"{path}: {'; '.join(seen) or 'missing'}")


def counts(star: StoredStar) -> DataFrame:
    """The manifest of a build as it is now, written beside nothing: rows that a later manifest can be compared with."""
    return written_once(quality.manifest(star))
