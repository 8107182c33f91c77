"""Facts laid out by a common key, so that joins and sums on it shuffle nothing.

A table is partitioned by month and, within a month, bucketed by ``order_id``: order lines and
deliveries of one order lie under the same bucket number in both. Rows are rebalanced by month
and bucket before the write, so a month's bucket that outgrows a file is written by several
tasks, and an order with a third of all lines makes many files. A bucket is read by one task,
though. So the build counts the rows of every bucket, and where one holds far more than its
share, readers leave the layout alone and shuffle, where adaptive execution can split it.

Spark knows buckets of tables in its catalog only. A build's tables are defined there, under a
name made of their path, by the session that opens it; the files stay where they are.
"""

from __future__ import annotations

from hashlib import sha256
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import dates as D
from ..session import CODEC

KEY = "order_id"
# A bucket may hold this many times its share of the rows; a third of all rows in one order is more for 12 buckets on.
MOST_SHARE = 4


def table_name(path: str) -> str:
    return f"depotlens_{sha256(path.encode()).hexdigest()[:24]}"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket Spark files a row under."""
    return F.pmod(F.hash(key), F.lit(buckets))


def write(
    df: DataFrame, path: str, day: str, buckets: int, key: str = KEY, seen: Callable[[DataFrame], DataFrame] = lambda df: df,
    mode: str = "error",
) -> None:
    """Write ``df`` below ``path``, partitioned by the month of ``day``, bucketed and ordered by ``key``; ``mode`` may append to it.

    ``seen`` may observe the rows as the writing tasks get them.
    """
    month = f"{day}_month"
    placed = df.withColumns({month: D.month_key(F.col(day)), "_bucket": bucket_of(key, buckets)})
    (
        seen(placed.hint("rebalance", F.col(month), F.col("_bucket")).drop("_bucket"))
        .write.mode(mode)
        .partitionBy(month)
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .option("compression", CODEC)
        .saveAsTable(table_name(path))
    )


def read(spark: SparkSession, path: str, schema: StructType, day: str, buckets: int, key: str = KEY) -> DataFrame:
    """The table below ``path``, with its buckets known to the planner."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        where = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (`{day}_month`) "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def largest_share(df: DataFrame, buckets: int, key: str = KEY) -> DataFrame:
    """One row ``(share)``: the rows of the largest bucket, in times an even share. A hot key is counted before the shuffle."""
    sizes = df.groupBy(bucket_of(key, buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") * F.lit(float(buckets)) / F.sum("n")).alias("share"))
