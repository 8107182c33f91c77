"""Shared folder, written steps, Arrow batches and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from depotlens.session import scratch_dir

from .textops import mixed

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{scratch_dir(spark)}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read again if an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_at = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Remove written steps that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that are gone."""
    spark.sparkContext._jvm.System.gc()


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose text adds up to about ``most`` bytes, so that work arrays stay small.

    A text longer than that comes alone. No text is cut.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        ends = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        begin, base = 0, 0
        for i in range(batch.num_rows):
            if ends[i] - base > most and i > begin:
                yield batch.slice(begin, i - begin)
                begin, base = i, ends[i - 1]
        if begin < batch.num_rows:
            yield batch.slice(begin)


ARROW_ROWS = 2_000


def _giving_back(function: Callable) -> Callable:
    """``function``, whose worker hands what it has freed back to the system when a task ends.

    Spark keeps workers for later tasks. What the largest task took would else stay with them while other stages run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, whose heap numpy's arrays are on
        if trim is not None:
            trim(0)

    return run


def arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as texts make rows long: the session's limit is lowered, never raised."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(_giving_back(function), schema)


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join between two Python steps: never by broadcast, so that a shuffle stands between the steps.

    In one stage both would have a worker for every running task. Spark hands idle workers out in turn and keeps them, so
    each of them would fill with what later steps cache.
    """
    return df.hint("merge")


BLOOM_BITS = 1 << 24


def _bloom_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of two positions per key."""
    h = mixed(keys.view(np.uint64))
    places = np.concatenate([h, h >> np.uint64(32)]) & np.uint64(BLOOM_BITS - 1)
    return (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63))


def _bloom_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    for batch in batches:
        at, bits = _bloom_places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        np.bitwise_or.at(words, at, bits)
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["word", "bits"])


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of longs, of a fixed 2 MB whatever the number of keys: for use in tasks before a shuffle.

    Keys it lets through in error cost work in the join that follows, never a wrong row.
    """
    found = arrow(keys, _bloom_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def perhaps_in(words: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which keys the filter lets through; null never."""
    known = keys.is_valid().to_numpy(zero_copy_only=False)
    at, bits = _bloom_places(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    both = ((words[at] & bits) != 0).reshape(2, -1)
    return both[0] & both[1] & known


def sifted(df: DataFrame, words: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose first column the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(perhaps_in(words, batch.column(0))))

    return arrow(df, run, df.schema)


def _smaller_ends(links: DataFrame, strict: bool) -> DataFrame:
    """One half step: every vertex hands its smallest known vertex to its neighbours.

    With ``strict`` only larger neighbours are told (and the vertex itself is not), else the smaller ones and itself.
    """
    if strict:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = both.join(least, "u")
    if strict:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every vertex of ``links`` (u > v) either names one smaller vertex or is named by others."""
    ends = links.select(F.col("u").alias("vertex"), F.lit(1).alias("names"), F.lit(0).alias("named"))
    ends = ends.union(links.select(F.col("v").alias("vertex"), F.lit(0).alias("names"), F.lit(1).alias("named")))
    by = ends.groupBy("vertex").agg(F.sum("names").alias("names"), F.max("named").alias("named"))
    return by.where("names > 1 OR (names = 1 AND named = 1)").isEmpty()


def contracted(links: DataFrame, name: str = "components", steps: int | None = None) -> DataFrame:
    """Written pairs (u > v) with the components of ``links`` (u, v, longs; read once): stars around the smallest vertices.

    Alternating star contraction: a logarithmic number of rounds in practice, each of plain groupings and joins that
    pre-aggregate on the map side. Every round is a written table, so a lost executor repeats one round at most. With
    ``steps`` it ends after so many rounds, whether stars or not: the pairs still have the same components.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while steps != 0 if steps is not None else not _all_stars(now):
        step = written(_smaller_ends(_smaller_ends(now, True), False), name)
        dropped(now)
        now = step
        steps = None if steps is None else steps - 1
    return now


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``vertex``, ``component`` of every vertex in ``links`` (u, v, longs): the smallest reachable vertex."""
    now = contracted(links, name)
    found = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return found.union(roots)
