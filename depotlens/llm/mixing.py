"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a budget in words. Whole copies of a source are free of choice: a budget of 1.3 times the source
takes every document once and needs 0.3 of its words again. Which documents these are is decided by a hash of the
document: sizes are summed by source and hash bucket, the bucket in which the budget runs out is found from the sums,
and only that bucket is split again, until it is a single hash value. A document is taken if its hash lies below its
source's threshold, so nothing is sorted, no document is compared with another, and a larger budget takes a superset.

Nulls and empties: a null text has size 0; a null source is a source of its own, last in order; a null doc_id hashes as
the empty string. Rows with equal doc_id share one hash and are taken together. An empty table gives an empty mix.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, dropped, written

HASH_DIGITS = 15  # hex digits of the hash that are used: 60 bits
STEP_DIGITS = 3  # that each round looks at: 4,096 buckets


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, seed: str) -> Column:
    """A hash of the document's id as hex digits; text order is number order."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, HASH_DIGITS)


def budgets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], percent: int, most: int) -> dict[str | None, float]:
    """Words to take of each source: ``percent`` of all words, dealt by weight, at most ``most`` times a source.

    Sources in order of their names, null last, have the weights in turn. What a full source can't take is dealt
    again among the others by weight, until none is above its limit. Exact fractions until the end.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    limit = {name: Fraction(most * size) for name, size in order}
    left = Fraction(percent * sum(size for _, size in order), 100)
    target: dict[str | None, Fraction] = {}
    open_ = [name for name, _ in order]
    while open_:
        share = left / sum(weight[n] for n in open_)
        full = [n for n in open_ if weight[n] * share >= limit[n]]
        if not full:
            target |= {n: weight[n] * share for n in open_}
            break
        target |= {n: limit[n] for n in full}
        left -= sum(limit[n] for n in full)
        open_ = [n for n in open_ if n not in target]
    return {n: float(x) for n, x in target.items()}


def budget_table(sized: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``source``, ``source_size``, ``target``: one row per source."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).collect()  # one row per source
    target = budgets([(r["source"], r["source_size"]) for r in totals], weights, percent, most)
    columns = {
        "source": pa.array([r["source"] for r in totals], pa.string()),
        "source_size": pa.array([r["source_size"] for r in totals], pa.int64()),
        "target": pa.array([target[r["source"]] for r in totals], pa.float64()),
    }
    return spark.createDataFrame(pa.table(columns))  # a list of rows would start Python workers of its own kind


def thresholds(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """``source``, ``copies``, ``below``: every document is taken ``copies`` times and once more if its hash is at most ``below``.

    ``sized`` (source, size, hash) is read once per round, and after the first only in the boundary buckets. The last
    hash value is taken too if that leaves the sum nearer to the budget.
    """
    # Without words there is nothing to meet: the source is taken as it is, no copies more.
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    now = budget.select("source", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("rest"), F.lit("").alias("prefix"))
    done = None
    along = Window.partitionBy("source").orderBy("bucket")
    for digits in range(STEP_DIGITS, HASH_DIGITS + 1, STEP_DIGITS):
        bucket = F.expr(f"left(hash, {digits})").alias("bucket")
        if done is None:
            counted = sized.groupBy("source", bucket).agg(F.sum("size").alias("size"))
            sums = counted.alias("d").join(now.alias("t"), F.expr("d.source <=> t.source"))
            sums = sums.select("d.source", "copies", "rest", "bucket", "size")
        else:
            same = F.expr(f"d.source <=> t.source AND left(d.hash, {digits - STEP_DIGITS}) = t.prefix")
            inside = sized.alias("d").join(now.alias("t"), same)
            sums = inside.groupBy("d.source", "copies", "rest", bucket).agg(F.sum("size").alias("size"))
        ranked = sums.withColumn("upto", F.sum("size").over(along)).withColumn("next", F.lead("bucket").over(along))
        # The boundary is the first bucket with which the sum exceeds the rest; else all of it is taken.
        over = F.col("upto") > F.col("rest")
        edge = ranked.where(over).groupBy("source", "copies", "rest").agg(F.min(F.struct("bucket", "upto", "size")).alias("edge"))
        within = ranked.where(~over).groupBy("source", "copies", "rest").agg(F.max(F.struct("bucket", "upto")).alias("within"))
        both = within.alias("w").join(edge.alias("e"), F.expr("w.source <=> e.source"), "full").select(
            F.coalesce("w.source", "e.source").alias("source"), F.coalesce("w.copies", "e.copies").alias("copies"),
            F.coalesce("w.rest", "e.rest").alias("rest"), "within", "edge",
        )
        both = written(both, "thresholds")
        # Hashes up to the last whole bucket are below the threshold; "g" stands after every hex digit.
        reached = F.when(F.col("within").isNotNull(), F.concat(F.col("within.bucket"), F.lit("g")))
        found = both.select("source", "copies", reached.alias("below"), F.lit(digits).alias("round"))
        done = found if done is None else done.unionByName(found)
        now = both.where("edge IS NOT NULL").select(
            "source", "copies", (F.col("rest") - F.coalesce("within.upto", F.lit(0))).alias("rest"), F.col("edge.bucket").alias("prefix")
        )
        last = both.where("edge IS NOT NULL").select(
            "source", "copies",
            F.when(2 * (F.col("rest") - F.coalesce("within.upto", F.lit(0))) >= F.col("edge.size"), F.concat(F.col("edge.bucket"), F.lit("g"))).alias("below"),
            F.lit(digits + 1).alias("round"),
        )
    # The threshold of the deepest round that has one is the highest: later rounds look inside the bucket above it.
    return done.unionByName(last).groupBy("source").agg(F.first("copies").alias("copies"), F.max("below").alias("below"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source and more) with ``size``, ``source_size``, ``target`` and ``copies`` to take."""
    own = docs.drop("size", "source_size", "target", "copies", "hash")
    sized = own.select("source", words_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), seed).alias("hash"))
    sized = written(sized, "sizes")
    budget = budget_table(sized, weights, percent, most)
    edges = budget.alias("b").join(thresholds(sized, budget).alias("t"), F.expr("b.source <=> t.source"), "left")
    edges = edges.select(
        F.col("b.source").alias("of_source"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("whole"), "below"
    )
    edges = written(edges, "edges")  # one row per source, small enough to be sent to the documents
    dropped(sized)
    marked = own.withColumn("size", words_of(F.col("text"))).withColumn("hash", hash_of(F.col("doc_id"), seed))
    out = marked.join(edges, F.col("source").eqNullSafe(F.col("of_source")))
    again = F.when((F.col("hash") < F.col("below")) & (F.col("size") > 0), 1).otherwise(0)
    return out.withColumn("copies", (F.col("whole") + again).cast("long")).drop("hash", "of_source", "whole", "below")


def taken(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    out = mixed(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), **settings)
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
