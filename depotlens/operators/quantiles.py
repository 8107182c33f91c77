"""Exact quantile that never sorts or gathers a whole column in one task.

The built-in exact percentile keeps a map of all distinct values in one buffer. Here
values are counted first and put into BINS bins, a histogram finds the bins that hold the
wanted ranks, and only the distinct values of those bins are put in order. Bin edges are
approximate quantiles of the distinct values, so bins stay about equally full however
clustered the values are or how far out the extremes lie; the result does not depend on
where exactly the edges are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written_once

BINS = 256


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``(n_values, quantile)``: linear interpolation between the two nearest ranks."""
    if not 0 <= q <= 1:
        raise ValueError("q must be within 0..1")
    # Needed by the edges, the histogram and the final step: computed once.
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values = written_once(counted)

    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    stats = values.agg(
        F.percentile_approx("v", shares, 10000).alias("edges"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"),
        ((F.sum("n") - 1) * F.lit(q)).alias("position"),
    )
    s = stats.select(F.struct("*").alias("s")).scalar()
    upto = F.filter("edges", lambda e: e <= F.col("v"))
    binned = values.withColumn("edges", s["edges"]).withColumn("bin", F.size(upto)).drop("edges")

    # At most BINS rows come into this window.
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        binned.groupBy("bin").agg(F.sum("n").alias("n"))
        .withColumn("before", F.sum("n").over(running) - F.col("n"))
    )
    below, above = F.floor(s["position"]), F.ceil(s["position"])

    def holds(rank):
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    wanted = histogram.where(holds(below) | holds(above)).select("bin", "before")  # two rows at most
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        binned.join(F.broadcast(wanted), "bin")
        .withColumn("before", F.col("before") + F.sum("n").over(inside) - F.col("n"))
    )
    ends = ranked.agg(
        F.max(F.when(holds(below), F.col("v"))).alias("low"), F.max(F.when(holds(above), F.col("v"))).alias("high")
    )
    return ends.select(
        s["n_values"].alias("n_values"),
        (F.col("low") + (F.col("high") - F.col("low")) * (s["position"] - below)).alias("quantile"),
    )
