"""How delays and order fulfilment spread: quantiles by region from mergeable sketches, and their error.

A sketch of a region's month is made once and merged for any period (``plans.monthly``), so a
quantile of five years reads no fact. Sketches keep about three times ``SKETCH_SIZE`` numbers,
whatever they have seen. A quantile's rank is off by ``RANK_ERROR`` at most, in 99 of 100 cases;
up to ``SKETCH_SIZE`` values it is exact. ``quantiles.exact_quantile`` has no error, at the price
of a pass over the facts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .periods import ALL_DATA, Period
from .scope import fulfilled, in_region, one_of

SKETCH_SIZE, RANK_ERROR = 1000, 0.005
QUANTILES = (0.5, 0.95, 0.99)
DAY_OF = {"delay": "dispatch_datetime", "fulfilment": "order_date"}


def _everything() -> Column:
    return F.lit(True)


def _delays(star, period: Period, only: Column) -> DataFrame:
    return period.of(star.deliveries.where(only), "dispatch_datetime").select(
        "region_id", "dispatch_datetime", F.col("delay_minutes").cast("double").alias("value")
    )


def _fulfilment(star, period: Period, only: Column) -> DataFrame:
    """Percent of the ordered eaches that came, by order."""
    lines = period.of(star.order_lines_core.where(fulfilled() & only), "order_date")
    orders = lines.groupBy("order_id", "region_id", "order_date").agg(
        F.sum("ordered_eaches").cast("double").alias("ordered"), F.sum("delivered_eaches").cast("double").alias("delivered")
    )
    return orders.select("region_id", "order_date", F.try_divide(F.lit(100.0) * F.col("delivered"), "ordered").alias("value"))


MEASURES = {"delay": _delays, "fulfilment": _fulfilment}


def values(star, measure: str, period: Period = ALL_DATA, only: Column | None = None) -> DataFrame:
    """The measured values with region and day; ``only`` may name the months of facts to read. NULL values are left out."""
    one_of("measure", measure, MEASURES)
    found = MEASURES[measure](star, period, _everything() if only is None else only)
    return found.where(F.col("value").isNotNull())


def sketch_sums() -> tuple[Column, Column]:
    """Number of values, and their sketch: sums that merge."""
    return F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch")


def quantiles(star, measure: str, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """``region_id``, ``region_code``, ``region_name``, ``n_values``, ``p50``, ``p95``, ``p99`` by region.

    A star that keeps sketches merges them; any other makes them from facts. Regions without a value have no row.
    """
    kept = star.sketch_rows(one_of("measure", measure, MEASURES), period)
    if kept is None:
        kept = values(star, measure, period).groupBy("region_id").agg(*sketch_sums())
    merged = kept.groupBy("region_id").agg(F.sum("n").alias("n_values"), F.kll_merge_agg_double("sketch").alias("sketch"))
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in QUANTILES]))
    named = [at[i].alias(f"p{round(100 * q)}") for i, q in enumerate(QUANTILES)]
    regions = in_region(star.dim_region, star.dim_region, region_code)
    found = merged.join(regions.select("region_id", "region_code", "region_name"), "region_id")
    return found.select("region_id", "region_code", "region_name", "n_values", *named).orderBy("region_code", "region_id")


def rank_errors(star, measure: str, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """The quantiles against all values: ``measure``, ``region_code``, ``quantile``, ``n_values``, ``estimate``, ``rank_error``.

    An estimate covers the ranks from the share of values below it to the share up to it; the error is how far the wanted
    rank lies outside. Reads the facts.
    """
    names = [f"p{round(100 * q)}" for q in QUANTILES]
    found = quantiles(star, measure, period, region_code).select("region_id", "region_code", *names)
    counts = [F.count(F.lit(1)).alias("n")]
    for name in names:
        counts += [F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto")]
    by_region = values(star, measure, period).join(found, "region_id").groupBy("region_id", "region_code", *names).agg(*counts)

    def one(q: float, name: str) -> Column:
        off = F.greatest(F.lit(0.0), F.col(f"{name}_below") / F.col("n") - F.lit(q), F.lit(q) - F.col(f"{name}_upto") / F.col("n"))
        return F.struct(F.lit(q).alias("quantile"), F.col(name).alias("estimate"), off.alias("rank_error"))

    each = by_region.select("region_code", F.col("n").alias("n_values"), F.inline(F.array(*[one(q, n) for q, n in zip(QUANTILES, names)])))
    return each.select(F.lit(measure).alias("measure"), "region_code", "quantile", "n_values", "estimate", "rank_error")


def accuracy(star, period: Period = ALL_DATA, bound: float = RANK_ERROR) -> DataFrame:
    """Every measure's quantiles: whether their rank error is within ``bound``."""
    rows = reduce(DataFrame.unionByName, [rank_errors(star, m, period) for m in MEASURES])
    return rows.select("measure", "region_code", "quantile", "n_values", (F.col("rank_error") <= bound).alias("within_bound"))
