"""Findings about the data itself, computed rather than quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numeric as N
from .quantiles import exact_quantile
from .service import order_fulfilment


def full_delivery_share(star) -> DataFrame:
    """One row: order lines of any status, how many were ever delivered in full."""
    full = F.col("delivered_eaches") >= F.col("ordered_eaches")
    return star.order_lines_core.agg(
        F.count(F.lit(1)).alias("n_lines"), N.count_where(full).alias("n_full")
    ).withColumn("pct_full", N.share_pct(F.col("n_full"), F.col("n_lines"), 2))


def fulfilment_quantile(star, q: float = 0.99) -> DataFrame:
    """One row: the ``q`` quantile of order-level fulfilment, in percent."""
    pct = F.try_divide(F.lit(100.0) * F.col("delivered_eaches").cast("double"), F.col("ordered_eaches").cast("double"))
    orders = order_fulfilment(star).select(pct.alias("fulfilment_pct"))
    return exact_quantile(orders, "fulfilment_pct", q).select(
        "n_values", N.rounded(F.col("quantile"), 4).alias("fulfilment_pct")
    )


def delay_disagreement(star) -> DataFrame:
    """One row: deliveries whose recorded delay is not the one of the arrival times, also by sign."""
    minutes = F.timestamp_diff("MINUTE", F.col("planned_arrival_ts"), F.col("actual_arrival_ts"))
    d = star.deliveries.select(minutes.alias("by_clock"), "delay_minutes")
    both = F.col("by_clock").isNotNull() & F.col("delay_minutes").isNotNull()
    return d.where(both).agg(
        F.count(F.lit(1)).alias("n_deliveries"),
        N.count_where(F.col("by_clock") != F.col("delay_minutes")).alias("n_disagree"),
        N.count_where(F.signum("by_clock") != F.signum("delay_minutes")).alias("n_sign_disagrees"),
    ).withColumn("pct_disagree", N.share_pct(F.col("n_disagree"), F.col("n_deliveries"), 1))


def expiry_by_ageing_bucket(star) -> DataFrame:
    """Mean days to expiry per ageing bucket: equal means say the bucket carries nothing."""
    return (
        star.inventory.groupBy("ageing_bucket")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("days_to_expiry").alias("s"), F.count("days_to_expiry").alias("n"))
        .select("ageing_bucket", "n_rows", N.ratio(F.col("s"), F.col("n"), 1).alias("avg_days_to_expiry"))
    )


def mean_delay(star) -> DataFrame:
    d = star.deliveries.agg(F.sum("delay_minutes").alias("s"), F.count("delay_minutes").alias("n_deliveries"))
    return d.select("n_deliveries", N.ratio(F.col("s"), F.col("n_deliveries"), 1).alias("avg_delay_minutes"))


def discontinued_skus_ordered(star) -> DataFrame:
    """One row: distinct SKUs ordered after they were discontinued, and the lines."""
    return star.order_lines.where("ordered_after_discontinued").agg(
        F.countDistinct("sku_code").alias("n_skus"), F.count(F.lit(1)).alias("n_lines")
    )
