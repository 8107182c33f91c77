"""Network-wide indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numeric as N
from . import money, service
from .periods import ALL_DATA, Period


def network_kpis(
    star, month: Period = ALL_DATA, quarter: Period = ALL_DATA, region_code: str | None = None
) -> DataFrame:
    """One row: fill rate of the month; on-time, fulfilment, returns and freight of the quarter.

    All are ratios of sums, not averages of rounded group values.
    """
    fill = service.fill_rate(star, "region", month, region_code).agg(
        N.share_pct(F.sum("delivered_qty"), F.sum("ordered_qty"), 1).alias("v")
    )
    otif = service.otif_base(star, ["region_id"], quarter, region_code).agg(
        *[F.sum(c).alias(c) for c in service.OTIF_SUMS]
    )
    returned = money.returns_by_category(star, quarter, region_code)
    dispatched = money.dispatch_by_category(star, quarter, region_code)
    leak = (
        returned.join(dispatched, "category", "left")
        .agg(N.share_pct(F.sum("returned"), F.sum("dispatch"), 2).alias("v"))
    )
    freight = money.freight_and_cases(star, quarter, region_code).agg(
        N.ratio(F.sum("freight"), F.sum("delivered_cases"), 2).alias("v")
    )
    return otif.select(
        fill.scalar().alias("fill_rate_pct"),
        N.share_pct(F.col("n_on_time"), F.col("n_deliveries"), 1).alias("on_time_pct"),
        N.ratio(F.col("fulfilment_sum"), F.col("fulfilment_n"), 1).alias("avg_fulfilment_pct"),
        leak.scalar().alias("returns_pct"),
        freight.scalar().alias("freight_inr_per_case"),
    )


def money_extremes(star, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """One row: category with the largest returned value, dearest and cheapest warehouse per case."""
    leak = money.returns_leakage(star, "category", period, region_code)
    freight = money.freight_cost_per_case(star, period, region_code)
    cost = F.col("freight_inr_per_case")
    top = leak.agg(
        F.min(F.struct((-F.col("return_value_inr")).alias("neg"), F.col("dim_code").alias("code"))).alias("t")
    )
    ends = freight.agg(
        F.min(F.when(cost.isNotNull(), F.struct((-cost).alias("neg"), F.col("dim_code").alias("code")))).alias("hi"),
        F.min(F.when(cost.isNotNull(), F.struct(cost.alias("cost"), F.col("dim_code").alias("code")))).alias("lo"),
    )
    best = top.select(F.col("t.code")).scalar()
    value = top.select(-F.col("t.neg")).scalar()
    return ends.select(
        best.alias("top_return_category"),
        value.alias("top_return_value_inr"),
        F.col("hi.code").alias("dearest_warehouse"),
        (-F.col("hi.neg")).alias("dearest_inr_per_case"),
        F.col("lo.code").alias("cheapest_warehouse"),
        F.col("lo.cost").alias("cheapest_inr_per_case"),
    )
