"""Temperature excursions, cold-chain returns, near-expiry stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..functions import numeric as N
from .periods import ALL_DATA, Period
from .scope import in_region, one_of, ranked, within

# Return reasons that belong to the cold chain.
COLD_CHAIN_REASONS = ("RT01_NEAR_EXPIRY", "RT06_COLD_CHAIN_BREACH")


def excursions_by_month(star, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """Excursions per hundred deliveries of orders that hold at least one chilled line."""
    chilled = star.order_line_keys.join(
        star.dim_product.where("is_chilled").select("product_id"), "product_id", "left_semi"
    )
    chilled_orders = chilled.select("order_id").distinct()
    per_order = star.deliveries_by_order(
        [D.month_key(F.col("dispatch_datetime")).alias("dim_code")],
        [F.count(F.lit(1)).alias("n"), N.count_where(F.col("temperature_excursion_flag")).alias("hits")],
        period,
    )
    return (
        in_region(per_order, star.dim_region, region_code)
        .join(chilled_orders, "order_id", "left_semi")
        .groupBy("dim_code")
        .agg(F.sum("n").alias("chilled_deliveries"), F.sum("hits").alias("excursions"))
        .select(
            "dim_code",
            F.col("dim_code").alias("dim_label"),
            "chilled_deliveries",
            "excursions",
            N.share_pct(F.col("excursions"), F.col("chilled_deliveries"), 2).alias("excursions_per_hundred"),
        )
        .orderBy("dim_code")
    )


def excursion_extremes(by_month: DataFrame) -> DataFrame:
    """One row: best and worst month. Ties go to the earlier month."""
    rate, month = F.col("excursions_per_hundred"), F.col("dim_code")
    best = F.min(F.struct(rate.alias("rate"), month.alias("month")))
    worst = F.min(F.struct((-rate).alias("neg"), month.alias("month")))
    return by_month.agg(best.alias("b"), worst.alias("w"), F.count(F.lit(1)).alias("n_months")).select(
        F.col("b.month").alias("best_month"),
        F.col("b.rate").alias("best_rate"),
        F.col("w.month").alias("worst_month"),
        (-F.col("w.neg")).alias("worst_rate"),
        "n_months",
    )


def cold_chain_returns(
    star, period: Period = ALL_DATA, region_code: str | None = None, limit: int | None = None
) -> DataFrame:
    returns = star.returns_core.where(F.col("return_reason_code").isin(*COLD_CHAIN_REASONS))
    cat = F.col("category")
    out = (
        in_region(period.of(returns, "return_date"), star.dim_region, region_code)
        .groupBy(cat.alias("dim_code"), cat.alias("dim_label"), "return_reason_code")
        .agg(F.sum("credit_note_value_inr").cast("double").alias("return_value_inr"), F.count(F.lit(1)).alias("n_returns"))
    )
    return ranked(out, "return_value_inr", "desc", ("dim_code", "return_reason_code"), limit)


def near_expiry(
    star,
    group_by: str = "category",
    near_expiry_days: int = 30,
    warehouse_code: str | None = None,
    region_code: str | None = None,
) -> DataFrame:
    """Stock of the latest snapshot that expires within ``near_expiry_days``.

    Stock already expired counts as stock on hand but not as near expiry.
    """
    one_of("group_by", group_by, ("category", "warehouse"))
    within("near_expiry_days", near_expiry_days, 1, 365)
    stock = star.latest_inventory
    by_warehouse = group_by == "warehouse"
    key = "warehouse_id" if by_warehouse else "category"
    # Category without a warehouse scope needs no warehouse at all.
    keys = [key] if by_warehouse or not (warehouse_code or region_code) else ["warehouse_id", key]
    near = F.col("days_to_expiry").between(0, near_expiry_days)
    sums = stock.groupBy(*keys).agg(
        F.sum("on_hand_cases").alias("on_hand_cases"),
        N.sum_where(near, F.col("on_hand_cases")).alias("near_expiry_cases"),
    )
    if "warehouse_id" in keys:
        warehouse = star.dim_warehouse
        if warehouse_code:
            warehouse = warehouse.where(F.col("warehouse_code") == warehouse_code)
        warehouse = in_region(warehouse, star.dim_region, region_code)
        sums = sums.join(warehouse.select("warehouse_id", "warehouse_code", "warehouse_name"), "warehouse_id")
    code, label = ("warehouse_code", "warehouse_name") if by_warehouse else ("category", "category")
    out = (
        sums.groupBy(F.col(code).alias("dim_code"), F.col(label).alias("dim_label"))
        .agg(F.sum("on_hand_cases").alias("on_hand_cases"), F.sum("near_expiry_cases").alias("near_expiry_cases"))
        .withColumn("near_expiry_pct", N.share_pct(F.col("near_expiry_cases"), F.col("on_hand_cases"), 1))
    )
    return ranked(out, "near_expiry_pct", "desc", ("dim_code",), None)
