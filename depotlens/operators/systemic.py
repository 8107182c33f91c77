"""Findings that hold across the network: late routes, orders for discontinued SKUs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numeric as N
from .scope import in_region, within

VERY_LATE_MINUTES = 120


def _by_route(star, region_code: str | None) -> DataFrame:
    """Sums per route in scope: deliveries are summed by route before the route is looked up."""
    sums = star.deliveries_by_route(
        [
            F.count(F.lit(1)).alias("n"),
            N.count_where(F.col("delay_minutes") > VERY_LATE_MINUTES).alias("late"),
            F.sum("delay_minutes").alias("delay"),
            F.count("delay_minutes").alias("n_delays"),
        ]
    )
    routes = in_region(star.dim_route, star.dim_region, region_code)
    return sums.join(routes.select("route_id", "route_code", "route_name"), "route_id")


def _by_code(by_route: DataFrame) -> DataFrame:
    return (
        by_route.groupBy("route_code", "route_name")
        .agg(F.sum("n").alias("n_deliveries"), F.sum("late").alias("n_very_late"))
        .withColumn("pct_very_late", N.share_pct(F.col("n_very_late"), F.col("n_deliveries"), 1))
    )


def _is_late(min_deliveries: int, min_pct: float):
    return (F.col("n_deliveries") >= min_deliveries) & (F.col("pct_very_late") > min_pct)


def late_routes(star, region_code: str | None = None, min_deliveries: int = 10, min_pct: float = 10.0) -> DataFrame:
    """Routes over two hours late on more than ``min_pct`` percent (as shown, one decimal) of deliveries."""
    found = _by_code(_by_route(star, region_code)).where(_is_late(min_deliveries, min_pct))
    return found.orderBy(F.desc("pct_very_late"), "route_code")


def late_routes_summary(star, region_code: str | None = None) -> DataFrame:
    """One row: late routes, all routes in scope, whether that is all of them, mean delay."""
    by_route = _by_route(star, region_code)
    delay = by_route.agg(
        F.sum("delay").alias("s"), F.sum("n_delays").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_deliveries")
    )
    n_late = _by_code(by_route).where(_is_late(10, 10.0)).agg(F.count(F.lit(1))).scalar()
    n_routes = in_region(star.dim_route, star.dim_region, region_code).agg(F.count(F.lit(1))).scalar()
    return delay.select(
        n_late.alias("n_late_routes"),
        n_routes.alias("n_routes"),
        "n_deliveries",
        N.ratio(F.col("s"), F.col("n"), 1).alias("avg_delay_minutes"),
    ).withColumn("is_systemic", (F.col("n_routes") > 0) & (F.col("n_late_routes") == F.col("n_routes")))


def _discontinued_lines(star, region_code: str | None) -> DataFrame:
    """Lines ordered after discontinuation, counted per (outlet, product), from non-test outlets."""
    outlets = star.dim_outlet_plain.where(~F.col("is_test_outlet"))
    outlets = in_region(outlets, star.dim_region, region_code)
    return (
        star.order_lines.where("ordered_after_discontinued")
        .groupBy("outlet_id", "sku_code", "product_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("order_date").alias("first"),
            F.max("order_date").alias("last"),
        )
        .join(outlets.select("outlet_id", "outlet_code", "outlet_name"), "outlet_id")
    )


def discontinued_orders(star, region_code: str | None = None, top: int | None = 20) -> DataFrame:
    """Outlet and SKU pairs with orders after the SKU was discontinued, most lines first."""
    within("top", top, 1, 500)
    out = (
        _discontinued_lines(star, region_code)
        .groupBy("outlet_code", "outlet_name", "sku_code", "product_name")
        .agg(
            F.sum("n").alias("n_order_lines"),
            F.min("first").alias("first_order_after_discontinuation"),
            F.max("last").alias("last_order_after_discontinuation"),
        )
        .orderBy(F.desc("n_order_lines"), "outlet_code", "sku_code")
    )
    return out if top is None else out.limit(top)


def discontinued_summary(star, region_code: str | None = None) -> DataFrame:
    """One row: lines, outlets and SKUs involved, outlets in scope, whether that is all of them."""
    lines = _discontinued_lines(star, region_code)
    outlets = in_region(star.dim_outlet_plain.where(~F.col("is_test_outlet")), star.dim_region, region_code)
    n_outlets = outlets.agg(F.count(F.lit(1))).scalar()
    return lines.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_order_lines"),
        F.countDistinct("outlet_id").alias("n_outlets_ordering"),
        F.countDistinct("sku_code").alias("n_discontinued_skus"),
        F.max("last").alias("last_order_date"),
    ).select(
        "*",
        n_outlets.alias("n_outlets"),
        ((n_outlets > 0) & (F.col("n_outlets_ordering") == n_outlets)).alias("is_systemic"),
    )
