"""Fill rate and on-time-in-full.

Facts are summed per id before any dimension is joined, so dimensions meet one row per
id instead of one per order line, and a hot id collapses on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N
from .periods import ALL_DATA, Period
from .scope import DIMENSIONS, fulfilled, in_region, one_of, ranked


def fill_rate(
    star,
    group_by: str = "outlet",
    period: Period = ALL_DATA,
    region_code: str | None = None,
    exclude_test_outlets: bool = True,
    exclude_closed_outlets: bool = False,
    exclude_deleted_outlets: bool = True,
    order: str = "asc",
    limit: int | None = None,
) -> DataFrame:
    """Delivered over ordered eaches of fulfilled orders, in percent, per group."""
    one_of("group_by", group_by, DIMENSIONS)
    id_col, code, label = DIMENSIONS[group_by]
    lines = in_region(star.fulfilled_lines(period, "place"), star.dim_region, region_code)

    needs_outlet = group_by == "outlet" or exclude_test_outlets or exclude_closed_outlets or exclude_deleted_outlets
    keys = list(dict.fromkeys(["outlet_id", id_col] if needs_outlet else [id_col]))
    sums = lines.groupBy(*keys).agg(F.sum("ordered_eaches").alias("o"), F.sum("delivered_eaches").alias("d"))
    if needs_outlet:
        outlet = star.dim_outlet_plain
        if exclude_test_outlets:
            outlet = outlet.where(~F.col("is_test_outlet"))
        if exclude_deleted_outlets:
            outlet = outlet.where(F.col("is_deleted") == 0)
        if exclude_closed_outlets:
            outlet = outlet.where(F.col("status") != "CLOSED")
        wanted = [code, label] if group_by == "outlet" else []
        sums = sums.join(outlet.select("outlet_id", *wanted), "outlet_id")
    if group_by != "outlet":
        sums = sums.groupBy(id_col).agg(F.sum("o").alias("o"), F.sum("d").alias("d"))
        sums = sums.join(star.dimension(group_by).select(id_col, code, label), id_col)
    out = (
        sums.groupBy(F.col(code).alias("dim_code"), F.col(label).alias("dim_label"))
        .agg(F.sum("o").alias("ordered_qty"), F.sum("d").alias("delivered_qty"))
        .where("ordered_qty > 0")
        .withColumn("fill_rate_pct", N.share_pct(F.col("delivered_qty"), F.col("ordered_qty"), 1))
    )
    return ranked(out, "fill_rate_pct", order, ("dim_code",), limit)


def fill_rate_band(fill_rate_df: DataFrame) -> DataFrame:
    """Adds ``band``: good from 90, warn from 75, else bad."""
    pct = F.col("fill_rate_pct")
    return fill_rate_df.withColumn("band", F.when(pct >= 90, "good").when(pct >= 75, "warn").otherwise("bad"))


def order_fulfilment(star) -> DataFrame:
    """Eaches ordered and delivered per fulfilled order, with the order's date."""
    return star.order_totals(fulfilled())


def otif_base(
    star,
    id_cols: list[str],
    period: Period = ALL_DATA,
    region_code: str | None = None,
    on_time_threshold_minutes: int = 0,
    exclude_test_outlets: bool = False,
) -> DataFrame:
    """Per ``id_cols``: deliveries, how many on time, in full, both, and the fulfilment sums.

    Deliveries are counted per order first; the join with the order totals is then one
    row per order and group on either side.
    """
    kept = star.otif_rows(period, on_time_threshold_minutes)
    if kept is None:
        kept = otif_by_order(star, period, on_time_threshold_minutes)
    kept = in_region(kept, star.dim_region, region_code)
    if exclude_test_outlets:
        plain = star.dim_outlet_plain.where(~F.col("is_test_outlet")).select("outlet_id")
        kept = kept.join(plain, "outlet_id", "left_semi")
    return kept.groupBy(*id_cols).agg(*[F.sum(c).alias(c) for c in OTIF_SUMS])


def otif_by_order(
    star, period: Period = ALL_DATA, on_time_threshold_minutes: int = 0, only: Column | None = None
) -> DataFrame:
    """The sums of ``otif_base`` per order and place of its deliveries, with the order's date, for orders that meet ``only``."""
    orders = star.order_totals(fulfilled() if only is None else only, period)
    on_time = F.col("delay_minutes") <= on_time_threshold_minutes
    counts = [F.count(F.lit(1)).alias("n"), N.count_where(on_time).alias("n_on_time")]
    per_order = star.deliveries_by_order(["route_id", "warehouse_id"], counts)
    in_full = F.col("delivered_eaches") >= F.col("ordered_eaches")
    fulfilment = F.try_divide(
        F.lit(100.0) * F.col("delivered_eaches").cast("double"), F.col("ordered_eaches").cast("double")
    )
    n, none = F.col("n"), F.lit(0).cast("bigint")
    return per_order.join(orders, "order_id").select(
        "order_date", "outlet_id", "region_id", "route_id", "warehouse_id",
        n.alias("n_deliveries"),
        "n_on_time",
        F.when(in_full, n).otherwise(none).alias("n_in_full"),
        F.when(in_full, F.col("n_on_time")).otherwise(none).alias("n_otif"),
        (fulfilment * n).alias("fulfilment_sum"),
        F.when(fulfilment.isNotNull(), n).otherwise(none).alias("fulfilment_n"),
    )


OTIF_SUMS = ("n_deliveries", "n_on_time", "n_in_full", "n_otif", "fulfilment_sum", "fulfilment_n")


def otif_rates() -> list:
    """Result columns from the sums of ``otif_base``."""
    n = F.col("n_deliveries")
    return [
        n.alias("n_deliveries"),
        F.col("n_otif").alias("n_otif_strict"),
        N.share_pct(F.col("n_otif"), n, 2).alias("otif_pct_strict"),
        N.share_pct(F.col("n_on_time"), n, 1).alias("on_time_pct"),
        N.share_pct(F.col("n_in_full"), n, 2).alias("in_full_pct_strict"),
        N.ratio(F.col("fulfilment_sum"), F.col("fulfilment_n"), 1).alias("avg_fulfilment_pct"),
    ]


def otif(
    star,
    group_by: str = "region",
    period: Period = ALL_DATA,
    region_code: str | None = None,
    on_time_threshold_minutes: int = 0,
    exclude_test_outlets: bool = False,
    order: str = "asc",
    limit: int | None = None,
) -> DataFrame:
    """On time and in full per group. In full is strict and judged on the whole order."""
    one_of("group_by", group_by, DIMENSIONS)
    id_col, code, label = DIMENSIONS[group_by]
    base = otif_base(star, [id_col], period, region_code, on_time_threshold_minutes, exclude_test_outlets)
    out = (
        base.join(star.dimension(group_by).select(id_col, code, label), id_col)
        .groupBy(F.col(code).alias("dim_code"), F.col(label).alias("dim_label"))
        .agg(*[F.sum(c).alias(c) for c in OTIF_SUMS])
        .select("dim_code", "dim_label", *otif_rates())
    )
    return ranked(out, "otif_pct_strict", order, ("dim_code",), limit)
