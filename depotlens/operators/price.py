"""Own list price against competitor prices, from confidently matched listings only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numeric as N
from .scope import fulfilled, within


def top_skus(star, top_n: int = 20) -> DataFrame:
    """The ``top_n`` SKUs by line value of fulfilled orders; ties go to the lower SKU code."""
    within("top_n", top_n, 1, 100)
    return (
        star.order_lines_core.where(fulfilled())
        .groupBy("product_id")
        .agg(F.sum("line_value_inr").alias("v"))
        .join(star.dim_product.select("product_id", "sku_code", "product_name"), "product_id")
        .groupBy("sku_code", "product_name")
        .agg(F.sum("v").alias("value"))
        .orderBy(F.desc("value"), "sku_code")
        .limit(top_n)
    )


def _in_city(df: DataFrame, city: str | None) -> DataFrame:
    return df.where(F.lower("city") == city.lower()) if city else df


def price_gap(star, city: str | None = None, top_n: int = 20) -> DataFrame:
    """Top SKUs with the lowest competitor price seen; NULL where no listing matches."""
    top = top_skus(star, top_n)  # at most 100 rows, whatever the data size
    wanted = F.broadcast(top.select("sku_code"))
    competitor = (
        _in_city(star.price_position.where("match_confidence = 'matched'"), city)
        .join(wanted, "sku_code", "left_semi")
        .groupBy("sku_code")
        .agg(F.min("price_inr").alias("low"), F.countDistinct("retailer").alias("n_retailers_observed"))
    )
    own = star.dim_product.select("sku_code", "mrp_inr").join(wanted, "sku_code", "left_semi")
    gap = F.col("mrp_inr") - F.col("low")
    return (
        top.join(own, "sku_code")
        .join(competitor, "sku_code", "left")
        .select(
            F.col("sku_code").alias("dim_code"),
            F.col("product_name").alias("dim_label"),
            F.col("value").cast("double").alias("dispatch_value_inr"),
            F.col("mrp_inr").cast("double").alias("own_mrp_inr"),
            F.col("low").cast("double").alias("lowest_competitor_price_inr"),
            "n_retailers_observed",
            N.rounded(gap.cast("double"), 2).alias("gap_inr"),
            N.share_pct(gap, F.col("mrp_inr"), 1).alias("gap_pct"),
        )
        .orderBy(F.desc("dispatch_value_inr"), "dim_code")
    )


def price_gap_counts(gap: DataFrame) -> DataFrame:
    """One row: top SKUs, how many have no match, how many are priced above the market."""
    low = F.col("lowest_competitor_price_inr")
    return gap.agg(
        F.count(F.lit(1)).alias("n_skus"),
        N.count_where(low.isNull()).alias("n_no_match"),
        N.count_where(low.isNotNull()).alias("n_matched"),
        N.count_where(F.col("gap_inr") > 0).alias("n_above_market"),
    )


def price_summary(star, city: str | None = None, category: str | None = None, exact: bool = False) -> DataFrame:
    """Gap of matched listings per category.

    The average is taken over the stored one-decimal percentages; ``exact`` averages the
    unrounded ones.
    """
    df = _in_city(star.price_position.where("match_confidence = 'matched'"), city)
    if category:
        df = df.where(F.lower("category") == category.lower())
    cat, gap = F.col("category"), F.col("mrp_gap_pct")
    # Stored percentages have one decimal; summing tenths as integers is exact.
    average = N.ratio(F.sum(F.round(gap * 10).cast("bigint")), F.count(gap) * F.lit(10.0), 1)
    if exact:
        own = F.col("own_mrp_inr").cast("double")
        average = N.rounded(F.avg(F.try_divide(F.lit(100.0) * F.col("mrp_gap_inr").cast("double"), own)), 1)
    return (
        df.groupBy(cat.alias("dim_code"), cat.alias("dim_label"))
        .agg(
            F.count(F.lit(1)).alias("n_matched_listings"),
            average.alias("avg_gap_pct"),
            N.rounded(F.min(gap), 1).alias("min_gap_pct"),
            N.rounded(F.max(gap), 1).alias("max_gap_pct"),
        )
        .orderBy(F.desc_nulls_last("avg_gap_pct"), "dim_code")
    )
