"""Freight cost and returns leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numeric as N
from .periods import ALL_DATA, Period
from .scope import in_region, one_of, ranked


def _freight_in_scope(star, period: Period, region_code: str | None, on_region: str = "route_region_id") -> DataFrame:
    return in_region(star.freight_rows(period), star.dim_region, region_code, on_region)


def freight_and_cases(star, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """Per warehouse with both: freight billed and cases delivered, each in its own dates."""
    warehouse = star.dim_warehouse.select("warehouse_id", "warehouse_code")
    billed = (
        _freight_in_scope(star, period, region_code)
        .where(F.col("warehouse_id").isNotNull())
        .groupBy("warehouse_id")
        .agg(F.sum("amount_inr").alias("freight"))
        .join(warehouse, "warehouse_id")
        .groupBy("warehouse_code")
        .agg(F.sum("freight").alias("freight"))
    )
    cases = (
        in_region(star.fulfilled_lines(period, "place"), star.dim_region, region_code)
        .groupBy("warehouse_id")
        .agg(F.sum("delivered_cases").alias("delivered_cases"))
        .join(warehouse, "warehouse_id")
        .groupBy("warehouse_code")
        .agg(F.sum("delivered_cases").alias("delivered_cases"))
    )
    return billed.join(cases, "warehouse_code")


def freight_cost_per_case(
    star, period: Period = ALL_DATA, region_code: str | None = None, limit: int | None = None
) -> DataFrame:
    out = (
        freight_and_cases(star, period, region_code)
        .join(star.dim_warehouse.select("warehouse_code", "warehouse_name"), "warehouse_code")
        .select(
            F.col("warehouse_code").alias("dim_code"),
            F.col("warehouse_name").alias("dim_label"),
            F.col("freight").cast("double").alias("freight_inr"),
            N.rounded(F.col("delivered_cases"), 4).alias("delivered_cases"),
            N.ratio(F.col("freight"), F.col("delivered_cases"), 2).alias("freight_inr_per_case"),
        )
    )
    return ranked(out, "freight_inr_per_case", "desc", ("dim_code",), limit)


def freight_by_carrier(
    star, period: Period = ALL_DATA, region_code: str | None = None, limit: int | None = None
) -> DataFrame:
    out = (
        _freight_in_scope(star, period, region_code)
        .groupBy(F.col("carrier_id").alias("dim_code"), F.col("carrier_name").alias("dim_label"))
        .agg(F.sum("amount_inr").alias("s"), F.sum("n").alias("n_invoices"), F.sum("n_amount").alias("n"))
        .select(
            "dim_code",
            "dim_label",
            F.col("s").cast("double").alias("freight_inr"),
            "n_invoices",
            N.ratio(F.col("s"), F.col("n"), 2).alias("avg_invoice_inr"),
        )
    )
    return ranked(out, "freight_inr", "desc", ("dim_code",), limit)


def dispatch_by_category(star, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """Line value of fulfilled orders per category, summed per product before the product is joined."""
    return (
        in_region(star.fulfilled_lines(period, "product"), star.dim_region, region_code)
        .groupBy("product_id")
        .agg(F.sum("line_value_inr").alias("v"))
        .join(star.dim_product.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.sum("v").alias("dispatch"))
    )


def returns_by_category(star, period: Period = ALL_DATA, region_code: str | None = None) -> DataFrame:
    """Value, count and leading reason of returns per category, from one pass per (category, reason)."""
    returns = in_region(star.return_rows(period), star.dim_region, region_code)
    per_reason = returns.groupBy("category", "return_reason_code").agg(
        F.sum("credit_note_value_inr").alias("v"), F.sum("n").alias("n")
    )
    lead = F.min(
        F.when(
            F.col("return_reason_code").isNotNull(),
            F.struct((-F.col("n")).alias("neg"), F.col("return_reason_code").alias("code")),
        )
    )
    return per_reason.groupBy("category").agg(
        F.sum("v").alias("returned"), F.sum("n").alias("n_returns"), lead["code"].alias("leading_reason_code")
    )


def returns_leakage(
    star,
    group_by: str = "category",
    period: Period = ALL_DATA,
    region_code: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Returned value against dispatched value per category.

    Returns carry no carrier, so by carrier the result is empty rather than made up.
    """
    one_of("group_by", group_by, ("category", "carrier"))
    cat = F.col("category")
    out = (
        returns_by_category(star, period, region_code)
        .join(dispatch_by_category(star, period, region_code), "category", "left")
        .select(
            cat.alias("dim_code"),
            cat.alias("dim_label"),
            F.col("returned").cast("double").alias("return_value_inr"),
            "n_returns",
            "leading_reason_code",
            F.col("dispatch").cast("double").alias("dispatch_value_inr"),
            N.share_pct(F.col("returned"), F.col("dispatch"), 2).alias("returns_pct_of_dispatch"),
        )
    )
    if group_by == "carrier":
        return star.spark.createDataFrame([], out.schema)
    return ranked(out, "return_value_inr", "desc", ("dim_code",), limit)
