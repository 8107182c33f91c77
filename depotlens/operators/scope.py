"""Region, status and parameter scope shared by the metric operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FULFILLED = ("DELIVERED", "PARTIAL")

# Where each fact carries its region.
REGION_ANCHOR = {
    "order_lines": "region_id",
    "deliveries": "region_id",
    "returns": "region_id",
    "freight": "route_region_id",
    "routes": "region_id",
    "outlets": "region_id",
    "warehouses": "region_id",
}

# Dimension behind each group-by choice: id, code and label column.
DIMENSIONS = {
    "outlet": ("outlet_id", "outlet_code", "outlet_name"),
    "region": ("region_id", "region_code", "region_name"),
    "warehouse": ("warehouse_id", "warehouse_code", "warehouse_name"),
    "route": ("route_id", "route_code", "route_name"),
}


def in_region(df: DataFrame, dim_region: DataFrame, region_code: str | None, on: str = "region_id") -> DataFrame:
    """Rows of one region. An unknown code leaves nothing; no code leaves everything."""
    if not region_code:
        return df
    region = dim_region.where(F.col("region_code") == region_code).select(F.col("region_id").alias(on))
    return df.join(region, on, "left_semi")


def fulfilled() -> Column:
    return F.col("order_status").isin(*FULFILLED)


def one_of(name: str, value: str, allowed) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def within(name: str, value: int | None, low: int, high: int) -> int | None:
    if value is not None and not low <= value <= high:
        raise ValueError(f"{name} must be within {low}..{high}")
    return value


def ranked(df: DataFrame, by: str, order: str, ties: tuple[str, ...], limit: int | None) -> DataFrame:
    """Sorted by ``by`` (NULL last) with the tie columns as last keys; top ``limit`` if given."""
    one_of("order", order, ("asc", "desc"))
    within("limit", limit, 1, 500)
    key = F.asc_nulls_last(by) if order == "asc" else F.desc_nulls_last(by)
    out = df.orderBy(key, *[F.asc_nulls_last(t) for t in ties])
    return out if limit is None else out.limit(limit)


def active_regions(dim_region: DataFrame) -> DataFrame:
    return (
        dim_region.where(F.col("status") == "ACTIVE")
        .select("region_code", "region_name", "regional_manager")
        .orderBy("region_name")
    )
