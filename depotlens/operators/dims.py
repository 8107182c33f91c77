"""Conformed dimensions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates as D
from .skew import mark_repeated_keys

# Spellings in use for a city, and the name patterns of test and migration records.
CITY_SPELLINGS = {"Bangalore": "Bengaluru", "New Delhi": "Delhi"}
TEST_NAME_PATTERNS = ("%TEST%", "DO NOT USE%", "ZZ%")

SPINE_START = date(2025, 1, 1)
SPINE_END = date(2026, 7, 30)


def region(raw: DataFrame) -> DataFrame:
    return raw.select("region_id", "region_code", "region_name", "regional_manager", "status")


def warehouse(raw: DataFrame) -> DataFrame:
    return raw.select(
        "warehouse_id", "warehouse_code", "warehouse_name", "city", "region_id", "manager_name", "status"
    )


def route(raw: DataFrame) -> DataFrame:
    return raw.select("route_id", "route_code", "route_name", "region_id", "status")


def salesperson(raw: DataFrame) -> DataFrame:
    return raw.select("salesperson_id", "employee_code", "full_name", "region_id", "designation", "status")


def product(raw: DataFrame) -> DataFrame:
    """Dates parsed leniently; a product counts as discontinued as soon as any text is there."""
    return raw.select(
        "product_id", "sku_code", "product_name", "brand", "category", "pack_size_value", "pack_size_uom",
        "mrp_inr",
        F.col("is_chilled").cast("boolean").alias("is_chilled"),
        D.lenient_date(F.col("discontinued_date")).alias("discontinued_date"),
        D.lenient_date(F.col("launch_date")).alias("launch_date"),
        F.col("discontinued_date").isNotNull().alias("is_discontinued"),
    )


def canonical_city(city: Column, spellings: dict[str, str] = CITY_SPELLINGS) -> Column:
    return reduce(lambda rest, kv: F.when(city == kv[0], F.lit(kv[1])).otherwise(rest), spellings.items(), city)


def is_test_name(name: Column, patterns: tuple[str, ...] = TEST_NAME_PATTERNS) -> Column:
    """Case-sensitive; NULL for a NULL name."""
    return reduce(lambda a, b: a | b, [name.like(p) for p in patterns])


def outlet_identity(gst: Column, latitude: Column, longitude: Column) -> Column:
    """Tax number if there is one, else the exact point, else NULL."""
    by_tax = F.concat(F.lit("gst:"), F.when(gst != "", gst))
    by_point = F.concat(F.lit("geo:"), latitude.cast("string"), F.lit(","), longitude.cast("string"))
    return F.coalesce(by_tax, by_point)


def outlet_plain(raw: DataFrame) -> DataFrame:
    """Canonical city, test flag, default inclusion. Flags only; no row is dropped."""
    is_test = is_test_name(F.col("outlet_name"))
    return raw.withColumns(
        {
            "city_canonical": canonical_city(F.col("city")),
            "is_test_outlet": is_test,
            "include_by_default": (F.col("is_deleted") == 0) & ~is_test,
        }
    )


def outlet(raw: DataFrame) -> DataFrame:
    """``outlet_plain`` with the duplicate flag: all outlets that share an identity are flagged."""
    identity = outlet_identity(F.col("gst_number"), F.col("latitude"), F.col("longitude"))
    keyed = outlet_plain(raw).withColumn("dedup_key", identity)
    return mark_repeated_keys(keyed, key="dedup_key", row_id="outlet_id", flag="is_duplicate_outlet").drop("dedup_key")


def date_spine(spark: SparkSession, first: date = SPINE_START, last: date = SPINE_END) -> DataFrame:
    """One row per day, both ends included, with calendar and fiscal columns."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    return with_calendar(days)


def with_calendar(days: DataFrame) -> DataFrame:
    d = F.col("date")
    return days.select(
        d,
        F.year(d).alias("calendar_year"),
        F.month(d).alias("calendar_month"),
        F.quarter(d).alias("calendar_quarter"),
        D.fiscal_year(d).alias("fiscal_year"),
        D.fiscal_quarter(d).alias("fiscal_quarter"),
    )


def date_spine_of(df: DataFrame, day: str) -> DataFrame:
    """The spine between the first and last day found in ``df``."""
    ends = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return with_calendar(ends.select(F.explode(F.sequence("first", "last")).alias("date")))
