"""The quality gate: checks as rows, one verdict, and the helpers that enforce it.

Counts, NULL keys, date ranges and domains of a table come out of one aggregate over it,
or out of what was observed of its rows while they were written.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N
from ..plans.star import DIMENSION_TABLES, FACT_TABLES
from .skew import orphan_count, repeated_key_count

OPTIONAL_TABLES = ("fact_weather",)
FEEDS = ("freight", "listings", "weather")
EXPECTED_TABLES = DIMENSION_TABLES + FACT_TABLES

# The keys, references, date columns and domains that are checked.
PRIMARY_KEYS = (
    ("dim_region", "region_id"),
    ("dim_warehouse", "warehouse_id"),
    ("dim_route", "route_id"),
    ("dim_outlet", "outlet_id"),
    ("dim_product", "product_id"),
    ("fact_order_lines", "order_line_id"),
    ("fact_deliveries", "delivery_id"),
)
NOT_NULL = (
    ("fact_order_lines", "order_line_id"),
    ("fact_order_lines", "outlet_id"),
    ("fact_order_lines", "sku_code"),
    ("fact_deliveries", "delivery_id"),
    ("fact_deliveries", "order_id"),
    ("dim_outlet", "outlet_id"),
    ("dim_product", "sku_code"),
)
FOREIGN_KEYS = (
    ("fact_order_lines", "outlet_id", "dim_outlet", "outlet_id"),
    ("fact_deliveries", "route_id", "dim_route", "route_id"),
    ("fact_deliveries", "warehouse_id", "dim_warehouse", "warehouse_id"),
    ("fact_returns", "outlet_id", "dim_outlet", "outlet_id"),
)
DATE_COLUMNS = (("fact_order_lines", "order_date"), ("fact_deliveries", "dispatch_datetime"))
CONFIDENCES = ("matched", "ambiguous", "unmatched")
FIRST, LAST, TEST_OUTLETS = date(2024, 6, 1), date(2026, 12, 31), 3

# References that an inner join of the build would hide, checked on the sources.
SOURCE_KEYS = (
    ("order_lines", "order_id", "orders", "order_id"),
    ("order_lines", "product_id", "products", "product_id"),
    ("deliveries", "order_id", "orders", "order_id"),
    ("returns_credit_notes", "product_id", "products", "product_id"),
    ("returns_credit_notes", "outlet_id", "outlets", "outlet_id"),
    ("inventory_snapshots", "product_id", "products", "product_id"),
)


def _check(name: str, passed: Column, observed: Column, hard: bool = True) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.lit(hard).alias("hard"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("bigint").alias("observed"),
    )


def _rows(one_row: DataFrame, checks: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*checks)))


@dataclass(frozen=True)
class Observed:
    """What the aggregates of a table gave when its rows went by: their text, and name -> value."""

    aggregates: str
    values: dict[str, int]


def text_of(aggregates: list[Column]) -> str:
    """Aggregates as text; observed values answer for equal texts only (the same window, the same domains)."""
    return "; ".join(str(a) for a in aggregates)


def table_aggregates(
    name: str, first: date = FIRST, last: date = LAST, expected_test_outlets: int | Column = TEST_OUTLETS
) -> list[Column]:
    """The aggregates over one table that its checks need, all of them whole numbers.

    The expected number of test outlets is a number, or an aggregate over the outlets that knows them by another sign.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [N.count_where(F.col(c).isNull()).alias(f"null_{c}") for t, c in NOT_NULL if t == name]
    for table, column in DATE_COLUMNS:
        if table == name:
            day = F.col(column).cast("date")
            outside = N.count_where((day < F.lit(first)) | (day > F.lit(last)))
            aggs += [F.count(day).alias("dated"), outside.alias("out_of_range")]
    if name == "dim_outlet":
        wanted = expected_test_outlets if isinstance(expected_test_outlets, Column) else F.lit(expected_test_outlets)
        aggs += [N.count_where(F.col("is_test_outlet")).alias("test"), wanted.alias("wanted")]
    if name == "fact_price_position":
        aggs.append(N.count_where(~F.col("match_confidence").isin(*CONFIDENCES)).alias("bad"))
    return aggs


def _aggregate_checks(name: str) -> list[Column]:
    """The checks over the columns of ``table_aggregates``."""
    optional = name in OPTIONAL_TABLES
    checks = [_check(f"nonzero_rows:{name}", F.lit(True) if optional else F.col("n") > 0, F.col("n"), not optional)]
    for column in (c for t, c in NOT_NULL if t == name):
        nulls = F.col(f"null_{column}")
        checks.append(_check(f"no_null_key:{name}.{column}", nulls == 0, nulls))
    for column in (c for t, c in DATE_COLUMNS if t == name):
        ok = (F.col("dated") > 0) & (F.col("out_of_range") == 0)
        checks.append(_check(f"date_range:{name}.{column}", ok, F.col("out_of_range")))
    if name == "dim_outlet":
        checks.append(_check("invariant:test_outlet_count", F.col("test") == F.col("wanted"), F.col("test"), hard=False))
    if name == "fact_price_position":
        checks.append(_check("invariant:price_position_match_confidence", F.col("bad") == 0, F.col("bad")))
    return checks


def table_checks(name: str, df: DataFrame, observed: Observed | None = None, **bounds) -> DataFrame:
    """All checks of one table that a single aggregate answers; the table is not read if its aggregates were observed."""
    aggs = table_aggregates(name, **bounds)
    if observed is None or observed.aggregates != text_of(aggs):
        return _rows(df.agg(*aggs), _aggregate_checks(name))
    one = df.sparkSession.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in observed.values.items()])
    return _rows(one, _aggregate_checks(name))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def report(
    star,
    first: date = FIRST,
    last: date = LAST,
    expected_test_outlets: int | Column = TEST_OUTLETS,
    tables: tuple[str, ...] = EXPECTED_TABLES,
    observed: dict[str, Observed] | None = None,
) -> DataFrame:
    """The 37 checks as rows ``(check_name, hard, passed, observed)``.

    ``tables`` are the tables found; checks of a missing one are left out and its absence
    fails the first check. Tables in ``observed`` are read for unique keys and references only.
    """
    return _union(report_parts(star, first, last, expected_test_outlets, tables, observed))


def report_parts(
    star,
    first: date = FIRST,
    last: date = LAST,
    expected_test_outlets: int | Column = TEST_OUTLETS,
    tables: tuple[str, ...] = EXPECTED_TABLES,
    observed: dict[str, Observed] | None = None,
) -> list[DataFrame]:
    """The checks of ``report``: those that shuffle no rows in one frame, and a frame for each key and reference."""
    bounds = {"first": first, "last": last, "expected_test_outlets": expected_test_outlets}
    known = observed or {}
    have = [t for t in EXPECTED_TABLES if t in tables]
    n_missing = len(EXPECTED_TABLES) - len(have)
    frames = [
        _rows(star.spark.range(1), [_check("required_tables_exist", F.lit(n_missing == 0), F.lit(n_missing))])
    ]
    frames += [table_checks(t, star.table(t), known.get(t), **bounds) for t in have]
    frames = [_union(frames)]
    for table, pk in PRIMARY_KEYS:
        if table in have:
            one = repeated_key_count(star.table(table), pk)
            frames.append(_rows(one, [_check(f"unique_pk:{table}.{pk}", F.col("n") == 0, F.col("n"))]))
    for child, fk, parent, pk in FOREIGN_KEYS:
        if child in have and parent in have:
            one = orphan_count(star.table(child), fk, star.table(parent), pk)
            name = f"fk_integrity:{child}.{fk}->{parent}.{pk}"
            frames.append(_rows(one, [_check(name, F.col("n") == 0, F.col("n"))]))
    return frames


def source_report(landed) -> DataFrame:
    """Checks on the sources: references the build's inner joins rely on, line and SKU keys, units."""
    return _union(source_parts(landed))


def source_parts(landed) -> list[DataFrame]:
    """The checks of ``source_report``, a frame for each."""
    frames = []
    for child, fk, parent, pk in SOURCE_KEYS:
        one = orphan_count(getattr(landed, child), fk, getattr(landed, parent), pk)
        frames.append(_rows(one, [_check(f"source_fk:{child}.{fk}->{parent}.{pk}", F.col("n") == 0, F.col("n"))]))
    for table, key in (("products", "sku_code"), ("order_lines", "order_line_id"), ("outlets", "outlet_id")):
        one = repeated_key_count(getattr(landed, table), key)
        frames.append(_rows(one, [_check(f"source_unique:{table}.{key}", F.col("n") == 0, F.col("n"))]))
    uom = landed.order_lines.agg(N.count_where(~F.col("qty_uom").isin("CASE", "EACH")).alias("n"))
    frames.append(_rows(uom, [_check("source_uom:order_lines", F.col("n") == 0, F.col("n"), hard=False)]))
    return frames


REJECTED_PER_MILLE = 10


def rejected_report(landed, most_per_mille: int = REJECTED_PER_MILLE) -> DataFrame | None:
    """A soft check per feed: bad records put aside, at most so many of a thousand. None if the read put none aside."""
    if landed.rejected is None:
        return None
    frames = []
    for feed in FEEDS:
        bad = landed.rejected.where(F.col("source") == feed).agg(F.count(F.lit(1)).alias("bad"))
        good = getattr(landed, feed).agg(F.count(F.lit(1)).alias("good"))
        one = bad.select("bad", good.scalar().alias("good"))
        ok = F.col("bad") * 1000 <= (F.col("bad") + F.col("good")) * most_per_mille
        frames.append(_rows(one, [_check(f"rejected_records:{feed}", ok, F.col("bad"), hard=False)]))
    return _union(frames)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: ``ok`` unless a hard check failed, the counts, and the names of the failed ones."""
    failed = F.col("hard") & ~F.col("passed")
    names = F.sort_array(F.collect_list(F.when(failed, F.col("check_name"))))  # one entry per check, a fixed few
    return checks.agg(
        F.when(N.count_where(failed) == 0, "ok").otherwise("failed").alias("status"),
        N.count_where(F.col("passed")).alias("checks_passed"),
        N.count_where(failed).alias("checks_failed"),
        N.count_where(~F.col("passed") & ~F.col("hard")).alias("warnings"),
        F.array_join(names, ", ").alias("failed_checks"),
    )


def manifest(star, tables: tuple[str, ...] = EXPECTED_TABLES) -> DataFrame:
    """Row count per table."""
    return _union(
        [star.table(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in tables]
    )


def changed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose row count differs between two manifests; none after a run that must not write."""
    b = before.select("table_name", F.col("n_rows").alias("n_before"))
    a = after.select("table_name", F.col("n_rows").alias("n_after"))
    return b.join(a, "table_name", "full").where(~F.col("n_before").eqNullSafe(F.col("n_after")))


def conservation(star) -> DataFrame:
    """One row: regions' sums against the unscoped total, and outlets claimed by several regions.

    Each region is scoped the way the metrics do it; nothing may be lost or counted twice.
    """
    lines = star.order_lines_core
    total = lines.agg(
        F.sum("ordered_eaches").alias("o"), F.sum("delivered_eaches").alias("d"), F.count(F.lit(1)).alias("n")
    )
    scoped = (
        lines.groupBy("region_id")
        .agg(F.sum("ordered_eaches").alias("o"), F.sum("delivered_eaches").alias("d"), F.count(F.lit(1)).alias("n"))
        .join(star.dim_region.select("region_id", "region_code"), "region_id")
        .agg(F.sum("o").alias("ro"), F.sum("d").alias("rd"), F.sum("n").alias("rn"))
    )
    shared = (
        lines.select("outlet_id", "region_id").distinct().groupBy("outlet_id").agg(F.count(F.lit(1)).alias("k"))
        .agg(N.count_where(F.col("k") > 1).alias("s"))
    )
    r = scoped.select(F.struct("ro", "rd", "rn").alias("r")).scalar()
    return total.select(
        F.col("n").alias("n_lines"),
        (F.col("n") - r["rn"]).alias("lines_outside_regions"),
        (F.col("o") - r["ro"]).alias("ordered_difference"),
        (F.col("d") - r["rd"]).alias("delivered_difference"),
        shared.scalar().alias("outlets_in_several_regions"),
    )
