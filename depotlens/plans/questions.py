"""The fixed business questions, as calls of the metric operators, and the routing of free text to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import coldchain, money, periods, price, privacy, service, systemic

# Questions in order of precedence; any keyword set that is fully contained hits.
ROUTES = (
    ("q1_worst_fill_rate_outlets", (("fill rate", "outlet"), ("fill rate", "lowest"))),
    ("q2_otif_by_region", (("otif", "region"),)),
    ("q3_returns_by_category", (("return", "categor"), ("return", "reason"))),
    ("q4_temperature_excursions", (("excursion",), ("temperature", "chilled"))),
    ("q5_late_routes", (("route", "late"), ("route", "hour"))),
    ("q6_price_gap_top_skus", (("mrp", "competitor"), ("mrp", "mumbai"), ("price", "competitor", "sku"))),
    ("q7_freight_per_case_by_warehouse", (("freight", "case"), ("freight", "warehouse"))),
    ("q8_discontinued_sku_orders", (("discontinued",),)),
)


def today(star) -> DataFrame:
    """One row: the newest order date that has a line."""
    return periods.newest_day(star.order_lines_core)


def worst_fill_rate_outlets(star, region_code: str | None = None) -> DataFrame:
    month = periods.last_month_of(today(star))
    return service.fill_rate(star, "outlet", month, region_code, exclude_closed_outlets=True, order="asc", limit=5)


def otif_by_region(star, region_code: str | None = None) -> DataFrame:
    return service.otif(star, "region", periods.last_quarter_of(today(star)), region_code, limit=10)


def returns_by_category(star, region_code: str | None = None) -> DataFrame:
    return money.returns_leakage(star, region_code=region_code, limit=5)


def temperature_excursions(star, region_code: str | None = None) -> DataFrame:
    return coldchain.excursions_by_month(star, region_code=region_code)


def late_routes(star, region_code: str | None = None) -> DataFrame:
    return systemic.late_routes(star, region_code)


def price_gap_top_skus(star, region_code: str | None = None) -> DataFrame:
    """Competitor cities are not sales regions, so the region does not apply."""
    return price.price_gap(star, "mumbai", 20)


def freight_per_case_by_warehouse(star, region_code: str | None = None) -> DataFrame:
    return money.freight_cost_per_case(star, periods.last_quarter_of(today(star)), region_code, limit=10)


def discontinued_sku_orders(star, region_code: str | None = None) -> DataFrame:
    return systemic.discontinued_orders(star, region_code)


ANSWERS = {
    "q1_worst_fill_rate_outlets": worst_fill_rate_outlets,
    "q2_otif_by_region": otif_by_region,
    "q3_returns_by_category": returns_by_category,
    "q4_temperature_excursions": temperature_excursions,
    "q5_late_routes": late_routes,
    "q6_price_gap_top_skus": price_gap_top_skus,
    "q7_freight_per_case_by_warehouse": freight_per_case_by_warehouse,
    "q8_discontinued_sku_orders": discontinued_sku_orders,
}


def matched_question(text: Column) -> Column:
    """Id of the first question whose keywords the text contains, NULL if none."""
    lower = F.lower(text)

    def hit(keyword_sets) -> Column:
        every = [reduce(lambda a, b: a & b, [lower.contains(k) for k in keys]) for keys in keyword_sets]
        return reduce(lambda a, b: a | b, every)

    return F.coalesce(*[F.when(hit(keys), F.lit(qid)) for qid, keys in ROUTES])


def route(log: DataFrame, text: str = "text") -> DataFrame:
    """A question log with ``question_id`` and ``mode``: fast_path, blocked (with ``reason``) or unavailable."""
    t = F.col(text)
    qid = matched_question(t)
    kind = privacy.value_category(t)
    reason = F.when(qid.isNotNull(), F.lit(None)).when(
        privacy.asks_for_personal_data(t), F.lit("blocked_personal_data_request")
    ).otherwise(F.concat(F.lit("blocked_pii_value_"), kind))
    return log.withColumns({"question_id": qid, "reason": reason}).withColumn(
        "mode",
        F.when(F.col("question_id").isNotNull(), "fast_path")
        .when(F.col("reason").isNotNull(), "blocked")
        .otherwise("unavailable"),
    )
