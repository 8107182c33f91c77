"""Conformed facts.

Joins against dimensions carry no broadcast hint: Spark broadcasts a side whose
measured size is below its threshold and shuffles otherwise, and adaptive execution
splits a skewed partition of either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..functions import numeric as N


def _line_columns(lines: DataFrame) -> list:
    uom, pack = F.col("qty_uom"), F.col("case_pack_at_order")
    out = [
        "order_line_id", "order_id", "line_number", "product_id", "ordered_qty", "allocated_qty", "delivered_qty",
        "qty_uom", "case_pack_at_order",
        N.to_eaches(F.col("ordered_qty"), uom, pack).alias("ordered_eaches"),
        N.to_eaches(F.col("delivered_qty"), uom, pack).alias("delivered_eaches"),
        N.to_cases(F.col("ordered_qty"), uom, pack).alias("ordered_cases"),
        N.to_cases(F.col("delivered_qty"), uom, pack).alias("delivered_cases"),
        "unit_price_inr", "line_discount_pct", "line_value_inr", "gst_rate_pct", "batch_id", "substitution_flag",
        "short_reason_code",
    ]
    # Split shipments name the warehouse on the line; it wins over the order's.
    if "warehouse_id" in lines.columns:
        out.append(F.col("warehouse_id").alias("line_warehouse_id"))
    return out


def _order_columns() -> list:
    return [
        "order_id", "order_number", "outlet_id",
        F.col("order_date").cast("date").alias("order_date"),
        F.expr("try_cast(requested_delivery_date AS DATE)").alias("requested_delivery_date"),
        "channel", "region_id", "route_id", "warehouse_id", "salesperson_id", "order_status", "source_system",
        "promo_code",
    ]


def line_units(lines: DataFrame) -> DataFrame:
    """Lines with their quantities in eaches and cases."""
    return lines.select(_line_columns(lines))


def order_attributes(orders: DataFrame) -> DataFrame:
    return orders.select(_order_columns())


def order_lines_core(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with units and their order's attributes, before the product is looked up."""
    out = line_units(lines).join(order_attributes(orders), "order_id")
    if "line_warehouse_id" in out.columns:
        out = out.withColumn("warehouse_id", F.coalesce("line_warehouse_id", "warehouse_id")).drop("line_warehouse_id")
    return out


def order_lines(lines: DataFrame, orders: DataFrame, dim_product: DataFrame) -> DataFrame:
    """One row per order line, order and product attributes denormalised."""
    product = dim_product.select(
        "product_id", "sku_code", "product_name", "brand", "category", "is_chilled", "is_discontinued",
        "discontinued_date",
    )
    return (
        order_lines_core(lines, orders)
        .join(product, "product_id")
        .withColumn(
            "ordered_after_discontinued",
            F.col("is_discontinued") & (F.col("order_date") > F.col("discontinued_date")),
        )
    )


def unexpected_uom(lines: DataFrame) -> DataFrame:
    """One row: lines whose unit is neither CASE nor EACH."""
    return lines.agg(N.count_where(~F.col("qty_uom").isin("CASE", "EACH")).alias("n_unexpected_uom"))


def delivery_columns(raw: DataFrame, shift_utc: bool = True) -> DataFrame:
    """Deliveries with typed times and flags, before their order is looked up."""
    return raw.select(
        "delivery_id", "order_id", "delivery_note_number", "route_id", "warehouse_id", "telematics_vendor",
        F.col("dispatch_datetime").cast("timestamp_ntz").alias("dispatch_datetime"),
        D.strict_timestamp(F.col("planned_arrival")).alias("planned_arrival_ts"),
        D.feed_timestamp(F.col("actual_arrival"), F.col("telematics_vendor"), shift_utc).alias("actual_arrival_ts"),
        "delay_minutes", "distance_km", "delivery_status",
        F.col("pod_captured").cast("boolean").alias("pod_captured"),
        (F.col("temperature_excursion_flag") == 1).alias("temperature_excursion_flag"),
        "max_temp_celsius", "returned_cases", "failure_reason_code", "fuel_cost_inr",
        (F.col("delay_minutes") <= 0).alias("is_on_time"),
    )


def deliveries(raw: DataFrame, orders: DataFrame, shift_utc: bool = True) -> DataFrame:
    order = orders.select("order_id", "outlet_id", "channel", "region_id")
    return delivery_columns(raw, shift_utc).join(order, "order_id")


def returns(raw: DataFrame, lines: DataFrame | None, dim_product: DataFrame, dim_outlet: DataFrame) -> DataFrame:
    """The sign of the returned quantity is source noise. A case quantity needs its line's pack.

    Without ``lines`` the quantity in eaches is left out and the lookup saved.
    """
    qty = F.abs("return_qty")
    eaches = []
    if lines is not None:
        raw = raw.join(lines.select("order_line_id", "case_pack_at_order"), "order_line_id", "left")
        eaches = [N.to_eaches(qty, F.col("qty_uom"), F.col("case_pack_at_order")).alias("return_eaches")]
    return (
        raw
        .join(dim_product.select("product_id", "sku_code", "category", "brand"), "product_id")
        .join(dim_outlet.select("outlet_id", "region_id"), "outlet_id")
        .select(
            "return_id", "credit_note_number", "order_id", "order_line_id", "outlet_id", "region_id", "product_id",
            F.col("return_date").cast("date").alias("return_date"),
            qty.alias("return_qty"),
            "qty_uom", *eaches,
            "return_reason_code", "credit_note_value_inr", "disposition", "status", "sku_code", "category", "brand",
        )
    )


def inventory(raw: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Days to expiry from the dates; the source's ageing bucket rides along but is not trusted."""
    dated = raw.withColumns(
        {"snapshot_date": F.col("snapshot_date").cast("date"), "expiry_date": F.col("expiry_date").cast("date")}
    )
    return dated.join(dim_product.select("product_id", "sku_code", "category", "is_chilled"), "product_id").select(
        "snapshot_id", "snapshot_date", "warehouse_id", "product_id", "batch_id", "on_hand_cases", "on_hand_eaches",
        "allocated_cases", "available_cases", "days_of_cover", "expiry_date", "ageing_bucket",
        F.datediff("expiry_date", "snapshot_date").alias("days_to_expiry"),
        "damaged_cases", "blocked_cases", "storage_temp_celsius", "sku_code", "category", "is_chilled",
    )


def freight(invoices: DataFrame, dim_warehouse: DataFrame, dim_route: DataFrame) -> DataFrame:
    """Invoices with warehouse and route resolved by code; unmatched ones stay, with NULL ids.

    The route's region comes along: it is the only region an invoice has.
    """
    warehouse = dim_warehouse.select("warehouse_code", "warehouse_id")
    route = dim_route.select("route_code", "route_id", F.col("region_id").alias("route_region_id"))
    return (
        invoices.join(warehouse, "warehouse_code", "left")
        .join(route, "route_code", "left")
        .select(
            "invoice_id", "carrier_id", "carrier_name", "warehouse_code", "warehouse_id", "route_code", "route_id",
            "route_region_id", "invoice_date", "service_date", "amount_inr", "fuel_surcharge_pct",
            "detention_charge_inr", "distance_km", "weight_kg", "temperature_controlled", "status",
        )
    )


def freight_unmatched(fact_freight: DataFrame) -> DataFrame:
    """One row: invoices without a known warehouse, without a known route, in all."""
    return fact_freight.agg(
        N.count_where(F.col("warehouse_id").isNull()).alias("n_unmatched_warehouse"),
        N.count_where(F.col("route_id").isNull()).alias("n_unmatched_route"),
        F.count(F.lit(1)).alias("n_invoices"),
    )


def weather(raw: DataFrame) -> DataFrame:
    return raw.select("city", F.col("date").cast("date").alias("date"), "temp_max_c", "precipitation_mm")
