"""Declared schemas: operational tables, landed feeds, and the star schema's optional tables.

Nothing is inferred. An optional feed that is missing becomes an empty frame of its schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
RUPEES = T.DecimalType(18, 2)


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "DECIMAL(18,2)": RUPEES,
    "DECIMAL(18,4)": MONEY,
}


def table_schema(columns: str, **nested: T.DataType) -> T.StructType:
    """Columns as ``name TYPE, ...``; needs no session, unlike a DDL string."""
    flat = [c.split(" ") for c in columns.split(", ")]
    fields = [T.StructField(name, _TYPES[kind]) for name, kind in flat]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in nested.items()])


# Operational tables, as the source system holds them.
OPERATIONAL = {
    "regions": table_schema(
        "region_id BIGINT, region_code STRING, region_name STRING, regional_manager STRING, status STRING"
    ),
    "warehouses": table_schema(
        "warehouse_id BIGINT, warehouse_code STRING, warehouse_name STRING, city STRING, region_id BIGINT, "
        "manager_name STRING, status STRING"
    ),
    "routes": table_schema("route_id BIGINT, route_code STRING, route_name STRING, region_id BIGINT, status STRING"),
    "salespeople": table_schema(
        "salesperson_id BIGINT, employee_code STRING, full_name STRING, region_id BIGINT, designation STRING, "
        "status STRING"
    ),
    "outlets": table_schema(
        "outlet_id BIGINT, outlet_code STRING, outlet_name STRING, city STRING, region_id BIGINT, "
        "gst_number STRING, latitude DOUBLE, longitude DOUBLE, is_deleted INT, status STRING, "
        "contact_name STRING, contact_phone STRING, contact_email STRING"
    ),
    "products": table_schema(
        "product_id BIGINT, sku_code STRING, product_name STRING, brand STRING, category STRING, "
        "pack_size_value DOUBLE, pack_size_uom STRING, mrp_inr DECIMAL(18,2), is_chilled INT, "
        "discontinued_date STRING, launch_date STRING"
    ),
    "orders": table_schema(
        "order_id BIGINT, order_number STRING, outlet_id BIGINT, order_date STRING, "
        "requested_delivery_date STRING, channel STRING, region_id BIGINT, route_id BIGINT, warehouse_id BIGINT, "
        "salesperson_id BIGINT, order_status STRING, source_system STRING, promo_code STRING, created_at STRING"
    ),
    "order_lines": table_schema(
        "order_line_id STRING, order_id BIGINT, line_number INT, product_id BIGINT, ordered_qty BIGINT, "
        "allocated_qty BIGINT, delivered_qty BIGINT, qty_uom STRING, case_pack_at_order BIGINT, "
        "unit_price_inr DECIMAL(18,4), line_discount_pct DOUBLE, line_value_inr DECIMAL(18,4), "
        "gst_rate_pct DOUBLE, batch_id STRING, substitution_flag INT, short_reason_code STRING"
    ),
    "deliveries": table_schema(
        "delivery_id BIGINT, order_id BIGINT, delivery_note_number STRING, route_id BIGINT, warehouse_id BIGINT, "
        "telematics_vendor STRING, dispatch_datetime STRING, planned_arrival STRING, actual_arrival STRING, "
        "delay_minutes INT, distance_km DOUBLE, delivery_status STRING, pod_captured INT, "
        "temperature_excursion_flag INT, max_temp_celsius DOUBLE, returned_cases BIGINT, "
        "failure_reason_code STRING, fuel_cost_inr DECIMAL(18,2)"
    ),
    "returns_credit_notes": table_schema(
        "return_id STRING, credit_note_number STRING, order_id BIGINT, order_line_id STRING, outlet_id BIGINT, "
        "product_id BIGINT, return_date STRING, return_qty BIGINT, qty_uom STRING, return_reason_code STRING, "
        "credit_note_value_inr DECIMAL(18,2), disposition STRING, status STRING"
    ),
    "inventory_snapshots": table_schema(
        "snapshot_id STRING, snapshot_date STRING, warehouse_id BIGINT, product_id BIGINT, batch_id STRING, "
        "on_hand_cases BIGINT, on_hand_eaches BIGINT, allocated_cases BIGINT, available_cases BIGINT, "
        "days_of_cover DOUBLE, expiry_date STRING, ageing_bucket STRING, damaged_cases BIGINT, "
        "blocked_cases BIGINT, storage_temp_celsius DOUBLE"
    ),
}

# Landed feeds, before normalisation.
INVOICE = table_schema(
    "invoice_id STRING, carrier_id STRING, carrier_name STRING, warehouse_code STRING, route_code STRING, "
    "invoice_date STRING, service_date STRING, amount BIGINT, detention_charge BIGINT, fuel_surcharge_pct DOUBLE, "
    "distance_km DOUBLE, weight_kg DOUBLE, temperature_controlled BOOLEAN, status STRING, created_at_utc STRING"
)
INVOICE_PAGE = T.StructType(
    [
        T.StructField("data", T.ArrayType(INVOICE)),
        T.StructField("next_cursor", T.StringType()),
        T.StructField("total_estimate", T.LongType()),
    ]
)
CARRIER = table_schema("carrier_id STRING, carrier_name STRING", regions=T.ArrayType(T.StringType()))
SURCHARGE = table_schema("month STRING, surcharge_pct DOUBLE")
WEATHER_DOC = table_schema(
    "city STRING",
    daily=T.StructType(
        [
            T.StructField("time", T.ArrayType(T.StringType())),
            T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
            T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        ]
    ),
)

# Normalised feeds, as read by the warehouse build.
FREIGHT = table_schema(
    "invoice_id STRING, carrier_id STRING, carrier_name STRING, warehouse_code STRING, route_code STRING, "
    "invoice_date DATE, service_date DATE, amount_inr DECIMAL(18,2), fuel_surcharge_pct DOUBLE, "
    "detention_charge_inr DECIMAL(18,2), distance_km DOUBLE, weight_kg DOUBLE, temperature_controlled BOOLEAN, "
    "status STRING, created_at_ist TIMESTAMP_NTZ"
)
LISTINGS = table_schema(
    "listing_id STRING, city STRING, product_detail_url STRING, title STRING, brand_guess STRING, "
    "retailer STRING, pack_raw STRING, pack_value DOUBLE, pack_uom STRING, category STRING, "
    "price_inr DECIMAL(18,4), price_source STRING, mrp_inr DECIMAL(18,2), stock_status STRING, rating DOUBLE, "
    "rating_count INT, last_seen STRING, source_url STRING"
)
WEATHER = table_schema("city STRING, date DATE, temp_max_c DOUBLE, precipitation_mm DOUBLE")


# What the invoice ingest stores: the feed with its partition columns.
STORED_FREIGHT = T.StructType(FREIGHT.fields + table_schema("run STRING, batch_id BIGINT, created_month STRING, id_bucket INT").fields)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
