import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from depotlens import schemas
from depotlens.plans.star import Landed, LazyStar
from depotlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "depotlens-tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows_of(spark):
    """Frame of dict rows under a schema; columns left out are NULL."""

    def make(schema, rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return make


BASE = {
    "regions": [
        {"region_id": 1, "region_code": "WST", "region_name": "West", "status": "ACTIVE"},
        {"region_id": 2, "region_code": "STH", "region_name": "South", "status": "ACTIVE"},
    ],
    "warehouses": [
        {"warehouse_id": 1, "warehouse_code": "W1", "warehouse_name": "One", "region_id": 1},
        {"warehouse_id": 2, "warehouse_code": "W2", "warehouse_name": "Two", "region_id": 2},
    ],
    "routes": [
        {"route_id": 1, "route_code": "R1", "route_name": "First", "region_id": 1},
        {"route_id": 2, "route_code": "R2", "route_name": "Second", "region_id": 2},
    ],
    "salespeople": [{"salesperson_id": 1, "employee_code": "E1", "full_name": "Someone", "region_id": 1}],
    "outlets": [
        {"outlet_id": 1, "outlet_code": "O1", "outlet_name": "Shop", "region_id": 1, "is_deleted": 0, "status": "ACTIVE"},
        {"outlet_id": 2, "outlet_code": "O2", "outlet_name": "Mart", "region_id": 2, "is_deleted": 0, "status": "ACTIVE"},
    ],
    "products": [
        {"product_id": 1, "sku_code": "S1", "product_name": "Milk", "brand": "A", "category": "DAIRY", "is_chilled": 1},
        {"product_id": 2, "sku_code": "S2", "product_name": "Rice", "brand": "B", "category": "DRY", "is_chilled": 0},
    ],
}


@pytest.fixture(scope="session")
def mini(spark, rows_of):
    """A lazy star over hand-made rows: the base dimensions, and the given tables."""

    def make(freight=None, listings=None, weather=None, **tables):
        frames = {
            name: rows_of(schema, tables.get(name, BASE.get(name, []))) for name, schema in schemas.OPERATIONAL.items()
        }
        return LazyStar(Landed(spark, **frames, freight=freight, listings=listings, weather=weather))

    return make


@pytest.fixture(scope="session")
def order():
    def make(order_id, day="2026-05-10", status="DELIVERED", outlet=1, region=1, route=1, warehouse=1):
        return {
            "order_id": order_id, "order_date": day, "order_status": status, "outlet_id": outlet, "region_id": region,
            "route_id": route, "warehouse_id": warehouse,
        }

    return make


@pytest.fixture(scope="session")
def line():
    def make(line_id, order_id, ordered, delivered, uom="EACH", pack=12, product=1, value="10.0000"):
        from decimal import Decimal

        return {
            "order_line_id": str(line_id), "order_id": order_id, "product_id": product, "ordered_qty": ordered,
            "delivered_qty": delivered, "qty_uom": uom, "case_pack_at_order": pack, "line_value_inr": Decimal(value),
        }

    return make
