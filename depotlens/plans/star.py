"""The star schema, as lazy plans over the landed sources or as stored tables.

Both kinds offer the same names, so every metric operator runs on either. The lazy kind
leaves out lookups that a metric does not need (the product of a line, the line of a
return). That is sound once the quality gate has passed on the sources: it fails hard on
a line without a product and on a repeated line id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..session import folder_exists
from ..operators import dims, facts, matching
from ..operators.periods import ALL_DATA, Period
from ..operators.scope import fulfilled
from . import copartition

DIMENSION_TABLES = ("dim_region", "dim_warehouse", "dim_route", "dim_salesperson", "dim_outlet", "dim_product", "dim_date")
FACT_TABLES = (
    "fact_order_lines", "fact_deliveries", "fact_returns", "fact_freight", "fact_inventory_snapshot",
    "fact_price_position", "fact_weather",
)


SCHEMAS = "_schemas"
LAYOUT = "_layout"
BUCKETED = {"fact_order_lines": "order_date", "fact_deliveries": "dispatch_datetime"}


class Sources:
    """What a build reads: one attribute per operational table and feed."""

    spark: SparkSession
    rejected: DataFrame | None = None

    def optional(self, name: str, schema) -> DataFrame:
        """A feed, or an empty frame of its schema where it is missing."""
        found = getattr(self, name)
        return schemas.empty(self.spark, schema) if found is None else found


@dataclass(frozen=True)
class Landed(Sources):
    """Sources given as frames. Feeds may be missing."""

    spark: SparkSession
    regions: DataFrame
    warehouses: DataFrame
    routes: DataFrame
    salespeople: DataFrame
    outlets: DataFrame
    products: DataFrame
    orders: DataFrame
    order_lines: DataFrame
    deliveries: DataFrame
    returns_credit_notes: DataFrame
    inventory_snapshots: DataFrame
    freight: DataFrame | None = None
    listings: DataFrame | None = None
    weather: DataFrame | None = None
    rejected: DataFrame | None = None  # bad records of the feeds, if they were put aside


class Slice(Sources):
    """One of ``n`` slices of some sources, by their common ``key``; the other sources whole.

    Every row, one without a key too, lies in one slice, and rows of equal keys in the same: the joins by ``key`` of all
    slices together give what the whole gives.
    """

    def __init__(self, landed: Sources, names: tuple[str, ...], key: str, n: int, i: int):
        self.spark = landed.spark
        self._landed, self._names, self._rows = landed, names, copartition.bucket_of(key, n) == i

    def __getattr__(self, name: str) -> DataFrame | None:
        found = getattr(self._landed, name)
        return found if found is None or name not in self._names else found.where(self._rows)


def _eaches() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("ordered_eaches", "delivered_eaches")]


class _Star:
    """Metric operators read facts through the methods here; what they return is summed, so a row may stand for many.

    ``n`` and ``n_amount`` count the rows, and those with an amount, that a row stands for.
    """

    spark: SparkSession

    def fulfilled_lines(self, period: Period, grain: str) -> DataFrame:
        """Lines of fulfilled orders: eaches and cases by place (outlet, region, route, warehouse), or line value by product."""
        return period.of(self.order_lines_core.where(fulfilled()), "order_date")

    def freight_rows(self, period: Period) -> DataFrame:
        counted = {"n": F.lit(1), "n_amount": F.col("amount_inr").isNotNull().cast("int")}
        return period.of(self.freight, "invoice_date").withColumns(counted)

    def return_rows(self, period: Period) -> DataFrame:
        return period.of(self.returns_core, "return_date").withColumn("n", F.lit(1))

    def otif_rows(self, period: Period, on_time_threshold_minutes: int) -> DataFrame | None:
        """Sums of on-time-in-full by place, if they are kept for such a period and threshold."""
        return None

    def sketch_rows(self, measure: str, period: Period) -> DataFrame | None:
        """Sketches of a measure by region, if they are kept for such a period."""
        return None

    def dimension(self, name: str) -> DataFrame:
        return {
            "outlet": lambda: self.dim_outlet_plain,
            "region": lambda: self.dim_region,
            "warehouse": lambda: self.dim_warehouse,
            "route": lambda: self.dim_route,
        }[name]()

    def table(self, name: str) -> DataFrame:
        return {
            "dim_region": lambda: self.dim_region,
            "dim_warehouse": lambda: self.dim_warehouse,
            "dim_route": lambda: self.dim_route,
            "dim_salesperson": lambda: self.dim_salesperson,
            "dim_outlet": lambda: self.dim_outlet,
            "dim_product": lambda: self.dim_product,
            "dim_date": lambda: self.dim_date,
            "fact_order_lines": lambda: self.order_lines,
            "fact_deliveries": lambda: self.deliveries,
            "fact_returns": lambda: self.returns,
            "fact_freight": lambda: self.freight,
            "fact_inventory_snapshot": lambda: self.inventory,
            "fact_price_position": lambda: self.price_position,
            "fact_weather": lambda: self.weather,
        }[name]()


class LazyStar(_Star):
    def __init__(self, landed: Sources, strict_family: bool = True, shift_utc: bool = True):
        self.landed = landed
        self.spark = landed.spark
        self.strict_family = strict_family
        self.shift_utc = shift_utc

    @cached_property
    def dim_region(self) -> DataFrame:
        return dims.region(self.landed.regions)

    @cached_property
    def dim_warehouse(self) -> DataFrame:
        return dims.warehouse(self.landed.warehouses)

    @cached_property
    def dim_route(self) -> DataFrame:
        return dims.route(self.landed.routes)

    @cached_property
    def dim_salesperson(self) -> DataFrame:
        return dims.salesperson(self.landed.salespeople)

    @cached_property
    def dim_outlet(self) -> DataFrame:
        return dims.outlet(self.landed.outlets)

    @cached_property
    def dim_outlet_plain(self) -> DataFrame:
        """Outlets without the duplicate flag, whose key count no metric needs."""
        return dims.outlet_plain(self.landed.outlets)

    @cached_property
    def dim_product(self) -> DataFrame:
        return dims.product(self.landed.products)

    @cached_property
    def dim_date(self) -> DataFrame:
        orders = self.landed.orders.select(F.col("order_date").cast("date").alias("order_date"))
        return dims.date_spine_of(orders, "order_date")

    @cached_property
    def order_lines(self) -> DataFrame:
        return facts.order_lines(self.landed.order_lines, self.landed.orders, self.dim_product)

    @cached_property
    def order_lines_core(self) -> DataFrame:
        return facts.order_lines_core(self.landed.order_lines, self.landed.orders)

    @cached_property
    def order_line_keys(self) -> DataFrame:
        """Order and product of each line; the order itself is looked up by whoever joins on it."""
        return self.landed.order_lines.select("order_id", "product_id")

    @cached_property
    def deliveries(self) -> DataFrame:
        return facts.deliveries(self.landed.deliveries, self.landed.orders, self.shift_utc)

    def order_totals(self, only: Column, period: Period = ALL_DATA) -> DataFrame:
        """Eaches per order, for orders of the period that meet ``only``.

        Lines are summed before their order is looked up, so an order with very many
        lines reaches the join as one row per map task.
        """
        units = facts.line_units(self.landed.order_lines)
        sums = units.groupBy("order_id").agg(*_eaches())
        orders = period.of(facts.order_attributes(self.landed.orders).where(only), "order_date")
        return sums.join(orders, "order_id").select(
            "order_id", "order_date", "ordered_eaches", "delivered_eaches"
        )

    def deliveries_by_order(self, keys: list, aggregates: list[Column], period: Period = ALL_DATA) -> DataFrame:
        """Deliveries dispatched in ``period``, aggregated per order and ``keys``, with outlet and region.

        As with lines, the order is looked up after the aggregation.
        """
        raw = period.of(facts.delivery_columns(self.landed.deliveries, self.shift_utc), "dispatch_datetime")
        per_order = raw.groupBy("order_id", *keys).agg(*aggregates)
        return per_order.join(self.landed.orders.select("order_id", "outlet_id", "region_id"), "order_id")

    def deliveries_by_route(self, aggregates: list[Column]) -> DataFrame:
        """Needs nothing of the order: that it exists is checked on the sources."""
        return facts.delivery_columns(self.landed.deliveries, self.shift_utc).groupBy("route_id").agg(*aggregates)

    @cached_property
    def returns(self) -> DataFrame:
        return facts.returns(
            self.landed.returns_credit_notes, self.landed.order_lines, self.dim_product, self.dim_outlet_plain
        )

    @cached_property
    def returns_core(self) -> DataFrame:
        """Returns without the line lookup that only the quantity in eaches needs."""
        return facts.returns(self.landed.returns_credit_notes, None, self.dim_product, self.dim_outlet_plain)

    @cached_property
    def inventory(self) -> DataFrame:
        return facts.inventory(self.landed.inventory_snapshots, self.dim_product)

    @property
    def latest_inventory(self) -> DataFrame:
        """Stock of the newest snapshot."""
        days = self.landed.inventory_snapshots.select(F.col("snapshot_date").cast("date").alias("snapshot_date"))
        return self.inventory.where(F.col("snapshot_date") == days.agg(F.max("snapshot_date")).scalar())

    @cached_property
    def freight(self) -> DataFrame:
        invoices = self.landed.optional("freight", schemas.FREIGHT)
        return facts.freight(invoices, self.dim_warehouse, self.dim_route)

    @cached_property
    def price_position(self) -> DataFrame:
        listings = self.landed.optional("listings", schemas.LISTINGS)
        return matching.price_position(listings, self.dim_product, self.strict_family)

    @cached_property
    def weather(self) -> DataFrame:
        return facts.weather(self.landed.optional("weather", schemas.WEATHER))


class StoredStar(_Star):
    """Tables of one build of a warehouse. Use ``warehouse.open_checked`` to get one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @cached_property
    def _schemas(self) -> dict[str, StructType]:
        """The columns of every table as built; a table without rows has no file to tell them."""
        rows = self.spark.read.parquet(f"{self.path}/{SCHEMAS}").collect()  # one row per table
        return {r["table_name"]: StructType.fromJson(json.loads(r["schema"])) for r in rows}

    @cached_property
    def buckets(self) -> int:
        """Buckets by order, 0 if the build has none or an order outweighs them."""
        if not folder_exists(self.spark, f"{self.path}/{LAYOUT}"):
            return 0
        row = self.spark.read.parquet(f"{self.path}/{LAYOUT}").agg(F.max("buckets"), F.max("share")).first()
        return row[0] if row[1] is None or row[1] <= copartition.MOST_SHARE else 0

    def _read(self, name: str) -> DataFrame:
        path, schema = f"{self.path}/{name}", self._schemas[name]
        if name in BUCKETED and self.buckets:
            return copartition.read(self.spark, path, schema, BUCKETED[name], self.buckets)
        return self.spark.read.schema(schema).parquet(path)

    dim_region = cached_property(lambda self: self._read("dim_region"))
    dim_warehouse = cached_property(lambda self: self._read("dim_warehouse"))
    dim_route = cached_property(lambda self: self._read("dim_route"))
    dim_salesperson = cached_property(lambda self: self._read("dim_salesperson"))
    dim_outlet = cached_property(lambda self: self._read("dim_outlet"))
    dim_product = cached_property(lambda self: self._read("dim_product"))
    dim_date = cached_property(lambda self: self._read("dim_date"))
    order_lines = cached_property(lambda self: self._read("fact_order_lines"))
    deliveries = cached_property(lambda self: self._read("fact_deliveries"))
    returns = cached_property(lambda self: self._read("fact_returns"))
    freight = cached_property(lambda self: self._read("fact_freight"))
    inventory = cached_property(lambda self: self._read("fact_inventory_snapshot"))
    price_position = cached_property(lambda self: self._read("fact_price_position"))
    weather = cached_property(lambda self: self._read("fact_weather"))

    @property
    def dim_outlet_plain(self) -> DataFrame:
        return self.dim_outlet

    @property
    def order_lines_core(self) -> DataFrame:
        return self.order_lines

    @property
    def order_line_keys(self) -> DataFrame:
        return self.order_lines.select("order_id", "product_id")

    def order_totals(self, only: Column, period: Period = ALL_DATA) -> DataFrame:
        """All lines of an order have its date, so a period reads its months only."""
        lines = period.of(self.order_lines.where(only), "order_date")
        return lines.groupBy("order_id").agg(F.min("order_date").alias("order_date"), *_eaches())

    def deliveries_by_order(self, keys: list, aggregates: list[Column], period: Period = ALL_DATA) -> DataFrame:
        deliveries = period.of(self.deliveries, "dispatch_datetime")
        return deliveries.groupBy("order_id", "outlet_id", "region_id", *keys).agg(*aggregates)

    def deliveries_by_route(self, aggregates: list[Column]) -> DataFrame:
        return self.deliveries.groupBy("route_id").agg(*aggregates)

    @property
    def returns_core(self) -> DataFrame:
        return self.returns

    @property
    def latest_inventory(self) -> DataFrame:
        """The newest month comes from the partitions' names; only that month is read."""
        months = self.inventory.agg(F.max("snapshot_date_month")).scalar()
        newest = self.inventory.where(F.col("snapshot_date_month") == months)
        return newest.where(F.col("snapshot_date") == newest.agg(F.max("snapshot_date")).scalar())
