"""The benchmark tables (region, nation, customer, supplier, part, orders, lineitem, events)
dressed as the landed sources of a distributor, so that every operator runs on them.

Amounts are rounded to whole cents before they become decimals, so sums are exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.star import Sources
from ..schemas import table_schema
from . import landed


def _col(name: str) -> Column:
    return F.col(name)


def _code(prefix: str, key: str, width: int) -> Column:
    digits = F.col(key).cast("string")
    padded = F.lpad(digits, width, "0")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(padded))


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# The benchmark tables as they are on disk; a declared schema saves a footer scan per read.
TABLES = {
    "region": table_schema("r_regionkey INT, r_name STRING"),
    "nation": table_schema("n_nationkey INT, n_name STRING, n_regionkey INT"),
    "customer": table_schema("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"),
    "supplier": table_schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"),
    "part": table_schema(
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": table_schema(
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "lineitem": table_schema(
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": table_schema(
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": table_schema("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
    "conversations": table_schema("conv_id BIGINT, turn BIGINT, role STRING, text STRING"),
}


class SampleTables(Sources):
    """Each source is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    # -- dimensions ---------------------------------------------------------------

    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(
            _col("r_regionkey").cast("bigint").alias("region_id"),
            F.upper(F.substring("r_name", 1, 3)).alias("region_code"),
            _col("r_name").alias("region_name"),
            F.concat(F.lit("Head of "), "r_name").alias("regional_manager"),
            F.lit("ACTIVE").alias("status"),
        )

    @cached_property
    def routes(self) -> DataFrame:
        return self.raw("nation").select(
            _col("n_nationkey").cast("bigint").alias("route_id"),
            _code("RT", "n_nationkey", 3).alias("route_code"),
            _col("n_name").alias("route_name"),
            _col("n_regionkey").cast("bigint").alias("region_id"),
            F.lit("ACTIVE").alias("status"),
        )

    def _nation_region(self, key: str) -> DataFrame:
        return self.raw("nation").select(_col("n_nationkey").alias(key), _col("n_regionkey").cast("bigint").alias("region_id"))

    @cached_property
    def warehouses(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self._nation_region("s_nationkey"), "s_nationkey")
            .select(
                _col("s_suppkey").alias("warehouse_id"),
                _code("WH", "s_suppkey", 5).alias("warehouse_code"),
                _col("s_name").alias("warehouse_name"),
                F.lit("Mumbai").alias("city"),
                "region_id",
                F.concat(F.lit("Manager "), _col("s_suppkey").cast("string")).alias("manager_name"),
                F.lit("ACTIVE").alias("status"),
            )
        )

    @cached_property
    def salespeople(self) -> DataFrame:
        return self.raw("nation").select(
            _col("n_nationkey").cast("bigint").alias("salesperson_id"),
            _code("EMP", "n_nationkey", 3).alias("employee_code"),
            F.concat(F.lit("Rep "), "n_name").alias("full_name"),
            _col("n_regionkey").cast("bigint").alias("region_id"),
            F.lit("FIELD").alias("designation"),
            F.lit("ACTIVE").alias("status"),
        )

    @cached_property
    def outlets(self) -> DataFrame:
        key = _col("c_custkey")
        name = F.when(key % 211 == 0, F.concat(F.lit("ZZ "), "c_name")).when(
            key % 307 == 0, F.concat(F.lit("DO NOT USE "), "c_name")
        )
        cities = F.array(*[F.lit(c) for c in ("Bangalore", "New Delhi", "Mumbai", "Bengaluru", "Delhi")])
        gst = F.when(key % 3 != 0, F.concat(F.lit("GST"), (key - F.when(key % 40 == 1, 1).otherwise(0)).cast("string")))
        return (
            self.raw("customer")
            .join(self._nation_region("c_nationkey"), "c_nationkey")
            .select(
                key.alias("outlet_id"),
                _code("OUT", "c_custkey", 7).alias("outlet_code"),
                name.otherwise(_col("c_name")).alias("outlet_name"),
                F.element_at(cities, (key % 5 + 1).cast("int")).alias("city"),
                "region_id",
                _col("c_nationkey").cast("bigint").alias("route_id"),
                gst.alias("gst_number"),
                (key - key % 60).cast("double").alias("latitude"),
                _col("c_nationkey").cast("double").alias("longitude"),
                F.when(key % 97 == 0, 1).otherwise(0).alias("is_deleted"),
                F.when(key % 31 == 0, "CLOSED").otherwise("ACTIVE").alias("status"),
                F.concat(F.lit("Contact "), key.cast("string")).alias("contact_name"),
                F.concat(F.lit("+91"), F.lpad(key.cast("string"), 10, "9")).alias("contact_phone"),
                F.concat(F.lit("outlet"), key.cast("string"), F.lit("@example.com")).alias("contact_email"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        key = _col("p_partkey")
        return self.raw("part").select(
            key.alias("product_id"),
            _code("SKU", "p_partkey", 6).alias("sku_code"),
            _col("p_name").alias("product_name"),
            _col("p_brand").alias("brand"),
            _col("p_type").alias("category"),
            _col("p_size").cast("double").alias("pack_size_value"),
            F.lit("G").alias("pack_size_uom"),
            (_cents("p_retailprice") / 100).cast("decimal(18,2)").alias("mrp_inr"),
            F.when(_col("p_type").isin("SMALL", "PROMO"), 1).otherwise(0).alias("is_chilled"),
            F.when(key % 14 == 0, F.lit("1998-06-30")).alias("discontinued_date"),
            _null("string").alias("launch_date"),
        )

    # -- transactions -------------------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        place = self.outlets.select(_col("outlet_id"), "region_id", "route_id")
        status = F.when(_col("o_orderstatus") == "F", "DELIVERED").when(_col("o_orderstatus") == "P", "PARTIAL")
        return (
            self.raw("orders")
            .withColumnRenamed("o_custkey", "outlet_id")
            .join(place, "outlet_id")
            .select(
                _col("o_orderkey").alias("order_id"),
                _col("o_orderkey").cast("string").alias("order_number"),
                "outlet_id",
                _col("o_orderdate").cast("date").alias("order_date"),
                _null("string").alias("requested_delivery_date"),
                _col("o_orderpriority").alias("channel"),
                "region_id",
                "route_id",
                _null("bigint").alias("warehouse_id"),
                _col("route_id").alias("salesperson_id"),
                status.otherwise("OPEN").alias("order_status"),
                F.lit("ERP_WEB").alias("source_system"),
                _null("string").alias("promo_code"),
            )
        )

    @staticmethod
    def _line_id() -> Column:
        """Order and line number alone repeat in these tables; with part, supplier and price they do not."""
        parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
        return F.concat_ws("-", *parts, _cents("l_extendedprice").cast("string"))

    @cached_property
    def order_lines(self) -> DataFrame:
        discount = F.round(_col("l_discount") * 100).cast("bigint")
        ordered = _col("l_quantity").cast("bigint")
        short = F.floor(_col("l_quantity") * F.round(_col("l_discount") * 100) / F.lit(100.0))
        value_e4 = (_cents("l_extendedprice") * (F.lit(100) - discount)).cast("decimal(18,0)")
        return self.raw("lineitem").select(
            self._line_id().alias("order_line_id"),
            _col("l_orderkey").alias("order_id"),
            _col("l_linenumber").alias("line_number"),
            _col("l_partkey").alias("product_id"),
            _col("l_suppkey").alias("warehouse_id"),
            ordered.alias("ordered_qty"),
            ordered.alias("allocated_qty"),
            (ordered - short).cast("bigint").alias("delivered_qty"),
            F.when(_col("l_linestatus") == "F", "CASE").otherwise("EACH").alias("qty_uom"),
            (F.lit(1) + _col("l_partkey") % 24).cast("bigint").alias("case_pack_at_order"),
            (_cents("l_extendedprice") / 100).cast("decimal(18,4)").alias("unit_price_inr"),
            discount.cast("double").alias("line_discount_pct"),
            (value_e4 / F.lit(10000)).cast("decimal(18,4)").alias("line_value_inr"),
            (_col("l_tax") * 100).alias("gst_rate_pct"),
            _null("string").alias("batch_id"),
            F.lit(0).alias("substitution_flag"),
            _null("string").alias("short_reason_code"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        """One per order that has lines."""
        shipped = self.raw("lineitem").groupBy(_col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("ship"), F.min("l_suppkey").alias("warehouse_id")
        )
        key = _col("order_id")
        late = F.floor(F.datediff("ship", "order_date") / F.lit(5.0)).cast("int") + (_col("route_id") % 5 * 10).cast("int")
        vendors = F.when(key % 3 == 0, "TELEMATICS_A").when(key % 3 == 1, "TELEMATICS_B").otherwise("MANUAL")
        # One arrival in eight agrees with the recorded delay, the others are a day-part off.
        actual = F.col("planned") + F.make_dt_interval(mins=F.col("delay_minutes") + (key % 8 * 60).cast("int"))
        as_text = F.when(key % 3 == 1, F.date_format(actual, "dd-MMM-yyyy hh:mm a")).otherwise(
            F.date_format(actual, "yyyy-MM-dd HH:mm:ss")
        )
        return (
            shipped.join(self.orders.select("order_id", "order_date", "route_id"), "order_id")
            .withColumn("delay_minutes", late)
            .withColumn("planned", F.col("ship") + F.expr("INTERVAL 10 HOURS"))
            .select(
                key.alias("delivery_id"),
                "order_id",
                F.concat(F.lit("DN"), key.cast("string")).alias("delivery_note_number"),
                "route_id",
                "warehouse_id",
                vendors.alias("telematics_vendor"),
                F.date_format("ship", "yyyy-MM-dd HH:mm:ss").alias("dispatch_datetime"),
                F.date_format("planned", "yyyy-MM-dd HH:mm:ss").alias("planned_arrival"),
                as_text.alias("actual_arrival"),
                "delay_minutes",
                _null("double").alias("distance_km"),
                F.lit("DONE").alias("delivery_status"),
                F.lit(1).alias("pod_captured"),
                F.when(key % 17 == 0, 1).otherwise(0).alias("temperature_excursion_flag"),
                _null("double").alias("max_temp_celsius"),
                F.lit(0).cast("bigint").alias("returned_cases"),
                _null("string").alias("failure_reason_code"),
                _null("decimal(18,2)").alias("fuel_cost_inr"),
            )
        )

    @cached_property
    def returns_credit_notes(self) -> DataFrame:
        """All returned lines; the sign of the quantity is unreliable."""
        n = _col("l_linenumber")
        reason = (
            F.when(n == 1, "RT01_NEAR_EXPIRY")
            .when(n == 6, "RT06_COLD_CHAIN_BREACH")
            .otherwise(F.concat(F.lit("RT0"), n.cast("string"), F.lit("_OTHER")))
        )
        qty = _col("l_quantity").cast("bigint")
        owner = self.raw("orders").select(_col("o_orderkey").alias("l_orderkey"), _col("o_custkey").alias("outlet_id"))
        return (
            self.raw("lineitem")
            .where(_col("l_returnflag") == "R")
            .join(owner, "l_orderkey")
            .select(
                self._line_id().alias("return_id"),
                F.concat(F.lit("CN"), self._line_id()).alias("credit_note_number"),
                _col("l_orderkey").alias("order_id"),
                self._line_id().alias("order_line_id"),
                "outlet_id",
                _col("l_partkey").alias("product_id"),
                _col("l_shipdate").cast("date").alias("return_date"),
                F.when(n % 2 == 0, -qty).otherwise(qty).alias("return_qty"),
                F.when(_col("l_linestatus") == "F", "CASE").otherwise("EACH").alias("qty_uom"),
                reason.alias("return_reason_code"),
                (_cents("l_extendedprice") / 100).cast("decimal(18,2)").alias("credit_note_value_inr"),
                F.lit("SCRAP").alias("disposition"),
                F.lit("CLOSED").alias("status"),
            )
        )

    @cached_property
    def inventory_snapshots(self) -> DataFrame:
        shelf = self.raw("part").select(_col("p_partkey").alias("l_partkey"), "p_size")
        day = F.trunc(_col("l_shipdate").cast("date"), "week")
        on_hand = _col("l_quantity").cast("bigint")
        none = F.lit(0).cast("bigint")
        return (
            self.raw("lineitem")
            .join(shelf, "l_partkey")
            .select(
                self._line_id().alias("snapshot_id"),
                day.alias("snapshot_date"),
                _col("l_suppkey").alias("warehouse_id"),
                _col("l_partkey").alias("product_id"),
                self._line_id().alias("batch_id"),
                on_hand.alias("on_hand_cases"),
                (on_hand * (F.lit(1) + _col("l_partkey") % 24)).alias("on_hand_eaches"),
                none.alias("allocated_cases"),
                on_hand.alias("available_cases"),
                _null("double").alias("days_of_cover"),
                F.date_add(_col("l_shipdate").cast("date"), _col("p_size") * 2 - 12).alias("expiry_date"),
                F.concat(F.lit("AGE"), (_col("l_linenumber") % 4).cast("string")).alias("ageing_bucket"),
                none.alias("damaged_cases"),
                none.alias("blocked_cases"),
                _null("double").alias("storage_temp_celsius"),
            )
        )

    # -- feeds --------------------------------------------------------------------

    @cached_property
    def invoices(self) -> DataFrame:
        """Freight invoices as the partner sends them: minor units, UTC text."""
        key = _col("o_orderkey")
        code = F.concat(F.lit("CR"), (key % 7).cast("string"))
        warehouse = F.lpad((key % 120).cast("string"), 5, "0")
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        created = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
        return self.raw("orders").select(
            F.concat(F.lit("INV"), key.cast("string")).alias("invoice_id"),
            code.alias("carrier_id"),
            F.concat(F.lit("Carrier "), code).alias("carrier_name"),
            F.concat(F.lit("WH"), warehouse).alias("warehouse_code"),
            F.concat(F.lit("RT"), F.lpad((key % 27).cast("string"), 3, "0")).alias("route_code"),
            day.alias("invoice_date"),
            day.alias("service_date"),
            _cents("o_totalprice").alias("amount"),
            F.when(key % 3 != 0, key % 5000).alias("detention_charge"),
            (key % 10).cast("double").alias("fuel_surcharge_pct"),
            (key % 900).cast("double").alias("distance_km"),
            (key % 7000).cast("double").alias("weight_kg"),
            (key % 4 == 0).alias("temperature_controlled"),
            F.lit("BILLED").alias("status"),
            F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at_utc"),
        )

    def invoice_pages(self, per_page: int = 200) -> DataFrame:
        """The same invoices as landed page documents, ``per_page`` at most to a page."""
        page = F.floor(F.col("key") / per_page)
        rows = self.invoices.withColumn("key", F.substring("invoice_id", 4, 20).cast("bigint"))
        fields = [c for c in rows.columns if c != "key"]
        return (
            rows.groupBy(page.alias("page"))
            .agg(F.collect_list(F.struct(*fields)).alias("data"), F.count(F.lit(1)).alias("n"))
            .select(
                "page",
                F.to_json(
                    F.struct(
                        "data",
                        F.concat(F.lit("c"), (F.col("page") + 1).cast("string")).alias("next_cursor"),
                        F.col("n").alias("total_estimate"),
                    )
                ).alias("body"),
            )
        )

    @cached_property
    def carriers(self) -> DataFrame:
        """Carriers with the (at most five) regions their routes lie in."""
        route = self.routes.select("route_code", "region_id").join(self.regions, "region_id")
        return (
            self.invoices
            .select("carrier_id", "carrier_name", "route_code")
            .distinct()
            .join(route, "route_code")
            .groupBy("carrier_id", "carrier_name")
            .agg(F.sort_array(F.collect_set("region_code")).alias("regions"))
        )

    @cached_property
    def surcharge_docs(self) -> DataFrame:
        """One JSON document per month with orders."""
        month = F.date_format("o_orderdate", "yyyy-MM")
        return (
            self.raw("orders")
            .groupBy(month.alias("month"))
            .agg((F.count(F.lit(1)) % 25).cast("double").alias("surcharge_pct"))
            .select(F.to_json(F.struct("month", "surcharge_pct")).alias("body"))
        )

    @cached_property
    def weather_docs(self) -> DataFrame:
        """One document per city with parallel daily arrays (one entry per calendar day)."""
        daily = self.raw("events").groupBy(_col("event_type").alias("city"), _col("ts").cast("date").alias("day")).agg(
            F.max("value").alias("tmax"), F.min("value").alias("rain")
        )
        days = F.sort_array(F.collect_list(F.struct("day", "tmax", "rain")))
        return daily.groupBy("city").agg(days.alias("d")).select(
            F.to_json(
                F.struct(
                    "city",
                    F.struct(
                        F.transform("d", lambda x: x["day"].cast("string")).alias("time"),
                        F.transform("d", lambda x: x["tmax"]).alias("temperature_2m_max"),
                        F.transform("d", lambda x: x["rain"]).alias("precipitation_sum"),
                    ).alias("daily"),
                )
            ).alias("body")
        )

    LISTING_CITIES = ("mumbai", "delhi", "bengaluru", "chennai")

    @cached_property
    def listings(self) -> DataFrame:
        key = _col("p_partkey")
        cities = F.array(*[F.lit(c) for c in self.LISTING_CITIES])
        even = key % 2 == 0
        price_e4 = (_cents("p_retailprice") * (F.lit(85) + key % 30)).cast("decimal(18,0)")
        size = _col("p_size").cast("double")
        return self.raw("part").select(
            key.cast("string").alias("listing_id"),
            F.element_at(cities, (key % 4 + 1).cast("int")).alias("city"),
            F.concat(F.lit("/product/"), key.cast("string"), F.lit(".html")).alias("product_detail_url"),
            F.concat_ws(" ", "p_brand", "p_name").alias("title"),
            F.when(key % 10 != 3, _col("p_brand")).alias("brand_guess"),
            F.concat(F.lit("shop"), (key % 9).cast("string")).alias("retailer"),
            F.when(even, size / F.lit(1000.0)).otherwise(size).alias("pack_value"),
            F.when(even, "KG").otherwise("G").alias("pack_uom"),
            _col("p_type").alias("category"),
            (price_e4 / F.lit(10000)).cast("decimal(18,4)").alias("price_inr"),
            (_cents("p_retailprice") / 100).cast("decimal(18,2)").alias("mrp_inr"),
            F.lit("IN_STOCK").alias("stock_status"),
            F.lit("2001-08-01").alias("last_seen"),
        )

    CARDS_PER_PAGE = 20

    def listing_pages(self) -> DataFrame:
        """The listings as raw city pages of cards, in the four price markups in turn."""
        key = _col("p_partkey")
        paise = _cents("p_retailprice")
        rupees = F.format_number(paise / F.lit(100.0), 2)
        price = (
            F.when(key % 5 == 0, F.concat(F.lit('<span class="price">&#8377;'), rupees, F.lit("</span>")))
            .when(
                key % 5 == 1,
                F.concat(F.lit('<span class="pricing-block" data-price-paise="'), paise.cast("string"), F.lit('">-</span>')),
            )
            .when(key % 5 == 2, F.concat(F.lit('<div class="amt">Rs '), rupees, F.lit(" <small>incl</small></div>")))
            .when(key % 5 == 3, F.concat(F.lit('<b class="sellingPrice">INR '), rupees, F.lit("</b>")))
            .otherwise(F.lit("<i>price on request</i>"))
        )
        stock = F.when(key % 2 == 0, "In stock").otherwise("Currently unavailable")
        rated = F.concat(
            F.lit("rated "), (key % 5).cast("string"), F.lit("."), (key % 10).cast("string"), F.lit(" ("),
            (key % 100).cast("string"), F.lit(")"),
        )
        unit = F.when(key % 2 == 0, " g").otherwise(" ML")
        card = F.concat(
            F.lit('<div class="card product-item" data-listing-id="'), key.cast("string"), F.lit('"><a href="/product/'),
            key.cast("string"), F.lit('.html"><strong>'), "p_brand", F.lit(" &amp; "), "p_name",
            F.lit('</strong></a> <div class="muted">shop'), (key % 9).cast("string"), F.lit(" &middot; "),
            _col("p_size").cast("string"), unit, F.lit(" &middot; "), "p_type", F.lit("</div>"), price,
            F.lit('<div class="muted">MRP &#8377;'), rupees, F.lit(" &middot; "), stock, F.lit(" &middot; "), rated,
            F.lit('</div><div class="muted">Last seen: 2001-08-'), F.lpad((key % 28 + 1).cast("string"), 2, "0"),
            F.lit("</div></div>"),
        )
        city = F.element_at(F.array(*[F.lit(c) for c in self.LISTING_CITIES]), (key % 4 + 1).cast("int"))
        # A city owns every fourth key, so a page of CARDS_PER_PAGE spans four times as many keys.
        page = F.floor(key / (4 * self.CARDS_PER_PAGE)) + 1
        # Pages declare how many there are; one city declares a page that never landed.
        declared = self.raw("part").agg(F.max(page)).scalar() + F.when(_col("city") == "delhi", 1).otherwise(0)
        return (
            self.raw("part")
            .select(city.alias("city"), page.alias("page"), key.alias("key"), card.alias("card"))
            .groupBy("city", "page")
            .agg(F.sort_array(F.collect_list(F.struct("key", "card"))).alias("cards"))
            .select(
                "city",
                F.concat(F.lit("/city/"), "city", F.lit("/page/"), F.col("page").cast("string"), F.lit(".html")).alias("url"),
                F.concat(
                    F.lit("<html><body><p>Page "), F.col("page").cast("string"), F.lit(" of "), declared.cast("string"),
                    F.lit("</p>"),
                    F.array_join(F.transform("cards", lambda c: c["card"]), ""), F.lit("</body></html>"),
                ).alias("html"),
            )
        )

    @cached_property
    def freight(self) -> DataFrame:
        return landed.normalise_invoices(self.invoices)

    @cached_property
    def weather(self) -> DataFrame:
        return landed.weather_days(landed.parse_documents(self.weather_docs, "body", "weather"))
