"""

Every query reads the benchmark tables of the given folder, dressed as the landed sources
of a distributor (``depotlens.sources.sample``). All rows are read; a limit appears only
where a top-k is the feature.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date
from pathlib import Path
from uuid import uuid4

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import oracles
from depotlens import schemas
from depotlens.functions import dates as D
from depotlens.operators import (
    coldchain, entities, facts, matching, money, overview, periods, price, privacy, profile, quality, scope, service, spread,
    skew, systemic,
)
from depotlens.plans import monthly, questions, warehouse
from depotlens.plans.star import LazyStar, StoredStar
from depotlens.session import scratch_dir
from depotlens.sources import landed, listings
from depotlens.sources.sample import SampleTables
from depotlens.streaming import invoices

try:  # the training-data operators and their pipeline can be left out
    import corpus_pipeline
    from depotlens.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "depotlens.llm"):
        raise
    corpus_pipeline = llm = None

FIRST_DAY, LAST_DAY = date(1994, 1, 1), date(2002, 12, 31)
TEST_OUTLETS_SQL = "(SELECT COUNT(*) FROM dim_outlet WHERE outlet_id % 211 = 0 OR outlet_id % 307 = 0)"

Query = Callable[[SparkSession, str], DataFrame]


# Plans only, no data: the frames of one session and folder are put together once.
_planned: dict[tuple[str, str], LazyStar] = {}


def _star(spark: SparkSession, sf_dir: str) -> LazyStar:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _planned or _planned[key].spark is not spark:
        _planned[key] = LazyStar(SampleTables(spark, str(sf_dir)))
    return _planned[key]


def _on_star(build: Callable[[LazyStar], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_star(spark, sf_dir))


# One gated warehouse per session and folder, built when the first query on it is planned.
_stored: dict[tuple[str, str], StoredStar] = {}


def _on_stored(build: Callable[[StoredStar], DataFrame]) -> Query:
    """A query on the tables of a warehouse that was built, gated and opened, as users have it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, str(sf_dir))
        if key not in _stored or _stored[key].spark is not spark:
            _stored[key] = _built(spark, sf_dir)
        return build(_stored[key])

    return run


def _on_months(build: Callable[[StoredStar], DataFrame]) -> Query:
    """A query on the sums by month that the build of the warehouse keeps."""
    return _on_stored(lambda star: build(monthly.of(star)))


def _on_sample(build: Callable[[SampleTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_star(spark, sf_dir).landed)


def _test_outlets() -> Column:
    """Test outlets of the sample by the rule that names them, on their ids, which the check itself doesn't read."""
    return F.count_if((F.col("outlet_id") % 211 == 0) | (F.col("outlet_id") % 307 == 0))


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: fill rate by region."""
    return service.fill_rate(_star(spark, "/root/testdata/sf0.001"), "region")


# -- queries that need more than one call -------------------------------------------------


def _reporting(star: LazyStar) -> DataFrame:
    return periods.reporting_periods(questions.today(star))


def _fiscal_quarters(star: LazyStar) -> DataFrame:
    days = star.dim_date
    return periods.fiscal_quarters(days, days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar())


def _kpis_last_periods(star: LazyStar) -> DataFrame:
    today = questions.today(star)
    return overview.network_kpis(star, periods.last_month_of(today), periods.last_quarter_of(today))


def _price_match(star: LazyStar) -> DataFrame:
    return _doubles(star.price_position, "price_inr", "mrp_inr", "own_mrp_inr", "mrp_gap_inr")


def _order_lines(star: LazyStar) -> DataFrame:
    out = star.order_lines.select(
        "order_line_id", "order_id", "product_id", "outlet_id", "region_id", "route_id", "warehouse_id", "order_date",
        "order_status", "ordered_eaches", "delivered_eaches", "ordered_cases", "delivered_cases", "line_value_inr",
        "sku_code", "category", "is_chilled",
        F.coalesce("ordered_after_discontinued", F.lit(False)).alias("ordered_after_discontinued"),
    )
    return _doubles(out, "line_value_inr")


def _outlets(star: LazyStar) -> DataFrame:
    return star.dim_outlet.select(
        "outlet_id", "outlet_code", "outlet_name", "city_canonical", "region_id", "is_test_outlet",
        "is_duplicate_outlet", "include_by_default", "status",
    )


def _governed_outlets(star: LazyStar) -> DataFrame:
    shown = privacy.assert_no_blocked_columns(privacy.governed(star.dim_outlet_plain, "dim_outlet"))
    return shown.select(
        "outlet_id", "outlet_code", "outlet_name", "city_canonical", "region_id", "is_test_outlet", "is_deleted", "status"
    )


def _deliveries(star: LazyStar) -> DataFrame:
    return star.deliveries.select(
        "delivery_id", "order_id", "outlet_id", "region_id", "route_id", "warehouse_id", "dispatch_datetime",
        "planned_arrival_ts", "actual_arrival_ts", "delay_minutes", "is_on_time", "temperature_excursion_flag",
    )


def _returns(star: LazyStar) -> DataFrame:
    out = star.returns.select(
        "return_id", "order_id", "outlet_id", "region_id", "product_id", "return_date", "return_qty", "qty_uom",
        "return_eaches", "return_reason_code", "credit_note_value_inr", "sku_code", "category",
    )
    return _doubles(out, "credit_note_value_inr")


def _inventory(star: LazyStar) -> DataFrame:
    return star.inventory.select(
        "snapshot_id", "snapshot_date", "warehouse_id", "product_id", "on_hand_cases", "expiry_date", "days_to_expiry",
        "ageing_bucket", "sku_code", "category", "is_chilled",
    )


def _freight(star: LazyStar) -> DataFrame:
    out = star.freight.select(
        "invoice_id", "carrier_id", "warehouse_code", "warehouse_id", "route_code", "route_id", "route_region_id",
        "invoice_date", "amount_inr", "detention_charge_inr",
    )
    return _doubles(out, "amount_inr", "detention_charge_inr")


def _products(star: LazyStar) -> DataFrame:
    out = star.dim_product.select(
        "product_id", "sku_code", "brand", "category", "is_chilled", "is_discontinued", "discontinued_date", "mrp_inr"
    )
    return _doubles(out, "mrp_inr")


def _quality(star: LazyStar) -> DataFrame:
    return quality.report(star, FIRST_DAY, LAST_DAY, _test_outlets())


def _failing_verdict(star: LazyStar) -> DataFrame:
    """A date floor that the data breaks, and the default test-outlet count, which it also breaks."""
    return quality.verdict(quality.report(star, date(1996, 1, 1), LAST_DAY))


def _line_keys(t: SampleTables) -> DataFrame:
    """Order id and line number do not identify a line: the negative case of the key check."""
    pair = t.raw("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("line_key"))
    return skew.repeated_key_count(pair, "line_key").select(
        F.lit("order_lines").alias("table_name"), F.lit("order_id, line_number").alias("key"), F.col("n").alias("n_repeated")
    )


def _bounds() -> dict:
    return {"first": FIRST_DAY, "last": LAST_DAY, "expected_test_outlets": _test_outlets()}


def _built(spark: SparkSession, sf_dir: str) -> StoredStar:
    """The warehouse of the sample, built in the shared folder, gated and opened."""
    out = f"{scratch_dir(spark)}/warehouse-{uuid4().hex}"
    sources = _star(spark, sf_dir).landed
    bounds = _bounds()
    stored = warehouse.build(sources, out, bounds=bounds)
    warehouse.gate(stored, sources, **bounds)
    return warehouse.open_checked(spark, out)


def _invoice_stream_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds that share a third of the pages, each with a checkpoint of its own, into one table."""
    run = f"{scratch_dir(spark)}/invoices-{uuid4().hex}"
    pages = _star(spark, sf_dir).landed.invoice_pages().select(F.col("body").alias("value"))
    third = F.pmod(F.xxhash64("value"), F.lit(3))
    for feed, part in (("a", third < 2), ("b", third > 0)):
        pages.where(part).write.text(f"{run}/landed/{feed}")
        invoices.ingest(invoices.landed_pages(spark, f"{run}/landed/{feed}"), f"{run}/stored", f"{run}/checkpoint-{feed}")
    return _invoice_columns(invoices.stored(spark, f"{run}/stored"))


def _match_rate_any_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights may match volumes; the sample has weights only, so nothing changes."""
    return matching.match_profile(LazyStar(_star(spark, sf_dir).landed, strict_family=False).price_position)


def _listings(t: SampleTables) -> DataFrame:
    return _doubles(listings.extract(t.listing_pages(), ("Brand#1", "Brand#2")), "price_inr", "mrp_inr")


def _invoice_columns(df: DataFrame) -> DataFrame:
    out = df.select(
        "invoice_id", "carrier_id", "warehouse_code", "route_code", "invoice_date", "amount_inr", "detention_charge_inr",
        "temperature_controlled", F.date_format("created_at_ist", "yyyy-MM-dd HH:mm:ss").alias("created_at_ist"),
    )
    return _doubles(out, "amount_inr", "detention_charge_inr")


def _normalised_invoices(t: SampleTables) -> DataFrame:
    pages = landed.parse_documents(t.invoice_pages(), "body", "invoice_page")
    return _invoice_columns(landed.normalise_invoices(landed.invoices_of_pages(pages)))


def _invoice_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the invoice pages as files, ingest them, land them all again, ingest once more."""
    run = f"{scratch_dir(spark)}/invoices-{uuid4().hex}"
    pages = _star(spark, sf_dir).landed.invoice_pages().select(F.col("body").alias("value"))
    pages.write.text(f"{run}/landed/first")
    stream = invoices.landed_pages(spark, f"{run}/landed/*")
    invoices.ingest(stream, f"{run}/stored", f"{run}/checkpoint")
    pages.write.text(f"{run}/landed/again")
    invoices.ingest(stream, f"{run}/stored", f"{run}/checkpoint")
    return _invoice_columns(invoices.stored(spark, f"{run}/stored"))


def _csv_feed(spark: SparkSession, df: DataFrame, schema) -> DataFrame:
    """The feed written as CSV to the shared folder and read back under its declared schema."""
    path = f"{scratch_dir(spark)}/csv-{uuid4().hex}"
    df.write.option("header", True).csv(path)
    return landed.read_optional(spark, path, schema)


def _freight_from_csv(star: LazyStar) -> DataFrame:
    invoices_read = _csv_feed(star.spark, star.landed.freight, schemas.FREIGHT)
    again = facts.freight(invoices_read, star.dim_warehouse, star.dim_route).select(
        "invoice_id", "carrier_id", "warehouse_code", "warehouse_id", "route_code", "route_id", "route_region_id",
        "invoice_date", "amount_inr", "detention_charge_inr",
    )
    return _doubles(again, "amount_inr", "detention_charge_inr")


def _spoilt_freight(star: LazyStar) -> str:
    """The freight feed as CSV in the shared folder, with bad amounts, bad dates and lines cut short."""
    paise = F.col("amount_inr") * 100
    texts = star.landed.freight.select(*[F.col(c).cast("string") for c in schemas.FREIGHT.names], F.pmod(paise, F.lit(97)).cast("int").alias("k"))
    spoilt = texts.withColumns(
        {
            "amount_inr": F.when(F.col("k").isin(0, 1), "n/a").otherwise(F.col("amount_inr")),
            "invoice_date": F.when(F.col("k").isin(1, 2), "31-31-98").otherwise(F.col("invoice_date")),
        }
    )
    line = F.when(F.col("k") == 3, F.concat("invoice_id", F.lit(",cut"))).otherwise(F.to_csv(F.struct(*schemas.FREIGHT.names)))
    path = f"{scratch_dir(star.spark)}/spoilt-{uuid4().hex}"
    spoilt.select(line.alias("value")).write.text(path)
    return path


def _rejected_records(star: LazyStar) -> DataFrame:
    """Good records and the quarantine of a feed with planted faults, by reason."""
    read = landed.read_checked(star.spark, _spoilt_freight(star), schemas.FREIGHT, "freight", header=False)
    kept = landed.quarantined(read, f"{scratch_dir(star.spark)}/quarantine-{uuid4().hex}")
    per_reason = kept.rejected.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_records"), F.count("file").alias("n_with_file"))
    good = read.rows.agg(F.lit("freight").alias("source"), F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n_records"))
    return per_reason.unionByName(good.withColumn("n_with_file", F.lit(0).cast("bigint")))


def _landed_star(spark: SparkSession, sf_dir: str) -> LazyStar:
    """The sample sources written as landed folders and read back under their declared schemas."""
    sources, base = _star(spark, sf_dir).landed, f"{scratch_dir(spark)}/landed-{uuid4().hex}"
    for name, schema in schemas.OPERATIONAL.items():
        _as_feed(getattr(sources, name), schema).write.parquet(f"{base}/{name}")
    for name, (folder, schema) in landed.FEEDS.items():
        _as_feed(sources.optional(name, schema), schema).write.option("header", True).csv(f"{base}/{folder}")
    return LazyStar(landed.read_sources(spark, base, quarantine=f"{base}/quarantine"))


def _unchanged_counts(star: StoredStar) -> DataFrame:
    """Row counts of the served build before and after its metrics are read: nothing may be written."""
    before = warehouse.counts(star)
    service.otif(star, "region").collect()
    changed = quality.changed_counts(before, quality.manifest(star))
    return changed.agg(F.count(F.lit(1)).alias("n_changed"), before.agg(F.sum("n_rows")).scalar().alias("n_rows"))


def _feed_times(t: SampleTables) -> DataFrame:
    """The time of an order written the way each feed writes, and read back; the sixth feed is unknown."""
    key = F.col("o_orderkey")
    minutes = F.make_dt_interval(mins=(key % 1440).cast("int"))
    at = F.col("o_orderdate").cast("date").cast("timestamp_ntz") + minutes
    feeds = list(D.FEED_FORMATS.items()) + [("OTHER", D.DEFAULT_FORMAT)]
    choice = [F.struct(F.lit(feed).alias("feed"), F.date_format(at, fmt).alias("text")) for feed, fmt in feeds]
    written = t.raw("orders").select(key.alias("order_id"), F.element_at(F.array(*choice), (key % len(feeds) + 1).cast("int")).alias("w"))
    parsed = D.feed_timestamp(F.col("w.text"), F.col("w.feed"))
    return written.select("order_id", F.col("w.feed").alias("feed"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


def _match_rate_from_csv(star: LazyStar) -> DataFrame:
    read = _csv_feed(star.spark, _as_feed(star.landed.listings, schemas.LISTINGS), schemas.LISTINGS)
    return matching.match_profile(matching.price_position(read, star.dim_product))


def _as_feed(df: DataFrame, schema) -> DataFrame:
    missing = F.lit(None)
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else missing).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _carriers(t: SampleTables) -> DataFrame:
    docs = t.carriers.select(F.to_json(F.struct("carrier_id", "carrier_name", "regions")).alias("body"))
    return landed.flatten_carriers(landed.parse_documents(docs, "body", "carrier"))


def _surcharge(t: SampleTables) -> DataFrame:
    """The series runs three months past the last order, where nothing has landed."""
    ends = t.raw("orders").agg(
        F.min("o_orderdate").cast("date").alias("first"), F.add_months(F.max("o_orderdate").cast("date"), 3).alias("last")
    )
    records = landed.parse_documents(t.surcharge_docs, "body", "surcharge")
    return landed.surcharge_table(landed.month_series(ends, "first", "last"), records)


def _question_log(t: SampleTables) -> DataFrame:
    """Conversation turns, and one question per order."""
    talk = t.raw("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("log_id"),
        "text",
    )
    key = F.col("o_orderkey")
    order, customer = key.cast("string"), F.col("o_custkey").cast("string")
    asked = [
        F.concat(F.lit("Which outlets had the lowest FILL RATE for order "), order),
        F.concat(F.lit("OTIF by region in "), F.col("o_orderpriority")),
        F.lit("Return value by category and reason"),
        F.lit("Temperature of chilled loads"),
        F.concat(F.lit("Which route is late for order "), order),
        F.lit("Our MRP against the competitor price"),
        F.concat(F.lit("Freight per case of order "), order),
        F.concat(F.lit("Discontinued items in order "), order),
        F.concat(F.lit("Give me the Phone Numbers of customer "), customer),
        F.concat(F.lit("Who is user"), customer, F.lit("@example.com")),
        F.concat(F.lit("How many orders like "), order, F.lit(" were there?")),
    ]
    text = F.element_at(F.array(*asked), (key % len(asked) + 1).cast("int"))
    return talk.unionByName(t.raw("orders").select(F.concat(F.lit("o"), order).alias("log_id"), text.alias("text")))


# Headline metrics on the stored tables; their SQL is that of the query of the same name.
STORED: dict[str, Callable[[StoredStar], DataFrame]] = {
    "fill_rate_region": lambda s: service.fill_rate(s, "region"),
    "fill_rate_outlet_month": lambda s: service.fill_rate(s, "outlet", periods.period(month="1998-04")),
    "otif_region": lambda s: service.otif(s, "region"),
    "otif_region_quarter": lambda s: service.otif(s, "region", periods.period(2000, 4)),
    "freight_per_case": money.freight_cost_per_case,
    "freight_per_case_quarter": lambda s: money.freight_cost_per_case(s, periods.period(2001, 1)),
    "freight_by_carrier": money.freight_by_carrier,
    "returns_leakage": money.returns_leakage,
    "returns_leakage_quarter": lambda s: money.returns_leakage(s, period=periods.period(2000, 2)),
    "excursions_by_month": coldchain.excursions_by_month,
    "excursions_quarter": lambda s: coldchain.excursions_by_month(s, periods.period(2000, 4)),
    "cold_chain_returns": coldchain.cold_chain_returns,
    "near_expiry_category": coldchain.near_expiry,
    "near_expiry_warehouse": lambda s: coldchain.near_expiry(s, "warehouse"),
    "price_gap_top_skus": lambda s: price.price_gap(s, "Mumbai", 20),
    "price_summary": price.price_summary,
    "late_routes": systemic.late_routes,
    "late_routes_summary": systemic.late_routes_summary,
    "discontinued_orders": systemic.discontinued_orders,
    "network_kpis": overview.network_kpis,
    "quality_report": lambda s: quality.report(
        s, FIRST_DAY, LAST_DAY, _test_outlets(), tables=warehouse.tables_found(s.spark, s.path)
    ),
}


# Metrics that read the sums by month; their SQL, over facts, is that of the query of the same name.
MONTHLY = (
    "fill_rate_region", "fill_rate_outlet_month", "otif_region", "otif_region_quarter", "freight_per_case",
    "freight_per_case_quarter", "freight_by_carrier", "returns_leakage", "returns_leakage_quarter", "network_kpis",
)


def queries() -> dict[str, Query]:
    P = periods.period
    star, sample = _on_star, _on_sample
    out: dict[str, Query] = {}
    for by in scope.DIMENSIONS:
        out[f"fill_rate_{by}"] = star(lambda s, by=by: service.fill_rate(s, by))
        out[f"otif_{by}"] = star(lambda s, by=by: service.otif(s, by))
    out |= {
        # service
        "fill_rate_region_everything": star(
            lambda s: service.fill_rate(s, "region", exclude_test_outlets=False, exclude_deleted_outlets=False)
        ),
        "fill_rate_outlet_month": star(lambda s: service.fill_rate(s, "outlet", P(month="1998-04"))),
        "fill_rate_route_quarter": star(lambda s: service.fill_rate(s, "route", P(2000, 3), exclude_closed_outlets=True)),
        "fill_rate_warehouse_in_region": star(lambda s: service.fill_rate(s, "warehouse", region_code="ASI")),
        "fill_rate_outlet_banded": star(lambda s: service.fill_rate_band(service.fill_rate(s, "outlet"))),
        "otif_region_quarter": star(lambda s: service.otif(s, "region", P(2000, 4))),
        "otif_route_in_region": star(lambda s: service.otif(s, "route", region_code="EUR")),
        "otif_warehouse_tolerant": star(lambda s: service.otif(s, "warehouse", on_time_threshold_minutes=60)),
        "otif_region_without_test_outlets": star(lambda s: service.otif(s, "region", exclude_test_outlets=True)),
        "otif_outlet_month": star(lambda s: service.otif(s, "outlet", P(month="1998-04"), order="desc")),
        "otif_unknown_region": star(lambda s: service.otif(s, "region", region_code="NOWHERE")),
        # money
        "freight_per_case": star(money.freight_cost_per_case),
        "freight_per_case_quarter": star(lambda s: money.freight_cost_per_case(s, P(2001, 1))),
        "freight_per_case_in_region": star(lambda s: money.freight_cost_per_case(s, region_code="AFR")),
        "freight_by_carrier": star(money.freight_by_carrier),
        "freight_by_carrier_month_in_region": star(lambda s: money.freight_by_carrier(s, P(month="1997-02"), "AME")),
        "returns_leakage": star(money.returns_leakage),
        "returns_leakage_quarter": star(lambda s: money.returns_leakage(s, period=P(2000, 2))),
        "returns_leakage_in_region": star(lambda s: money.returns_leakage(s, region_code="MID")),
        # cold chain
        "excursions_by_month": star(coldchain.excursions_by_month),
        "excursions_quarter": star(lambda s: coldchain.excursions_by_month(s, P(2000, 4))),
        "excursions_in_region": star(lambda s: coldchain.excursions_by_month(s, region_code="EUR")),
        "excursion_extremes": star(lambda s: coldchain.excursion_extremes(coldchain.excursions_by_month(s))),
        "cold_chain_returns": star(coldchain.cold_chain_returns),
        "cold_chain_returns_in_region": star(lambda s: coldchain.cold_chain_returns(s, region_code="ASI")),
        "cold_chain_returns_quarter": star(lambda s: coldchain.cold_chain_returns(s, P(2000, 2))),
        "near_expiry_category": star(coldchain.near_expiry),
        "near_expiry_warehouse": star(lambda s: coldchain.near_expiry(s, "warehouse")),
        "near_expiry_category_one_warehouse": star(
            lambda s: coldchain.near_expiry(s, "category", 14, warehouse_code="WH00003")
        ),
        "near_expiry_category_in_region": star(lambda s: coldchain.near_expiry(s, "category", 60, region_code="AME")),
        # price position
        "price_match": star(_price_match),
        "match_rate": star(lambda s: matching.match_profile(s.price_position)),
        "price_gap_top_skus": star(lambda s: price.price_gap(s, "Mumbai", 20)),
        "price_gap_everywhere": star(lambda s: price.price_gap(s, None, 100)),
        "price_gap_counts": star(lambda s: price.price_gap_counts(price.price_gap(s, None, 100))),
        "price_summary": star(price.price_summary),
        "price_summary_city_category": star(lambda s: price.price_summary(s, "Chennai", "Economy")),
        # findings and overview
        "late_routes": star(systemic.late_routes),
        "late_routes_in_region": star(lambda s: systemic.late_routes(s, "EUR")),
        "late_routes_summary": star(systemic.late_routes_summary),
        "late_routes_summary_in_region": star(lambda s: systemic.late_routes_summary(s, "EUR")),
        "discontinued_orders_in_region": star(lambda s: systemic.discontinued_orders(s, "AFR", top=None)),
        "discontinued_orders": star(systemic.discontinued_orders),
        "discontinued_orders_all": star(lambda s: systemic.discontinued_orders(s, top=None)),
        "discontinued_summary": star(systemic.discontinued_summary),
        "discontinued_summary_in_region": star(lambda s: systemic.discontinued_summary(s, "AFR")),
        "network_kpis": star(overview.network_kpis),
        "network_kpis_last_periods": star(_kpis_last_periods),
        "money_extremes": star(overview.money_extremes),
        # fixed questions whose period hangs on the newest order
        "answer_worst_fill_rate_outlets": star(questions.worst_fill_rate_outlets),
        "answer_otif_by_region": star(questions.otif_by_region),
        "answer_returns_by_category": star(questions.returns_by_category),
        "answer_freight_per_case": star(questions.freight_per_case_by_warehouse),
        "answer_temperature_excursions": star(questions.temperature_excursions),
        "answer_late_routes": star(questions.late_routes),
        "answer_price_gap": star(questions.price_gap_top_skus),
        "answer_discontinued_orders": star(questions.discontinued_sku_orders),
        "returns_by_carrier": star(lambda s: money.returns_leakage(s, "carrier")),
        "question_routing": sample(lambda t: questions.route(_question_log(t)).drop("text")),
        # dimensions, facts, periods
        "date_spine": star(lambda s: s.dim_date),
        "fiscal_quarters": star(_fiscal_quarters),
        "reporting_periods": star(_reporting),
        "active_regions": star(lambda s: scope.active_regions(s.dim_region)),
        "outlet_conform": star(_outlets),
        "outlet_entities": _on_sample(lambda s: entities.outlet_entities(s.outlets)),
        "product_conform": star(_products),
        "order_lines_conform": star(_order_lines),
        "deliveries_conform": star(_deliveries),
        "returns_conform": star(_returns),
        "inventory_conform": star(_inventory),
        "freight_conform": star(_freight),
        "freight_unmatched": star(lambda s: facts.freight_unmatched(s.freight)),
        "unexpected_uom": star(lambda s: facts.unexpected_uom(s.landed.order_lines)),
        "weather_days": star(lambda s: s.weather),
        # quality and profile
        "quality_report": star(_quality),
        "source_quality_report": star(lambda s: quality.source_report(s.landed)),
        "quality_verdict": star(_failing_verdict),
        "line_key_violations": sample(_line_keys),
        "table_manifest": star(quality.manifest),
        "published_manifest": _on_stored(quality.manifest),
        "conservation": star(quality.conservation),
        "full_delivery_share": star(profile.full_delivery_share),
        "fulfilment_p99": star(lambda s: profile.fulfilment_quantile(s, 0.99)),
        "fulfilment_median": star(lambda s: profile.fulfilment_quantile(s, 0.5)),
        "fulfilment_p05": star(lambda s: profile.fulfilment_quantile(s, 0.05)),
        "delay_disagreement": star(profile.delay_disagreement),
        "expiry_by_ageing_bucket": star(profile.expiry_by_ageing_bucket),
        "mean_delay": star(profile.mean_delay),
        "discontinued_skus_ordered": star(profile.discontinued_skus_ordered),
        # personal data
        "pii_scan": sample(
            lambda t: privacy.scan(t.raw("documents")).select("doc_id", "source", "pii_category", "asks_for_personal_data")
        ),
        "pii_scan_conversations": sample(
            lambda t: privacy.scan(t.raw("conversations")).select("conv_id", "turn", "pii_category", "asks_for_personal_data")
        ),
        "pii_profile": sample(lambda t: privacy.profile(t.raw("documents"), "source")),
        "pii_redact": sample(
            lambda t: t.raw("documents").select("doc_id", privacy.redacted(F.col("text")).alias("redacted"))
        ),
        "pii_redact_conversations": sample(
            lambda t: t.raw("conversations").select("conv_id", "turn", privacy.redacted(F.col("text")).alias("redacted"))
        ),
        "governed_outlets": star(_governed_outlets),
        "governed_lineage": star(lambda s: privacy.lineage_profile(_governed_outlets(s))),
        # landed feeds
        "listing_extract": sample(_listings),
        "listing_page_coverage": sample(lambda t: listings.page_coverage(t.listing_pages())),
        "listing_unparsed_prices": sample(lambda t: listings.unparsed_prices(_listings(t))),
        "invoice_normalise": sample(_normalised_invoices),
        "rejected_records": star(_rejected_records),
        "feed_times": sample(_feed_times),
        "landed_fill_rate_region": lambda spark, sf_dir: service.fill_rate(_landed_star(spark, sf_dir), "region"),
        "unchanged_counts": _on_stored(_unchanged_counts),
        "observed_report": _on_stored(lambda s: warehouse.report(s, **_bounds())),
        "invoice_stream": _invoice_stream,
        "invoice_stream_second_run": _invoice_stream_second_run,
        "carrier_flatten": sample(_carriers),
        "surcharge_months": sample(_surcharge),
        "freight_from_csv": star(_freight_from_csv),
        "match_rate_from_csv": star(_match_rate_from_csv),
        "match_rate_any_family": _match_rate_any_family,
    }
    for name, build in STORED.items():
        out[f"stored_{name}"] = _on_stored(build)
    for name in MONTHLY:
        out[f"monthly_{name}"] = _on_months(STORED[name])
    out["monthly_quantiles"] = _on_months(spread.accuracy)
    out["monthly_quantiles_quarter"] = _on_months(lambda s: spread.accuracy(s, P(2000, 4)))
    if llm is not None:
        out |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    return out


def oracle_sql() -> dict[str, str]:
    out = oracles.registry(TEST_OUTLETS_SQL, str(FIRST_DAY), str(LAST_DAY), privacy.BLOCKED_PHRASES)
    out |= {f"stored_{name}": out[name] for name in STORED} | {f"monthly_{name}": out[name] for name in MONTHLY}
    same = {
        "invoice_stream_second_run": "invoice_stream", "match_rate_any_family": "match_rate",
        "answer_temperature_excursions": "excursions_by_month", "answer_late_routes": "late_routes",
        "answer_price_gap": "price_gap_top_skus", "answer_discontinued_orders": "discontinued_orders",
        "landed_fill_rate_region": "fill_rate_region", "observed_report": "quality_report",
    }
    out |= {name: out[other] for name, other in same.items()}
    if llm is not None:
        out |= llm.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return out
