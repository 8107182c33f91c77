"""Co-partitioned facts and sums by month: same rows as the plain path, and the plans they are for."""

import re
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import money, overview, periods, quality, service, spread
from depotlens.plans import copartition, monthly, warehouse
from depotlens.plans.star import LazyStar, StoredStar
from depotlens.sources.sample import SampleTables

QUARTER, MONTH = periods.period(2000, 4), periods.period(month="1998-04")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sources(spark):
    return SampleTables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def built(spark, sources, tmp_path_factory):
    return warehouse.build(sources, str(tmp_path_factory.mktemp("w") / "warehouse"))


def exchanges_by_order(df):
    return re.findall(r"Exchange hashpartitioning\(order_id[^)]*\)", plan_of(df))


def test_joins_by_order_shuffle_nothing(spark, built, sources):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for period in (periods.ALL_DATA, QUARTER):
            got = service.otif(built, "region", period)
            assert "Bucketed: true" in plan_of(got) and not exchanges_by_order(got)
            lines = built.order_lines.join(built.deliveries.select("order_id", "delivery_id"), "order_id")
            assert not exchanges_by_order(lines)
        assert exchanges_by_order(service.otif(LazyStar(sources), "region"))
        assert "PartitionFilters: [isnotnull(order_date_month" in plan_of(service.otif(built, "region", QUARTER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert service.otif(built, "route").collect() == service.otif(LazyStar(sources), "route").collect()


def test_a_build_is_read_by_another_session(spark, built):
    other = StoredStar(spark.newSession(), built.path)
    spark.sql(f"DROP TABLE IF EXISTS {copartition.table_name(built.path + '/fact_order_lines')}")  # an external table: files stay
    again = StoredStar(spark, built.path)
    assert again.order_lines.count() == other.order_lines.count() == spark.read.parquet(f"{built.path}/fact_order_lines").count()
    assert not exchanges_by_order(again.order_totals(F.lit(True)))


def test_a_hot_order(mini, spark, order, line, tmp_path):
    """It is written as many files, and a star that it would unbalance does not read by bucket."""
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "50k",  # lines stay the streamed side, as at any real size
    }
    before = {k: spark.conf.get(k) for k in conf}
    rows = [line(i, 1, 10, 9) for i in range(6000)] + [line(9000 + i, 2 + i % 40, 5, 5) for i in range(200)]
    sources = mini(orders=[order(i) for i in range(1, 42)], order_lines=rows).landed
    sources = replace(sources, order_lines=sources.order_lines.repartition(12))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        star = warehouse.build(sources, str(tmp_path / "w"), order_buckets=8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.read.parquet(f"{star.path}/fact_order_lines").where("order_id = 1").select(F.input_file_name()).distinct().count()
    assert files > 1
    assert star.buckets == 0 and "Bucketed: true" not in plan_of(star.order_totals(F.lit(True)))
    assert service.fill_rate(star, "region").collect() == service.fill_rate(LazyStar(sources), "region").collect()
    assert warehouse.build(sources, str(tmp_path / "w"), order_buckets=0).order_lines.count() == 6200


METRICS = {
    "fill": lambda s, p: service.fill_rate(s, "outlet", p, "ASI"),
    "fill_route": lambda s, p: service.fill_rate(s, "route", p, exclude_closed_outlets=True),
    "otif": lambda s, p: service.otif(s, "warehouse", p, "EUR", exclude_test_outlets=True),
    "freight": lambda s, p: money.freight_cost_per_case(s, p, "AFR"),
    "carrier": lambda s, p: money.freight_by_carrier(s, p),
    "returns": lambda s, p: money.returns_leakage(s, period=p, region_code="MID"),
    "kpis": lambda s, p: overview.network_kpis(s, p, p),
}


@pytest.mark.parametrize("name", METRICS)
def test_sums_by_month_give_the_metric(built, name):
    sums = monthly.of(built)
    for period in (periods.ALL_DATA if name in ("otif", "kpis") else QUARTER, MONTH):
        got = METRICS[name](sums, period)
        assert got.collect() == METRICS[name](built, period).collect()
        assert "/fact_" not in plan_of(got)
    odd = periods.Period(date(1998, 4, 3), date(1998, 6, 9), "odd")  # not of whole months
    assert "/monthly/" not in plan_of(METRICS[name](sums, odd))


def test_sums_prune_months_and_take_no_other_threshold(built):
    sums = monthly.of(built)
    assert "PartitionFilters: [isnotnull(order_date_month" in plan_of(service.fill_rate(sums, "region", MONTH))
    tolerant = service.otif(sums, "region", on_time_threshold_minutes=60)
    assert "/fact_" in plan_of(tolerant) and tolerant.collect() == service.otif(built, "region", on_time_threshold_minutes=60).collect()


def test_one_changed_month_is_rewritten(spark, mini, order, line, tmp_path):
    orders = [order(i, f"2026-{m:02d}-10") for i, m in ((1, 3), (2, 4), (3, 5))]
    lines = [line(i, i, 10, 9) for i in (1, 2, 3)]
    deliveries = [
        {"delivery_id": i, "order_id": i, "route_id": 1, "warehouse_id": 1, "dispatch_datetime": "2026-05-11 08:00:00", "delay_minutes": 0}
        for i in (1, 2, 3)
    ]
    out = str(tmp_path / "w")
    folders = {}

    def build(lines, deliveries):
        star = warehouse.build(mini(orders=orders, order_lines=lines, deliveries=deliveries).landed, out, order_buckets=2)
        rows = spark.read.parquet(f"{star.path}/{monthly.MANIFEST}").collect()
        return star, {(r["table_name"], r["month"]): r["folder"] for r in rows}

    first, folders = build(lines, deliveries)
    same, again = build(lines[::-1], deliveries)
    assert again == folders and len(folders) == 4 * 3 + 1  # four tables have rows in three months, delays in the month of dispatch
    changed, other = build([*lines[:1], line(2, 2, 10, 4), lines[2]], deliveries)
    assert {k for k in folders if folders[k] != other[k]} == {(t, "2026-04") for t in ("lines_by_place", "otif_by_place", "fulfilment_sketch")}
    written = [f for f in {*other.values()} - {*folders.values()}]
    assert all([r[0] for r in spark.read.parquet(f).select("order_date_month").distinct().collect()] == ["2026-04"] for f in written)
    late = [*deliveries[:2], {**deliveries[2], "delay_minutes": 5}]
    _, third = build([*lines[:1], line(2, 2, 10, 4), lines[2]], late)
    assert {k for k in other if other[k] != third[k]} == {("otif_by_place", "2026-05"), ("delay_sketch", "2026-05")}
    for star in (first, same, changed):  # each build keeps its own sums
        for p in (periods.ALL_DATA, periods.period(month="2026-04")):
            assert service.fill_rate(monthly.of(star), "region", p).collect() == service.fill_rate(star, "region", p).collect()
            assert service.otif(monthly.of(star), "region", p).collect() == service.otif(star, "region", p).collect()


BOUNDS = {"first": date(1994, 1, 1), "last": date(2002, 12, 31), "expected_test_outlets": 3}


def files_read(df):
    """Tables of the build that a plan scans."""
    return {m for f in df.inputFiles() for m in re.findall(r"/builds/\d+/(\w+)/", f)}


def test_the_gate_reads_no_fact_for_what_the_writes_counted(spark, mini, rows_of, order, line, tmp_path):
    outlets = [{"outlet_id": 1, "outlet_code": "O1", "outlet_name": "ZZ"}, {"outlet_id": None, "outlet_code": "O2", "outlet_name": "Shop"}]
    freight = [{"invoice_id": str(i), "invoice_date": date(1999, i, 1), "amount_inr": Decimal(1)} for i in (1, 2)]
    orders = [order(1, "1970-01-01"), order(2, "1998-03-04"), order(3, "1998-05-04", outlet=9)]
    lines = [line(i, 1 + i % 3, 10, 9) for i in range(50)]
    deliveries = [
        {"delivery_id": i, "order_id": i, "route_id": 1, "warehouse_id": 1, "dispatch_datetime": f"20{i:02d}-05-11 08:00:00", "delay_minutes": 0}
        for i in (1, 2, 3)
    ]
    sources = mini(outlets=outlets, orders=orders, order_lines=lines, deliveries=deliveries).landed
    sources = replace(sources, freight=rows_of(schemas.FREIGHT, freight))
    for buckets in (0, 4):
        star = warehouse.build(sources, str(tmp_path / "w"), buckets, BOUNDS)
        tables = warehouse.tables_found(spark, star.path)
        plain = quality.report(star, tables=tables, **BOUNDS)
        got = warehouse.report(star, **BOUNDS)
        assert len(got.collect()) == 37 and sorted(got.collect()) == sorted(plain.collect())
        rows = {r.check_name: r.observed for r in got.collect()}
        assert rows["nonzero_rows:fact_order_lines"] == 50 and rows["nonzero_rows:fact_weather"] == 0
        assert rows["date_range:fact_order_lines.order_date"] == 17 and rows["date_range:fact_deliveries.dispatch_datetime"] == 1
        assert rows["no_null_key:dim_outlet.outlet_id"] == 1
        # Only unique keys and references are still read; other bounds read again the tables they concern.
        keyed = {t for t, _ in quality.PRIMARY_KEYS} | {t for fk in quality.FOREIGN_KEYS for t in (fk[0], fk[2])}
        assert files_read(got) <= keyed and "fact_freight" in files_read(plain) and "fact_freight" not in files_read(got)
        only = quality.table_checks("fact_order_lines", star.order_lines, warehouse.observed_of(star)["fact_order_lines"], **BOUNDS)
        assert not only.inputFiles()
        other = BOUNDS | {"first": date(1960, 1, 1)}
        assert {r.check_name: r.observed for r in warehouse.report(star, **other).collect()}["date_range:fact_order_lines.order_date"] == 0


def test_a_failed_write_leaves_no_verdict(spark, mini, order, line, tmp_path):
    landed = mini(orders=[order(1)], order_lines=[line(1, 1, 1, 1)]).landed
    broken = replace(landed, outlets=landed.outlets.withColumn("outlet_name", F.raise_error(F.lit("lost")).cast("string")))
    out = str(tmp_path / "w")
    with pytest.raises(Exception, match="lost"):
        warehouse.build(broken, out)
    with pytest.raises(warehouse.WarehouseNotChecked, match="missing"):
        warehouse.open_checked(spark, out)
    star = StoredStar(spark, f"{out}/builds/00000001")
    assert warehouse.observed_of(star) == {}  # a report of it would read the tables


def test_observed_rows_of_a_split_month_count_once(spark, mini, order, line, tmp_path):
    """Rows are observed where they are written, so a month that is dealt to many tasks counts once."""
    orders = [order(1, "1998-03-04"), order(2, "1998-04-04")]
    lines = [line(i, 1 if i % 3 else 2, 10, 9) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        star = warehouse.build(mini(orders=orders, order_lines=lines).landed, str(tmp_path / "w"), 4, BOUNDS)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert warehouse.observed_of(star)["fact_order_lines"].values["n"] == 3000 == star.order_lines.count()


def test_quantiles_from_sketches_of_months(spark, built):
    sums = monthly.of(built)
    for period in (periods.ALL_DATA, QUARTER):
        for measure in spread.MEASURES:
            got = spread.quantiles(sums, measure, period)
            assert "/fact_" not in plan_of(got)
            facts = spread.values(built, measure, period).toPandas().groupby("region_id")["value"]
            rows = {r.region_id: r for r in got.collect()}
            assert rows.keys() == facts.groups.keys() and all(rows[k].n_values == len(v) for k, v in facts)
            for k, v in facts:
                for q in spread.QUANTILES:
                    e = rows[k][f"p{round(100 * q)}"]
                    assert (v < e).mean() - spread.RANK_ERROR <= q <= (v <= e).mean() + spread.RANK_ERROR
        assert all(r.within_bound for r in spread.accuracy(sums, period).collect())
    one = spread.quantiles(sums, "delay", QUARTER, "ASI").collect()
    assert [r.region_code for r in one] == ["ASI"] and spread.quantiles(sums, "delay", QUARTER, "NONE").collect() == []
    odd = periods.Period(date(1998, 4, 3), date(1998, 6, 9), "odd")
    assert "/monthly/" not in plan_of(spread.quantiles(sums, "delay", odd))
    with pytest.raises(ValueError):
        spread.quantiles(sums, "weight")


def test_sketches_of_a_hot_region(spark):
    """A million values, two thirds of them one value, merged of a hundred sketches."""
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 < 2, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("value"), (F.col("id") % 100).alias("part")
    )
    parts = rows.groupBy("part").agg(*spread.sketch_sums())
    at = F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch"), F.array(F.lit(0.5), F.lit(0.9)))
    half, high = parts.agg(at.alias("q")).first()["q"]
    assert half == 7.0 and abs((rows.where(F.col("value") <= high).count() / 1e6) - 0.9) <= spread.RANK_ERROR
    assert parts.agg(F.max(F.length("sketch"))).first()[0] < 8 * 4 * spread.SKETCH_SIZE
