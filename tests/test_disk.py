"""A build keeps to its disk: facts are written in slices, and no shuffle outlives its query."""

import time
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import periods, quality
from depotlens.plans import copartition, monthly, warehouse
from depotlens.plans.star import FACT_TABLES, LazyStar
from depotlens.session import REMOVE_SHUFFLES, file_bytes, shuffles_removed

BOUNDS = {"expected_test_outlets": 0}


@pytest.fixture(scope="module")
def sources(spark, rows_of, mini, order, line, tmp_path_factory):
    """Files, as only files are read slice by slice; with orphans, rows without a key and keys that repeat."""
    base = mini().landed
    orders = [order(i, f"1998-{1 + i % 4:02d}-07", outlet=1 + i % 3) for i in range(40)] + [order(7), order(None)]
    lines = [line(i, i % 44, 10, i % 11, product=1 + i % 3) for i in range(200)] + [line(5, 5, 3, 3), line(900, None, 1, 1)]
    lines.append(line(0, 3, 2, 2) | {"order_line_id": None})
    deliveries = [
        {"delivery_id": i, "order_id": i % 42 or None, "route_id": 1, "warehouse_id": 1, "dispatch_datetime": f"1998-0{1 + i % 5}-11 08:00:00", "delay_minutes": i % 3}
        for i in range(60)
    ]
    returns = [
        {"return_id": str(i), "order_line_id": str(i % 70) if i % 9 else None, "outlet_id": 1 + i % 2, "product_id": 1 + i % 3, "return_qty": i, "qty_uom": "CASE"}
        for i in range(80)
    ]
    stock = [{"snapshot_id": str(i) if i % 7 else None, "product_id": 1 + i % 3, "on_hand_cases": i} for i in range(90)]
    freight = [{"invoice_id": str(i % 30) if i % 8 else None, "warehouse_code": f"W{i % 3}", "amount_inr": Decimal(i)} for i in range(50)]
    made = mini(
        orders=orders, order_lines=lines, deliveries=deliveries, returns_credit_notes=returns, inventory_snapshots=stock,
        freight=rows_of(schemas.FREIGHT, freight),
    ).landed
    folder, read = tmp_path_factory.mktemp("sources"), {}
    for name in ("orders", "order_lines", "deliveries", "returns_credit_notes", "inventory_snapshots", "freight"):
        df = getattr(made, name)
        df.write.parquet(f"{folder}/{name}")
        read[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    return replace(base, **read)


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(str, df.select(*columns).collect()))


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [blocks.apply(i).getName() for i in range(blocks.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


@pytest.mark.parametrize("buckets", (4, 0))
def test_slices_are_the_whole(sources, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(warehouse, "SLICE_BYTES", 1)
    assert {warehouse.slices(sources, n) for n in warehouse.SLICED} == {warehouse.MOST_SLICES}
    star, lazy = warehouse.build(sources, str(tmp_path / "sliced"), buckets, BOUNDS), LazyStar(sources)
    for name in FACT_TABLES:
        month = warehouse.MONTH_OF.get(name)
        assert rows(star.table(name).drop(f"{month}_month")) == rows(lazy.table(name))
    assert rows(warehouse.report(star, **BOUNDS)) == rows(quality.report(star, **BOUNDS))  # what the slices observed adds up
    if buckets == 4:  # a slice holds one bucket, so a month's bucket is written by two slices at most
        found = star.order_lines.select(F.input_file_name().alias("f"), "order_date_month", copartition.bucket_of("order_id", 4).alias("b"))
        assert found.groupBy("order_date_month", "b").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_only_files_of_one_key_type_are_sliced(spark, sources, mini, monkeypatch):
    monkeypatch.setattr(warehouse, "SLICE_BYTES", 1)
    assert file_bytes(sources.orders) > 0 and file_bytes(mini().landed.orders) is None
    assert warehouse.slices(mini().landed, "fact_order_lines") == 1
    other = replace(sources, orders=sources.orders.withColumn("order_id", F.col("order_id").cast("int")))
    assert warehouse.slices(other, "fact_order_lines") == 1 and warehouse.slices(other, "fact_returns") > 1
    assert warehouse.slices(sources, "dim_outlet") == 1


def test_a_build_leaves_no_shuffle(spark, sources, tmp_path):
    before = shuffle_files(spark)
    was = spark.conf.get(REMOVE_SHUFFLES, None)
    warehouse.build(sources, str(tmp_path / "w"), 4, BOUNDS)
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not left and spark.conf.get(REMOVE_SHUFFLES, None) == was


def test_the_setting_lasts_as_long_as_the_last_who_asked(spark):
    was = spark.conf.get(REMOVE_SHUFFLES, None)
    first, second = shuffles_removed(spark), shuffles_removed(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(REMOVE_SHUFFLES) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(REMOVE_SHUFFLES, None) == was


def test_months_are_summed_in_parts(spark, sources, tmp_path, monkeypatch):
    assert monthly.parts_of({"a": 9, "b": 1}) == [["a", "b"]] and monthly.parts_of({}) == []
    monkeypatch.setattr(monthly, "PART_ROWS", 1)
    assert monthly.parts_of({"a": 9, "b": 4, "c": 5, "": 1}) == [["a"], ["c"], ["b"], [""]]
    monkeypatch.setattr(monthly, "MOST_PARTS", 2)
    assert monthly.parts_of({"a": 9, "b": 4, "c": 5, "": 1}) == [["", "a"], ["b", "c"]]
    star = warehouse.build(sources, str(tmp_path / "w"), 4, BOUNDS)
    sums = monthly.of(star)
    for name, t in monthly.tables().items():
        kept = sums.sums(name, periods.ALL_DATA)
        plain = [c for c in t.of(star).columns if c != "sketch"]
        assert rows(kept.select(*plain)) == rows(t.of(star).select(*plain))


def test_the_gate_shuffles_one_key_at_a_time(spark, sources, tmp_path):
    star = warehouse.build(sources, str(tmp_path / "w"), 4, BOUNDS)
    got = warehouse.gate(star, sources, **BOUNDS)
    assert rows(got) == rows(warehouse.report(star, **BOUNDS).unionByName(quality.source_report(sources)))
    parts = quality.report_parts(star, observed=warehouse.observed_of(star), **BOUNDS) + quality.source_parts(sources)
    joins = [p._jdf.queryExecution().optimizedPlan().toString().count("Union") for p in parts]
    assert not any(joins[1:]) and len(parts) == 1 + len(quality.PRIMARY_KEYS) + len(quality.FOREIGN_KEYS) + 10


def test_files_are_ordered_and_packed(spark, sources, tmp_path):
    star = warehouse.build(sources, str(tmp_path / "w"), 4, BOUNDS)
    for name, (key, _) in warehouse.SLICED.items():
        files = star.table(name).inputFiles()
        assert files and all(".zstd." in f for f in files)
        for f in files:
            found = [r[0] for r in spark.read.parquet(f).select(key).coalesce(1).collect()]
            assert found == sorted(found, key=lambda k: (k is not None, k))
