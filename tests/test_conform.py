from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.functions import dates as D, numeric as N
from depotlens.operators import dims, facts, quality, skew


def test_units(spark):
    df = spark.createDataFrame(
        [(24, "EACH", 12), (2, "CASE", 12), (5, "EACH", 0), (3, "PALLET", 4)], "q bigint, u string, p bigint"
    )
    q, u, p = F.col("q"), F.col("u"), F.col("p")
    got = df.select(N.to_eaches(q, u, p).alias("e"), N.to_cases(q, u, p).alias("c")).collect()
    assert [tuple(r) for r in got] == [(24, 2.0), (24, 2.0), (5, None), (12, 3.0)]


def test_pack_units(spark):
    df = spark.createDataFrame([(0.4, "kg"), (400.0, "G"), (1.5, "l"), (7.0, "ML"), (1.0, "DOZEN")], "v double, u string")
    got = df.select(N.pack_in_base_units(F.col("v"), F.col("u")), N.pack_family(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(400.0, "weight"), (400.0, "weight"), (1500.0, "volume"), (7.0, "volume"), (None, None)]


def test_rates_are_null_on_zero_and_round_half_up(spark):
    df = spark.createDataFrame([(1, 0), (1, 8), (1, None), (267, 10000)], "a int, b int")
    got = [r[0] for r in df.select(N.share_pct(F.col("a"), F.col("b"), 1)).collect()]
    assert got == [None, 12.5, None, 2.7]
    money = spark.createDataFrame([(Decimal("73.3500"), Decimal("900.00"))], "a decimal(18,4), b decimal(18,2)")
    assert money.select(N.share_pct(F.col("a"), F.col("b"), 1)).first()[0] == 8.2


def test_feed_timestamps(spark):
    rows = [
        ("05/03/2026 07:15", "ERP_WEB"), ("2026-03-05T20:15:00Z", "PARTNER_API"), ("2026-03-05 07:15:00", "SFA_MOBILE"),
        ("05-Mar-2026 07:15 PM", "TELEMATICS_B"), ("junk", "UNKNOWN"), ("2026-03-05 07:15:00", "UNKNOWN"), (None, "ERP_WEB"),
    ]
    df = spark.createDataFrame(rows, "t string, f string")
    got = [r[0] for r in df.select(D.feed_timestamp(F.col("t"), F.col("f"))).collect()]
    plain = datetime(2026, 3, 5, 7, 15)
    assert got == [plain, datetime(2026, 3, 6, 1, 45), plain, datetime(2026, 3, 5, 19, 15), None, plain, None]
    unshifted = df.select(D.feed_timestamp(F.col("t"), F.col("f"), shift_utc=False)).collect()[1][0]
    assert unshifted == datetime(2026, 3, 5, 20, 15)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_known_feed_fails_on_bad_text(spark, ansi):
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("junk", "ERP_WEB")], "t string, f string")
        with pytest.raises(Exception, match="timestamp: junk"):
            df.select(D.feed_timestamp(F.col("t"), F.col("f"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def test_parsing_ignores_the_session_zone(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 did not exist there on that day.
        df = spark.createDataFrame([("2026-03-08 02:30:00", "TELEMATICS_A"), ("2026-03-07T21:00:00Z", "PARTNER_API")], "t string, f string")
        got = [r[0] for r in df.select(D.feed_timestamp(F.col("t"), F.col("f")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == ["2026-03-08 02:30:00", "2026-03-08 02:30:00"]


def test_discontinued_flag_survives_an_unreadable_date(rows_of):
    texts = ["", "n/a", None, "2026-01-31", "2026"]
    raw = rows_of(schemas.OPERATIONAL["products"], [{"product_id": i, "discontinued_date": t} for i, t in enumerate(texts)])
    got = {r.product_id: (r.is_discontinued, r.discontinued_date) for r in dims.product(raw).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, None), 3: (True, date(2026, 1, 31)), 4: (True, None)}


def test_outlet_flags(rows_of):
    spec = [
        (1, "Shop", "Bangalore", "G1", None, None), (2, "Shop", "New Delhi", "G1", None, None),  # same tax number
        (3, "ZZ shop", "Pune", None, 1.0, 2.0), (4, "My TEST shop", "Pune", "", 1.0, 2.0),  # same point
        (5, "DO NOT USE", "Pune", "G5", 9.0, 9.0), (6, "a test", "Pune", None, 9.0, 9.0),  # not linked
        (7, "Plain", "Pune", None, None, None), (8, None, "Pune", None, None, 3.0),  # no identity
    ]
    names = ("outlet_id", "outlet_name", "city", "gst_number", "latitude", "longitude")
    raw = rows_of(schemas.OPERATIONAL["outlets"], [dict(zip(names, s), is_deleted=int(s[0] == 7)) for s in spec])
    got = {r.outlet_id: r for r in dims.outlet(raw).collect()}
    assert len(got) == 8
    assert [i for i in got if got[i].is_duplicate_outlet] and {i for i in got if got[i].is_duplicate_outlet} == {1, 2, 3, 4}
    assert {i for i in got if got[i].is_test_outlet} == {3, 4, 5}
    assert got[8].is_test_outlet is None and got[8].include_by_default is None
    assert got[1].city_canonical == "Bengaluru" and got[2].city_canonical == "Delhi" and got[3].city_canonical == "Pune"
    assert got[1].include_by_default and not got[7].include_by_default and not got[3].include_by_default


def test_hot_identity_is_flagged_like_the_rest(spark):
    """A third of all rows share one key, a third have none."""
    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id DIV 6) END AS k"
    )
    got = skew.mark_repeated_keys(df, "k", "id", "dup")
    counts = {r.k: r["n"] for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    rows = got.collect()
    assert len(rows) == 3000 and got.columns.count("k") == 1
    for r in rows:
        assert r.dup == (r.k is not None and counts[r.k] > 1)


def test_order_lines_drop_orphans_which_the_source_report_counts(mini, order, line):
    lines = [line("a", 1, 10, 8), line("b", 99, 1, 1), line("c", 1, 1, 1, product=99), line("d", 1, 1, 1, uom="BOX")]
    star = mini(orders=[order(1)], order_lines=lines)
    assert {r.order_line_id for r in star.order_lines.collect()} == {"a", "d"}
    report = {r.check_name: r.observed for r in quality.source_report(star.landed).collect()}
    assert report["source_fk:order_lines.order_id->orders.order_id"] == 1
    assert report["source_fk:order_lines.product_id->products.product_id"] == 1
    assert facts.unexpected_uom(star.landed.order_lines).first()[0] == 1


def test_ordered_after_discontinuation_is_strict(mini, order, line):
    products = [
        {"product_id": 1, "discontinued_date": "2026-05-10"}, {"product_id": 2, "discontinued_date": "n/a"}, {"product_id": 3},
    ]
    star = mini(
        products=products,
        orders=[order(1, "2026-05-10"), order(2, "2026-05-11")],
        order_lines=[line("a", 1, 1, 1), line("b", 2, 1, 1), line("c", 2, 1, 1, product=2), line("d", 2, 1, 1, product=3)],
    )
    got = {r.order_line_id: r.ordered_after_discontinued for r in star.order_lines.collect()}
    assert got == {"a": False, "b": True, "c": None, "d": False}


def test_returns(mini, order, line):
    def ret(i, line_id, qty, uom):
        return {"return_id": i, "order_line_id": line_id, "outlet_id": 1, "product_id": 1, "return_date": "2026-05-12",
                "return_qty": qty, "qty_uom": uom, "credit_note_value_inr": Decimal("5.00")}

    star = mini(
        orders=[order(1)],
        order_lines=[line("a", 1, 10, 8)],
        returns_credit_notes=[ret("1", "a", -2, "CASE"), ret("2", None, 2, "CASE"), ret("3", "zz", -3, "EACH")],
    )
    got = {r.return_id: (r.return_qty, r.return_eaches, r.region_id) for r in star.returns.collect()}
    assert got == {"1": (2, 24, 1), "2": (2, None, 1), "3": (3, 3, 1)}
    assert "return_eaches" not in star.returns_core.columns and star.returns_core.count() == 3


def test_warehouse_on_the_line_wins(spark, mini, order, line):
    star = mini(orders=[order(1)], order_lines=[line("a", 1, 1, 1), line("b", 1, 1, 1)])
    lines = star.landed.order_lines.withColumn("warehouse_id", F.when(F.col("order_line_id") == "b", F.lit(2).cast("bigint")))
    got = {r.order_line_id: r.warehouse_id for r in facts.order_lines_core(lines, star.landed.orders).collect()}
    assert got == {"a": 1, "b": 2}


def test_missing_feeds_become_empty_tables(mini):
    star = mini()
    for name in ("fact_freight", "fact_price_position", "fact_weather"):
        assert star.table(name).count() == 0
    assert "match_confidence" in star.price_position.columns
