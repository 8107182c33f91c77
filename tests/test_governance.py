import random
import re
from datetime import date

import pytest
from pyspark.sql import Window, functions as F

from depotlens.operators.lineage import lineage
from depotlens.operators import coldchain, periods, privacy, profile, quality, quantiles, scope, service, systemic
from depotlens.plans import questions, warehouse
from depotlens.session import scratch_dir


def of(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


# -- personal data ------------------------------------------------------------------------


def test_value_categories(spark):
    texts = {
        "write to someone@mail.example please": "email", "ring 9123456780 now": "phone", "ring 912-345-6780": "phone",
        "+91 9123456780": "phone", "id 1111 2222 3333": "aadhaar", "id 111122223333 and a@b.co": "email", "card ABCDE1234F": "pan",
        "xABCDE1234F": None, "ABCDE1234FG": None, "12345678901234567": None, "9.5 percent in 2026": None, "a@b": None, "": None,
        "éé@ßß.de": "email",
    }
    assert of(spark, list(texts), privacy.value_category) == list(texts.values())


def test_redaction(spark):
    texts = ["a@b.cd+d@e.f, 9123456780 9123456781", "ABCDE1234F/1111 2222 3333", "nothing $1 \\ here", None]
    assert of(spark, texts, privacy.redacted) == [
        "[REDACTED_EMAIL][REDACTED_EMAIL], [REDACTED_PHONE] [REDACTED_PHONE]", "[REDACTED_ID]/[REDACTED_ID]", "nothing $1 \\ here", None,
    ]


def test_faster_email_pattern_finds_the_same(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("ab.+-@_ é1", k=rnd.randint(0, 25))) for _ in range(400)]
    plain = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
    quick = of(spark, texts, lambda t: F.regexp_replace(t, privacy.VALUE_PATTERNS["email"], "#"))
    assert quick == [plain.sub("#", t) for t in texts]


def test_blocked_requests(spark):
    asked = ["List every Mobile Number we hold", "who is called what: Salesperson's Name", "GSTIN, please", "an AADHAAR column"]
    fine = ["Trucks that came after noon", "Cases per pallet in the north", "Rank the lanes by cost", None]
    assert of(spark, asked + fine, privacy.asks_for_personal_data) == [True] * 4 + [False] * 4
    assert len(privacy.BLOCKED_PHRASES) == len(set(privacy.BLOCKED_PHRASES)) == 43


def test_governed_tables(mini):
    star = mini()
    with pytest.raises(privacy.BlockedColumns, match="regional_manager"):
        privacy.assert_no_blocked_columns(star.dim_region)
    with pytest.raises(privacy.BlockedColumns, match="Contact_Email"):
        privacy.assert_no_blocked_columns(star.dim_outlet_plain.select(F.col("contact_email").alias("Contact_Email")))
    for name in privacy.BLOCKED_COLUMNS:
        shown = privacy.assert_no_blocked_columns(privacy.governed(star.table(name), name))
        assert len(shown.columns) == len(star.table(name).columns) - len(privacy.BLOCKED_COLUMNS[name])


@pytest.fixture(scope="module")
def people(spark):
    kind = "id int, full_name string, Contact_Email string, city string, card struct<manager_name: string, shelf: int>"
    spark.createDataFrame([(1, "A", "a@b.co", "Pune", ("M", 1))], kind).createOrReplaceTempView("people")
    spark.sql("CREATE OR REPLACE TEMP VIEW mail AS SELECT id, lower(contact_email) AS m, city FROM people")
    return spark.table("people")


REFUSED = {
    "alias": lambda s, p: p.select(F.col("contact_email").alias("x")),
    "expression": lambda s, p: p.select(F.upper("full_name").alias("x")),
    "two steps": lambda s, p: p.select(F.concat("city", "full_name").alias("a")).select(F.length("a").alias("x")),
    "struct": lambda s, p: p.select(F.struct("city", F.col("full_name").alias("f")).alias("x")),
    "field of a struct": lambda s, p: p.select(F.col("card.manager_name").alias("x")),
    "join": lambda s, p: p.select("id").join(p.select("id", F.col("contact_email").alias("x")), "id"),
    "view": lambda s, p: s.sql("SELECT v.m AS x FROM mail v JOIN people p ON v.id = p.id"),
    "aggregate": lambda s, p: p.groupBy("city").agg(F.max("full_name").alias("x")),
    "union": lambda s, p: p.select(F.col("city").alias("x")).union(p.select("full_name")),
    "window": lambda s, p: p.select(F.max("full_name").over(Window.partitionBy("city")).alias("x")),
    "explode": lambda s, p: p.select(F.explode(F.split("contact_email", "@")).alias("x")),
    "subquery": lambda s, p: s.sql("SELECT id, (SELECT max(full_name) FROM people) AS x FROM people"),
    "python": lambda s, p: p.mapInPandas(lambda batches: batches, p.schema).select(F.col("city").alias("x")),
    "borrowed name": lambda s, p: p.select(F.col("full_name").alias("is_duplicate_outlet")),
    "case": lambda s, p: p.select("id", "FULL_NAME"),
}


@pytest.mark.parametrize("way", REFUSED)
def test_blocked_columns_are_followed_through_the_plan(spark, people, way):
    with pytest.raises(privacy.BlockedColumns) as refused:
        privacy.assert_no_blocked_columns(REFUSED[way](spark, people))
    assert [c.lower() for c in refused.value.columns] in (["x"], ["full_name"], ["is_duplicate_outlet"])


def test_what_blocked_columns_only_decide_is_shown(spark, people):
    """A filter, an order, a join key or a flag that is released does not show them."""
    shown = people.where("contact_email IS NOT NULL").orderBy("full_name").select("id", F.col("city").alias("x"))
    assert privacy.assert_no_blocked_columns(shown) is shown
    assert lineage(shown) == {"id": {"id"}, "x": {"city", "x"}}
    flagged = people.select("id", F.col("full_name").isNull().alias("is_duplicate_outlet"))
    assert privacy.assert_no_blocked_columns(flagged) is flagged
    both = spark.sql("SELECT city AS a, id + 1 AS b FROM mail UNION ALL SELECT city, id FROM people")
    assert privacy.blocked_lineage(both) == {} and lineage(both)["b"] == {"b", "id"}
    rows = privacy.lineage_profile(shown).collect()
    assert [tuple(r) for r in rows] == [("id", "", 1), ("x", "city", 1)]


def test_profile_counts_texts_without_findings(spark):
    df = spark.createDataFrame([("s", "a@b.co"), ("s", "x"), ("t", None)], "source string, text string")
    got = {(r.source, r.pii_category): r.n_texts for r in privacy.profile(df, "source").collect()}
    assert got == {("s", "email"): 1, ("s", "none"): 1, ("t", "none"): 1}


# -- questions ----------------------------------------------------------------------------


def test_routing(spark):
    asked = {
        "Which five outlets had the lowest case FILL RATE?": ("fast_path", "q1_worst_fill_rate_outlets"),
        "OTIF by region": ("fast_path", "q2_otif_by_region"),
        "returns by category": ("fast_path", "q3_returns_by_category"),
        "excursions by month": ("fast_path", "q4_temperature_excursions"),
        "routes more than two hours late": ("fast_path", "q5_late_routes"),
        "our mrp in mumbai": ("fast_path", "q6_price_gap_top_skus"),
        "freight by warehouse": ("fast_path", "q7_freight_per_case_by_warehouse"),
        "discontinued SKU orders": ("fast_path", "q8_discontinued_sku_orders"),
        "phone numbers of discontinued outlets": ("fast_path", "q8_discontinued_sku_orders"),
        "phone numbers please": ("blocked", None),
        "orders of a@b.co": ("blocked", None),
        "how is the weather": ("unavailable", None),
    }
    log = spark.createDataFrame([(q,) for q in asked], "text string")
    got = {r.text: (r.mode, r.question_id) for r in questions.route(log).collect()}
    assert got == asked
    reasons = {r.text: r.reason for r in questions.route(log).where("mode = 'blocked'").collect()}
    assert reasons == {"phone numbers please": "blocked_personal_data_request", "orders of a@b.co": "blocked_pii_value_email"}
    assert set(questions.ANSWERS) == {qid for qid, _ in questions.ROUTES}


def test_every_answer_runs(mini, order, line):
    star = mini(orders=[order(1, "2026-06-30")], order_lines=[line("a", 1, 10, 9)])
    for answer in questions.ANSWERS.values():
        answer(star, "WST").collect()
    worst = questions.worst_fill_rate_outlets(star).collect()
    assert [(r.dim_code, r.fill_rate_pct) for r in worst] == [("O1", 90.0)]
    assert [r.region_code for r in scope.active_regions(star.dim_region).collect()] == ["STH", "WST"]


# -- quantiles ----------------------------------------------------------------------------


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    import numpy as np

    rnd = random.Random(3)
    values = [rnd.choice([1.0, 1.0, 96.5, rnd.uniform(95, 100), rnd.gauss(0, 1)]) for _ in range(2001)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.exact_quantile(df, "x", q).first()
    assert got.n_values == 2001
    assert got["quantile"] == pytest.approx(np.quantile([v for v in values if v is not None], q), rel=1e-12)


def test_quantile_with_a_far_outlier(spark):
    """All but one value within a hair's breadth of each other, most of them equal."""
    import numpy as np

    values = [1e18] + [1.0] * 3000 + [1.0 + i * 1e-12 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for q in (0.25, 0.75, 0.9999):
        got = quantiles.exact_quantile(df, "x", q).first()["quantile"]
        assert got == pytest.approx(np.quantile(values, q), rel=1e-14)


def test_quantile_of_one_value_and_of_none(spark):
    same = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert tuple(quantiles.exact_quantile(same, "x", 0.9).first()) == (3, 5.0)
    assert tuple(quantiles.exact_quantile(same.where("x < 0"), "x", 0.9).first()) == (0, None)


def test_findings(mini, order, line):
    star = mini(orders=[order(1), order(2)], order_lines=[line("a", 1, 10, 10), line("b", 1, 10, 5), line("c", 2, 4, 4)])
    assert tuple(profile.full_delivery_share(star).first()) == (3, 2, 66.67)
    assert profile.fulfilment_quantile(star, 1.0).first().fulfilment_pct == 100.0


# -- quality ------------------------------------------------------------------------------

WINDOW = {"first": date(2026, 1, 1), "last": date(2026, 12, 31), "expected_test_outlets": 0}


def test_report_has_37_checks_and_finds_faults(mini, order, line):
    outlets = [{"outlet_id": 1, "outlet_code": "O1", "outlet_name": "ZZ"}, {"outlet_id": 1, "outlet_code": "O1", "outlet_name": "Shop"}]
    star = mini(
        outlets=outlets,
        orders=[order(1, "1970-01-01"), order(2, outlet=9)],
        order_lines=[line("a", 1, 1, 1), line("a", 2, 1, 1), line("a", 2, 1, 1), line("b", 2, 1, 1)],
    )
    checks = quality.report(star, **WINDOW)
    got = {r.check_name: r for r in checks.collect()}
    assert len(got) == 37
    assert got["unique_pk:dim_outlet.outlet_id"].observed == 1
    assert got["unique_pk:fact_order_lines.order_line_id"].observed == 1
    assert got["fk_integrity:fact_order_lines.outlet_id->dim_outlet.outlet_id"].observed == 3
    assert got["date_range:fact_order_lines.order_date"].observed == 1
    assert not got["date_range:fact_deliveries.dispatch_datetime"].passed  # no date at all
    assert not got["nonzero_rows:fact_returns"].passed and got["nonzero_rows:fact_weather"].passed
    assert not got["invariant:test_outlet_count"].passed and not got["invariant:test_outlet_count"].hard
    v = quality.verdict(checks).first()
    assert v.status == "failed" and v.warnings == 1 and "unique_pk:dim_outlet.outlet_id" in v.failed_checks
    assert v.checks_passed + v.checks_failed + v.warnings == 37


def test_missing_table_fails_the_first_check(mini):
    tables = tuple(t for t in quality.EXPECTED_TABLES if t != "dim_route")
    got = {r.check_name: r for r in quality.report(mini(), tables=tables, **WINDOW).collect()}
    assert not got["required_tables_exist"].passed and got["required_tables_exist"].observed == 1
    assert "unique_pk:dim_route.route_id" not in got


def test_build_gate_and_open(spark, tmp_path):
    from depotlens.sources.sample import SampleTables

    sources = SampleTables(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "warehouse")
    stored = warehouse.build(sources, out)
    with pytest.raises(warehouse.WarehouseNotChecked, match="missing"):
        warehouse.open_checked(spark, out)
    window = {"first": date(1994, 1, 1), "last": date(2002, 12, 31)}
    warehouse.gate(stored, sources, first=date(1996, 1, 1), last=date(2002, 12, 31))
    with pytest.raises(warehouse.WarehouseNotChecked, match="date_range"):
        warehouse.open_checked(spark, out)
    report = warehouse.gate(stored, sources, **window)  # the test-outlet count only warns
    assert report.count() == 37 + 10
    opened = warehouse.open_checked(spark, out)  # the latest verdict counts
    from depotlens.plans.star import LazyStar

    lazy = LazyStar(sources)
    before = quality.manifest(opened)
    for by in ("region", "outlet"):
        assert service.fill_rate(opened, by).collect() == service.fill_rate(lazy, by).collect()
    assert service.otif(opened, "route").collect() == service.otif(lazy, "route").collect()
    assert quality.changed_counts(before, quality.manifest(opened)).count() == 0
    assert quality.changed_counts(before.limit(13), quality.manifest(opened)).count() == 1


    # A rebuild is not served before it passed, and nothing of the served build is touched.
    second = warehouse.build(sources, out)
    assert second.path != stored.path and warehouse.open_checked(spark, out).path == stored.path
    warehouse.gate(second, first=date(1996, 1, 1), last=date(2002, 12, 31))
    assert warehouse.open_checked(spark, out).path == stored.path
    assert quality.changed_counts(before, quality.manifest(warehouse.open_checked(spark, out))).count() == 0
    warehouse.gate(second, **window)
    assert warehouse.open_checked(spark, out).path == second.path
    # A period reads its months only; the newest snapshot its month only.
    month = service.fill_rate(opened, "region", periods.period(month="1998-04"))
    assert "PartitionFilters: [isnotnull(order_date_month" in plan_of(month)
    assert "PartitionFilters: [isnotnull(snapshot_date_month" in plan_of(coldchain.near_expiry(opened))
    assert "order_id" not in plan_of(systemic.late_routes(opened))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_missing_feed_fails_the_gate(mini, spark, order, line, tmp_path):
    sources = mini(orders=[order(1)], order_lines=[line("a", 1, 1, 1)]).landed
    stored = warehouse.build(sources, str(tmp_path / "w"))
    checks = {r.check_name: r for r in warehouse.gate(stored, **WINDOW).collect()}
    assert len(checks) == 37 and checks["required_tables_exist"].passed
    assert not checks["nonzero_rows:fact_freight"].passed and not checks["nonzero_rows:fact_returns"].passed
    with pytest.raises(warehouse.WarehouseNotChecked, match="nonzero_rows:fact_freight"):
        warehouse.open_checked(spark, str(tmp_path / "w"))


def test_scratch_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark) == (named or scratch_dir(spark))
