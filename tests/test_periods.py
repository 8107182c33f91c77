from calendar import monthrange
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from depotlens.operators import dims, periods as P

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(366 + 365)]
QUARTER_OF_MONTH = {4: 1, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 10: 3, 11: 3, 12: 3, 1: 4, 2: 4, 3: 4}


def test_fiscal_calendar_on_every_day():
    for d in DAYS:
        assert P.fiscal_year(d) == (d.year + 1 if d.month >= 4 else d.year)
        assert P.fiscal_quarter(d) == QUARTER_OF_MONTH[d.month]
        first, last = P.fiscal_quarter_bounds(P.fiscal_year(d), P.fiscal_quarter(d))
        assert first <= d <= last
        assert first.day == 1 and (last + timedelta(days=1)).day == 1


@pytest.mark.parametrize("fy, fq, first, last", [
    (2027, 1, date(2026, 4, 1), date(2026, 6, 30)),
    (2027, 2, date(2026, 7, 1), date(2026, 9, 30)),
    (2027, 3, date(2026, 10, 1), date(2026, 12, 31)),
    (2027, 4, date(2027, 1, 1), date(2027, 3, 31)),
])
def test_quarter_bounds(fy, fq, first, last):
    assert P.fiscal_quarter_bounds(fy, fq) == (first, last)


def test_last_complete_periods():
    assert P.last_complete_fiscal_quarter(date(2026, 6, 30))[:2] == (2027, 1)
    assert P.last_complete_fiscal_quarter(date(2026, 6, 29)) == (2026, 4, date(2026, 1, 1), date(2026, 3, 31))
    assert P.last_complete_fiscal_quarter(date(2026, 4, 1))[:2] == (2026, 4)
    assert P.last_complete_calendar_month(date(2026, 6, 30)) == (date(2026, 6, 1), date(2026, 6, 30))
    assert P.last_complete_calendar_month(date(2026, 3, 15)) == (date(2026, 2, 1), date(2026, 2, 28))
    for d in DAYS:
        _, _, first, last = P.last_complete_fiscal_quarter(d)
        assert last <= d and d - last < timedelta(days=93)
        first, last = P.last_complete_calendar_month(d)
        assert last <= d and first.day == 1 and last.day == monthrange(last.year, last.month)[1]


def test_columns_agree_with_the_driver_side(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "date date")
    for r in dims.with_calendar(days).collect():
        assert (r.fiscal_year, r.fiscal_quarter) == (P.fiscal_year(r.date), P.fiscal_quarter(r.date))
    for d in (date(2024, 7, 31), date(2024, 6, 30), date(2024, 6, 29), date(2025, 3, 31), date(2025, 12, 31)):
        as_of = spark.createDataFrame([(d,)], "as_of date")
        row = P.reporting_periods(as_of).first()
        fy, fq, first, last = P.last_complete_fiscal_quarter(d)
        month = P.last_complete_calendar_month(d)[0]
        assert tuple(row)[1:] == (f"{month:%Y-%m}", fy, fq, first, last)
        kept = [r.date for r in P.last_quarter_of(as_of).of(days, "date").collect()]
        assert kept and min(kept) == max(first, DAYS[0]) and max(kept) == last


def test_period_contract():
    assert P.period() is P.ALL_DATA
    assert P.period(2027, 1, "2026-02").label == "month 2026-02"
    assert P.period(month="2026-12").end == date(2027, 1, 1)
    for bad in ("2026-6", "2026", "2026-13", "2026-00", "26-06", "junk"):
        with pytest.raises(ValueError):
            P.period(month=bad)
    for fy, fq in ((2027, None), (None, 2), (1999, 1), (2101, 1), (2027, 0), (2027, 5)):
        with pytest.raises(ValueError):
            P.period(fy, fq)


def test_last_day_of_a_period_counts_whole(spark):
    ts = spark.sql("SELECT TIMESTAMP_NTZ'2026-06-30 23:59:59' AS t UNION ALL SELECT TIMESTAMP_NTZ'2026-07-01 00:00:00'")
    assert P.period(2027, 1).of(ts, "t").count() == 1


def test_month_partition_is_part_of_the_filter(spark, tmp_path):
    df = spark.createDataFrame([(date(2026, m, 1), m) for m in range(1, 7)], "d date, n int")
    df.withColumn("d_month", F.date_format("d", "yyyy-MM")).write.partitionBy("d_month").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = P.period(month="2026-03").of(stored, "d")
    assert [r.n for r in kept.collect()] == [3]
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "d_month" in scan.split("PartitionFilters: ")[1].split("]")[0]


def test_spine_holds_both_ends(spark):
    spine = dims.date_spine(spark)
    assert spine.count() == 576
    assert spine.agg(F.max("date")).first()[0] == date(2026, 7, 30)


def test_fiscal_quarter_listing(spark):
    spine = dims.date_spine(spark)
    got = P.fiscal_quarters(spine, F.lit(date(2025, 1, 1)), F.lit(date(2026, 6, 30))).collect()
    assert [(r.fiscal_year, r.fiscal_quarter) for r in got] == [(2027, 1), (2026, 4), (2026, 3), (2026, 2), (2026, 1), (2025, 4)]
    assert got[0].quarter_end == date(2026, 6, 30)
