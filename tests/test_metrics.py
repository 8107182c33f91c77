from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import coldchain, money, overview, periods, price, service, systemic

CLOCK = "2026-05-11 10:00:00"


def delivery(i, order_id, delay=0, dispatch="2026-05-11 08:00:00", route=1, warehouse=1, excursion=0):
    return {
        "delivery_id": i, "order_id": order_id, "delay_minutes": delay, "dispatch_datetime": dispatch, "route_id": route,
        "warehouse_id": warehouse, "temperature_excursion_flag": excursion, "planned_arrival": CLOCK,
        "telematics_vendor": "TELEMATICS_A", "actual_arrival": CLOCK,
    }


def test_fill_rate_scope_and_exclusions(mini, order, line):
    outlets = [
        {"outlet_id": 1, "outlet_code": "O1", "outlet_name": "Shop", "is_deleted": 0, "status": "ACTIVE"},
        {"outlet_id": 2, "outlet_code": "O2", "outlet_name": "ZZ", "is_deleted": 0, "status": "ACTIVE"},
        {"outlet_id": 3, "outlet_code": "O3", "outlet_name": "Old", "is_deleted": 0, "status": "CLOSED"},
        {"outlet_id": 4, "outlet_code": "O4", "outlet_name": "Gone", "is_deleted": 1, "status": "ACTIVE"},
        {"outlet_id": 5, "outlet_code": "O5", "outlet_name": "Odd", "is_deleted": 0, "status": None},
    ]
    orders = [order(i, outlet=i) for i in range(1, 6)] + [order(6, status="CANCELLED"), order(7, status="OPEN")]
    lines = [line(i, i, 10, 10 - i) for i in range(1, 8)] + [line("z", 3, 0, 0)]
    star = mini(outlets=outlets, orders=orders, order_lines=lines)

    def codes(**kw):
        return {r.dim_code: r.fill_rate_pct for r in service.fill_rate(star, "outlet", **kw).collect()}

    assert codes() == {"O1": 90.0, "O3": 70.0, "O5": 50.0}
    assert codes(exclude_closed_outlets=True) == {"O1": 90.0}
    assert set(codes(exclude_test_outlets=False, exclude_deleted_outlets=False)) == {"O1", "O2", "O3", "O4", "O5"}
    assert codes(region_code="NOPE") == {}
    assert list(codes(limit=1, order="desc")) == ["O1"]
    everything = service.fill_rate(star, "region", exclude_test_outlets=False, exclude_deleted_outlets=False).first()
    assert (everything.ordered_qty, everything.delivered_qty) == (50, 35)
    bands = {r.dim_code: r.band for r in service.fill_rate_band(service.fill_rate(star, "outlet")).collect()}
    assert bands == {"O1": "good", "O3": "bad", "O5": "bad"}


def test_fill_rate_without_ordered_quantity_is_left_out(mini, order, line):
    star = mini(orders=[order(1)], order_lines=[line("a", 1, 0, 0)])
    assert service.fill_rate(star, "outlet").count() == 0


def test_parameters_are_checked(mini):
    star = mini()
    for call in (
        lambda: service.fill_rate(star, "city"), lambda: service.otif(star, "sku"), lambda: service.fill_rate(star, limit=0),
        lambda: service.fill_rate(star, limit=501), lambda: service.otif(star, order="up"),
        lambda: coldchain.near_expiry(star, near_expiry_days=0), lambda: coldchain.near_expiry(star, near_expiry_days=366),
        lambda: coldchain.near_expiry(star, "sku"), lambda: price.price_gap(star, top_n=101), lambda: price.price_gap(star, top_n=0),
        lambda: money.returns_leakage(star, "route"),
    ):
        with pytest.raises(ValueError):
            call()


def test_otif_is_judged_per_order_and_counted_per_delivery(mini, order, line):
    star = mini(
        orders=[order(1), order(2), order(3), order(4, status="OPEN")],
        order_lines=[line("a", 1, 10, 10), line("b", 1, 5, 5), line("c", 2, 10, 5), line("d", 3, 0, 0), line("e", 4, 1, 1)],
        deliveries=[delivery(1, 1, -5), delivery(2, 1, 30), delivery(3, 2, 0), delivery(4, 3, 0), delivery(5, 4, 0)],
    )
    r = service.otif(star, "region").first()
    # In full: both deliveries of order 1, and order 3, which ordered nothing. Its ratio is NULL and leaves the average.
    assert (r.n_deliveries, r.n_otif_strict, r.otif_pct_strict) == (4, 2, 50.0)
    assert (r.on_time_pct, r.in_full_pct_strict, r.avg_fulfilment_pct) == (75.0, 75.0, 83.3)
    tolerant = service.otif(star, "region", on_time_threshold_minutes=30).first()
    assert tolerant.on_time_pct == 100.0
    assert service.otif(star, "region", periods.period(month="2026-04")).count() == 0


def test_freight_per_case(spark, rows_of, mini, order, line):
    def invoice(i, w, r, amount, day=date(2026, 5, 1)):
        return {"invoice_id": i, "carrier_id": "C", "carrier_name": "Carrier", "warehouse_code": w, "route_code": r,
                "amount_inr": Decimal(amount), "invoice_date": day}

    freight = rows_of(schemas.FREIGHT, [
        invoice("1", "W1", "R1", "100.00"), invoice("2", "W1", "R9", "50.00"), invoice("3", "W9", "R1", "7.00"),
        invoice("4", "W2", "R2", "70.00"),
    ])
    star = mini(freight=freight, orders=[order(1)], order_lines=[line("a", 1, 24, 24), line("b", 1, 1, 1, uom="CASE")])
    got = money.freight_cost_per_case(star).collect()
    assert [(r.dim_code, r.freight_inr, r.delivered_cases, r.freight_inr_per_case) for r in got] == [("W1", 150.0, 3.0, 50.0)]
    west = money.freight_cost_per_case(star, region_code="WST").first()
    assert west.freight_inr == 100.0  # the unmatched route has no region
    by_carrier = money.freight_by_carrier(star).first()
    assert (by_carrier.freight_inr, by_carrier.n_invoices, by_carrier.avg_invoice_inr) == (227.0, 4, 56.75)
    ends = overview.money_extremes(star).first()
    assert (ends.dearest_warehouse, ends.cheapest_warehouse, ends.top_return_category) == ("W1", "W1", None)


def test_returns_leakage_ties_and_missing_dispatch(mini, order, line):
    def ret(i, product, reason, value):
        return {"return_id": str(i), "outlet_id": 1, "product_id": product, "return_date": "2026-05-12", "return_qty": 1,
                "qty_uom": "EACH", "return_reason_code": reason, "credit_note_value_inr": Decimal(value)}

    star = mini(
        orders=[order(1)],
        order_lines=[line("a", 1, 1, 1, value="200.0000")],
        returns_credit_notes=[
            ret(1, 1, "RT09", "10.00"), ret(2, 1, "RT02", "5.00"), ret(3, 2, None, "1.00"), ret(4, 2, None, "1.00"), ret(5, 2, "RT05", "1.00"),
        ],
    )
    got = {r.dim_code: r for r in money.returns_leakage(star).collect()}
    assert got["DAIRY"].leading_reason_code == "RT02"  # tie: lowest code
    assert got["DAIRY"].returns_pct_of_dispatch == 7.5
    assert got["DRY"].leading_reason_code == "RT05"  # missing reasons do not lead
    assert got["DRY"].dispatch_value_inr is None and got["DRY"].returns_pct_of_dispatch is None
    empty = money.returns_leakage(star, "carrier")
    assert empty.count() == 0 and empty.columns == money.returns_leakage(star).columns


def test_excursions_count_the_whole_last_day(mini, order, line):
    star = mini(
        orders=[order(1), order(2), order(3)],
        order_lines=[line("a", 1, 1, 1), line("b", 1, 1, 1), line("c", 2, 1, 1, product=2), line("d", 3, 1, 1)],
        deliveries=[
            delivery(1, 1, dispatch="2026-06-30 08:00:00", excursion=1), delivery(2, 2, dispatch="2026-06-30 08:00:00", excursion=1),
            delivery(3, 3, dispatch="2026-07-01 00:00:00"), delivery(4, 3, dispatch="2026-06-01 00:00:00"),
        ],
    )
    got = coldchain.excursions_by_month(star, periods.period(2027, 1)).collect()
    assert [(r.dim_code, r.chilled_deliveries, r.excursions, r.excursions_per_hundred) for r in got] == [("2026-06", 2, 1, 50.0)]
    ends = coldchain.excursion_extremes(coldchain.excursions_by_month(star)).first()
    assert (ends.best_month, ends.worst_month, ends.n_months) == ("2026-07", "2026-06", 2)


def test_near_expiry_bounds(mini):
    def stock(i, days, cases, day="2026-06-28", warehouse=1, product=1):
        expiry = date(2026, 6, 28).toordinal() + days
        return {"snapshot_id": str(i), "snapshot_date": day, "warehouse_id": warehouse, "product_id": product,
                "on_hand_cases": cases, "expiry_date": str(date.fromordinal(expiry))}

    star = mini(inventory_snapshots=[
        stock(1, -1, 1), stock(2, 0, 10), stock(3, 30, 100), stock(4, 31, 1000), stock(5, 5, 7, day="2026-06-21"),
        stock(6, 5, 0, product=2, warehouse=2),
    ])
    got = {r.dim_code: r for r in coldchain.near_expiry(star).collect()}
    assert (got["DAIRY"].on_hand_cases, got["DAIRY"].near_expiry_cases, got["DAIRY"].near_expiry_pct) == (1111, 110, 9.9)
    assert got["DRY"].near_expiry_pct is None
    assert [r.dim_code for r in coldchain.near_expiry(star, "warehouse").collect()] == ["W1", "W2"]
    assert [r.dim_code for r in coldchain.near_expiry(star, warehouse_code="W2").collect()] == ["DRY"]
    assert coldchain.near_expiry(star, region_code="NOPE").count() == 0


def test_late_routes_filter_on_the_shown_percentage(mini, order, line):
    # 10.04 percent shows as 10.0 and is not above 10; nine deliveries are too few.
    late = [delivery(i, 1, 121 if i < 25 else 120) for i in range(249)]
    few = [delivery(1000 + i, 1, 500, route=2) for i in range(9)]
    star = mini(orders=[order(1)], order_lines=[line("a", 1, 1, 1)], deliveries=late + few)
    assert systemic.late_routes(star).count() == 0
    summary = systemic.late_routes_summary(star).first()
    assert (summary.n_late_routes, summary.n_routes, summary.n_deliveries, summary.is_systemic) == (0, 2, 258, False)
    all_late = mini(orders=[order(1)], order_lines=[line("a", 1, 1, 1)], deliveries=[delivery(i, 1, 200) for i in range(10)])
    west = systemic.late_routes_summary(all_late, "WST").first()
    assert (west.n_late_routes, west.n_routes, west.is_systemic) == (1, 1, True)


def test_discontinued_orders_skip_test_outlets(mini, order, line):
    outlets = [
        {"outlet_id": 1, "outlet_code": "O1", "outlet_name": "Shop", "region_id": 1},
        {"outlet_id": 2, "outlet_code": "O2", "outlet_name": "ZZ", "region_id": 1},
    ]
    products = [{"product_id": 1, "sku_code": "S1", "product_name": "Old", "discontinued_date": "2026-01-01"}]
    star = mini(
        outlets=outlets, products=products, orders=[order(1), order(2, outlet=2)],
        order_lines=[line("a", 1, 1, 1), line("b", 1, 1, 1), line("c", 2, 1, 1)],
    )
    got = systemic.discontinued_orders(star).collect()
    assert [(r.outlet_code, r.n_order_lines) for r in got] == [("O1", 2)]
    s = systemic.discontinued_summary(star).first()
    assert (s.n_order_lines, s.n_outlets_ordering, s.n_discontinued_skus, s.n_outlets, s.is_systemic) == (2, 1, 1, 1, True)
    none = systemic.discontinued_summary(star, "STH").first()
    assert (none.n_order_lines, none.n_outlets, none.is_systemic) == (0, 0, False)


def test_price_gap_keeps_unmatched_skus(mini, rows_of, order, line):
    products = [
        {"product_id": i, "sku_code": f"S{i}", "product_name": f"Item{i}", "brand": "A", "category": "X", "pack_size_value": 10.0 * i,
         "pack_size_uom": "G", "mrp_inr": Decimal("100.00")} for i in (1, 2, 3)
    ]

    def listing(i, grams, price, city="mumbai", shop="s1"):
        return {"listing_id": str(i), "city": city, "brand_guess": "A", "category": "X", "pack_value": grams, "pack_uom": "G",
                "price_inr": Decimal(price), "title": "A thing", "retailer": shop}

    listings = rows_of(schemas.LISTINGS, [
        listing(1, 10.0, "90.0000"), listing(2, 10.0, "80.0000", shop="s2"), listing(3, 10.0, "70.0000", city="delhi"),
        listing(4, 30.0, "130.0000"),
    ])
    star = mini(
        products=products, listings=listings, orders=[order(1)],
        order_lines=[line(i, 1, 1, 1, product=i, value=f"{100 * i}.0000") for i in (1, 2, 3)],
    )
    got = price.price_gap(star, "Mumbai", 3).collect()
    assert [(r.dim_code, r.lowest_competitor_price_inr, r.n_retailers_observed, r.gap_pct) for r in got] == [
        ("S3", 130.0, 1, -30.0), ("S2", None, None, None), ("S1", 80.0, 2, 20.0),
    ]
    assert tuple(price.price_gap_counts(price.price_gap(star, "mumbai", 3)).first()) == (3, 1, 2, 1)
    summary = price.price_summary(star).first()
    assert (summary.n_matched_listings, summary.min_gap_pct, summary.max_gap_pct, summary.avg_gap_pct) == (4, -30.0, 30.0, 7.5)
    assert price.price_summary(star, exact=True).first().avg_gap_pct == 7.5


def test_conservation_across_regions(mini, order, line):
    from depotlens.operators import quality

    star = mini(
        orders=[order(1), order(2, region=2, outlet=2), order(3, region=9)],
        order_lines=[line("a", 1, 4, 2), line("b", 2, 6, 6), line("c", 3, 5, 1)],
    )
    r = quality.conservation(star).first()
    assert (r.n_lines, r.lines_outside_regions, r.ordered_difference, r.delivered_difference) == (3, 1, 5, 1)
    assert r.outlets_in_several_regions == 1
    per_region = service.fill_rate(star, "region").agg(F.sum("ordered_qty")).first()[0]
    assert per_region == 10
