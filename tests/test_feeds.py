import json
from datetime import date, datetime
from decimal import Decimal
from html import unescape

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import quality
from depotlens.sources import landed, listings
from depotlens.streaming import invoices


def invoice(i, amount=12345, detention=None, created="2026-03-05T20:00:00Z", day="2026-03-05"):
    return {"invoice_id": i, "carrier_id": "C1", "carrier_name": "Carrier", "warehouse_code": "W1", "route_code": "R1",
            "invoice_date": day, "service_date": day, "amount": amount, "detention_charge": detention,
            "fuel_surcharge_pct": 1.5, "distance_km": 10.0, "weight_kg": 5.0, "temperature_controlled": True, "status": "BILLED",
            "created_at_utc": created}


def test_invoice_units_and_zone(rows_of):
    raw = rows_of(schemas.INVOICE, [invoice("a"), invoice("b", 1, 250)])
    a, b = landed.normalise_invoices(raw).orderBy("invoice_id").collect()
    assert (a.amount_inr, a.detention_charge_inr) == (Decimal("123.45"), None)
    assert (b.amount_inr, b.detention_charge_inr) == (Decimal("0.01"), Decimal("2.50"))
    assert a.created_at_ist == datetime(2026, 3, 6, 1, 30)
    assert [f.dataType for f in landed.normalise_invoices(raw).schema] == [f.dataType for f in schemas.FREIGHT]


def test_invoice_pages(spark):
    body = json.dumps({"data": [invoice("a"), invoice("b")], "next_cursor": None, "total_estimate": 2})
    pages = spark.createDataFrame([(body,)], "body string")
    got = landed.invoices_of_pages(landed.parse_documents(pages, "body", "invoice_page"))
    assert [r.invoice_id for r in got.collect()] == ["a", "b"]
    broken = spark.createDataFrame([("{not json",)], "body string")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        landed.parse_documents(broken, "body", "invoice_page").collect()


def test_carriers_months_surcharges_weather(spark, rows_of):
    c = rows_of(schemas.CARRIER, [{"carrier_id": "1", "regions": ["WST", "STH"]}, {"carrier_id": "2", "regions": []}])
    assert [r.regions for r in landed.flatten_carriers(c).collect()] == ["WST|STH", ""]
    span = spark.createDataFrame([(date(2025, 11, 30), date(2026, 2, 1))], "a date, b date")
    months = landed.month_series(span, "a", "b")
    assert [r.month for r in months.collect()] == ["2025-11", "2025-12", "2026-01", "2026-02"]
    records = rows_of(schemas.SURCHARGE, [{"month": "2025-12", "surcharge_pct": 2.5}, {"month": "2019-01", "surcharge_pct": 9.0}])
    table = {r.month: r.surcharge_pct for r in landed.surcharge_table(months, records).collect()}
    assert table == {"2025-11": None, "2025-12": 2.5, "2026-01": None, "2026-02": None}
    doc = {"city": "Pune", "daily": {"time": ["2026-01-01", "2026-01-02"], "temperature_2m_max": [30.5, None], "precipitation_sum": [0.0]}}
    docs = landed.parse_documents(spark.createDataFrame([(json.dumps(doc),)], "b string"), "b", "weather")
    assert [tuple(r) for r in landed.weather_days(docs).collect()] == [("Pune", date(2026, 1, 1), 30.5, 0.0)]


def test_optional_feed(spark, tmp_path):
    missing = landed.read_optional(spark, str(tmp_path / "none"), schemas.WEATHER)
    assert missing.count() == 0 and missing.schema == schemas.WEATHER
    (tmp_path / "empty").mkdir()
    assert landed.read_optional(spark, str(tmp_path / "empty"), schemas.WEATHER).count() == 0
    header_only = tmp_path / "header.csv"
    header_only.write_text("city,date,temp_max_c,precipitation_mm\n")
    assert landed.read_optional(spark, str(header_only), schemas.WEATHER).count() == 0
    full = tmp_path / "full.csv"
    full.write_text("city,date,temp_max_c,precipitation_mm\nPune,2026-01-01,30.5,\n")
    assert tuple(landed.read_optional(spark, str(full), schemas.WEATHER).first()) == ("Pune", date(2026, 1, 1), 30.5, None)


def test_operational_folder(spark, rows_of, tmp_path):
    for name, schema in schemas.OPERATIONAL.items():
        rows_of(schema, [{}]).write.parquet(str(tmp_path / name))
    sources = landed.read_sources(spark, str(tmp_path))
    assert sources.orders.schema.simpleString() == schemas.OPERATIONAL["orders"].simpleString()
    assert sources.orders.count() == 1 and sources.freight.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landed.read_table(spark, str(tmp_path / "absent"), schemas.OPERATIONAL["orders"])


# -- listing pages ------------------------------------------------------------------------


def card(i, price='<span class="price">&#8377;1,299.50</span>', meta="Corner Shop &middot; 400 g &middot; TEA", title="Amrit &amp; Co Tea", rest=""):
    return (
        f'<div class="card product-item" data-listing-id="{i}"><a href="/product/{i}.html"><strong>{title}</strong></a>\n'
        f'<div class="muted">{meta}</div>{price}{rest}</div>'
    )


def extracted(spark, *cards, brands=("Amrit", "Marwar")):
    page = "<html><p>Page 1 of 3</p>" + "".join(cards) + "</html>"
    pages = spark.createDataFrame([("pune", "/city/pune/page/1.html", page)], "city string, url string, html string")
    return {r.listing_id: r for r in listings.extract(pages, brands).collect()}


def test_price_markups(spark):
    got = extracted(
        spark,
        card(1),
        card(2, '<span class="pricing-block" data-price-paise="12345">-</span>'),
        card(3, '<div class="amt"><b>Rs</b> 1,000 <small>all in</small></div>'),
        card(4, '<b class="sellingPrice">INR 55.5</b>'),
        card(5, "<i>call us</i>"),
        card(6, '<b class="sellingPrice">INR 1</b><span class="price">2</span>'),
        card(7, '<span class="price">soon</span><span class="pricing-block" data-price-paise="900">'),
        card(8, '<span class="price">soon</span>'),
        card(9, '<span class="price"></span>'),
    )
    seen = {int(i): (r.price_inr, r.price_source) for i, r in got.items()}
    assert seen == {
        1: (Decimal("1299.50"), "span.price"), 2: (Decimal("123.45"), "pricing-block(paise)"), 3: (Decimal("1000"), "div.amt"),
        4: (Decimal("55.5"), "b.sellingPrice"), 5: (None, None), 6: (Decimal("2"), "span.price"),
        7: (Decimal("9"), "pricing-block(paise)"), 8: (None, "span.price"), 9: (None, "span.price"),
    }


def test_card_fields(spark):
    rest = (
        '<div class="muted">MRP &#x20B9;1,500 &middot; In stock at 3 shops &middot; rated 4.5 (120)</div>'
        '<div class="muted">Last seen: 2026-05-31</div>'
    )
    got = extracted(
        spark,
        card(1, rest=rest),
        card(2, meta="Shop &amp; Sons"),
        card(3, meta="A &middot; 1.5L"),
        card(4, meta="A &middot; 12 pieces &middot; X", rest='<div class="muted">MRP 10 &middot; currently unavailable</div>'),
        '<div class="card product-item" data-listing-id="5"><p>no title</p></div>',
        card(6, title="MARWAR and amrit"),
    )
    assert sorted(got) == ["1", "2", "3", "4", "6"]
    one = got["1"]
    assert (one.title, one.brand_guess, one.retailer, one.pack_raw, one.category) == ("Amrit & Co Tea", "Amrit", "Corner Shop", "400 g", "TEA")
    assert (one.pack_value, one.pack_uom, one.mrp_inr, one.stock_status) == (400.0, "G", Decimal("1500.00"), "IN_STOCK")
    assert (one.rating, one.rating_count, one.last_seen) == (4.5, 120, "2026-05-31")
    assert (one.product_detail_url, one.source_url, one.city) == ("/product/1.html", "/city/pune/page/1.html", "pune")
    assert (got["2"].retailer, got["2"].pack_raw, got["2"].category) == ("Shop & Sons", None, None)
    assert (got["3"].pack_value, got["3"].pack_uom, got["3"].category) == (1.5, "L", None)
    assert (got["4"].pack_value, got["4"].stock_status, got["4"].rating) == (None, "UNAVAILABLE", None)
    assert got["6"].brand_guess == "Amrit"  # list order wins


def test_page_coverage(spark):
    rows = [("pune", "/1", "page 1 of 3"), ("pune", "/2", "Page 2 of 3"), ("goa", "/1", "no count")]
    pages = spark.createDataFrame(rows, "city string, url string, html string")
    got = {r.city: (r.pages_declared, r.pages_seen, r.pages_missing) for r in listings.page_coverage(pages).collect()}
    assert got == {"pune": (3, 2, 1), "goa": (1, 1, 0)}
    assert listings.extract(pages, ("Marwar",)).count() == 0


@pytest.mark.parametrize("text", [
    "plain", "a &amp; b", "&#8377;5", "&#x20b9;5", "&amp;amp;", "&nope; &", "&&lt;&gt;", "caf&eacute; &quot;x&quot; &apos;y&apos;", "&#0065;",
    "tail &amp;", "&#x1F600;", "&middot;&nbsp;",
])
def test_unescape_agrees_with_the_standard_library(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(listings.unescaped(F.col("t"))).first()[0]
    assert got == unescape(text)


# -- rejected records ---------------------------------------------------------------------


def test_bad_records_go_into_quarantine(spark, tmp_path):
    folder = tmp_path / "weather"
    folder.mkdir()
    (folder / "a.csv").write_text('city,date,temp_max_c,precipitation_mm\nPune,2026-01-01,30.5,0.0\nPune,2026-01-02,hot,0.0\nGoa\n')
    (folder / "b.csv").write_text('city,date,temp_max_c,precipitation_mm\n"Big, Bay",2026-01-01,,\nGoa,01.02.26,x,1.0,9\n,,,\n')
    read = landed.quarantined(landed.read_checked(spark, str(folder), schemas.WEATHER, "weather"), str(tmp_path / "q"))
    good = sorted((r.city or "", r.temp_max_c) for r in read.rows.collect())
    assert good == [("", None), ("Big, Bay", None), ("Pune", 30.5)] and read.rows.schema == schemas.WEATHER
    bad = sorted((r.file.rsplit("/", 1)[1], r.reason, r.record) for r in read.rejected.collect())
    assert bad == [
        ("a.csv", "bad value: temp_max_c", "Pune,2026-01-02,hot,0.0"), ("a.csv", "not a whole record", "Goa"),
        ("b.csv", "bad value: date, temp_max_c", "Goa,01.02.26,x,1.0,9"),
    ]
    assert read.rows.select("city").count() == 3 and read.rejected.select("source").count() == 3
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"city": "Pune", "date": "2026-01-01", "temp_max_c": 1}\n{"city": "Goa", "temp_max_c": "warm"}\n{broken\n')
    read = landed.read_checked(spark, str(tmp_path / "j"), schemas.WEATHER, "weather", "json")
    assert [r.city for r in read.rows.collect()] == ["Pune"]
    assert sorted(r.reason for r in read.rejected.collect()) == ["bad value: temp_max_c", "not a whole record"]
    none = landed.read_checked(spark, str(tmp_path / "none"), schemas.WEATHER, "weather")
    assert none.rows.count() == none.rejected.count() == 0
    with pytest.raises(ValueError, match="csv and json"):
        landed.read_checked(spark, str(folder), schemas.WEATHER, "weather", "parquet")


def test_the_gate_warns_of_rejected_records(spark, mini):
    from dataclasses import replace

    bad = spark.createDataFrame([("weather", "f", "r", "x")] * 2 + [("freight", "f", "r", "x")], landed.REJECTED)
    days = spark.createDataFrame([("Pune", date(2026, 1, 1), 1.0, 0.0)] * 198, schemas.WEATHER)
    sources = replace(mini(weather=days).landed, rejected=bad)
    sources = replace(sources, freight=schemas.empty(spark, schemas.FREIGHT), listings=schemas.empty(spark, schemas.LISTINGS))
    got = {r.check_name: (r.hard, r.passed, r.observed) for r in quality.rejected_report(sources).collect()}
    assert got == {
        "rejected_records:weather": (False, True, 2), "rejected_records:freight": (False, False, 1), "rejected_records:listings": (False, True, 0),
    }
    assert quality.rejected_report(mini().landed) is None


# -- incremental ingest -------------------------------------------------------------------


def test_ingest_is_exactly_once_across_batches_and_restarts(spark, tmp_path):
    land, out, check = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "check")
    land.mkdir()

    def page(name, *ids, day="2026-03-05"):
        body = {"data": [invoice(i, day=day) for i in ids], "next_cursor": None, "total_estimate": 1}
        (land / name).write_text(json.dumps(body) + "\n")

    def run():
        invoices.ingest(invoices.landed_pages(spark, str(land), files_per_batch=1), out, check)
        return sorted(r.invoice_id for r in invoices.stored(spark, out).collect())

    page("1.json", "a", "b", "b")
    page("2.json", "b", "c")
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]  # nothing new landed
    page("3.json", "a", "c", "d")
    page("4.json", "e", day="2026-04-01")
    assert run() == ["a", "b", "c", "d", "e"]


MAY = "2026-05-05T20:00:00Z"


@pytest.mark.parametrize("final", [False, True])
def test_an_invoice_that_comes_back_changed(spark, rows_of, tmp_path, final):
    """Its own month does not matter; if it was created anew, it is found unless the caller ruled that out."""
    write = invoices.store_batch(str(tmp_path / "out"), "r", created_is_final=final)
    write(landed.normalise_invoices(rows_of(schemas.INVOICE, [invoice("a"), invoice("b")])), 0)
    april = "2026-04-01"
    moved = [
        invoice("a", day=april), invoice("c", day=april, created="2026-03-06T00:00:00Z"),
        invoice("c", 5, day=april),
    ]
    write(landed.normalise_invoices(rows_of(schemas.INVOICE, moved)), 1)
    write(landed.normalise_invoices(rows_of(schemas.INVOICE, [invoice("b", created=MAY)])), 2)
    rows = invoices.stored(spark, str(tmp_path / "out")).collect()
    assert sorted(r.invoice_id for r in rows) == (["a", "b", "b", "c"] if final else ["a", "b", "c"])
    assert next(r for r in rows if r.invoice_id == "c").amount_inr == Decimal("0.05")  # the first created


def test_a_batch_reads_the_partitions_of_its_ids(spark, rows_of, tmp_path):
    """The work of a batch does not grow with the table: months pass, it reads as many files as before."""
    out = str(tmp_path / "out")
    write = invoices.store_batch(out, "r", created_is_final=True, id_buckets=4)
    files, all_files = [], []
    for month in range(1, 7):
        at = f"2026-{month:02d}-10T00:00:00Z"
        batch = [invoice(f"{month}-{i}", created=at) for i in range(30)]
        write(landed.normalise_invoices(rows_of(schemas.INVOICE, batch)), month)
        again = landed.normalise_invoices(rows_of(schemas.INVOICE, batch[:3] + [invoice("new", created=at)]))
        looked = invoices.stored_ids(invoices.placed(again, 4), out, created_is_final=True)
        files.append(looked.select(F.input_file_name()).distinct().count())
        all_files.append(invoices.stored(spark, out).select(F.input_file_name()).distinct().count())
        assert "PartitionFilters: [" in looked._jdf.queryExecution().toString() and looked.count() <= 30
    assert max(files) <= 4 and all_files[-1] >= 5 * all_files[0]
    # half a year late, and still known
    late = [invoice("1-7", created="2026-01-10T00:00:00Z"), invoice("x", created="2026-01-11T00:00:00Z")]
    before = invoices.stored(spark, out).count()
    write(landed.normalise_invoices(rows_of(schemas.INVOICE, late)), 9)
    assert invoices.stored(spark, out).count() == before + 1


def test_a_run_is_its_checkpoint(spark, rows_of, tmp_path):
    one, two = (invoices.run_of(spark, str(tmp_path / c)) for c in "ab")
    assert one != two and invoices.run_of(spark, f"{tmp_path}/a/") == one
    out = str(tmp_path / "out")
    for run, id in ((one, "a"), (two, "a"), (two, "b")):
        invoices.store_batch(out, run, id_buckets=4)(landed.normalise_invoices(rows_of(schemas.INVOICE, [invoice(id)])), 0)
    assert sorted(r.invoice_id for r in invoices.stored(spark, out).collect()) == ["a", "b"]
    # the split of a table is that of its first batch
    invoices.store_batch(out, one, id_buckets=50)(landed.normalise_invoices(rows_of(schemas.INVOICE, [invoice(c) for c in "abc"])), 1)
    assert sorted((r.invoice_id, r.id_bucket < 4) for r in invoices.stored(spark, out).collect()) == [(c, True) for c in "abc"]
    with pytest.raises(TypeError):
        invoices.store_batch(out, one, True)


def test_a_replayed_batch_overwrites_itself(spark, rows_of, tmp_path):
    out = str(tmp_path / "out")
    write = invoices.store_batch(out, "r")
    batch = landed.normalise_invoices(rows_of(schemas.INVOICE, [invoice("a"), invoice("a"), invoice("b")]))
    write(batch, 0)
    write(batch, 1)
    write(batch, 1)
    write(batch, 0)
    got = invoices.stored(spark, out)
    assert sorted(r.invoice_id for r in got.collect()) == ["a", "b"]
    assert {(r.created_month, r.batch_id) for r in got.collect()} == {("2026-03", 0)}


def test_page_per_file(spark, tmp_path):
    body = json.dumps({"data": [invoice("a")], "next_cursor": "x", "total_estimate": 1}, indent=1)
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "p.json").write_text(body)
    stream = invoices.landed_pages(spark, str(tmp_path / "land"), page_per_file=True)
    invoices.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert invoices.stored(spark, str(tmp_path / "out")).count() == 1
