import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import dims, matching


def product(i, brand="A", category="X", grams=100.0, uom="G", name="Thing", mrp="50.00"):
    return {"product_id": i, "sku_code": f"S{i}", "product_name": name, "brand": brand, "category": category,
            "pack_size_value": grams, "pack_size_uom": uom, "mrp_inr": Decimal(mrp), "is_chilled": 0}


def listing(i, brand="A", category="X", value=100.0, uom="G", title="A pack", price="40.0000", city="mumbai"):
    return {"listing_id": str(i), "city": city, "title": title, "brand_guess": brand, "category": category, "pack_value": value,
            "pack_uom": uom, "price_inr": None if price is None else Decimal(price), "last_seen": "2026-06-01"}


@pytest.fixture(scope="module")
def match(rows_of):
    def run(listings, products, **kw):
        dim = dims.product(rows_of(schemas.OPERATIONAL["products"], products))
        out = matching.price_position(rows_of(schemas.LISTINGS, listings), dim, **kw)
        return {(r.city, r.listing_id): r for r in out.collect()}

    return run


def test_no_one_and_two_candidates(match):
    products = [product(1), product(2, grams=200.0), product(3, grams=200.2)]
    got = match([listing(1), listing(2, value=0.2, uom="kg"), listing(3, value=300.0), listing(4, brand=None), listing(5, price=None)], products)
    by_id = {k[1]: (r.match_confidence, r.sku_code) for k, r in got.items()}
    assert by_id == {
        "1": ("matched", "S1"), "2": ("ambiguous", "S2"), "3": ("unmatched", None), "4": ("unmatched", None), "5": ("matched", "S1"),
    }
    assert got[("mumbai", "1")].mrp_gap_inr == Decimal("10.0000") and got[("mumbai", "1")].mrp_gap_pct == 20.0
    assert got[("mumbai", "5")].mrp_gap_pct is None


def test_the_band_is_open_at_half_a_unit(match):
    products = [product(1, grams=100.0)]
    got = match([listing(1, value=100.5), listing(2, value=100.49), listing(3, value=99.51), listing(4, value=99.5)], products)
    assert {k[1]: r.match_confidence for k, r in got.items()} == {
        "1": "unmatched", "2": "matched", "3": "matched", "4": "unmatched",
    }


def test_weight_and_volume(match):
    products = [product(1, grams=400.0, uom="ML")]
    assert match([listing(1, value=400.0)], products)[("mumbai", "1")].match_confidence == "unmatched"
    loose = match([listing(1, value=400.0)], products, strict_family=False)
    assert loose[("mumbai", "1")].match_confidence == "matched"


def test_name_breaks_ties_but_stays_ambiguous(match):
    products = [product(1, name="A of red"), product(2, name="Golden Syrup"), product(3, name="Syrup")]
    got = match([listing(1, title="fine golden-syrup"), listing(2, title="of red tins"), listing(3, title="SYRUPS")], products)
    picks = {k[1]: (r.sku_code, r.match_confidence) for k, r in got.items()}
    # Short words never count, so the second falls back to the lowest product.
    assert picks == {"1": ("S2", "ambiguous"), "2": ("S1", "ambiguous"), "3": ("S2", "ambiguous")}


def test_a_very_long_title_token(match):
    products = [product(1, name="other things"), product(2, name="needle case")]
    token = "".join(random.Random(1).choices("abcdefg", k=100_000))
    got = match([listing(1, title=token[:60_000] + "Needle" + token[60_000:]), listing(2, title=token)], products)
    assert {k[1]: r.sku_code for k, r in got.items()} == {"1": "S2", "2": "S1"}


def test_the_brand_is_not_a_name_word(match):
    products = [product(1, brand="Marwar", name="Plain"), product(2, brand="Marwar", name="Marwar Gold")]
    got = match([listing(1, brand="Marwar", title="MARWAR something")], products)
    assert got[("mumbai", "1")].sku_code == "S1"


def test_same_id_in_two_cities_and_twice_in_one(match):
    products = [product(1), product(2, grams=200.0)]
    got = match([listing(1), listing(1, value=200.0, city="delhi"), listing(7), listing(7, price="30.0000")], products)
    assert got[("mumbai", "1")].sku_code == "S1" and got[("delhi", "1")].sku_code == "S2"
    twice = got[("mumbai", "7")]
    assert (twice.n_candidates, twice.match_confidence, twice.price_inr) == (2, "ambiguous", Decimal("30.0000"))


def brute_force(listings, products):
    factor = {"G": 1, "KG": 1000, "ML": 1, "L": 1000}
    family = {"G": "w", "KG": "w", "ML": "v", "L": "v"}
    out = {}
    for l in listings:
        cands = [
            p for p in products
            if l["brand_guess"] == p["brand"] and l["category"] == p["category"]
            and family[l["pack_uom"].upper()] == family[p["pack_size_uom"]]
            and abs(p["pack_size_value"] * factor[p["pack_size_uom"]] - l["pack_value"] * factor[l["pack_uom"].upper()]) < 0.5
        ]

        def hit(p):
            words = [w for w in p["product_name"].split(" ") if len(w) >= 4 and w.upper() != p["brand"].upper()]
            return any(w.upper() in l["title"].upper() for w in words)

        best = min(cands, key=lambda p: (not hit(p), p["product_id"]), default=None)
        kind = "unmatched" if not cands else "ambiguous" if len(cands) > 1 else "matched"
        out[l["city"], l["listing_id"]] = (best and best["sku_code"], kind, max(1, len(cands)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(match, seed):
    """One brand and category holds most of both sides; packs collide, names overlap by parts."""
    rnd = random.Random(seed)
    words = ["gold", "golden", "old", "tea", "teas", "green", "greens", "salt", "a", "Marwar", "x-gold", "éclair"]

    def common():
        return rnd.choice(["Marwar", "Marwar", "Amrit"]), rnd.choice(["X", "X", "Y"])

    products = []
    for i in range(120):
        b, c = common()
        name = " ".join(rnd.choices(words, k=rnd.randint(1, 3)))
        products.append(product(i, b, c, rnd.choice([100.0, 100.25, 100.7, 101.0, 0.5, 7.0]), rnd.choice(["G", "G", "ML", "KG"]), name))
    listings = []
    for i in range(150):
        b, c = common()
        title = " ".join(rnd.choices(words + ["marwargold", "GREENSALT"], k=rnd.randint(0, 4)))
        unit = rnd.choice(["g", "G", "ml", "kg"])
        listings.append(listing(i, b, c, rnd.choice([100.0, 100.4, 100.5, 0.1, 101.0, 7.0]), unit, title))
    got = {k: (r.sku_code, r.match_confidence, r.n_candidates) for k, r in match(listings, products).items()}
    assert got == brute_force(listings, products)


def test_no_pair_join_in_the_plan(spark, rows_of):
    """Listings and products only ever meet as cells: no nested loop, no product."""
    dim = dims.product(rows_of(schemas.OPERATIONAL["products"], [product(1)]))
    out = matching.price_position(rows_of(schemas.LISTINGS, [listing(1)]), dim)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Join Cross" not in plan


def test_profile(spark, rows_of):
    dim = dims.product(rows_of(schemas.OPERATIONAL["products"], [product(1)]))
    out = matching.price_position(rows_of(schemas.LISTINGS, [listing(1), listing(2, brand=None)]), dim)
    assert {r.match_confidence: r.n_listings for r in matching.match_profile(out).collect()} == {"matched": 1, "unmatched": 1}
    assert out.where(F.col("n_candidates") < 1).count() == 0
