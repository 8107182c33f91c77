from random import Random

from depotlens import schemas
from depotlens.operators import entities, skew

NAMES = ("outlet_id", "outlet_name", "gst_number", "latitude", "longitude", "is_deleted")


def outlets(rows_of, spec):
    return rows_of(schemas.OPERATIONAL["outlets"], [dict(zip(NAMES, s)) for s in spec])


def brute(spec):
    """Smallest reachable outlet of every outlet, by merging sets."""
    group = {s[0]: {s[0]} for s in spec if s[0] is not None}
    keys = {}
    for i, _, gst, lat, lon, _ in spec:
        if i is not None:
            for key in ([("t", gst)] if gst else []) + ([("p", lat, lon)] if None not in (lat, lon) else []):
                keys.setdefault(key, []).append(i)
    for members in keys.values():
        whole = set().union(*(group[i] for i in members))
        for i in whole:
            group[i] = whole
    return {i: min(g) for i, g in group.items()}


def test_survivors(rows_of):
    spec = [
        (5, "ZZ first", "G1", None, None, 0), (3, "Shop", None, 1.0, 2.0, 1), (9, "Shop", "G1", 1.0, 2.0, 0), (7, "Shop", "G1", None, None, 0),
        (1, "Alone", "", 8.0, None, 0), (2, None, None, None, None, None), (None, "Lost", "G1", None, None, 0),
        (20, "A", "2.0,1.0", None, None, 0), (21, "B", None, 2.0, 1.0, 0),  # keys of two kinds never meet
        (30, "Gone", "G3", None, None, 1), (31, "Kept", "G3", None, None, 0),
    ]
    got = {r.outlet_id: tuple(r)[1:] for r in entities.outlet_entities(outlets(rows_of, spec)).collect()}
    assert len(got) == len(spec) and got[None] == (None, 1, None, None)
    assert {i: got[i] for i in (3, 5, 7, 9)} == {3: (3, 4, 7, False), 5: (3, 4, 7, False), 7: (3, 4, 7, True), 9: (3, 4, 7, False)}
    assert all(got[i] == (i, 1, i, True) for i in (1, 2, 20, 21))
    assert got[30] == (30, 2, 31, False) and got[31] == (30, 2, 31, True)
    assert entities.outlet_entities(outlets(rows_of, [])).count() == 0


def test_random_links_chains_and_a_hot_key(rows_of):
    draw = Random(3)
    ids = draw.sample(range(10_000), 600)
    spec = [(i, "n", f"G{draw.randrange(150)}" if draw.random() < 0.4 else None, float(draw.randrange(200)), 1.0 if draw.random() < 0.4 else None, 0) for i in ids[:300]]
    # A chain of 100 links in random order of ids, and a tax number of a third of all rows.
    spec += [(i, "n", f"C{at // 2}", float(1000 + (at + 1) // 2), 5.0, 0) for at, i in enumerate(ids[300:400])]
    spec += [(i, "n", "HOT", None, None, 0) for i in ids[400:]]
    got = {r.outlet_id: r.entity_id for r in entities.outlet_entities(outlets(rows_of, spec)).collect()}
    assert got == brute(spec) and len({got[i] for i in ids[300:400]}) == 1


def test_lookup_spreads_hot_keys(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(-1, None), (-2, "none")], "id long, key string")
    values = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, value int")
    got = {r.id: r.value for r in skew.looked_up(df, "key", values).collect()}
    assert got == {i: 1 if i >= 0 and i % 3 else 2 if i == 3 else None for i in range(-2, 3000)} | {-1: None, -2: None}
