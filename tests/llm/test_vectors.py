"""Multi-index, hard negatives and whitening against brute force, and their defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.llm import multiindex, negatives, whitening

KIND = "vec_id long, embedding array<float>, label int, key string, row long, d int"


def frame(spark, rows):
    """(id, vector, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], KIND).repartition(3)


def floats(rows):
    return [[float(x) for x in np.float32(r)] for r in rows]


ODD = [
    (9000, None, 1), (9001, [], 1), (9002, [1.0, None, 0.0], 1), (9003, [float("nan"), 1.0, 0.0], 1),
    (9004, [float("inf"), 1.0, 0.0], 1),
]


# -- multi-index ------------------------------------------------------------------------------


def brute_links(rows, threshold):
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if la is None or la != rows[j][2] or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            a64, b64 = np.array(a), np.array(b)
            if a64 @ b64 / np.linalg.norm(a64) / np.linalg.norm(b64) >= threshold:
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[find(i)] = find(j)
    least = {}
    for i, (id, _, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), id) if x is not None], default=None)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    return sorted(((id, n[i], least[find(i)], id == least[find(i)]) for i, (id, _, _) in enumerate(rows)), key=key)


def links_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x or 0) for x in t))


def near_copies(seed, groups=12, d=12, noise=0.04):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.normal(size=d)
        size = int(rng.integers(1, 30))
        near = base + noise * np.linalg.norm(base) * rng.normal(size=(size, d)) / 3
        out += [(v, int(g % 3)) for v in floats(near)]
    out += [out[0]] * 5 + [(floats([3 * np.array(out[1][0])])[0], out[1][1]), (out[2][0], None), (out[2][0], 2 - out[2][1])]
    order = rng.permutation(len(out))
    return [(int(i), *out[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize("small", [False, True])
def test_links_of_near_copies(spark, monkeypatch, small):
    """The full radius loses nothing, with one cell as with many and with cells cut into slices."""
    if small:
        monkeypatch.setattr(multiindex, "PER_CELL", 3)
        monkeypatch.setattr(multiindex, "SLICE", 20)
        monkeypatch.setattr(multiindex, "TILE", 7)
    rows = near_copies(1) + ODD + [(9005, [0.0] * 12, 1), (None, [1.0] * 12, 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1)]
    rows += [(9006, [0.0, 1.0], 2), (9008, [0.0, 1.0], 2), (None, [1.0, 0.0], 2), (None, [1.0, 0.0], 2)]
    got = links_of(multiindex.linked(frame(spark, rows), threshold=0.98, recall=1.0))
    assert got == brute_links(rows, 0.98)


def test_recall_of_the_smaller_radius(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "PER_CELL", 8)
    rows = near_copies(3, groups=60, d=16, noise=0.15)
    found = links_of(multiindex.linked(frame(spark, rows), recall=0.99))
    wanted = brute_links(rows, 0.98)
    assert sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in wanted)
    assert all(f[1] <= w[1] for f, w in zip(found, wanted))
    keyed = frame(spark, rows).select(F.col("vec_id").alias("key"), "label", "embedding").where("label IS NOT NULL")
    index = multiindex.fitted(keyed, recall=0.9)
    assert index.radius < 0.04 and index.recall >= 0.9


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(5)
    rows = multiindex.units(rng.normal(size=(300, 10)))[1]
    index = multiindex.Index(10, (multiindex.codebook(rows[:, :5], 7), multiindex.codebook(rows[:, 5:], 6)), 0.3)
    a, b = rows[:150], rows[150:]
    assert (index.needed(a, b) <= np.square(a - b).sum(axis=1) + 1e-12).all()
    # the traversal visits exactly the cells within the radius, above home
    home, row, cell = index.visits(rows)
    (i, first), (j, second) = index.bounds(rows)
    whole = (first[:, :, None] + second[:, None, :]).reshape(len(rows), -1)
    want = {(r, c) for r, c in zip(*np.nonzero(whole <= 0.3)) if c > home[r]}
    assert set(zip(row, cell)) == want and len(row) == len(want)


def test_forest_is_the_components():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40):
        u, v = rng.integers(0, n, (2, n // 2))
        root = multiindex.forest(u, v, n)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v):
                want[a] = want[b] = min(want[a], want[b])
        assert (root == want).all()


def test_links_of_nothing(spark):
    assert multiindex.linked(frame(spark, [])).collect() == []
    assert links_of(multiindex.linked(frame(spark, ODD))) == sorted((i, 0, i, True) for i, _, _ in ODD)


# -- hard negatives ---------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, most=3):
    ok = [
        (id, np.floor(256 * np.array(v, float)).astype(np.int64), label)
        for id, v, label in rows
        if id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (id, a, label) in enumerate(ok):
        if id not in anchors:
            continue
        scored = sorted(((-int(a @ b), other, lo, m) for m, (other, b, lo) in enumerate(ok) if len(a) == len(b)), key=lambda t: (t[0], t[1]))
        for p, positive, _, _ in [s for s in scored if s[2] == label and s[3] != n][:positives]:
            hard = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:most]
            out += [(id, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (65, 64, 129), (100, 33, 70), (7, 0, 9), (128, 128, 128)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for most in (2**10, 2**28):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        got = negatives.strassen(a, b, leaf=4)
        assert got.dtype == np.int64 and (got.astype(object) == a.astype(object) @ b.astype(object)).all()


@pytest.mark.parametrize("tiles", [(512, 2048, 1 << 25), (3, 5, 128)])
def test_negatives(spark, monkeypatch, tiles):
    for name, value in zip(("ANCHOR_TILE", "CANDIDATE_TILE", "BLOCK_CELLS"), tiles):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(150, 6)) / 3
    vectors[100:] = np.round(vectors[100:])  # many equal scores and rows
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(floats(vectors))] + ODD
    rows += [(None, [1.0] * 6, 1), (500, [1.0] * 6, None), (501, [1.0, 2.0], 1), (502, [1.0, 2.5], 1), (503, [0.75, 1.5], 2)]
    anchors = {*range(0, 150, 4), 501, 9000}
    got = negatives.mined(frame(spark, rows), F.col("vec_id").isin(*anchors))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, anchors)


def test_negatives_of_nothing(spark):
    assert negatives.mined(frame(spark, []), F.lit(True)).collect() == []
    assert negatives.mined(frame(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]), F.lit(False)).collect() == []


# -- whitening --------------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(0)
    turn = lambda: np.linalg.qr(rng.normal(size=(24, 24)))[0]
    yield rng.normal(size=(200, 24))
    yield rng.normal(size=(10, 24))
    yield rng.normal(size=(80, 24)) * np.logspace(0, -8, 24)
    yield rng.normal(size=(80, 3)) @ rng.normal(size=(3, 24))
    yield np.eye(24)
    yield np.zeros((4, 24))
    yield rng.normal(size=(9, 1))
    for values in ([9, 9, 3, 1], [5, 5, 5, 5], [4, 4 + 1e-9, 4 - 1e-13, 1]):
        yield (turn() * np.repeat(values, 6)) @ turn()
    yield (turn() * np.sort(rng.integers(1, 12, 24).astype(float))) @ turn()


@pytest.mark.parametrize("c", list(matrices()), ids=lambda c: f"{c.shape}")
def test_directions(c):
    d = c.shape[1]
    r = np.linalg.qr(c, mode="r")
    values, vectors = whitening.directions(np.vstack([r, np.zeros((d - len(r), d))]), d)
    want = np.linalg.svd(c, compute_uv=False) ** 2
    want = np.pad(want, (0, d - len(want)))
    some = values > 0
    assert np.abs(values - want).max() <= 1e-12 * max(want[0], 1)
    assert (np.abs(values - want)[some] <= 1e-11 * want[some]).all()
    assert np.abs(c.T @ (c @ vectors) - vectors * values).max() <= 1e-12 * max(want[0], 1)
    assert np.abs(vectors[:, some].T @ vectors[:, some] - np.eye(some.sum())).max(initial=0) < 1e-10


def test_dqds_is_accurate_for_every_value():
    a, b = np.logspace(0, -12, 30), np.logspace(-1, -12, 29)
    got = whitening.dqds(list(a**2), list(b**2))
    want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert np.abs(np.array(got) / want - 1)[:12].max() < 1e-12
    assert math.isclose(np.prod(np.array(got)), np.prod(a**2), rel_tol=1e-11)  # the small ones, too


def whitened(df, **options):
    return whitening.whitened(df, whitening.fitted(df, **options)).orderBy("vec_id", "component").collect()


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # several rounds of merged triangles
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 9)) * np.arange(1, 10)
    rows = [(i, v, 1) for i, v in enumerate(floats(base))] + [(200 + i, v, None) for i, v in enumerate(floats(base[:30]))]
    odd = [*ODD, (9005, [1.0] * 4, 1), (9006, [1e30] * 9, 1)]
    got = whitened(frame(spark, rows + odd).repartition(7), components=5)
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:5], vectors[:, ::-1][:, :5]
    want = ((n * x - sums) / n) @ vectors / np.sqrt(values)
    w = np.array([r.whitened for r in got]).reshape(-1, 5)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-10
    assert [r.vec_id for r in got[::5]] == [r[0] for r in rows] and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::5]] == [int(s) for s in ((n * x - sums) ** 2).sum(axis=1)]
    assert np.allclose([r.explained for r in got[:5]], values / np.trace(centred.T @ centred / n), rtol=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_without_variance(spark):
    assert whitened(frame(spark, [])) == [] and whitened(frame(spark, ODD)) == []
    one = whitened(frame(spark, [(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]))
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None), (1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None),
    ]
    flat = whitened(frame(spark, [(1, [0.0, 2.0], 1), (2, [1.0, 2.0], 1)]))
    assert [(r.component, abs(r.whitened or 0.0), r.explained) for r in flat] == [(1, 1.0, 1.0), (2, 0.0, 0.0)] * 2
    assert flat[1].whitened is None and flat[0].identity_error < 1e-12


def test_whitening_of_huge_entries_is_exact_or_null(spark):
    got = whitened(frame(spark, [(1, [2.0**55, 0.0], 1), (2, [0.0, 0.0], 1), (3, [2.0**20, 0.0], 1)]))
    assert [r.deviation for r in got[::2]][0] is None and abs(got[0].whitened) > 1
