"""Near duplicates among embeddings by an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own, and the pairs of codes form a grid of cells; every
vector is filed under its cell. A vector then visits cells in the order of how near they could be, by a multi-sequence
traversal of the two sorted lists of its halves, and stops at a radius. What a cell could hold is bounded from below: a
vector nearer to another code lies beyond the plane between the codes. At the full radius of the link no link can
be missed; the index stops at the smaller radius that found the target share of the links of a bounded, hashed sample of
rows compared with all rows, and of the sample turned by the whole angle in random directions, whichever is larger. A
pair is met in one cell only, the home of the vector with the larger cell number, so only cells above its own are
visited. Each meeting is verified in double precision.

Rows with equal label and vector are one vertex with a count. A crowded cell is cut into slices, and every pair of slices
is a task of its own, so that no task grows with a group of copies. A task gives counts of links and a spanning forest,
never its pairs.

Defined results: rows whose label is null, or whose vector is null, empty or zero or holds a null or non-finite component,
link with nothing and are their own component. Vectors of different lengths don't link; only the commonest length has a
grid, others meet in one cell per label. A null id is never the smallest one; a component of such rows alone has a null
id and its rows are kept. Rows that share an id are separate rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow, components, dropped, written
from .vectors import lists, matrices

SAMPLE, QUERIES, BINS, TURNS = 16_384, 512, 200, 4
PER_CELL, SLICE, TILE = 512, 4_096, 512
MOST_CODES = 1_024


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not zero, and those at length one; scaled first, so that squares neither overflow nor vanish."""
    most = np.abs(rows).max(axis=1, initial=0)
    some = most > 0
    scaled = rows[some] / most[some, None]
    return some, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codebook(rows: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centres of the rows; fewer if rows repeat."""
    rows = np.unique(rows, axis=0)
    centres = rows[np.random.default_rng(0).permutation(len(rows))[:codes]]
    for _ in range(rounds):
        nearest = (np.square(centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


@dataclass(frozen=True)
class Index:
    """``books``: a codebook for either half of vectors of ``d`` numbers. ``radius``: how far a vector looks, squared.
    ``recall``: share of the links of the sampled rows that are found; None if they have none."""

    d: int
    books: tuple[np.ndarray, np.ndarray]
    radius: float
    recall: float | None = None

    def bounds(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: each row's own code, and the least squared distance to anything filed under every code."""
        out, cut = [], self.d // 2
        for half, codes in zip((rows[:, :cut], rows[:, cut:]), self.books):
            apart = np.square(codes).sum(axis=1) - 2 * half @ codes.T
            own = apart.argmin(axis=1)
            over = apart - apart[np.arange(len(own)), own][:, None]
            between = np.sqrt(np.square(codes[:, None] - codes[None]).sum(axis=2))[own]
            over = np.divide(over, 2 * between, out=np.zeros_like(over), where=between > 0)
            out.append((own, np.square(over)))
        return out

    def homes(self, rows: np.ndarray) -> np.ndarray:
        (i, _), (j, _) = self.bounds(rows)
        return i * len(self.books[1]) + j

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The radius at which each pair of rows meets: that at which the one with the smaller cell visits the other's."""
        ends = [self.bounds(a), self.bounds(b)]
        cells = [e[0][0] * len(self.books[1]) + e[1][0] for e in ends]
        at = np.arange(len(a))
        reach = [e[0][1][at, o[0][0]] + e[1][1][at, o[1][0]] for e, o in (ends, ends[::-1])]
        return np.where(cells[0] < cells[1], *reach) * (cells[0] != cells[1])

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and (row, cell) of all cells above home within the radius.

        Multi-sequence traversal of all rows at once: each row has a frontier of one cell per code of the first half,
        takes the nearest of them, and moves that frontier on by one code of the second half.
        """
        (i, first), (j, second) = self.bounds(rows)
        m, width = len(rows), second.shape[1]
        home = i * width + j
        order1, order2 = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
        first = np.take_along_axis(first, order1, axis=1)
        second = np.hstack([np.take_along_axis(second, order2, axis=1), np.full((m, 1), np.inf)])
        turn = np.zeros(first.shape, np.int64)
        ahead = first + second[:, :1]
        left, out = np.arange(m), [[], []]
        while left.size:
            near = ahead.argmin(axis=1)
            at = np.arange(left.size)
            left, near, keep = left[k := ahead[at, near] <= self.radius], near[k], np.flatnonzero(k)
            ahead, turn = ahead[keep], turn[keep]
            at = np.arange(left.size)
            cell = order1[left, near] * width + order2[left, turn[at, near]]
            above = cell > home[left]
            out[0].append(left[above])
            out[1].append(cell[above])
            turn[at, near] += 1
            ahead[at, near] = first[left, near] + second[left, turn[at, near]]
        return home, *(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _turned(rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and each of them turned by the whole angle of a link in random directions."""
    rng = np.random.default_rng(0)
    a = np.repeat(rows, TURNS, axis=0)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, size, out=np.zeros_like(side), where=size > 0)
    return a, threshold * a + np.sqrt(1 - threshold**2) * side


def _asked(index: Index, queries: np.ndarray, labels: np.ndarray, keys: np.ndarray, threshold: float, full: float) -> Callable:
    """Links of the sampled rows with all rows, by the radius at which they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(queries), BINS + 1), np.int64)
        for batch in batches:
            for at, rows in matrices(batch.column(2)):
                if rows.shape[1] != index.d:
                    continue
                some, rows = units(rows)
                at = pa.array(at[some])
                key, label = (batch.column(c).take(at).to_numpy(zero_copy_only=False) for c in (0, 1))
                i, j = np.nonzero((queries @ rows.T >= threshold) & (labels[:, None] == label) & (keys[:, None] != key))
                if i.size:
                    share = np.ceil(index.needed(queries[i], rows[j]) / full * BINS).astype(np.int64)
                    np.add.at(counts, (i, np.minimum(share, BINS)), 1)
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(counts[i, j])], ["query", "bin", "n"])

    return run


def fitted(vertices: DataFrame, threshold: float = 0.98, recall: float = 0.999) -> Index | None:
    """The index of (key, label, embedding): codes and radius from bounded samples. None without a usable vector."""
    common = (
        vertices.groupBy(F.size("embedding").alias("d"), "label").count().groupBy("d")
        .agg(F.sum("count").alias("n"), F.max("count").alias("crowd")).orderBy(F.desc("n"), F.desc("d")).first()
    )
    if common is None:
        return None
    d, own = common["d"], vertices.where(F.size("embedding") == common["d"])
    order = F.xxhash64("key", "label", "embedding")
    thin = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(max(1, common["n"] // (2 * SAMPLE)))) == 0
    sample = own.where(thin).orderBy(order, "key").limit(SAMPLE).toArrow()  # bounded by SAMPLE rows
    rows = np.concatenate([np.zeros((0, d))] + [r for chunk in sample.column("embedding").chunks for _, r in matrices(chunk)])
    _, rows = units(rows)
    if not len(rows):
        return None
    codes = int(np.clip(round((common["crowd"] / PER_CELL) ** 0.5), 1, MOST_CODES))
    full = 2 - 2 * threshold + 1e-9
    index = Index(d, (codebook(rows[:, : d // 2], codes), codebook(rows[:, d // 2 :], codes)), full, 1.0)
    if len(index.books[0]) * len(index.books[1]) == 1 or recall >= 1:
        return index
    some = rows[:QUERIES]
    radius = float(np.quantile(index.needed(*_turned(some, threshold)), recall, method="higher"))
    head = sample.slice(0, QUERIES)  # the sample's vectors are all usable, so its rows are those of the matrix
    keys, labels = (head.column(c).to_numpy() for c in ("key", "label"))
    run = _asked(index, some, labels, keys, threshold, full)
    seen = arrow(own.select("key", "label", "embedding"), run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(some), BINS + 1))
    for row in seen:  # QUERIES * BINS rows at most
        counts[row["query"], row["bin"]] = row["n"]
    counts = counts[counts.sum(axis=1) > 0].cumsum(axis=1)
    if not len(counts):
        return Index(d, index.books, min(radius, full), None)
    reached = np.minimum(counts.sum(axis=0) / counts[:, -1].sum(), (counts / counts[:, -1:]).mean(axis=0))  # of links, of rows
    radius = min(max(radius, np.argmax(reached >= recall) / BINS * full), full)
    return Index(d, index.books, radius, float(reached[min(int(radius / full * BINS), BINS)]))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with, by way of others or not."""
    root = np.arange(n)
    while u.size:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _filed(index: Index | None) -> Callable:
    """Every vertex with its length, home cell and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch.column(3)):
                some, unit = units(rows)
                at, m = pa.array(at[some]), int(some.sum())
                home, visits = np.zeros(m, np.int64), pa.array([[]] * m, pa.list_(pa.int64()))
                if index is not None and rows.shape[1] == index.d:
                    home, row, cell = index.visits(unit)
                    row, cell = row[o := row.argsort(kind="stable")], cell[o]
                    ends = np.searchsorted(row, np.arange(m + 1)).astype(np.int32)
                    visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell))
                key, copies, label, vector = (batch.column(c).take(at) for c in range(4))
                d = pa.array(np.full(m, rows.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([key, copies, label, d, pa.array(home), visits, vector], FILED_NAMES)

    return run


FILED = "key long, copies long, label long, d int, home long, visits array<bigint>, embedding {vector}"
FILED_NAMES = ["key", "copies", "label", "d", "home", "visits", "embedding"]
FOUND = "u long, v long, n long"


def _met(threshold: float) -> Callable:
    """One block of a cell: its slice of members against each other, or against another slice and visitors."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        copies = table.column("copies").to_numpy()
        left = table.column("side").to_numpy() == 0
        vectors = table.column("embedding").combine_chunks()
        unit = units(next(matrices(vectors))[1])[1]  # one length, all usable
        a = np.flatnonzero(left)
        inner = table.column("first")[0].as_py() == table.column("second")[0].as_py()
        b = np.r_[a, np.flatnonzero(~left)] if inner else np.flatnonzero(~left)
        count, ends = np.zeros(len(key), np.int64), []
        for i in range(0, a.size, TILE):
            for j in range(0, b.size, 4 * TILE):
                p, q = a[i : i + TILE], b[j : j + 4 * TILE]
                near = unit[p] @ unit[q].T >= threshold
                if inner and j <= i + TILE:  # members come first in b, in the order of a: those behind only
                    near &= np.arange(j, j + q.size) > np.arange(i, i + p.size)[:, None]
                x, y = np.nonzero(near)
                if not x.size:
                    continue
                x, y = p[x], q[y]
                count += np.bincount(x, copies[y], len(key)).astype(np.int64) + np.bincount(y, copies[x], len(key)).astype(np.int64)
                root = forest(x, y, len(key))
                ends.append(np.stack([np.arange(len(key)), root])[:, root != np.arange(len(key))])
        u, v = np.hstack(ends) if ends else np.zeros((2, 0), np.int64)
        root = forest(u, v, len(key))
        tied, linked = np.flatnonzero(root != np.arange(len(key))), np.flatnonzero(count)
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table(
            {
                "u": pa.concat_arrays([pa.array(key[linked]), pa.array(key[tied])]),
                "v": pa.concat_arrays([none(linked.size), pa.array(key[root[tied]])]),
                "n": pa.concat_arrays([pa.array(count[linked]), none(tied.size)]),
            }
        )

    return run


def _blocks(filed: DataFrame) -> DataFrame:
    """Members and visitors of every cell, dealt over the pairs of its slices."""
    place = ["label", "d", "cell"]
    cells = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(0).alias("side"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(1).alias("side"))))
    light = filed.select("label", "d", F.explode(cells).alias("c")).select("label", "d", "c.cell")
    crowded = written(light.groupBy(*place).count().where(F.col("count") > SLICE).select(*place, F.ceil(F.col("count") / SLICE).cast("int").alias("slices")), "crowded")
    dealt = filed.select("label", "d", "key", "copies", "embedding", F.explode(cells).alias("c")).select("label", "d", "c.*", "key", "copies", "embedding")
    dealt = dealt.join(crowded, place, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    as_left = F.transform(every, lambda o: F.struct(F.col("own").alias("first"), o.alias("second"), F.lit(0).alias("side")))
    before = F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    as_right = lambda firsts: F.transform(firsts, lambda o: F.struct(o.alias("first"), F.col("own").alias("second"), F.lit(1).alias("side")))
    pairs = F.when(F.col("side") == 0, F.concat(as_left, as_right(before))).otherwise(as_right(every))
    out = dealt.withColumn("own", own).withColumn("pair", F.explode(pairs))
    return out.select(*place, "pair.first", "pair.second", "pair.side", "key", "copies", "embedding")


def linked(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, recall: float = 0.999) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = rows.sparkSession
    kind = rows.schema[vector].dataType.simpleString()
    named = rows.select(
        F.monotonically_increasing_id().alias("key"), F.col(id).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("embedding")
    )
    named = written(named.withColumn("hash", F.xxhash64("label", "embedding")), "vectors")
    usable = named.where("label IS NOT NULL AND size(embedding) > 0")
    # Only rows that share a hash can be equal; all others are vertices as they are. Written, so that the planner knows
    # how few there are and leaves the other rows where they lie.
    shared = written(usable.groupBy("hash").count().where("count > 1").select("hash"), "shared")
    alike = usable.join(shared, "hash", "left_semi").select("key", "label", "embedding")
    same = alike.groupBy("label", "embedding").agg(F.min("key").alias("vertex"), F.count(F.lit(1)).alias("copies"))
    same = written(same, "copies")
    repeated = same.where("copies > 1")
    members = written(alike.join(repeated, ["label", "embedding"]).select("key", "vertex", "copies"), "members")
    single = usable.join(shared, "hash", "left_anti").select("key", F.lit(1).cast("long").alias("copies"), "label", "embedding")
    vertices = single.union(same.select("vertex", "copies", "label", "embedding"))

    index = fitted(vertices.select("key", "label", "embedding"), threshold, recall)
    filed = written(arrow(vertices, _filed(index), FILED.format(vector=kind)), "filed")
    able = written(filed.where("copies > 1").select(F.col("key").alias("vertex")), "able")  # a class of zeros links with nothing
    blocks = _blocks(filed).groupBy("label", "d", "cell", "first", "second")
    found = written(blocks.applyInArrow(_met(threshold), FOUND), "links")
    dropped(filed, same)
    groups = components(found.where("v IS NOT NULL").select("u", "v"), "components")
    counts = found.where("n IS NOT NULL").groupBy(F.col("u").alias("vertex")).agg(F.sum("n").alias("others"))
    return _named(named.select("key", "vec_id"), members.join(able, "vertex", "left_semi"), counts, groups)


def _named(rows: DataFrame, members: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    vertex = F.coalesce("vertex", "key")
    filed = rows.join(members, "key", "left").select("key", "vec_id", vertex.alias("vertex"), F.coalesce("copies", F.lit(1)).alias("copies"))
    filed = filed.join(counts, "vertex", "left").join(groups, "vertex", "left")
    filed = filed.select(
        "key", "vec_id", F.coalesce("component", "vertex").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    filed = written(filed, "named")
    least = filed.where("n_links > 0").groupBy("component").agg(F.min("vec_id").alias("least"))
    named = filed.join(least, "component", "left")
    component = F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("vec_id"))
    return named.select("vec_id", "n_links", component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
