"""Hard negatives: exact inner products by Strassen's recursion on int64 tiles, kept in mergeable heaps.

A set of anchors meets all rows, in blocks. Rows are dealt over blocks by a hash; a block of bounded size is held by one
task, and the anchors stream past it in batches. Within a task, tiles of anchors and candidates are multiplied by
Strassen's seven products, padded with zeros to even sizes; all additions are integer additions, so scores are exact.
Every tile is merged into the heap of its anchor, every block's heaps into those of the whole table (a window limit,
which Spark applies before and after the shuffle). The first pass finds each anchor's best rows of its own label, the
second the best rows of other labels whose score lies in the window below each of those.

Defined results: rows with a null label, id or vector, an empty vector, or a null or non-finite component take no part.
Vectors of different lengths are not compared. Rows are told apart even if they share an id: ties go to the smaller id,
then to the earlier row, and an anchor is never its own positive, but an equal row is. Scores beyond a long wrap around.
An empty table, or no anchors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow, dropped, written
from .vectors import lists, longs, matrices

LEAF = 32
ANCHOR_TILE, CANDIDATE_TILE = 512, 2_048
BLOCK_CELLS = 1 << 25  # numbers of one block of candidates
LOWEST = np.iinfo(np.int64).min


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product. Doubles hold integers below 2^53 exactly, and multiply them faster."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    rows, columns = a.shape[0] % 2, a.shape[1] % 2
    return np.pad(a, ((0, rows), (0, columns))) if rows or columns else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of their quarters, down to ``leaf``."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return _leaf(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:rows, :columns]


class Heaps:
    """The first ``most`` entries of each of ``n`` heaps: highest score, then smallest id, then earliest row."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.at, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.bar = np.full(n, LOWEST)  # below it nothing gets in

    def merge(self, at: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not at.size:
            return
        at, score = np.concatenate([self.at, at]), np.concatenate([self.score, score])
        id, row = np.concatenate([self.id, id]), np.concatenate([self.row, row])
        order = np.lexsort((row, id, ~score, at))
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(at.size) - np.repeat(first, np.diff(np.r_[first, at.size]))
        keep = order[rank < self.most]
        full = order[rank == self.most - 1]
        self.bar[at[rank == self.most - 1]] = score[full]
        self.at, self.score, self.id, self.row = at[rank < self.most], score[keep], id[keep], row[keep]


def _integers(factor: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch.column(1)):
                x = np.floor(factor * rows)
                x = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64) + np.where(x >= 2.0**63, np.iinfo(np.int64).max, 0) + np.where(x <= -(2.0**63), LOWEST, 0)
                id, label, anchor = (batch.column(i).take(pa.array(at)) for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays([id, label, anchor, lists(x, pa.int64())], ["id", "label", "anchor", "x"])

    return run


def _met(work: Callable, names: list[str]) -> Callable:
    """Rows sorted by block, candidates before anchors: holds the candidates of one block, hands each batch of anchors on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                piece, key = batch.slice(begin, end - begin), tuple(keys[:2, begin])
                if key != block:
                    block, parts, held = key, [], None
                x = longs(piece.column(6))
                ids = [piece.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)]
                if keys[2, begin] == 0:
                    small = np.abs(x).max(initial=0) < 2**31
                    parts.append((x.astype(np.int32) if small else x, *ids))
                    continue
                if held is None:
                    held = [np.concatenate(p) for p in zip(*parts)] if parts else None
                    parts = []
                if held is None:
                    continue
                for i in range(0, len(x), ANCHOR_TILE):
                    cut = slice(i, i + ANCHOR_TILE)
                    more = [piece.column(j).slice(i, ANCHOR_TILE) for j in range(7, piece.num_columns)]
                    found = work(x[cut], *(a[cut] for a in ids), held, *more)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return run


def _tiles(x: np.ndarray, held: list[np.ndarray]) -> Iterator[tuple]:
    """Scores of a tile of anchors with every tile of the candidates, and those candidates' id, label and row."""
    for j in range(0, len(held[0]), CANDIDATE_TILE):
        c, id, label, row = (a[j : j + CANDIDATE_TILE] for a in held)
        yield strassen(x, np.ascontiguousarray(c.astype(np.int64).T)), id, label, row


def _positives(most: int) -> Callable:
    def work(x, id, label, row, held):
        best = Heaps(len(x), most)
        for score, c_id, c_label, c_row in _tiles(x, held):
            fits = (score >= best.bar[:, None]) & (label[:, None] == c_label) & (row[:, None] != c_row)
            i, j = np.nonzero(fits)
            best.merge(i, score[i, j], c_id[j], c_row[j])
        return row[best.at], best.score, best.id, best.row

    return work


def _window(most: int, low: int, high: int) -> Callable:
    def work(x, id, label, row, held, positives):
        ends = positives.value_lengths().to_numpy(zero_copy_only=False)
        wanted = positives.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(len(x)), ends)  # one heap per anchor and positive
        place = np.arange(at.size) - np.repeat(np.cumsum(ends) - ends, ends)
        floor = -((-wanted // 100) * low + (-wanted % 100) * low // 100)  # least n with low * p <= 100 * n
        ceiling = (wanted // 100) * high + (wanted % 100) * high // 100
        best = Heaps(at.size, most)
        for score, c_id, c_label, c_row in _tiles(x, held):
            other = label[:, None] != c_label
            for k in range(int(ends.max(initial=0))):
                heap = np.flatnonzero(place == k)
                s = score[at[heap]]
                bottom = np.maximum(floor[heap], best.bar[heap])
                i, j = np.nonzero((s <= ceiling[heap][:, None]) & (s >= bottom[:, None]) & other[at[heap]])
                best.merge(heap[i], s[i, j], c_id[j], c_row[j])
        return row[at[best.at]], place[best.at].astype(np.int32), best.score, best.id, best.row

    return work


def _first(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The merged heaps of all blocks, with the place of each entry from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _passed(rows: DataFrame, anchors: DataFrame, blocks: int, work: Callable, schema: str) -> DataFrame:
    """``work`` on every batch of anchors and block of rows of the same length of vector."""
    shape = [F.size("x").alias("d"), F.col("block"), F.col("kind"), "id", "label", "row", "x"]
    extra = [c for c in anchors.columns if c not in rows.columns]
    none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    candidates = rows.withColumns({"block": block, "kind": F.lit(0)}).select(*shape, *none)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = anchors.withColumns({"block": every, "kind": F.lit(1)}).select(*shape, *extra)
    dealt = candidates.union(asked).repartition("d", "block").sortWithinPartitions("d", "block", "kind", "id", "row")
    return arrow(dealt, _met(work, [f.split()[0] for f in schema.split(", ")]), schema)


def mined(
    rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    factor: float = 256.0, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other
    labels whose score is between ``window`` percent of the positive's score. ``label`` must be a whole number."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    whole = arrow(kept, _integers(factor), "id long, label long, anchor boolean, x array<bigint>")
    whole = written(whole.withColumn("row", F.monotonically_increasing_id()), "integers")
    n, widest = whole.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    held = max(1, BLOCK_CELLS // (widest or 1))
    blocks = max(-(-n // held), min(-(-n // 4_096), 2 * spark.sparkContext.defaultParallelism), 1)
    table, anchors = whole.drop("anchor"), whole.where("anchor").drop("anchor")

    found = _passed(table, anchors, blocks, _positives(positives), "anchor_row long, score long, id long, row long")
    best = written(_first(found, ["anchor_row"], positives), "positives")
    lists_of = best.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = anchors.join(lists_of.select(F.col("anchor_row").alias("row"), F.col("p.score").alias("p")), "row")
    schema = "anchor_row long, place int, score long, id long, row long"
    found = _passed(table, asked.select(*table.columns, "p"), blocks, _window(negatives, *window), schema)
    hard = _first(found, ["anchor_row", "place"], negatives).select(
        "anchor_row", F.col("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    pairs = best.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return hard.join(pairs, ["anchor_row", "place"]).join(named, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
