"""Improbable-feature digests of whole texts, and how alike two digests are.

Every window of ``WINDOW`` bytes has an entropy; over all documents some entropies are common and some are rare. Within
each run of windows the rarest one wins a vote, the leftmost of equals, and windows with enough votes are the features
of the text. Features are hashed into Bloom filters, one after another as each fills up. Two digests are compared
filter by filter: the bits in common, less what chance gives, over the most that could be common; each filter of the
shorter digest counts with its best partner and by its number of bits.

``neighbours`` also compares every document with its own edited text and with the next document in order of doc_id.
Documents are dealt by ranges of doc_id, sorted within a range and streamed; the first document of a range is sent to
the range before as well, so a range needs no other.

Nulls and empties: a null text counts as empty; empty texts have one common digest. Rows without doc_id come first.
Rows that repeat a doc_id are ordered by the hash of their text. A table of one row is its own next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops
from .common import arrow, in_pieces

WINDOW = 32  # bytes of a feature, and features of a run
LEAD = 28  # empty bytes before a text, so that short texts have several windows
VOTES = 6  # that make a window a feature
BINS = 1024
FILTER_BITS = 2048
PER_FILTER = 160  # features
HASHES = 5
CHANCE = 0.3  # of the way from chance to the most is no likeness yet

_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_SUM = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * (1 << 12)).astype(np.int64)  # of c log c
_STEP = np.concatenate([[0], np.diff(_SUM)])
_ONCE = np.arange(WINDOW, dtype=np.int64)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with room between them; where each begins, and its number of windows."""
    room = [max(WINDOW, LEAD + len(t)) for t in texts]
    begins = np.cumsum([WINDOW] + [r + 1 for r in room])
    data = b"".join([bytes(WINDOW), *[bytes(LEAD) + t + bytes(r - LEAD - len(t) + 1) for t, r in zip(texts, room)], bytes(WINDOW)])
    return np.frombuffer(data, np.uint8), begins[:-1], np.array(room) - WINDOW + 1


def _entropy_bins(x: np.ndarray) -> np.ndarray:
    """The entropy of every window of the array as a bin; a window that slides by one byte loses one and gains one."""
    ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int(_SUM[np.bincount(x[:WINDOW])].sum())
    total = np.cumsum(np.concatenate([[first], _STEP[behind[WINDOW:]] - _STEP[ahead[: len(x) - WINDOW]]]))
    return (total * (BINS - 1)) // int(_SUM[WINDOW])


def _valid(n: int, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int8)
    edge[begins] += 1
    edge[begins + counts] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, np.int64)
    for piece in in_pieces(batches, "text", 500_000):
        x, begins, windows = _laid_out([(t or "").encode() for t in piece.column(0).to_pylist()])
        bins = _entropy_bins(x)
        counts += np.bincount(bins[_valid(len(bins), begins, windows)], minlength=BINS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(counts)], ["bin", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Per entropy bin its rank over the windows of all documents, the rarest first."""
    counts = arrow(docs.select("text"), _histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(BINS, np.int64)
    n[counts["bin"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(BINS, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(BINS)
    return rank


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of every text, as rows of 64-bit words."""
    x, begins, windows = _laid_out(texts)
    bins = _entropy_bins(x)
    n = len(bins)
    wide = np.int64 if n >= 1 << 20 else np.int32
    place_bits = max(1, int(n).bit_length())
    key = (rank[bins] << place_bits).astype(np.int64) | np.arange(n)
    never = np.int64(BINS << place_bits)
    key[~_valid(n, begins, windows)] = never
    key = key.astype(wide) if BINS << place_bits < 1 << 31 else key
    reach = 1
    while reach < WINDOW:  # the least of a run, by runs of half its length
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    won = key[key < never] & ((1 << place_bits) - 1)
    features = np.flatnonzero(np.bincount(won, minlength=n) >= VOTES)
    owner = np.searchsorted(begins, features, side="right") - 1
    words = np.ascontiguousarray(x[features[:, None] + _ONCE]).view(np.uint64)
    hashed = np.zeros(len(features), np.uint64)
    for k in range(words.shape[1]):
        hashed = textops.mixed(hashed + words[:, k])
    number = np.arange(len(features)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
    filters_of = -(-np.bincount(owner, minlength=len(texts)) // PER_FILTER)
    first = np.cumsum(filters_of) - filters_of
    row = first[owner] + number // PER_FILTER
    bits = np.zeros(int(filters_of.sum()) * FILTER_BITS, bool)
    for k in range(HASHES):
        bits[row * FILTER_BITS + ((hashed >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    filters = np.packbits(bits, bitorder="little").view(np.uint64).reshape(-1, FILTER_BITS // 64)
    return [filters[a : a + k] for a, k in zip(first.tolist(), filters_of.tolist())]


def written_out(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint64).reshape(-1, FILTER_BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0, no more in common than chance gives, to 1."""
    if len(a) > len(b):
        a, b = b, a
    own, other = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(own[i], other)
        floor = own[i] * other / FILTER_BITS
        floor += CHANCE * (most - floor)
        best[i] = max(0.0, float(((common - floor) / np.maximum(most - floor, 1e-9)).max()))
    return float(min(1.0, (best * own).sum() / own.sum()))


def _dealt(bounds: np.ndarray, firsts: dict[int, int]):
    """Every row with its range; a row that begins a range goes to the range before as well, marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.where(known, np.searchsorted(bounds, ids, side="right"), 0)
            marked = [(i, p) for i, (x, k) in enumerate(zip(ids.tolist(), known.tolist())) for p in firsts.get(x if k else None, ())]
            take = pa.array(np.concatenate([np.arange(len(ids)), np.array([i for i, _ in marked], np.int64)]))
            parts = np.concatenate([part, np.array([p for _, p in marked], np.int64)]).astype(np.int32)
            mark = np.concatenate([np.zeros(len(ids), bool), np.ones(len(marked), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts), pa.array(mark), batch.column(0).take(take), batch.column(1).take(take)], ["part", "guest", "doc_id", "text"]
            )

    return run


def _compared(rank: np.ndarray):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    def compared(group: list[tuple]) -> pa.RecordBatch:
        """Of rows in order all but the last, each with its next."""
        texts = [t or "" for _, _, _, t in group]
        edited = []
        for text, following in zip(texts, texts[1:]):
            swapped = len(text) // 4
            edited.append(text[: len(text) - swapped] + following[:swapped])
        as_bytes = [t.encode() for t in texts + edited]
        found = digests(as_bytes, rank)
        n = len(group) - 1
        own, new = found[: n + 1], found[n + 1 :]
        out = [
            (group[i][2], len(texts[i]), hashlib.sha256(as_bytes[n + 1 + i]).hexdigest(), written_out(own[i]), written_out(new[i]),
             likeness(own[i], new[i]), likeness(own[i], own[i + 1]))
            for i in range(n)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows(batches):
            if held and row[0] != held[-1][0]:  # another range in the same task
                if len(held) > 1:
                    yield compared(held)
                held, size = [], 0
            if held and held[-1][1]:
                continue  # the range has its guest already
            held.append(row)
            size += len(row[3] or "")
            if size > 500_000 and len(held) > 1:
                yield compared(held)
                held, size = held[-1:], len(row[3] or "")
        if len(held) > 1:
            yield compared(held)

    return run


def neighbours(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its digest, its edited text's, and how alike it is to that and to the next row."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    rank = rarity(texts)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n_parts for i in range(1, n_parts)]
    at = texts.agg(F.percentile_approx("doc_id", cuts or [0.5], 10_000).alias("cuts")).first()[0]
    bounds = np.unique(np.array(at or [], np.int64))
    # The first id of every range that has rows: as many numbers as partitions.
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.lit(bounds.tolist()).cast("array<long>"), lambda b: b <= F.col("doc_id"))))
    lowest = texts.groupBy(part.alias("part")).agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    order = sorted((r["part"], None if r["nulls"] else r["first"]) for r in lowest)
    firsts: dict[int | None, list[int]] = {}
    for (p, _), (_, following) in zip(order, order[1:] + order[:1]):
        firsts.setdefault(following, []).append(p)
    dealt = arrow(texts, _dealt(bounds, firsts), "part int, guest boolean, doc_id long, text string")
    sorted_ = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(
        "part", "guest", F.col("doc_id").asc_nulls_first(), F.sha2(F.coalesce("text", F.lit("")), 256)
    )
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow(sorted_, _compared(rank), columns)
