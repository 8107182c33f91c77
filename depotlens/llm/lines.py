"""Line dedup by a deletion-neighbourhood join: of lines within an edit of each other only the earliest stays.

A line is dropped if the table holds an equal line, or one within the edit bound, further ahead; ahead means a smaller
doc_id, or an earlier place in the same document. Edits are insertions, deletions and replacements of one character.
Lines shorter than ``least_chars`` are compared for equality only, as one edit may change their meaning, and lines
without a word always stay.

Equal lines are grouped by a 128-bit hash. Of the distinct lines those can only be within one edit that share their
first or last half with a line of fitting length; these are fetched, and every variant with one character deleted is
emitted as a hashed key. Two lines are within one edit if one is a variant of the other (insertion, deletion) or if
both lose the character at the same place and are equal then (replacement). Under each key every line needs to meet
its earliest member only, so a mass of similar lines costs one comparison each. The edit distance of the pairs that
meet is verified on the lines themselves.

Nulls and empties: a null text has no lines and stays null, an empty text stays empty. Rows that repeat a doc_id share
their places: a line stays if its place is kept in any of them, so equal rows keep the same lines. Rows without doc_id
stand after all others and repeat one missing id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textops
from .common import WORD, apart, arrow, bloom_filter, dropped, in_pieces, sifted, written

LAST = (1 << 63) - 1  # stands for a missing doc_id in the order
_SECOND = np.uint64(0xD1342543DE82EF95)


def _line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every line of every row, and its row; a row of n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    rows_of = np.searchsorted(offsets, feeds, side="right") - 1
    begins = np.concatenate([offsets[:-1], feeds + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), rows_of])
    order = np.lexsort((begins, rows))
    begins, rows = begins[order], rows[order]
    last = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last, offsets[rows + 1], np.append(begins[1:] - 1, 0))
    return begins, ends, rows


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line with a word: its hashes, its length in characters, hashes of its halves, and where it stands."""
    names = ["h1", "h2", "chars", "even_head", "even_tail", "odd_head", "odd_tail", "doc", "place"]
    for piece in in_pieces(batches, "text"):
        data, offsets = textops.text_bytes(piece.column(1))
        begins, ends, rows = _line_ends(data, offsets)
        firsts = np.searchsorted(rows, np.arange(len(piece)))
        places = np.arange(len(rows)) - firsts[rows]
        ink = np.concatenate([[0], np.cumsum(~textops.IS_SPACE[data])])
        real = ink[ends] > ink[begins]
        begins, ends, rows, places = begins[real], ends[real], rows[real], places[real]
        sums, inverse = textops.running(data)
        whole = textops.piece_hash(sums, inverse, begins, ends)
        # Characters begin at bytes that don't continue one; halves are cut between characters.
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(starts, begins)
        count = np.searchsorted(starts, ends) - first
        at = np.append(starts, len(data))
        halves = []
        for length in (count, np.maximum(count - 1, 0)):  # its own length, and that of a line one character shorter
            half = length // 2
            head = textops.piece_hash(sums, inverse, begins, at[first + half])
            tail = textops.piece_hash(sums, inverse, at[first + count - half], ends)
            halves += [textops.mixed(h + length.astype(np.uint64) * _SECOND + np.uint64(k)).view(np.int64) for k, h in ((1, head), (2, tail))]
        ids = piece.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)[rows]
        size = (ends - begins).astype(np.uint64)
        columns = [textops.mixed(whole + size).view(np.int64), textops.mixed(whole * _SECOND + size).view(np.int64), count, *halves, ids, places]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, place, line, head, tail = [], [], [], [], []
        for i, text, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines = (text or "").split("\n")
            for p in places:
                if p["place"] < len(lines):
                    doc.append(i), place.append(p["place"]), line.append(lines[p["place"]])
                    head.append(p["head"]), tail.append(p["tail"])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        columns = [pa.array(c, kind) for c, kind in zip((doc, place, line, head, tail), kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "place", "line", "head", "tail"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line one key for itself (cut -1) and one for each deleted character that may be where a candidate differs.

    Lines that share their first half differ behind it, and the other way round; with both shared, anywhere.
    """
    for piece in in_pieces(batches, "line", 200_000):
        data, offsets = textops.text_bytes(piece.column(2))
        sums, inverse = textops.running(data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        row = np.searchsorted(offsets, starts, side="right") - 1
        after = np.append(starts[1:], len(data))
        begin, end = offsets[row], offsets[row + 1]
        width = after - starts
        at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(piece)))[row]
        chars = np.bincount(row, minlength=len(piece))[row]
        head, tail = (piece.column(k).to_numpy(zero_copy_only=False)[row] for k in (3, 4))
        half = (chars - 1) // 2
        meant = (head & (at >= half)) | (tail & (at < chars - half))
        starts, row, after, at = starts[meant], row[meant], after[meant], at[meant]
        begin, end, width = begin[meant], end[meant], width[meant]
        # What follows the deleted character moves ahead by its bytes.
        moved = (sums[end] - sums[after]) * inverse[begin] * inverse[width]
        shorter = textops.piece_hash(sums, inverse, begin, starts) + moved
        size = (end - begin - width).astype(np.uint64)
        own = textops.piece_hash(sums, inverse, offsets[:-1], offsets[1:])
        key = textops.mixed(np.concatenate([own + np.diff(offsets).astype(np.uint64), shorter + size])).view(np.int64)
        cut = np.concatenate([np.full(len(piece), -1), at]).astype(np.int32)
        take = pa.array(np.concatenate([np.arange(len(piece)), row]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(cut), piece.column(0).take(take), piece.column(1).take(take)], ["key", "cut", "doc", "place"]
        )


_UNIT = 1 << 32  # more lines than any text has


def _spot() -> Column:
    """Where a line stands, as one number: a minimum of it needs no sort, as one of a pair would."""
    doc = F.col("doc").cast("decimal(20,0)")
    return (doc * F.lit(_UNIT).cast("decimal(11,0)") + F.col("place").cast("decimal(11,0)")).cast("decimal(38,0)")


def _doc_and_place(spot: str) -> dict[str, Column]:
    unit = F.lit(_UNIT).cast("decimal(38,0)")
    return {"doc": F.floor(F.col(spot) / unit).cast("long"), "place": F.pmod(F.col(spot), unit).cast("long")}


def distinct_lines(docs: DataFrame) -> DataFrame:
    """Every distinct line with a word: where it stands first, its length and the hashes of its halves."""
    halves = ["even_head", "even_tail", "odd_head", "odd_tail"]
    columns = f"h1 long, h2 long, chars long, {', '.join(f'{h} long' for h in halves)}, doc long, place long"
    every = arrow(docs.select("doc_id", "text"), _line_hashes, columns).withColumn("spot", _spot())
    same = [F.min(c).alias(c) for c in ("chars", *halves)]
    return every.groupBy("h1", "h2").agg(F.min("spot").alias("spot"), *same).drop("h1", "h2")


def near_lines(lines: DataFrame, texts: DataFrame, least_chars: int) -> DataFrame:
    """``spot`` of the distinct ``lines`` that have an earlier line within one edit."""
    keys = [F.struct(F.col(f"{n}_{end}").alias("key"), F.lit(end == "head").alias("head")) for n in ("even", "odd") for end in ("head", "tail")]
    met = lines.where(F.col("chars") >= least_chars).select("spot", F.explode(F.array(*keys)).alias("k")).select("spot", "k.*")
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = met.join(shared.hint("shuffle_hash"), "key", "left_semi").groupBy("spot")
    wanted = wanted.agg(F.bool_or("head").alias("head"), F.bool_or(~F.col("head")).alias("tail"))
    wanted = written(wanted.select(*[c.alias(n) for n, c in _doc_and_place("spot").items()], "head", "tail"), "lines-wanted")
    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("place", "head", "tail")).alias("places"))
    with_order = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
    some = sifted(with_order, bloom_filter(wanted.select("doc"))).join(apart(places), "doc").select("doc", "text", "places")
    near = written(arrow(some, _wanted_lines, "doc long, place long, line string, head boolean, tail boolean"), "lines-near")
    # Made twice from the written lines: they take far less room than their variants.
    variants = arrow(near, _variants, "key long, cut int, doc long, place long").select("key", "cut", _spot().alias("spot"))
    # Under a key: the line that is the key itself, the earliest of those cut down to it, and the earliest per place cut.
    per_cut = variants.groupBy("key", "cut").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))
    whole, part = F.when(F.col("cut") < 0, F.col("first")), F.when(F.col("cut") >= 0, F.col("first"))
    per_key = per_cut.groupBy("key").agg(F.min(whole).alias("whole"), F.min(part).alias("part"), F.sum("n").alias("n"))
    firsts = per_cut.drop("n").join(per_key.where("n > 1").drop("n"), "key")
    earlier = F.when(F.col("cut") < 0, F.array("part")).otherwise(F.array("first", "whole"))
    pairs = variants.join(firsts.hint("shuffle_hash"), ["key", "cut"]).select("spot", F.explode(earlier).alias("other"))
    pairs = pairs.where("other < spot").distinct()
    at = near.select(_spot().alias("spot"), "line")
    checked = pairs.join(at, "spot").join(at.select(F.col("spot").alias("other"), F.col("line").alias("earlier")), "other")
    found = written(checked.where(F.levenshtein("line", "earlier", 1) >= 0).select("spot").distinct(), "lines-dropped")
    dropped(wanted, near)
    return found


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the text of its kept lines; lines without a word stay where they are."""
    for batch in batches:
        out, total, left = [], [], []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text is None:
                out.append(None), total.append(0), left.append(0)
                continue
            lines, stay = text.split("\n"), set(places or ())
            keep = [x for p, x in enumerate(lines) if p in stay or not x.strip(" \t\x0b\x0c\r")]
            out.append("\n".join(keep)), total.append(len(lines)), left.append(len(keep))
        columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(left, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["own", "text", "kept_text", "n_lines", "n_kept"])


def deduplicated(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """``own`` (the row's columns but its text), ``text``, ``kept_text``, ``n_lines``, ``n_kept`` of every row of ``docs``."""
    texts = docs.select("doc_id", "text")
    lines = written(distinct_lines(texts), "lines")
    kept = lines.select("spot").join(near_lines(lines, texts, least_chars), "spot", "left_anti").select(
        *[c.alias(n) for n, c in _doc_and_place("spot").items()]
    )
    places = kept.groupBy("doc").agg(F.collect_list("place").alias("places"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own")
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), own, "text")
    joined = rows.join(places, "doc", "left").select("own", "text", "places")
    counted = [StructField("kept_text", StringType()), StructField("n_lines", LongType()), StructField("n_kept", LongType())]
    return arrow(joined, _without, StructType([*joined.schema.fields[:2], *counted]))


def without_repeats(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """``docs`` with the kept lines as text and, where there is such a column, its length as ``n_chars``.

    Documents that lose all their words go; those that had none before stay.
    """
    out = deduplicated(docs, least_chars)
    word = lambda c: F.coalesce(F.col(c).rlike(WORD), F.lit(False))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [new[c].alias(c) if c in new else F.col("own")[c].alias(c) for c in docs.columns]
    return out.where(word("kept_text") | ~word("text")).select(*columns)
