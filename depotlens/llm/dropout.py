"""SentencePiece encoding with seeded merge dropout, and decoding.

A vocabulary of merge type is applied as its own library applies it: all neighbouring pieces that make a piece together
wait in an agenda by rank, and the best is merged until none is left. With dropout a candidate that comes up is skipped
if a hash of the seed, the text around it and its place says so. The same seed gives the same pieces on every run and
every executor, another seed gives others, and every segmentation decodes to the text it came from.

No piece of the vocabulary holds certain neighbours, so a text may be cut there before merging. Every occurrence of a
chunk has draws of its own, hashed from the seed, its document and place, and the candidate. What a chunk becomes
depends on which steps of its agenda were skipped and on nothing else, so that is worked out once per worker for every
chunk and set of skipped steps that occurs; an occurrence goes from set to set until its draws skip no further step.
All work is done on arrays.

Nulls and empties: a null text has null ids and decodes to null; an empty text has no ids. Characters without a piece,
the word mark U+2581 among them, are spelled in bytes. Every row is encoded by itself, so ties and repeats agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from . import textops
from .common import arrow, in_pieces

MARK = "▁"  # stands for a space in the vocabulary
PIECE_BPE_32K = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = 1 << 30  # the rank of neighbours that make no piece
CACHED = 400_000  # chunks and sets of skipped steps that a worker remembers; then it starts anew
SHORT = 21  # characters of a chunk whose agenda has under 64 steps: one per neighbours and two per merge at most


@dataclass
class Vocabulary:
    """Pieces and their order of merging. Of the size of the vocabulary file."""

    ids: dict[str, int]
    pairs: np.ndarray = field(repr=False)  # two ids that make a piece together, the first shifted by 16 bits; sorted
    pair_ranks: np.ndarray = field(repr=False)
    by_rank: np.ndarray = field(repr=False)
    symbol: np.ndarray = field(repr=False)  # of every character: its id, or the character as a negative number
    byte_ids: list[int]
    spelled: list[bytes]  # what every id decodes to
    kind: np.ndarray = field(repr=False)  # of every character: its row in ``joined``, 0 for those in no longer piece
    joined: np.ndarray = field(repr=False)  # which neighbours occur in some piece


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file of merge type with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, score, spelled, byte_ids = {}, {}, [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            plain = piece.replace(MARK, " ")
            ids[plain], score[plain] = i, model.get_score(i)
            spelled.append(plain.encode())
    order = sorted(score, key=lambda p: -score[p])
    splits = ((p, r, k) for r, p in enumerate(order) for k in range(1, len(p)))
    pairs = {ids[p[:k]] << 16 | ids[p[k:]]: r for p, r, k in splits if p[:k] in ids and p[k:] in ids}
    at, ranks = (np.array(x) for x in zip(*sorted(pairs.items())))
    symbol = -np.arange(0x110000) - 1
    for p, i in ids.items():
        if len(p) == 1:
            symbol[ord(p)] = i
    longer = [p for p in ids if len(p) > 1]
    chars = sorted({c for p in longer for c in p})
    kind = np.zeros(0x110000, np.int16)
    for k, c in enumerate(chars, 1):
        kind[ord(c)] = k
    joined = np.zeros((len(chars) + 1,) * 2, bool)
    for p in longer:
        for a, b in zip(p, p[1:]):
            joined[kind[ord(a)], kind[ord(b)]] = True
    return Vocabulary(ids, at, ranks, np.array([ids[p] for p in order]), symbol, byte_ids, spelled, kind, joined)


def _flattened(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _skipped(keys: np.ndarray, ranks: np.ndarray, places: np.ndarray, below: int) -> np.ndarray:
    """The draws of candidates: a hash of the chunk's key, the merge and its place, under a limit of 32 bits."""
    drawn = keys ^ (ranks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (textops.mixed(drawn) >> np.uint64(32)) < below


def _ranks(left: np.ndarray, right: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    pair = left.astype(np.int64) << 16 | right
    at = np.minimum(np.searchsorted(vocab.pairs, pair), len(vocab.pairs) - 1)
    return np.where((vocab.pairs[at] == pair) & (left >= 0) & (right >= 0), vocab.pair_ranks[at], NEVER)


def merged(
    symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, vocab: Vocabulary, skip_below: int = 0, trace: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many chunks after all merges, and their number per chunk.

    All chunks take one step of their agenda at a time: the best rank, leftmost first, is merged or skipped. A skipped
    candidate is gone until a neighbour changes. Chunks whose agenda is empty leave. With ``trace`` the ``keys`` are the
    steps to skip, as bits, and every step's chunks, ranks and places are added to it.
    """
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joins = np.append(chunk[1:] == chunk[:-1], False)
    rank = np.full(len(symbols), NEVER)
    rank[joins] = _ranks(symbols[:-1][joins[:-1]], symbols[1:][joins[:-1]], vocab)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(symbols)))
        if (over := best == NEVER).any():
            gone = np.repeat(over, size)
            done.append((chunk[gone], symbols[gone]))
            symbols, chunk, place, rank = symbols[~gone], chunk[~gone], place[~gone], rank[~gone]
            best, size = best[~over], size[~over]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == np.repeat(best, size))
        hits = hits[np.append(True, chunk[hits[1:]] != chunk[hits[:-1]])]
        if trace is not None:
            skip = (keys[chunk[hits]] >> np.uint64(len(trace))) & np.uint64(1) > 0
            trace.append((chunk[hits], rank[hits], place[hits]))
            rank[hits[skip]] = NEVER
            hits = hits[~skip]
        elif skip_below:
            skip = _skipped(keys[chunk[hits]], rank[hits], place[hits], skip_below)
            rank[hits[skip]] = NEVER
            hits = hits[~skip]
        symbols[hits] = vocab.by_rank[rank[hits]]
        stays = np.ones(len(symbols), bool)
        stays[hits + 1] = False
        symbols, chunk, place, rank = symbols[stays], chunk[stays], place[stays], rank[stays]
        at = hits - np.arange(len(hits))
        at = np.unique(np.concatenate([at, at[at > 0] - 1]))
        joins = at + 1 < len(symbols)
        joins[joins] = chunk[at[joins]] == chunk[at[joins] + 1]
        changed = at[joins]
        # A pair whose parts are as before keeps its rank, also if it was skipped: only pairs beside a merge change.
        rank[at[~joins]] = NEVER
        beside = np.zeros(len(symbols) + 1, bool)
        beside[hits - np.arange(len(hits))] = True
        new = changed[beside[changed] | beside[changed + 1]]
        rank[new] = _ranks(symbols[new], symbols[new + 1], vocab)
    every, flat = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
    order = np.argsort(every, kind="stable")
    return flat[order], np.bincount(every, minlength=len(lengths))


def spelled_out(symbols: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece, which are negative characters, as the ids of their bytes."""
    odd = np.flatnonzero(symbols < 0)
    if not len(odd):
        return symbols, lengths
    wide = np.ones(len(symbols), np.int64)
    bytes_of = {c: [vocab.byte_ids[b] for b in chr(-c - 1).encode()] for c in np.unique(symbols[odd]).tolist()}
    wide[odd] = [len(bytes_of[c]) for c in symbols[odd].tolist()]
    out = np.repeat(symbols, wide)
    out[out < 0] = [b for c in symbols[odd].tolist() for b in bytes_of[c]]
    chunk = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(chunk, weights=wide, minlength=len(lengths)).astype(np.int64)


def _encoder(vocab: Vocabulary, key_column: int, seed: int, dropout: float):
    skip_below = int(dropout * (1 << 32))
    # Of every chunk with its skipped steps: key; starts and lengths of ids and of steps. Then ids, and ranks and places of steps.
    known = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]
    pools = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8)]

    def looked_up(keys: np.ndarray, points: np.ndarray, begins: np.ndarray, ends: np.ndarray, skips: np.ndarray) -> list[np.ndarray]:
        """Starts and lengths of the ids and the steps of distinct states (sorted keys), after the unknown are worked out."""
        at = np.searchsorted(known[0], keys)
        new = np.append(known[0], np.uint64(0))[at] != keys
        new |= at == len(known[0])
        if new.any():
            width, steps = (ends - begins)[new], []
            symbols, count = merged(vocab.symbol[_flattened(points, begins[new], width)], width, skips[new], vocab, trace=steps)
            ids, count = spelled_out(symbols, count, vocab)
            chunk, rank, place = (np.concatenate([s[i] for s in steps] or [np.zeros(0, np.int64)]) for i in range(3))
            order = np.argsort(chunk, kind="stable")
            taken = np.bincount(chunk, minlength=len(width))
            found = (keys[new], len(pools[0]) + np.cumsum(count) - count, count, len(pools[1]) + np.cumsum(taken) - taken, taken)
            for i, x in enumerate(found):
                known[i] = np.insert(known[i], at[new], x)
            for i, x in enumerate((ids, rank[order], place[order])):
                pools[i] = np.concatenate([pools[i], x.astype(pools[i].dtype)])
            at = np.searchsorted(known[0], keys)
        return [x[at] for x in known[1:]]

    def short(points: np.ndarray, begins: np.ndarray, ends: np.ndarray, chunks: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in the pool of the ids of every occurrence: ``chunks`` are hashes of the texts, ``drawn`` keys of the draws."""
        if len(known[0]) > CACHED:
            known[:], pools[:] = [x[:0].copy() for x in known], [x[:0].copy() for x in pools]
        starts, lengths = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        skips, now = np.zeros(len(begins), np.uint64), np.arange(len(begins))
        while len(now):
            states = textops.mixed(chunks[now] + textops.mixed(skips[now]) * np.uint64(0xD1342543DE82EF95))
            unique, first, again = np.unique(states, return_index=True, return_inverse=True)
            some = now[first]
            begin, count, step, steps = (x[again] for x in looked_up(unique, points, begins[some], ends[some], skips[some]))
            starts[now], lengths[now] = begin, count
            if not skip_below:
                break
            of = np.repeat(np.arange(len(now)), steps)
            number = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
            at = np.repeat(step, steps) + number
            hit = _skipped(drawn[now][of], pools[1][at], pools[2][at], skip_below)
            hit = np.flatnonzero(hit)
            hit = hit[(skips[now][of[hit]] >> number[hit].astype(np.uint64)) & np.uint64(1) == 0]
            hit = hit[np.append(True, of[hit[1:]] != of[hit[:-1]])] if len(hit) else hit
            now, bits = now[of[hit]], np.uint64(1) << number[hit].astype(np.uint64)
            skips[now] |= bits
        return starts, lengths

    def ids_of(texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and their number per row."""
        marked = [" " + t if t else "" for t in texts]
        joined = "".join(marked)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
        kind = vocab.kind[points]
        cut = np.empty(len(points), bool)
        cut[1:] = ~vocab.joined[kind[:-1], kind[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], len(points))
        rows = np.searchsorted(offsets, begins, side="right") - 1
        sums, inverse = textops.running_of(textops.mixed(points.astype(np.uint64) + np.uint64(seed)))
        chunk = textops.piece_hash(sums, inverse, begins, ends) + (ends - begins).astype(np.uint64)
        drawn = textops.mixed(keys[rows] + (begins - offsets[rows]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        starts, lengths = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        few = ends - begins <= SHORT
        starts[few], lengths[few] = short(points, begins[few], ends[few], chunk[few], drawn[few])
        pool = pools[0]
        if not few.all():  # long chunks seldom repeat: each is worked out with its own draws
            width = (ends - begins)[~few]
            symbols, count = merged(vocab.symbol[_flattened(points, begins[~few], width)], width, drawn[~few], vocab, skip_below)
            ids, count = spelled_out(symbols, count, vocab)
            starts[~few], lengths[~few] = len(pool) + np.cumsum(count) - count, count
            pool = np.concatenate([pool, ids.astype(np.int32)])
        counts = np.bincount(rows, weights=lengths, minlength=len(texts)).astype(np.int64)
        return _flattened(pool, starts, lengths), counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            text = piece.column(piece.schema.get_field_index("text"))
            given = piece.column(key_column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = textops.mixed(given.view(np.uint64) + np.uint64(seed))
            flat, counts = ids_of(text.to_pylist(), keys)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([*piece.columns, ids], [*piece.schema.names, "ids"])
        known[:], pools[:] = [x[:0].copy() for x in known], [x[:0].copy() for x in pools]  # nothing stays when the task ends

    return run


def decoded(ids: pa.ListArray, spelled: list[bytes]) -> list[str | None]:
    """The texts of rows of ids."""
    lengths = np.array([len(s) for s in spelled])
    pool = np.frombuffer(b"".join(spelled), np.uint8)
    flat = ids.flatten().to_numpy()
    data = _flattened(pool, (np.cumsum(lengths) - lengths)[flat], lengths[flat]).tobytes()
    per_row = np.concatenate([[0], np.cumsum(lengths[flat])])
    begin, out = 0, []
    for n, null in zip(ids.value_lengths().fill_null(0).to_pylist(), ids.is_null().to_pylist()):
        row = data[per_row[begin] : per_row[begin + n]]
        out.append(None if null else row[1:].decode())  # without the space that was put in front
        begin += n
    return out


def encoded(
    docs: DataFrame, path: str = PIECE_BPE_32K, seed: int = 20260, dropout: float = 0.1, key: str = "doc_id"
) -> DataFrame:
    """``docs`` (a column ``text`` and an integer ``key``) with the ids of its text."""
    plain = docs.drop("ids")
    run = _encoder(vocabulary(path), plain.columns.index(key), seed, dropout)
    return arrow(plain, run, StructType([*plain.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def round_trip(
    docs: DataFrame, path: str = PIECE_BPE_32K, seed: int = 20260, dropout: float = 0.1, key: str = "doc_id"
) -> DataFrame:
    """``encoded`` with ``lossless``: whether the ids of the row decode to its text."""
    plain = docs.drop("ids", "lossless")
    vocab = vocabulary(path)
    encode, text = _encoder(vocab, plain.columns.index(key), seed, dropout), plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            ids = batch.column(batch.num_columns - 1)
            same = [a == b for a, b in zip(decoded(ids, vocab.spelled), batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], [*batch.schema.names, "lossless"])

    more = [StructField("ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())]
    return arrow(plain, run, StructType([*plain.schema.fields, *more]))
