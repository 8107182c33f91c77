"""N-gram Jaccard join by signature trees: all documents whose shingle sets overlap by at least the threshold.

Documents with equal shingle sets are one class and are represented by their smallest doc_id. Classes meet under the
tokens (shingle hashes) that stand first in an order kept by all: two sets can only reach the threshold t if they share
k of their first n - ceil(t n) + k tokens, for the smaller of their k. A class that shares too few of its first tokens
with any other is out, which takes care of passages that documents have in common. Those that stay meet under their
first n - ceil(t n) + 1 tokens only, as the first token that two sets share is among these. A pair is followed under
that token only where enough tokens of both stand behind it (``rest``) to make up the overlap. The order puts tokens of
often hit counter slots last; the counters cover all documents and have a fixed number.

Under each token the classes form a signature tree: a leaf is a class with the bitmap of its tokens, a node the OR of
its children's bitmaps with the ranges of their sizes and of their component labels. First some rounds compare every
class with one class of its token, another in each round, and label components. Then pairs of nodes are taken apart
from the roots down, all tokens at once; a pair is given up when its sizes, its largest possible overlap or one common
component make further links between its documents impossible or needless. What remains are pairs of classes, whose
overlap is bounded once more by bitmaps that grow with the set, and which are then compared exactly. So a mass of near copies costs about one comparison each and round, and no link between
different components is lost.

Nulls and empties: a null or wordless text has an empty set and is linked with nothing. Rows that repeat a doc_id are
one document. A row without doc_id gets the component of the documents whose set it shares, null if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textops
from .common import apart, arrow, bloom_filter, components, contracted, dropped, in_pieces, perhaps_in, sifted, written

SLOTS = 1 << 18
MORE = 5  # percent of a set by which its first tokens are more than one shared token takes
ROUNDS = 3
LANES = 32  # longs of a bitmap: 2,048 bits
FAN = 16


def _bitmaps(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bitmap of every row's tokens, as longs."""
    width = LANES * 64
    bits = np.zeros(len(sizes) * width, bool)
    bits[np.repeat(np.arange(len(sizes)) * width, sizes) + (tokens & np.uint64(width - 1)).astype(np.int64)] = True
    lanes = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(lanes) + 1, LANES, dtype=np.int32)), pa.array(lanes))


def _wide_bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of at least four bits per token; its length is a power of two, so that a longer one folds onto it."""
    width = max(LANES * 64, 1 << (4 * len(tokens) - 1).bit_length()) if len(tokens) else LANES * 64
    bits = np.zeros(width, bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _set_hashes(every: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of every set, equal for equal sets wherever they stand; ``ends`` begins with 0."""
    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (
        textops.mixed(every + np.uint64(1)), textops.mixed(every * np.uint64(3) + np.uint64(7))))
    return [(x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in sums]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its size, set hash and bitmaps; at the end of the task the counts of token slots."""
    slots = np.zeros(SLOTS, np.int64)
    names = ["kind", "a", "b", "c", "d", "bits", "wide"]
    for piece in in_pieces(batches, "text"):
        sets = textops.shingle_sets(piece.column(1))
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        slots += np.bincount((every >> np.uint64(46)).astype(np.int64), minlength=SLOTS)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        one, two = _set_hashes(every, ends)
        wide = pa.array([_wide_bitmap(s) for s in sets], pa.binary())
        kind = np.zeros(len(sizes), np.int64)
        columns = [pa.array(kind), piece.column(0), pa.array(sizes), pa.array(one), pa.array(two), _bitmaps(every, sizes), wide]
        yield pa.RecordBatch.from_arrays(columns, names)
    used = np.flatnonzero(slots)
    rest = np.zeros(len(used), np.int64)
    columns = [pa.array(x) for x in (rest + 1, used, slots[used], rest, rest)]
    columns += [pa.nulls(len(used), pa.list_(pa.int64())), pa.nulls(len(used), pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names)


def _least_overlap(n, percent: int):
    """The fewest tokens of ``n`` that any partner must share: at least ``percent`` of 100 of the larger set."""
    return -(-n * percent // 100)


def _prefixes(slots: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            sets = textops.shingle_sets(piece.column(1))
            firsts, heads = [], []
            for s in sets:
                head = len(s) - _least_overlap(len(s), percent)
                heads.append(head + 1)
                length = head + max(1, len(s) * MORE // 100) if len(s) else 0
                late = slots[(s >> np.uint64(46)).astype(np.int64)]
                firsts.append(s[np.argsort(late, kind="stable")[:length]].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), sizes, pa.array(heads, pa.int64()), tokens], ["doc", "n", "head", "tokens"])

    return run


def _sets(words: np.ndarray):
    """The sets of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.filter(pa.array(perhaps_in(words, batch.column(0)))) for batch in batches)
        for piece in in_pieces(some, "text"):
            tokens = pa.array([s.tobytes() for s in textops.shingle_sets(piece.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), tokens], ["doc", "tokens"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"])
            yield found.filter(pa.array(keep, pa.bool_()))

    return run


def _perhaps_linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5)):
                a, b = (np.frombuffer(t.as_buffer(), np.uint8) for t in (x, y))
                short = min(len(a), len(b))
                a, b = (np.bitwise_or.reduce(t.reshape(-1, short), axis=0) for t in (a, b))
                lost = min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum()))
                keep.append((int(np.bitwise_count(a & b).sum()) + lost) * (100 + percent) >= (n + m) * percent)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"])
            yield found.filter(pa.array(keep, pa.bool_()))

    return run


def _sifted_pairs(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose wide bitmaps allow the threshold (bound as in ``_may_link``), written."""
    some = sifted(wide, bloom_filter(pairs.select(F.explode(F.array("u", "v")).alias("doc"))))
    one = some.select(F.col("doc").alias("u"), F.col("n").alias("n"), F.col("wide").alias("x"))
    two = some.select(F.col("doc").alias("v"), F.col("n").alias("m"), F.col("wide").alias("y"))
    both = pairs.join(one, "u").join(apart(two), "v").select("u", "v", "n", "x", "m", "y")
    return written(arrow(both, _perhaps_linked(percent), "u long, v long").distinct(), "sifted-pairs")


def _verified(pairs: DataFrame, wide: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v; written) whose sets reach the threshold, written (again for repeated doc_ids); ``wide`` has doc, n and wide bitmap."""
    pairs = _sifted_pairs(pairs, wide, percent)
    # No shuffle of texts: sets that the filter lets through in error find no pair in the joins.
    wanted = bloom_filter(pairs.select(F.explode(F.array("u", "v")).alias("doc")))
    sets = written(arrow(texts, _sets(wanted), "doc long, tokens binary"), "sets")
    one = sets.select(F.col("doc").alias("u"), F.col("tokens").alias("x"))
    two = sets.select(F.col("doc").alias("v"), F.col("tokens").alias("y"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y")
    links = written(arrow(both, _linked(percent), "u long, v long"), "links")
    dropped(sets, pairs)
    return links


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Sizes of which some pair may reach the threshold: the smaller is at least ``percent`` of the larger."""
    return (F.col(f"{a}.most") * 100 >= F.col(f"{b}.least") * percent) & (
        F.col(f"{b}.most") * 100 >= F.col(f"{a}.least") * percent
    )


def _may_link(percent: int, by_rest: bool = False) -> Column:
    """Whether some document under node a may be linked with one under node b, and isn't yet by its component.

    A shared token sets a bit of both bitmaps, but several tokens of a document may share a bit: no more than its
    tokens less its bits (``lost``). The overlap is therefore at most the common bits plus the lost tokens of either
    side, and it must reach the threshold's part of the sum of both sizes. With ``by_rest`` the same holds for the tokens
    from the shared one on: under the first token that two sets share, their whole overlap is among these.
    """
    common = sum((F.bit_count(F.col(f"a.b{i}").bitwiseAND(F.col(f"b.b{i}"))) for i in range(LANES)), F.lit(0))
    most = common + F.least("a.lost", "b.lost")
    needed = (F.col("a.least") + F.col("b.least")) * percent
    one_component = (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    enough = (F.least("a.rest", "b.rest") * (100 + percent) >= needed) if by_rest else F.lit(True)
    return _sizes_fit("a", "b", percent) & enough & (most * (100 + percent) >= needed) & ~one_component


def _nodes(children: DataFrame, by: list[Column | str]) -> DataFrame:
    lanes = [F.bit_or(f"b{i}").alias(f"b{i}") for i in range(LANES)]
    return children.groupBy(*by).agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.max("lost").alias("lost"), F.max("rest").alias("rest"),
        F.min("low").alias("low"), F.max("high").alias("high"), *lanes,
    )


def _described(signed: DataFrame) -> DataFrame:
    """As leaves of a tree: size, lost tokens and bitmap of every class."""
    bits = [F.col("bits")[i].alias(f"b{i}") for i in range(LANES)]
    lost = F.col("n") - sum((F.bit_count(F.col("bits")[i]) for i in range(LANES)), F.lit(0))
    return signed.select("doc", F.col("n").alias("least"), F.col("n").alias("most"), lost.alias("lost"), *bits)


def _hub_pairs(members: DataFrame, classes: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Every class with one class of each of its tokens, as far as sizes, bitmaps and components leave something to find."""
    if labels is None:
        labelled = members.withColumn("component", F.col("doc"))
    else:
        labelled = members.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    first = labelled.groupBy("token").agg(
        F.min_by("doc", F.xxhash64(F.lit(turn), "doc")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    pairs = labelled.join(first.where("low <> high").drop("low", "high"), "token").where("doc <> hub")
    pairs = pairs.select(F.least("doc", "hub").alias("u"), F.greatest("doc", "hub").alias("v")).distinct()
    own = classes if labels is None else classes.join(labels, "doc", "left")
    own = own.withColumn("low", F.coalesce("component", "doc") if labels is not None else F.col("doc"))
    own = written(own.withColumn("high", F.col("low")).drop("component"), "hub-classes")
    met = pairs.join(own.withColumnRenamed("doc", "u").alias("a"), "u").join(own.withColumnRenamed("doc", "v").alias("b"), "v")
    found = written(met.where(_may_link(percent)).select("u", "v"), "hub-pairs")
    dropped(own)
    return found


def _remaining_pairs(members: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a token and whose bitmaps allow a link: the dual traversal."""
    labelled = members.join(labels, "doc", "left").select("token", "doc", "rest", F.coalesce("component", "doc").alias("component"))
    mixed = labelled.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n_members")
    )
    # Two members have been compared already: one of them was the hub.
    mixed = written(mixed.where("low <> high AND n_members > 2").select("token", "n_members"), "tree-tokens")
    largest = mixed.agg(F.max("n_members")).first()[0] or 0
    depth = 0
    while FAN ** (depth + 1) < largest:
        depth += 1
    # A leaf's place in its tree: the deeper the more members the token has; 0 everywhere for a small token. Components
    # stay together, as the bitmap of like documents has few bits and a node of one component needs no pairs of its own;
    # within one, documents are spread over half the levels.
    spread, within = F.lit(1).cast("long"), F.lit(1).cast("long")
    for k in range(1, depth + 1):
        spread = F.when(F.col("n_members") > FAN**k, F.lit(FAN**k).cast("long")).otherwise(spread)
        within = F.when(F.col("n_members") > FAN**k, F.lit(FAN ** (k // 2)).cast("long")).otherwise(within)
    place = F.pmod(F.xxhash64("component"), (spread / within).cast("long")) * within + F.pmod(F.xxhash64("doc"), within)
    leaves = labelled.join(mixed, "token").select(
        "token", place.alias("place"), "doc", "rest", F.col("component").alias("low"), F.col("component").alias("high")
    )
    leaves = written(leaves.join(classes, "doc"), "tree-leaves")
    levels = [written(_nodes(leaves, ["token", "place"]), "tree-nodes")]
    for _ in range(depth):
        up = F.floor(F.col("place") / FAN).cast("long").alias("place")
        levels.append(written(_nodes(levels[-1], ["token", up]), "tree-nodes"))
    pairs = None
    for nodes in reversed(levels):
        a, b = nodes.alias("a"), nodes.alias("b")
        if pairs is None:
            met = a.join(b, F.expr("a.token = b.token AND a.place <= b.place"))
        else:
            below = pairs.alias("p")
            met = below.join(a, F.expr(f"p.token = a.token AND p.x = a.place DIV {FAN}"))
            met = met.join(b, F.expr(f"p.token = b.token AND p.y = b.place DIV {FAN} AND a.place <= b.place"))
        step = met.where(_may_link(percent, True)).select(F.expr("a.token AS token"), F.expr("a.place AS x"), F.expr("b.place AS y"))
        step = written(step, "tree-pairs")
        if pairs is not None:
            dropped(pairs)
        pairs = step
    a, b, p = leaves.alias("a"), leaves.alias("b"), pairs.alias("p")
    met = p.join(a, F.expr("p.token = a.token AND p.x = a.place")).join(
        b, F.expr("p.token = b.token AND p.y = b.place AND (p.x < p.y OR a.doc < b.doc)")
    )
    met = met.where(_may_link(percent, True)).select(F.expr("least(a.doc, b.doc) AS u"), F.expr("greatest(a.doc, b.doc) AS v"))
    found = written(met.distinct(), "tree-found")
    dropped(mixed, leaves, pairs, *levels)
    return found


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs`` (doc_id, text).

    Links are pairs with 100 * intersection >= percent * union of their five-word shingle sets.
    """
    texts = docs.select("doc_id", "text")
    told = written(arrow(texts, _signatures, "kind long, a long, b long, c long, d long, bits array<long>, wide binary"), "signatures")
    signed = told.where("kind = 0").select(
        F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("s1"), F.col("d").alias("s2"), "bits"
    )
    wide = told.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), "wide")
    slots = np.zeros(SLOTS, np.int64)
    counts = told.where("kind = 1").groupBy(F.col("a").alias("slot")).agg(F.sum("b").alias("n")).toArrow()  # at most SLOTS rows
    slots[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    named = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc")).where("doc IS NOT NULL")
    named = written(named, "classes")

    first = arrow(texts, _prefixes(slots.astype(np.uint32), percent), "doc long, n long, head long, tokens array<long>")
    rows = first.join(named.select("doc"), "doc", "left_semi").select("doc", "n", "head", F.posexplode("tokens").alias("place", "token"))
    rows = rows.select("doc", "token", F.expr("CASE WHEN place < head THEN n - place END").alias("rest"))
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    every = written(rows.join(met.hint("shuffle_hash"), "token", "left_semi"), "met-rows")
    # A partner has ``percent`` of a class's size at least, and as many more first tokens of its own.
    wanted = F.greatest(F.floor(F.floor(F.col("n") * percent / 100) * MORE / 100), F.lit(1))
    shared = every.groupBy("doc").agg(F.count(F.lit(1)).alias("n_shared"))
    # A document that stands for several sets (a repeated doc_id) keeps the size and bitmap of one; its links are checked on all.
    classes = signed.join(named, (signed.doc_id == named.doc) & (signed.s1 == named.s1) & (signed.s2 == named.s2)).select("doc", "n", "bits")
    classes = classes.join(shared, "doc").where(F.col("n_shared") >= wanted).dropDuplicates(["doc"])
    classes = written(_described(classes), "met-classes")
    early = sifted(every.where("rest IS NOT NULL").select("doc", "token", "rest"), bloom_filter(classes.select("doc")))
    early = written(early.join(classes.select("doc"), "doc", "left_semi"), "early-rows")
    # Tokens with the same classes are one meeting place, and those with one class left are none. The first of them
    # stands for all: as the order is the same everywhere, it has the largest rest in every class.
    mark = [F.sum(F.xxhash64(F.lit(i), "doc").cast("decimal(38,0)")).alias(f"mark{i}") for i in range(2)]
    places = early.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max("rest").alias("rest"), *mark).where("c > 1")
    places = places.groupBy("c", "mark0", "mark1").agg(F.max_by("token", "rest").alias("token")).select("token")
    members = written(early.join(places, "token", "left_semi"), "members")
    dropped(every, early)
    links, labels = None, None
    for turn in range(ROUNDS):
        pairs = _hub_pairs(members, classes, labels, turn, percent)
        near = _verified(pairs, wide, texts, percent)
        last = turn + 1 == ROUNDS or (links is not None and near.isEmpty())
        # Between rounds one step will do: a label that is no component's yet lets a pair be compared again, no more.
        # The trees need whole components, or the parts of a mass of near copies would meet in pairs.
        before, links = links, contracted(near if links is None else links.union(near), "links-met", None if last else 1)
        dropped(pairs, near, *([] if before is None else [before, labels]))
        labels = written(links.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("component")), "labels")
        if last:
            break
    rest = _verified(_remaining_pairs(members, classes, labels, percent), wide, texts, percent)
    found = components(links.union(rest)).withColumnRenamed("vertex", "doc")
    of_class = named.join(found, "doc", "left").select("s1", "s2", F.coalesce("component", "doc").alias("component"))
    dropped(members, classes, labels)
    return signed.join(of_class, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def without_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand first in their component; documents without words stay, as they are linked with nothing.

    Of rows that repeat a doc_id all stay or none; rows without doc_id stay unless their set has a documented twin.
    """
    found = jaccard_components(docs, percent).where("doc_id = component_id OR component_id IS NULL")
    first = found.select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first, docs.doc_id.eqNullSafe(first.first_id), "left_semi")
