"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

Terms are words and word beginnings of four to seven letters. The labelled sample (at most ``max_examples`` rows per
label, by a hash of the id) tells which terms go with which label; these are the vocabulary, all other text is one more
term whose weight is the text's length, so that the density of telling words counts and not their mere presence. Words
that tell of label 1 share a term as well. Document frequencies are counted over all documents.

The examples' weights stand in inverted lists, cut into blocks of examples with the largest weight of each block. A
query visits blocks in order of the best cosine they could hold and stops when none can enter its nearest ``k``; equal
vectors are one example with a count, so ties take part together. Neighbours vote by a power of their cosine, each
label at the rate it has among the labelled rows, and the votes are calibrated on the examples themselves, each without
its own vector's vote. The nearest examples of each label come with the score as evidence.

Nulls and empties: a null or empty text has no terms and scores the rate of label 1. Rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow, in_pieces

K = 15
BLOCK = 64  # examples
PREFIXES = range(4, 8)  # letters
MAX_EXAMPLES = 6000  # of each label
MAX_TERMS = 2000
LEAST_STRENGTH = 30.0  # of a term's tie to a label, as a log-likelihood ratio
FILLER = 0.05  # weight of a character's worth of other text, next to a term of weight 1
SHARPNESS = 8  # power of the cosine in a vote
POOLED, OTHER = 0, 1  # terms that stand for all words of label 1, and for the text as a whole
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _terms_of(text: str) -> set[str]:
    """Words, and beginnings of words marked by a star."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _label_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's examples of each label have a term."""

    def counted(seen: dict[int, Counter]) -> pa.RecordBatch:
        rows = [(t, y, n) for y, c in seen.items() for t, n in c.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            ["term", "toxic", "n"],
        )

    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for piece in in_pieces(batches, "text"):
        for text, label in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            seen[label].update(_terms_of(text or ""))
        if sum(map(len, seen.values())) > 300_000:
            yield counted(seen)
            seen = {0: Counter(), 1: Counter()}
    yield counted(seen)


def chosen_terms(examples: DataFrame, n0: int, n1: int, max_terms: int = MAX_TERMS) -> tuple[dict[str, int], set[str]]:
    """The vocabulary, numbered from 2, and those of its terms that tell of label 1."""
    counts = arrow(examples.select("text", "toxic"), _label_terms, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    # The log-likelihood ratio of a two by two table, and three times the other label's rate at least.
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / float(max(1, n0 + n1))
    strength = 2 * (
        part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0)
    )
    ratio = ((a + 0.5) / (n1 + 1.0)) / ((b + 0.5) / (n0 + 1.0))
    told = counts.withColumn("strength", strength).withColumn("ratio", ratio)
    told = told.where((F.col("strength") >= LEAST_STRENGTH) & ((F.col("ratio") >= 3) | (F.col("ratio") <= 1 / 3)))
    best = told.orderBy(F.desc("strength"), "term").limit(max_terms).select("term", "ratio").collect()
    return {r["term"]: i + 2 for i, r in enumerate(best)}, {r["term"] for r in best if r["ratio"] >= 3}


class Finder:
    """Finds the vocabulary's terms in a text: an automaton over their letters, checked at word borders."""

    def __init__(self, terms: dict[str, int], toxic: set[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        plain: dict[str, list[tuple[int, bool, bool]]] = {}
        for t, i in terms.items():
            plain.setdefault(t.rstrip("*"), []).append((i, t.endswith("*"), t in toxic))
        for letters, entries in plain.items():
            self.automaton.add_word(letters, (len(letters), entries))
        if plain:
            self.automaton.make_automaton()
        self.any = bool(plain)

    def counts(self, text: str) -> dict[int, int]:
        """How often each term occurs; the pooled term once per word with a term of label 1."""
        found: dict[int, int] = {}
        if self.any:
            low = text.lower()
            pooled = -1
            for last, (size, entries) in self.automaton.iter(low):
                begin = last - size + 1
                if begin and low[begin - 1].isalpha():
                    continue
                whole = last + 1 == len(low) or not low[last + 1].isalpha()
                for term, prefix, toxic in entries:
                    if prefix != whole:
                        found[term] = found.get(term, 0) + 1
                        if toxic and begin != pooled:
                            pooled = begin
                            found[POOLED] = found.get(POOLED, 0) + 1
        return found


def _document_counts(terms: dict[str, int], toxic: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = Finder(terms, toxic), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(finder.counts(text or "").keys())
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["term", "n"])

    return run


@dataclass
class Weights:
    """Inverse document frequencies by term, from counts over all documents."""

    idf: np.ndarray

    def vector(self, counts: dict[int, int], n_chars: int) -> dict[int, float]:
        out = {t: n * self.idf[t] for t, n in counts.items()}
        out[OTHER] = FILLER * n_chars / 5.0
        norm = math.sqrt(sum(x * x for x in out.values())) or 1.0
        return {t: x / norm for t, x in out.items() if x}


class BlockMaxIndex:
    """Examples in blocks; per term and block the list of its weights and the largest of them."""

    def __init__(self, vectors: list[dict[int, float]], ids: list[list[int]], positive: np.ndarray, total: np.ndarray, n_terms: int):
        lead = [max(v.items(), key=lambda x: (x[0] > OTHER, x[1])) if v else (0, 0.0) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i][0], -vectors[i].get(POOLED, 0.0), lead[i][1], i))
        self.ids = [ids[i] for i in order]
        self.positive, self.total = positive[order], total[order]
        self.n = len(order)
        self.blocks = max(1, -(-self.n // BLOCK))
        self.most = np.zeros((n_terms, self.blocks), np.float32)
        self.lists: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        for at, i in enumerate(order):
            for t, w in vectors[i].items():
                where, weights = self.lists.setdefault((t, at // BLOCK), ([], []))
                where.append(at % BLOCK), weights.append(w)
                self.most[t, at // BLOCK] = max(self.most[t, at // BLOCK], np.float32(w) * np.float32(1.000001))
        self.packed = {k: (np.array(a), np.array(w)) for k, (a, w) in self.lists.items()}
        del self.lists

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples, so many that they stand for ``k`` rows; all of equal cosine."""
        terms = list(query)
        weights = np.array([query[t] for t in terms])
        bound = weights @ self.most[terms] if terms else np.zeros(self.blocks)
        places: list[np.ndarray] = []
        cosines: list[np.ndarray] = []
        floor, held = -1.0, np.zeros(0)
        rows = np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < floor - 1e-9 or bound[b] <= 0:
                break
            got = np.zeros(BLOCK)
            for t, w in zip(terms, weights.tolist()):
                entry = self.packed.get((t, b))
                if entry is not None:
                    got[entry[0]] += w * entry[1]
            near = np.flatnonzero((got > 0) & (got >= floor - 1e-9))
            if b == without // BLOCK and without >= 0:
                near = near[near != without % BLOCK]
            if not len(near):
                continue
            places.append(near + b * BLOCK), cosines.append(got[near])
            held, rows = np.concatenate(cosines), self.total[np.concatenate(places)]
            order = np.argsort(-held, kind="stable")
            reached = np.searchsorted(np.cumsum(rows[order]), k)
            floor = held[order[reached]] if reached < len(order) else floor
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.concatenate(places)
        keep = held >= floor - 1e-9
        return at[keep], held[keep]


@dataclass
class Model:
    terms: dict[str, int]
    toxic: set[str]
    weights: Weights
    index: BlockMaxIndex
    rate: float  # of label 1 among the labelled rows
    balance: tuple[float, float]  # what an example of label 0 and 1 stands for
    steps: tuple[np.ndarray, np.ndarray]  # votes and the scores they are calibrated to

    def vote(self, query: dict[int, float], without: int = -1) -> tuple[float, list[int], list[int]]:
        """The share of label 1 in the votes, and the nearest examples of labels 1 and 0."""
        at, cosine = self.index.nearest(query, K, without)
        if not len(at):
            return self.rate, [], []
        sharp = cosine**SHARPNESS
        yes = (sharp * self.index.positive[at]).sum() * self.balance[1]
        no = (sharp * (self.index.total[at] - self.index.positive[at])).sum() * self.balance[0]
        near = at[np.argsort(-cosine, kind="stable")]
        pick = lambda wanted: [i for p in near.tolist() if wanted(p) for i in self.index.ids[p][:1]][:3]
        positive, total = self.index.positive, self.index.total
        return float(yes / (yes + no)), pick(lambda p: positive[p] > 0), pick(lambda p: positive[p] < total[p])

    def score(self, vote: float) -> float:
        return float(min(1.0, max(0.0, np.interp(vote, *self.steps))))


def _calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps from votes to the rate of label 1 around them: neighbouring pools merge until the rates rise."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # weight of label 1, weight, sum of votes
    for v, y, w in zip(votes[order], labels[order], weights[order]):
        pools.append([y * w, w, v * w])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c]
    at = np.array([p[2] / p[1] for p in pools])
    rate = np.array([p[0] / p[1] for p in pools])
    return np.concatenate([[0.0], at, [1.0]]), np.concatenate([[rate[0]], rate, [rate[-1]]])


def fitted(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model | None:
    """The index of the labelled sample; None if there is no labelled row of either label to learn from.

    What reaches the driver is bounded by ``max_examples`` and ``max_terms``: examples as counts of vocabulary terms.
    """
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    picked = [told.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    rows = [(r["doc_id"], r["toxic"]) for p in picked for r in p.collect()]  # at most twice max_examples
    sample = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    terms, toxic = chosen_terms(examples, n0, n1, max_terms)
    counted = arrow(docs.select("text"), _document_counts(terms, toxic), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n_docs = docs.count()
    idf = np.ones(len(terms) + 2)
    for r in counted.collect():  # one row per term of the vocabulary
        idf[r["term"]] = math.log((1 + n_docs) / (1 + r["n"])) + 1
    weights = Weights(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms, toxic)
        for batch in batches:
            found = [weights.vector(finder.counts(t or ""), len(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([list(v) for v in found], pa.list_(pa.int64())),
                pa.array([list(v.values()) for v in found], pa.list_(pa.float64())),
            ], ["doc_id", "toxic", "terms", "weights"])

    held = arrow(examples.select("doc_id", "text", "toxic"), vectors, "doc_id long, toxic int, terms array<long>, weights array<double>").toArrow()
    together: dict[tuple, list] = {}
    for i, y, t, w in sorted(zip(*(held[c].to_pylist() for c in held.column_names))):
        key = tuple(sorted((a, round(b, 6)) for a, b in zip(t, w)))
        entry = together.setdefault(key, [dict(zip(t, w)), [], 0, 0])
        entry[1].append(i)
        entry[2] += y
        entry[3] += 1
    groups = list(together.values())
    positive, total = np.array([g[2] for g in groups], float), np.array([g[3] for g in groups], float)
    index = BlockMaxIndex([g[0] for g in groups], [g[1] for g in groups], positive, total, len(idf))
    rate = sizes[1] / (sizes[0] + sizes[1])
    model = Model(terms, toxic, weights, index, rate, (sizes[0] / max(1, n0), sizes[1] / max(1, n1)), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    # Calibration: every distinct example is scored by the others.
    place = {tuple(ids): p for p, ids in enumerate(index.ids)}
    votes, truth, mass = [], [], []
    for vector, ids, yes, n in groups:
        vote = model.vote(vector, place[tuple(ids)] if n == 1 else -1)[0]
        for y, many in ((1, yes), (0, n - yes)):
            if many:
                votes.append(vote), truth.append(y), mass.append(many * model.balance[y])
    model.steps = _calibrated(np.array(votes), np.array(truth, float), np.array(mass))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``score`` and the nearest examples of either label for every row of ``docs`` (doc_id, text)."""
    columns = "doc_id long, score double, like_toxic array<long>, like_clean array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.terms, model.toxic) if model else None
        plain: tuple | None = None
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if model is None or not text:
                    out.append((model.rate if model else 0.0, [], []))
                    continue
                counts = finder.counts(text)
                if not counts and plain is not None:
                    out.append(plain)  # texts without a term of the vocabulary have one direction
                    continue
                vote, toxic, clean = model.vote(model.weights.vector(counts, len(text)))
                out.append((model.score(vote), toxic, clean))
                if not counts:
                    plain = out[-1]
            scores, toxic, clean = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic, pa.list_(pa.int64())), pa.array(clean, pa.list_(pa.int64()))],
                ["doc_id", "score", "like_toxic", "like_clean"],
            )

    return arrow(docs.select("doc_id", "text"), run, columns)
