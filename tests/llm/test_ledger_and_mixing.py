"""Rule ledger and source mixing against plain Python."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from depotlens.llm import ledger, mixing

from .conftest import SPACE, words


def measures(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


TEXTS = [
    "a b c a b c", "a b c d a b c", "a a a a", "a b c", "a b", "", None, " \t", "x\ny\nx\n\n\nx ", "a b c\x0ba b c\x0cz",
    "#1 <b> & | % $ *", "ab c a bc", "a b c d e a b c q c d e",
]


def test_measures(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in ledger.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text), r.text


def test_measures_of_the_sample(sample):
    df, rows = sample
    for r in ledger.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(rows[r.doc_id]["text"])


def test_places_beyond_the_packed_ones(spark, monkeypatch):
    """Texts with more windows than a packed place can name are compared by whole hashes."""
    monkeypatch.setattr(ledger, "_PLACES", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in ledger.measured(df).collect():
        assert r.n_repeat_words == measures(r.text)[4]


def test_bits_policies_and_ablations(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "few words"), (3, "### " * 60), (4, None)]
    book = ledger.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    failed = {r.doc_id: r.failed for r in book.collect()}
    assert failed == {1: 0, 2: ledger.BIT["few_words"], 3: ledger.mask_of("repeats", "symbols"), 4: ledger.BIT["few_words"]}
    assert {r.doc_id for r in ledger.passing(book, ledger.BASE).collect()} == {1}
    found = {r.rule: (r.n_broken, r.n_only, r.n_kept_without) for r in ledger.ablations(book, ledger.CORPUS).collect()}
    assert found["few_words"] == (2, 2, 3) and found["symbols"] == (1, 0, 1) and found["word_length"] == (0, 0, 1)


def test_kept_has_the_columns_of_its_input(awkward, nothing):
    out = ledger.kept(awkward)
    assert out.columns == awkward.columns and out.schema == awkward.schema
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1, 2, 6, 9]
    assert {r.failed for r in out.collect()} == {"x"}
    assert ledger.kept(nothing).count() == 0 and ledger.ablations(ledger.ledger(nothing), ledger.CORPUS).count() == 0


def test_budgets_share_the_excess():
    sizes = [("b", 100), ("a", 10), (None, 1000), ("c", 50)]
    target = mixing.budgets(sizes, (3, 1, 2), 150, 2)
    assert target["a"] == 20 and target["b"] == 200 and target["c"] == 100  # the null source has weight 3 and is last
    assert target[None] == 1740 - 320
    assert mixing.budgets([], (3, 1, 2), 150, 2) == {}


def mixed(rows):
    return sorted((str(r.doc_id), r["size"], r.copies) for r in rows)


def test_thresholds_are_what_sorting_by_hash_would_take(sample):
    df, rows = sample
    got = mixing.mixed(df).collect()
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(words(rows[r.doc_id]["text"]))
        by[r.source].append(r)
    import hashlib

    target = mixing.budgets([(s, sum(r["size"] for r in g)) for s, g in by.items()], (3, 1, 2), 150, 2)
    for s, g in by.items():
        total = sum(r["size"] for r in g)
        whole = int(Fraction(target[s]) // total)
        rest = target[s] - whole * total
        upto = 0
        for r in sorted(g, key=lambda r: hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:15]):
            more = upto + r["size"] <= rest or (upto <= rest and 2 * (rest - upto) >= r["size"] and rest - upto >= 0)
            assert r.copies == whole + (more and r["size"] > 0), (s, r.doc_id)
            upto = upto + r["size"] if upto + r["size"] <= rest else float("inf")
        assert all(r.copies <= 2 for r in g)


def test_mix_of_awkward_rows(awkward, nothing):
    out = mixing.mixed(awkward).collect()
    assert len(out) == awkward.count() and all(r.copies <= 2 for r in out)
    assert mixed(out) == mixed(mixing.mixed(awkward.repartition(3)).collect())
    taken = mixing.taken(awkward)
    assert taken.columns == awkward.columns and taken.count() == sum(r.copies for r in out)
    assert mixing.taken(nothing).count() == 0
