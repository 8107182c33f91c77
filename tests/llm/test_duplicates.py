"""Line dedup, the Jaccard join and digests against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from depotlens.llm import common, digest, lines, sigtree
from depotlens.llm.common import components, contracted, written

from .conftest import SPACE, words

ORDER = (1 << 63) - 1


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return max(len(a), len(b)) - i - j <= 1


def kept_lines(rows, least_chars):
    """doc_id -> kept text, by comparing every line with every earlier one."""
    first = {}
    for i, text in sorted((ORDER if i is None else i, t) for i, t in rows if t is not None):
        for p, x in enumerate(text.split("\n")):
            if x.strip(SPACE):
                first[x] = min(first.get(x, (i, p)), (i, p))
    near = {
        a for a in first if len(a) >= least_chars
        if any(len(b) >= least_chars and first[b] < first[a] and one_edit(a, b) for b in first)
    }
    stay = {first[x] for x in first if x not in near}
    return [
        (i, text if text is None else "\n".join(
            x for p, x in enumerate(text.split("\n")) if not x.strip(SPACE) or ((ORDER if i is None else i), p) in stay))
        for i, text in rows
    ]


def test_lines_of_random_texts(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé漢") for _ in range(rng.randint(4, 9))) for _ in range(12)]

    def edited(x):
        k = rng.randrange(len(x))
        return rng.choice([x, x, x[:k] + x[k + 1 :], x[:k] + "b" + x[k + 1 :], x[:k] + "é" + x[k:], x + "  "])

    rows = [(i, "\n".join(rng.choice(["", " ", edited(rng.choice(base))]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rows += [(80, None), (81, ""), (None, rows[3][1] + "\nonly here stands this"), (-5, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (0, 6):
        got = {(r.own.doc_id, r.kept_text) for r in lines.deduplicated(df, least).collect()}
        assert got == set(kept_lines(rows, least))


def test_lines_of_the_sample(sample):
    df, rows = sample
    got = {r.own.doc_id: r.kept_text for r in lines.deduplicated(df).collect()}
    assert got == dict(kept_lines([(i, r["text"]) for i, r in rows.items()], 20))


def test_lines_of_awkward_rows(awkward, nothing):
    out = lines.without_repeats(awkward)
    assert out.schema.names == awkward.schema.names
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.text)
    assert len(by[1]) == 2 and 2 not in by and by[3] == [None] and by[5] == [" \n\t "] and by[None] == [None]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) and {r.place for r in rows} == {"x"}
    assert lines.without_repeats(nothing).count() == 0


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else ())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def expected_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    least = {}
    for i in sorted(sets):
        if i in least:
            continue
        least[i], todo = i, [i]
        while todo:
            a = todo.pop()
            for b in set().union(*(holders[x] for x in sets[a])) - set(least) if sets[a] else ():
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[b] = i
                    todo.append(b)
    return {i: (len(sets[i]), least[i]) for i in sets}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df).collect()}


def variants_of_a_few_texts(n):
    rng = random.Random(3)
    texts = [[f"t{rng.randrange(400)}" for _ in range(rng.choice([5, 9, 30, 80]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w[: rng.choice([len(w), len(w), len(w) - 1])])))
    return rows


def test_components_of_variants(spark):
    """Trees of several levels: many near copies of few texts, most of them linked only through others."""
    rows = variants_of_a_few_texts(400) + [(1000, ""), (1001, None), (1002, "a b"), (1003, "A B"), (1004, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found_components(df) == expected_components(rows)


def test_small_fans_make_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "FAN", 2)
    rows = variants_of_a_few_texts(150)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == expected_components(rows)


def test_equal_sets_have_equal_hashes_wherever_they_stand():
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abacadae"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    told = next(sigtree._signatures(iter([batch])))
    hashes = list(zip(told.column(3).to_pylist(), told.column(4).to_pylist()))
    assert len(set(hashes[::2])) == 1 and len(set(hashes)) == 5


def test_wide_bitmaps_bound_the_overlap():
    """No linked pair is given up, whatever its sizes, and unlike ones of many tokens are."""
    rng = np.random.default_rng(5)
    columns, linked = [[] for _ in range(6)], []
    for k in range(300):
        n = int(rng.choice([1, 5, 250, 260, 1100, 5000]))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(n * rng.choice([0, 0.1, 0.2, 0.9])) :], rng.integers(0, 1 << 63, int(n * rng.choice([0, 0.1, 0.2, 0.9])), dtype=np.uint64)]))
        if not len(y):
            continue
        shared = len(np.intersect1d(x, y))
        linked.append((k, 100 * shared >= 80 * (len(x) + len(y) - shared), shared, max(len(x), len(y))))
        for column, value in zip(columns, (k, k, len(x), sigtree._wide_bitmap(x), len(y), sigtree._wide_bitmap(y))):
            column.append(value)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "n", "x", "m", "y"])
    kept = set(next(sigtree._perhaps_linked(80)(iter([batch]))).column(0).to_pylist())
    assert all(k in kept for k, link, _, _ in linked if link) and any(link for _, link, _, _ in linked)
    assert not any(k in kept for k, _, shared, n in linked if n > 250 and 3 * shared < n)


def test_components_of_the_sample(sample):
    df, rows = sample
    assert found_components(df) == expected_components([(i, r["text"]) for i, r in rows.items()])


def test_components_of_awkward_rows(awkward, nothing):
    got = sigtree.jaccard_components(awkward).collect()
    assert len(got) == awkward.count()
    of = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert of[(1, 56)] == of[(2, 56)] == of[(9, 57)] == of[(None, 56)] == 1
    assert of[(3, 0)] == 3 and of[(4, 0)] == 4 and of[(7, 1)] == 7 and of[(None, 0)] is None
    stay = sigtree.without_copies(awkward)
    assert stay.schema == awkward.schema
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "1", "3", "4", "5", "6", "7", "8", "None", "None"]
    assert sigtree.jaccard_components(nothing).count() == 0


def test_star_contraction_follows_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 999)]
    random.Random(1).shuffle(links)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {999: 999, 1000: 999, 1001: 999}


def test_contraction_ends_at_stars_and_may_end_before(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "written", lambda df, name: made.append(name) or written(df, name))
    stars = spark.createDataFrame([(10 * k + i, 10 * k) for k in range(4) for i in range(1, 5)], "u long, v long")
    assert {r.vertex: r.component for r in components(stars).collect()} == {10 * k + i: 10 * k for k in range(4) for i in range(5)}
    assert len(made) == 1  # finished stars need no further round
    chains = [(i, i + 1) for i in range(40) if i != 20]
    some = contracted(spark.createDataFrame(chains, "u long, v long"), "some", 1)
    assert len(made) == 3 and all((r.u <= 20) == (r.v <= 20) and r.u > r.v for r in some.collect())
    assert {r.vertex: r.component for r in components(some).collect()} == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_sets_are_fetched_without_a_shuffle_of_texts(sample, monkeypatch):
    plans = defaultdict(list)

    def noted(df, name):
        plans[name].append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(sigtree, "written", noted)
    sigtree.jaccard_components(sample[0])
    assert plans["sets"] and not any("Exchange" in p for p in plans["sets"])


def test_digests_of_the_sample(sample):
    df, rows = sample
    got = {r.doc_id: r for r in digest.neighbours(df).collect()}
    order = sorted(rows)
    of_text = defaultdict(set)
    for i, following in zip(order, order[1:] + order[:1]):
        text, more = rows[i]["text"] or "", rows[following]["text"] or ""
        swapped = len(text) // 4
        edited = text[: len(text) - swapped] + more[:swapped]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, new, other = (digest.read_back(x) for x in (r.fingerprint, r.edited_fingerprint, got[following].fingerprint))
        assert r.near_edited == digest.likeness(own, new) and r.near_next == digest.likeness(own, other)
        of_text[text].add(r.fingerprint)
        of_text[edited].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in of_text.values())
    long = [r for r in got.values() if r.n_chars >= 300]
    assert min(r.near_edited for r in long) > 0.4
    assert sorted(r.near_next for r in long)[int(len(long) * 0.95)] < 0.1


def test_digests_of_awkward_rows(awkward, nothing):
    got = digest.neighbours(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = digest.neighbours(awkward.where("doc_id = 7")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    assert digest.neighbours(nothing).count() == 0


def entropy_rank(window):
    counts = [window.count(b) for b in set(window)]
    return int(sum(digest._SUM[c] for c in counts)) * (digest.BINS - 1) // int(digest._SUM[digest.WINDOW])


def test_features_are_what_the_definition_says():
    rng = random.Random(5)
    rank = digest.np.random.default_rng(2).permutation(digest.BINS)
    texts = ["".join(rng.choice("abcdef ghé") for _ in range(n)).encode() for n in (0, 1, 40, 300)]
    w = digest.WINDOW
    found = digest.digests(texts, rank)
    for text, filters in zip(texts, found):
        x = bytes(digest.LEAD) + text
        x += bytes(max(0, w - len(x)))
        ranks = [rank[entropy_rank(x[i : i + w])] for i in range(len(x) - w + 1)]
        votes = [0] * len(ranks)
        for start in range(1 - w, len(ranks)):
            run = [i for i in range(start, start + w) if 0 <= i < len(ranks)]
            votes[min(run, key=lambda i: (ranks[i], i))] += 1
        n = sum(v >= digest.VOTES for v in votes)
        assert len(filters) == -(-n // digest.PER_FILTER) and n > 0
        assert (digest.likeness(filters, filters)) == 1.0
    assert digest.digests([texts[3]], rank)[0].tobytes() == found[3].tobytes()
