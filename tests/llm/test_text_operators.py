"""Merge dropout, pages, toxicity, licences and tool calls."""

import json

import pyarrow as pa
import pytest
import sentencepiece

from depotlens.llm import dropout, licenses, pages, toolcalls, toxicity

from .conftest import SF


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=dropout.PIECE_BPE_32K)


def ids_of(df, **settings):
    return {(r.doc_id, r.text): (r.ids, r.lossless) for r in dropout.round_trip(df.select("doc_id", "text"), **settings).collect()}


def test_without_dropout_it_is_the_library(sample, model):
    df, rows = sample
    got = ids_of(df, dropout=0.0)
    assert all(ids == model.encode(text) and same for (_, text), (ids, same) in got.items())


def test_dropout_varies_by_seed_and_is_lossless(sample, model):
    df, rows = sample
    one, again, other = ids_of(df, seed=1), ids_of(df.repartition(7), seed=1), ids_of(df, seed=2)
    assert one == again and one != other and all(same for _, same in [*one.values(), *other.values()])
    plain = sum(len(model.encode(text)) for _, text in one)
    assert plain < sum(len(ids) for ids, _ in one.values()) < 1.3 * plain
    none = ids_of(df, dropout=1.0)
    spelled = dropout.vocabulary(dropout.PIECE_BPE_32K).spelled
    assert {len(spelled[i].decode(errors="replace")) for ids, _ in none.values() for i in ids} == {1}


def test_every_occurrence_has_its_own_draws(spark):
    """Each candidate of each occurrence is skipped on its own: many segmentations, those of working out each by itself."""
    np, vocab = dropout.np, dropout.vocabulary(dropout.PIECE_BPE_32K)
    text = "understanding"
    df = spark.createDataFrame([(i, text) for i in range(3000)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in dropout.encoded(df, seed=3).collect()}
    points = np.array([ord(c) for c in " " + text])
    assert len({tuple(ids) for ids in got.values()}) > 4
    keys = dropout.textops.mixed(dropout.textops.mixed(np.arange(3000).astype(np.uint64) + np.uint64(3)))
    flat, counts = dropout.merged(np.tile(vocab.symbol[points], 3000), np.full(3000, len(points)), keys, vocab, int(0.1 * (1 << 32)))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [got[i] for i in range(3000)]


def test_ids_of_awkward_rows(awkward, nothing):
    out = dropout.encoded(awkward)
    assert out.columns == [c for c in awkward.columns if c != "ids"] + ["ids"]
    for (_, text), (ids, same) in ids_of(awkward).items():
        assert same and (ids is None) == (text is None) and (ids == []) == (text == "")
    assert dropout.encoded(nothing).count() == 0


ARTICLE = "<article><h1>Head</h1><p>One &amp; two<br>three<p>four <b>five</b>six</article>"


def blocks(html, template=()):
    page = pages.Page(html)
    return page.blocks(page.main(), set(template))


def test_blocks_of_a_page():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><header><h1>Site</h1></header>"
        f"<nav><a>m</a></nav><!-- <p>no</p> --><div class='ad'>buy</div>{ARTICLE}<aside>s</aside><form>f<input></form>"
        "<section id=comments><article>bad</article></section><footer>end"
    )
    assert blocks(page) == ["Head", "One & two three", "four fivesix"]
    assert blocks("<p>a&nbsp;&lt;b&gt; <ul><li>x<li>y</ul><table><tr><td>1<td>2</table>tail") == ["a <b>", "x", "y", "1", "2", "tail"]
    assert blocks("<main><header><h2>H</h2>by me</header>text<div class='share-box'>no</div></main>") == ["H", "text"]
    assert blocks("") == [] and blocks("plain &copy text") == ["plain © text"] and blocks("a < b <") == ["a < b <"]
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 10) == ["deep"]


def test_named_paragraphs_and_stray_quotes():
    text = "<p>Article text one, long enough.</p><p>And two.</p>"
    want = ["Article text one, long enough.", "And two."]
    assert blocks(f"<article>{text}<p class='ad'>Buy now</p><p class=advert>Or now</p></article>") == want
    assert blocks(f"<article>{text}<p class='social-policy'>Kept</p></article>") == [*want, "Kept"]
    assert blocks("<p data-x=it's>Article text one.</p><p>Text two, it's here > end.</p>") == ["Article text one.", "Text two, it's here > end."]
    assert blocks("<!--><p>B</p><p>C -->") == ["B", "C -->"] and blocks("<!-- a --><p>D</p><!--->x") == ["D", "x"]
    assert blocks('<p title="a>b" lang=en">E</p>') == ["E"]


def test_names_of_elements_with_the_article():
    text = "<p>A long enough article to be the most of this page.</p>"
    for page in (
        f"<div class='layout with-sidebar'><article>{text}</article></div>", f"<article class='post has-comments'>{text}</article>",
        f"<div class='modal'><article>{text}</article></div>", f"<body><form>{text}<div class='sidebar'>links</div></form></body>",
        f"<body><div class='widget'>{text}</div><div id='comment-list'>bad</div></body>",
    ):
        assert blocks(page) == ["A long enough article to be the most of this page."], page
    inner = "<h2 id='related-work'>One</h2><section id='notice-period'>two</section><p class='social-policy'>three</p><h3 class='banner'>four</h3>"
    assert blocks(f"<article>{inner}<div class='related-posts'>five</div><div id='ad-1'>six</div></article>") == ["One", "two", "three", "four"]
    assert blocks(f"<body>{text}<section id=comments><article>bad</article></section></body>") == [text[3:-4]]


def test_comments_and_notices_go_whatever_their_share():
    many = "".join(f"<p>A reader's long comment, number {i}.</p>" for i in range(5))
    for name in ("class='comments'", "id='comments'", "class=cookie-notice"):
        assert blocks(f"<article><p>One line.</p><div {name}>{many}</div></article>") == ["One line."]
        assert blocks(f"<body><p>One line.</p><div {name}><article>{many}</article></div></body>") == ["One line."]
    frames = "<div class='cookie-notice'>We use a lot of cookies here.</div><div class='widget'><p>Story</p></div>"
    assert blocks(f"<body>{frames}</body>") == ["Story"] and blocks(f"<body><p>Text</p>{frames}</body>") == ["Text"]
    assert blocks("<body><h1>T</h1><form><p>Story</p><div class='sidebar'>links</div></form></body>") == ["T", "Story"]
    assert blocks("<main><p>a</p><label>b</label><div class=modal><article>c</article></div></main>") == ["a", "b", "c"]
    assert blocks("<article><p>a</p><div class=popup><article>teaser</article></div></article>") == ["a"]


def test_pages_take_time_by_their_length():
    """Ten times the elements, open or side by side, in far less than a hundred times the time."""
    from time import process_time

    def took(html):
        at = process_time()
        page = pages.Page(html)
        page.holders(page.main()), blocks(html)
        return process_time() - at

    for part in ("<article><p>x</p></article>", "<span>", "<li>x", "<div><p>", "<a ", "<div class=comments><article>y</article>"):
        assert took(part * 20_000) < 40 * max(took(part * 2_000), 0.02), part


def test_templates_are_deleted_per_host(spark):
    def page(i, host, quote):
        box = f"<div class='x'><p>Read our {host} mail</p></div>"
        return (i, f"http://{host}/p{i}", f"<body><div><p>Story {i} is a long story of its own, told here.</p></div><p>{quote}</p>{box}</body>")

    rows = [page(i, "a.org", "as they say") for i in range(8)] + [page(i, "b.org", "as they say") for i in range(8, 10)]
    rows += [(20, None, "<p>x"), (21, "http://a.org/", None), (21, "http://a.org/", ""), (None, "A.org", "<p>y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in pages.main_text(df).collect()}
    assert got[(3, "http://a.org/p3")][0] == "Story 3 is a long story of its own, told here.\nas they say"
    assert got[(9, "http://b.org/p9")][0].endswith("Read our b.org mail")
    assert got[(20, None)] == ("x", 1) and got[(21, "http://a.org/")] == ("", 0)
    copies = spark.createDataFrame([(i, "http://c.org/", rows[0][2]) for i in range(30)], df.schema)
    assert {r.text for r in pages.main_text(copies).collect()} == {"Story 0 is a long story of its own, told here.\nas they say\nRead our a.org mail"}
    assert pages.main_text(df.limit(0)).count() == 0


def test_templates_of_a_few_pages_and_of_short_ones(spark):
    """A template on six pages of a host of a thousand, three times as long as the article it stands with."""
    box = "<div class='x'><p>" + "All of this box is of the site. " * 10 + "</p></div>"
    page = lambda i: f"<body><p>Story {i} is short.</p>{box if i < 6 else f'<p>{i}</p>'}</body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(1000)] + [(2000, "http://b.org/1", page(1))]
    rows += [(3000 + i, f"http://c.org/{i}", f"<body><div><article><p>Same story</p></article></div><p>{i}</p></body>") for i in range(8)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Story {i} is short." for i in range(6)) and got[7] == "Story 7 is short.\n7"
    assert "of the site" in got[2000] and {got[3000 + i] for i in range(8)} == {"Same story"}


def test_pages_of_the_sample(spark):
    import html
    import re

    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_block_max_search_is_exact():
    rng = toxicity.np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        v = {int(t): float(w) for t, w in zip(rng.choice(12, 4, replace=False), rng.random(4) + 0.01)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    total = rng.integers(1, 4, 500).astype(float)
    index = toxicity.BlockMaxIndex(vectors, [[i] for i in range(500)], total * 0, total, 12)
    where = {ids[0]: p for p, ids in enumerate(index.ids)}
    for q in vectors[:60]:
        cosine = toxicity.np.array([sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors])
        order = toxicity.np.argsort(-cosine, kind="stable")
        least = cosine[order[int(toxicity.np.searchsorted(total[order].cumsum(), 15))]]
        want = {where[i] for i in range(500) if cosine[i] >= least - 1e-9 and cosine[i] > 0}
        at, _ = index.nearest(q, 15)
        assert set(at.tolist()) == want


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = toxicity.scored(docs, toxicity.fitted(docs, labels))
    rows = found.join(labels, "doc_id").where(toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    yes, no = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert found.count() == docs.count() and all(0 <= s <= 1 for s in yes + no)
    assert sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no)) > 0.85
    assert sum(s >= 0.7 for s in no) <= 0.03 * len(no)


def test_labels_of_held_out_rows_are_not_read(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.held_out(toxicity.F.col("doc_id"))
    turned = labels.withColumn("toxic", toxicity.F.when(out, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (sorted(toxicity.scored(docs, toxicity.fitted(docs, x)).collect()) for x in (labels, turned))
    assert a == b
    model = toxicity.fitted(docs, labels)
    assert toxicity.scored(awkward, model).count() == awkward.count() and toxicity.scored(nothing, model).count() == 0
    assert toxicity.fitted(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.scored(docs, None).collect()} == {0.0}


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\nmore words that no notice has, " + "x " * 200),
        ("a/b/c/main.py", "print(1)"), ("a/b/gpl.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/d/e.py", "nothing"), ("a/z.py", "Some text.\nLicensed under CC BY-NC 4.0. And more follows here\n" + "y " * 300),
        ("a/q.py", None), (None, "Licensed under CC BY-NC 4.0"), ("top.py", ""), ("x/y.py", "a licence for cats and their copyright of mice"),
        ("x/y.py", "a licence for cats and their copyright of mice"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "'k' AS license", "'k' AS dir")
    got = {r.path: (r.license, r.own, r.inherited_from) for r in licenses.scanned(df).collect()}
    assert got["a/LICENSE"] == ("MIT", True, None) and got["a/b/gpl.txt"] == ("GPL-3.0", True, None)
    assert got["a/b/c/main.py"] == got["a/b/d/e.py"] == ("GPL-3.0", False, "a/b")
    assert got["a/z.py"] == ("CC-BY-NC-4.0", True, None) and got["a/q.py"] == ("MIT", False, "a")
    assert got["top.py"] == got["x/y.py"] == (None, False, None)
    assert got[None] == ("CC-BY-NC-4.0", True, None)
    assert licenses.scanned(df).count() == len(rows) and licenses.scanned(df.limit(0)).count() == 0


def test_licences_of_rows_with_one_path(spark):
    """Every row has the licence of its own text; equal rows say no more than one; a very long text is read to its end."""
    mit, plain, long = "Licensed under the MIT License.", "plain words of no one", "more of it " * 100_000 + "\nLicensed under the MIT License."
    part = mit + "\n" + "w " * 60  # less than a licence file's share once, more if it counted twice
    rows = [("a/x.py", mit), ("a/x.py", plain), ("b/y.py", part), ("b/y.py", part), ("b/z.py", ""), (None, None), (None, plain), (None, mit), ("c/l.py", long)]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "'k' AS file", "1 AS place", "2 AS notice")
    got = sorted(((str(r.path), str(r.license), r.own, r.inherited_from) for r in licenses.scanned(df).collect()), key=repr)
    assert got == sorted([
        ("a/x.py", "MIT", True, None), ("a/x.py", "MIT", False, "a"), ("b/y.py", "MIT", True, None), ("b/y.py", "MIT", True, None),
        ("b/z.py", "None", False, None), ("None", "None", False, None), ("None", "None", False, None), ("None", "MIT", True, None),
        ("c/l.py", "MIT", True, None),
    ], key=repr)


def test_license_texts_by_their_words(spark):
    """Bodies without a word of licensing, wrapped lines, versions told by full texts, and headers in comments."""
    text = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    assert not licenses.re.search("licen[sc]|spdx", text["BSD-3-Clause"], licenses.re.I)
    bsd = text["BSD-3-Clause"].split("\n\n", 1)[1].replace("copyright", "(c)")
    header = "Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this file except in\n# compliance with the License.\n# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    rows = [
        ("bsd/LICENSE", bsd), ("bsd/x.py", "print(1)"), ("gpl2/COPYING", text["GPL-2.0"]), ("gpl2/a/x.c", "int x;"), ("gpl3/COPYING", text["GPL-3.0"]),
        ("agpl/COPYING", text["AGPL-3.0"]), ("lgpl/COPYING", text["LGPL-2.1"]), ("mpl/LICENSE", text["MPL-2.0"]), ("mit/y.c", f"/*\n * {text['MIT']}*/\n" + "int main(void);\n" * 400),
        ("head/z.py", f"#!/bin/sh\n# Copyright A\n#\n# {header}\n\n" + "echo more\n" * 300), ("none/n.txt", "redistribution of land and use of forms in the two provinces\n" * 40),
        ("soft/w.c", "// Wrapped, licensed under the GNU\n// Lesser General Public License,\n// version 3.\nint y;\n"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.own) for r in licenses.scanned(df).collect()}
    assert got["bsd/LICENSE"] == ("BSD-3-Clause", True) and got["bsd/x.py"] == ("BSD-3-Clause", False)
    assert got["gpl2/COPYING"] == ("GPL-2.0", True) and got["gpl2/a/x.c"] == ("GPL-2.0", False) and got["gpl3/COPYING"] == ("GPL-3.0", True)
    assert got["agpl/COPYING"] == ("AGPL-3.0", True) and got["lgpl/COPYING"] == ("LGPL-2.1", True) and got["mpl/LICENSE"] == ("MPL-2.0", True)
    assert got["mit/y.c"] == ("MIT", True) and got["head/z.py"] == ("Apache-2.0", True) and got["soft/w.c"] == ("LGPL-3.0", True)
    assert got["none/n.txt"] == (None, False)


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [
            (1, "c1", 5, "add", '{"a": 2}', []), (1, "c2", 1, "add", '{"b":1, "a":0}', ["c1"]), (1, "c3", 2, "add", "{", ["c2", "gone"]),
            (1, "c4", 1, "sub", "{}", None), (2, "x", 1, "add", None, ["y"]), (2, "y", 1, "add", '{"a":true}', ["x"]), (1, None, 9, "add", "{}", []),
            (1, "c1", 5, "add", '{"a": 2}', []), (1, "c5", 6, "add", '{"a":1}', ["c3"]),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "c1", 9, "late"), (1, "c1", 9, "late"), (1, "c1", 6, "first"), (1, "c9", 1, "orphan"), (1, None, 1, "")], "conv_id long, call_id string, turn long, content string")
    out = toolcalls.linked(calls, results, schema).collect()
    got, rest = {r.call_id: r for r in out if r.kind == "call"}, [r for r in out if r.kind != "call"]
    assert sorted((r.kind, r.call_id, r.turn, r.n_copies, r.linked, r.valid, r.errors, r.record) for r in rest) == [
        ("further_result", "c1", 9, 2, True, False, "further result", '{"id":"c1","result":"late"}'),
        ("result_without_call", "c9", 1, 1, False, False, "result without call", '{"id":"c9","result":"orphan"}'),
    ]
    assert got["c1"].n_results == 2 and got["c2"].n_results == 0 and set(got) == {"c1", "c2", "c3", "c4", "c5", "x", "y"}
    place = {k: (r.order_turn, r.order_step, r.cyclic) for k, r in got.items()}
    assert place["c1"] == (5, 0, False) and place["c2"] == (5, 1, False) and place["c3"] == (5, 2, False) and place["c5"] == (6, 0, False)
    assert place["x"][2] and place["y"][2]
    assert got["c1"].linked and got["c1"].n_copies == 2 and not got["c2"].linked and got["c3"].n_missing == 1
    assert got["c1"].valid and got["c2"].errors == "$.b: unknown; $.a: too small" and got["y"].errors == "$.a: not integer"
    assert got["c3"].errors == got["x"].errors == "arguments are no JSON" and got["c4"].errors == "no such tool"
    assert got["c1"].record == '{"after":[],"arguments":{"a":2},"id":"c1","name":"add","result":"first"}'
    assert toolcalls.linked(calls.limit(0), results, schema).count() == 3 and toolcalls.linked(calls.limit(0), results.limit(0), schema).count() == 0


def test_calls_of_conversations_with_equal_identifiers(spark):
    """Identifiers count within a conversation; null turns and contents, and a very long text."""
    long = "word " * 200_000
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
    calls = [(c, f"call_{i}", 2 * i, "reply", json.dumps({"text": f"{c} {i}"}), [f"call_{i - 1}"] if i else None) for c in (1, 2, None) for i in (0, 1)]
    calls += [(3, "call_0", None, "reply", json.dumps({"text": long}), ["call_1"])]
    results = [(1, "call_0", 1, "one"), (2, "call_0", 1, "two"), (2, "call_0", None, None), (None, "call_1", 3, long), (3, "call_1", 3, "none asked")]
    results = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").selectExpr("*", "1 AS key", "2 AS kind")
    out = toolcalls.linked(spark.createDataFrame(calls, schema), results).collect()
    got = {(r.conv_id, r.call_id): (json.loads(r.record)["result"], r.n_copies, r.n_results, r.n_missing, r.valid) for r in out if r.kind == "call"}
    assert got == {
        (1, "call_0"): ("one", 1, 1, 0, True), (1, "call_1"): (None, 1, 0, 0, True), (2, "call_0"): (None, 1, 2, 0, True),
        (2, "call_1"): (None, 1, 0, 0, True), (None, "call_0"): (None, 1, 0, 0, True), (None, "call_1"): (long, 1, 1, 0, True),
        (3, "call_0"): (None, 1, 0, 1, True),
    }
    assert sorted((r.kind, r.conv_id, r.call_id, r.turn) for r in out if r.kind != "call") == [
        ("further_result", 2, "call_0", 1), ("result_without_call", 3, "call_1", 3)
    ]


def test_random_calls_against_brute_force(spark):
    """Places, cycles and missing calls of random graphs over several conversations, by following every dependency."""
    from random import Random

    draw = Random(7)
    calls = {(c, f"i{i}"): (draw.randrange(6), [f"i{draw.randrange(11)}" for _ in range(draw.choice((0, 0, 1, 1, 2)))]) for c in range(12) for i in range(10)}
    rows = [(c, i, t, "reply", '{"text":"x"}', a) for (c, i), (t, a) in calls.items()]
    edges = {k: {(k[0], a) for a in v[1] if (k[0], a) in calls} for k, v in calls.items()}

    def above(k):
        seen, todo = set(), list(edges[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += edges[x]
        return seen

    over = {k: above(k) for k in calls}
    loops = {k for k in calls if k in over[k]}
    # On a cycle, or between two: below one and above one.
    cyclic = loops | {k for k in calls if over[k] & loops and any(k in over[x] for x in loops)}

    def place(k):
        free = [x for x in edges[k] if not (k in cyclic and x in cyclic)]
        return max([(calls[k][0], 0)] + [(t, s + 1) for t, s in map(place, free)])

    schema = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    out = toolcalls.linked(spark.createDataFrame(rows, schema), results).collect()
    assert len(out) == len(calls)
    late_only = {}
    for r in out:
        k = (r.conv_id, r.call_id)
        late_only[k] = (r.cyclic, r.n_missing)
        if k not in cyclic and not over[k] & cyclic:
            assert (r.order_turn, r.order_step) == place(k), k
    assert late_only == {k: (k in cyclic, sum((k[0], a) not in calls for a in calls[k][1])) for k in calls}


def test_late_chains_and_cycles(spark):
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
    place = lambda rows: {
        r.call_id: (r.order_turn, r.order_step, r.cyclic)
        for r in toolcalls.linked(spark.createDataFrame([(1, i, t, "reply", "{}", a) for i, t, a in rows], schema), results).collect()
    }
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    chain = [("A", 10, []), ("B", 5, ["A"]), ("C", 6, ["B"]), ("D", 7, ["C"])]
    assert place(chain) == {"A": (10, 0, False), "B": (10, 1, False), "C": (10, 2, False), "D": (10, 3, False)}
    got = place(chain + [("x", 1, ["y"]), ("y", 2, ["z"]), ("z", 2, ["x"]), ("s", 3, ["s"]), ("w", 1, ["z", "D"])])
    assert {k for k, v in got.items() if v[2]} == {"x", "y", "z", "s"}
    assert got["D"] == (10, 3, False) and got["w"] == (10, 4, False)


def test_messages_as_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q\n\"é\""), (1, 2, "assistant", "a"), (1, 3, "user", ""), (None, 1, "user", "x"), (2, 0, "user", None), (2, 1, "assistant", None)]
    rows += [(2, 2, "assistant", "on its own")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS call_id", "2 AS content")
    got = {r.call_id: r for r in toolcalls.linked(toolcalls.calls_of(df), toolcalls.results_of(df)).collect()}
    assert set(got) == {"1:1", "1:3", "2:0", "2:1"} and got["2:1"].kind == "result_without_call" and json.loads(got["1:1"].record)["arguments"]["text"] == 'q\n"é"'
    assert got["1:1"].linked and got["1:1"].valid and not got["1:3"].linked and got["1:3"].errors == "$.text: too short"
    assert got["2:0"].linked and json.loads(got["2:0"].record)["result"] == ""
