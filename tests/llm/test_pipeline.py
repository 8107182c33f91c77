"""The pipeline's stages on the sample, and its result against the stages' brute-force counterparts."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from depotlens.llm import dropout, lines, mixing, sigtree
from depotlens.llm.common import written

from .conftest import SF
from .test_duplicates import expected_components, kept_lines
from .test_ledger_and_mixing import measures

ROOT = Path(__file__).parents[2]


def quality_kept(text):
    n, chars, symbols, dup, repeats = measures(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    capitals = sum("A" <= c <= "Z" for c in text or "")
    return not (
        n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or 2 * capitals > chars or 2 * dup > len(lines) or not 2 * n <= chars <= 15 * n
    )


def test_stages_and_result(spark, sample):
    df, rows = sample
    now = [(i, r["text"]) for i, r in rows.items() if quality_kept(r["text"])]
    now = [(i, t) for i, t in kept_lines(now, 20) if t.split()]
    of = expected_components(now)
    now = [(i, t) for i, t in now if of[i][1] == i]
    frame = spark.createDataFrame([(i, t, rows[i]["source"]) for i, t in now], "doc_id long, text string, source string")
    taken = sorted((r.doc_id, r.text) for r in mixing.taken(frame).collect())
    want = sorted((r.doc_id, tuple(r.ids)) for r in dropout.encoded(spark.createDataFrame(taken, "doc_id long, text string")).collect())
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and got


def test_stages_return_the_columns_of_documents(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def python_steps_in_one_stage(df):
    """The most Python steps that one task of ``df`` runs, by its plan before it is run."""
    above, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"\w", line).start()
        above = [(d, name) for d, name in above if d < depth] + [(depth, re.match(r"\W*(\w+)", line)[1])]
        names = [name for _, name in above]
        last = max((i for i, name in enumerate(names) if "Exchange" in name), default=0)
        most = max(most, names[last:].count("MapInArrow"))
    return most


def test_no_stage_has_workers_of_two_python_steps(spark, monkeypatch):
    """Small tables are sent to all tasks, which must not put two steps with Python workers into one stage."""
    base = [f"line {i} of a text with its own words {i * 7} and {i * 13}" for i in range(60)]
    docs = [(i, "\n".join([*base[:40], f"line {i} stands here alone"]), "en", "a", 0) for i in range(6)]
    docs += [(i, "\n".join(x[:-1] + "x" for x in base), "en", "b", 0) for i in range(6, 9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs = written(docs, "few-docs")
    seen = {}

    def noted(df, name):
        seen.setdefault(name, []).append(python_steps_in_one_stage(df))
        return written(df, name)

    monkeypatch.setattr(lines, "written", noted)
    monkeypatch.setattr(sigtree, "written", noted)
    assert python_steps_in_one_stage(lines.without_repeats(docs)) == 1
    assert python_steps_in_one_stage(sigtree.without_copies(docs)) <= 1
    assert max(seen["lines-near"]) == max(seen["sets"]) == max(seen["sifted-pairs"]) == 1, seen
    assert all(most <= 1 for found in seen.values() for most in found), seen


def test_budgets_need_no_python_worker(spark):
    sized = spark.createDataFrame([("a", 10), (None, 4)], "source string, size long")
    budget = mixing.budget_table(sized, (3, 1, 2), 150, 2)
    assert budget.dtypes == [("source", "string"), ("source_size", "bigint"), ("target", "double")]
    assert "PythonRDD" not in budget._jdf.queryExecution().toRdd().toDebugString()
    assert sorted(map(tuple, budget.collect()), key=str) == [("a", 10, 15.75), (None, 4, 5.25)]


KEPT_BY_A_WORKER = """
import random, re
from types import SimpleNamespace
import pyarrow as pa
from depotlens.llm import common, dropout

class Docs:
    sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda name: "2000"))
    def mapInArrow(self, function, schema):
        return function

def held():
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

draw = random.Random(3)
words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 12))) for _ in range(60_000)]
batches = [pa.record_batch({"doc_id": [i], "text": [" ".join(draw.choices(words, k=50_000))]}) for i in range(6)]
run = common.arrow(Docs(), dropout._encoder(dropout.vocabulary(dropout.PIECE_BPE_32K), 0, 1, 0.1), "")
before = held()
assert sum(len(out) for out in run(iter(batches))) == 6
print(held() - before)
"""


def test_a_worker_gives_memory_back_when_its_task_ends():
    """Workers wait for later tasks, while the JVM beside them needs the room."""
    done = subprocess.run([sys.executable, "-c", KEPT_BY_A_WORKER], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 30, f"{done.stdout.strip()} MB stay with an idle worker"
