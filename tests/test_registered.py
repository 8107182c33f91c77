"""Every registered query against its SQL counterpart, on the smallest benchmark tables."""

import os
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module
from tools.check import compare

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_every_query_has_a_counterpart():
    named = re.compile(r"op\d+_|pipeline$")  # tested by brute force where SQL can't express them
    assert {q for q in QUERIES if not named.match(q)} <= set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) == []
