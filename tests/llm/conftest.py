import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside.
CLASHES = ("size", "token", "doc", "part", "failed", "n_words", "place", "key", "copies", "ids", "hash", "own", "n", "_row")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest benchmark documents, as a frame and as {doc_id: row}."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r["doc_id"]: r for r in df.collect()}


LONG = "".join(f"word{i} " for i in range(60_000))
BASE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash."""
    rows = [
        (1, BASE, "en", "a", 5), (1, BASE, "en", "a", 5), (2, BASE, None, None, None), (3, None, "en", "b", 0),
        (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (None, BASE, "en", "a", 1), (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)), (7, "one", "en", "c", 3), (8, "é ▁ \x01 漢字\n漢字\n", "zz", "c", 9), (9, BASE + " more", "en", "a", 9),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for c in CLASHES:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df.cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
