"""Quality rules as a bitmask ledger: every rule is evaluated once per document, policies only read the bits.

A ledger row holds the measurements of a document and ``failed``, a bitmask of the rules it breaks. A policy is a named,
versioned mask: a document is kept if it breaks none of the policy's rules. Ablations need the ledger only, grouped by
its bitmask. Everything is a built-in expression per row; nothing is shuffled but the counts of an ablation.

Nulls and empties: a null text counts as empty; both have no words and break ``few_words``. Ties and repeated rows are
judged row by row. Columns of the input with the names of measurements are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE

_BLANK = " \t\n\x0b\f\r"
_PLACE_BITS = 23  # of a packed window: its place among the text's windows
_PLACES = (1 << _PLACE_BITS) - 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """What a document breaks the rule by, on the measurements."""

    name: str
    breaks: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


BASE = Policy("base", 1, mask_of("few_words", "repeats"))
CORPUS = Policy("corpus", 1, mask_of(*BIT))


def _same_above(x: Column, y: Column) -> Column:
    """Whether two packed windows agree in all bits but those of the place."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), _PLACE_BITS) == 0


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of its text.

    Words in repeated three-word windows: windows are hashed to 64 bits, packed with their place, and sorted as plain
    longs; neighbours that agree are candidates, and only these are compared by their whole hashes. Texts of more windows
    than a place can name go straight to the second comparison.
    """
    plain = docs.drop(*MEASURES).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    trimmed = F.btrim("_text", F.lit(_BLANK))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    first = plain.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)),
            "_lines": lines,
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_capitals": F.regexp_count("_text", F.lit("[A-Z]")).cast("long"),
        }
    ).drop("_text")
    window = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    second = first.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_window": F.slice(window, 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        }
    ).drop("_words", "_lines")
    packed = F.transform("_window", lambda h, i: h.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(i.cast("long").bitwiseAND(_PLACES)))
    third = second.withColumn("_sorted", F.when(F.size("_window") <= _PLACES, F.sort_array(packed)))
    near = F.filter(
        "_sorted",
        lambda x, i: _same_above(x, F.get("_sorted", i + 1)) | ((i > 0) & _same_above(x, F.get("_sorted", i - 1))),
    )
    places = F.when(F.size("_window") <= _PLACES, F.transform(near, lambda x: x.bitwiseAND(_PLACES).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.size("_window") - 1)
    )
    fourth = third.withColumn(
        "_named", F.sort_array(F.transform(places, lambda p: F.struct(F.get("_window", p).alias("h"), p.alias("p"))))
    )
    twice = F.filter(
        "_named",
        lambda e, i: (e["h"] == F.get("_named", i + 1)["h"]) | ((i > 0) & (e["h"] == F.get("_named", i - 1)["h"])),
    )
    fifth = fourth.withColumn("_repeats", F.sort_array(F.transform(twice, lambda e: e["p"])))
    covered = F.transform("_repeats", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_repeats", i + 1) - p, F.lit(3))))
    return fifth.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x)
    ).drop("_window", "_sorted", "_named", "_repeats")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failed``, the bitmask of the rules that each row breaks."""
    bits = [F.when(F.expr(rule.breaks), F.lit(BIT[rule.name])).otherwise(0) for rule in RULES]
    return measured(docs.drop("failed"), text).withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def breaks(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(policy.mask) != 0


def passing(book: DataFrame, policy: Policy) -> DataFrame:
    """The rows of a ledger that the policy keeps.

    The optimizer would carry the condition down to the text and write every measurement out once more for each place
    that reads it, many times over. It doesn't go below a column like ``_row``, which depends on where the row is.
    """
    held = book.withColumn("_row", F.monotonically_increasing_id())
    return held.where((F.col("_row") >= 0) & ~breaks(policy)).drop("_row")


def kept(docs: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    clash = [c for c in docs.columns if c in (*MEASURES, "failed", "_row")]
    held = docs.withColumn("_held", F.struct(*[F.col(f"`{c}`") for c in clash])) if clash else docs
    out = passing(ledger(held.drop("_row")), policy)
    return out.select(*[(F.col("_held")[c] if c in clash else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents it breaks, those that only it rejects, and documents kept without the rule.

    The ledger is summed per bitmask first; there are at most 2 ** rules of them.
    """
    masks = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & policy.mask]
    each = masks.select("failed", "n", F.inline(F.array(*rules)))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    inside = F.col("failed").bitwiseAND(policy.mask)
    return each.groupBy("rule").agg(
        count(inside.bitwiseAND(F.col("bit")) != 0).alias("n_broken"),
        count(inside == F.col("bit")).alias("n_only"),
        count((inside == 0) | (inside == F.col("bit"))).alias("n_kept_without"),
    )
