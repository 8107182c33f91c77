"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import digest, dropout, ledger, licenses, lines, mixing, multiindex, negatives, pages, sigtree, toolcalls, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: below 100 at the top of their source, below 1,000 in the folder of their language, else one deeper."""
    lang, block = F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string")
    folders = F.when(F.col("doc_id") < 100, F.array()).when(F.col("doc_id") < 1000, F.array(lang)).otherwise(F.array(lang, block))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), folders, name)
    found = licenses.scanned(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"(-?[0-9]+)[.]txt$", 1).cast("long"))


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.neighbours(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "like_toxic", "like_clean",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("own.doc_id", "n_lines", "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ledger.breaks(ledger.BASE).alias("base_failed"),
        (~ledger.breaks(ledger.CORPUS)).alias("kept"), "failed",
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return toolcalls.linked(toolcalls.calls_of(messages), toolcalls.results_of(messages))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dropout.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "lossless")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.linked(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has a wrong label, every fiftieth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fitted(vectors))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_digest": op2_digest,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_mix_sources": op6_mix_sources,
    "op7_tool_calls": op7_tool_calls,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_main_text": op10_main_text,
    "op11_multi_index": op11_multi_index,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

# Exact integer products as sums of doubles, which hold them; positives by rank, then the window below each of them.
OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label,
         list_transform(embedding, lambda c: FLOOR(256 * CAST(c AS DOUBLE))) x
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (
  SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_dot_product(a.x, b.x) AS BIGINT) score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (
  SELECT anchor_id, vec_id positive_id, score positive_score FROM scores WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) "rank",
       s.vec_id negative_id, p.positive_score, s.score negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY "rank" <= 3
"""

# Every pair of a label; the component as the smallest row reachable. The index may miss one in a thousand of the links,
# and does so on no table that is small enough for this.
OP11_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id u, b.vec_id v FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id u, vec_id v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, MIN(v) component_id FROM reach GROUP BY u),
counts AS (SELECT u, COUNT(*) n FROM links GROUP BY u)
SELECT e.vec_id, COALESCE(c.n, 0) n_links, l.component_id, e.vec_id = l.component_id kept
FROM embeddings e JOIN least l ON l.u = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""

ORACLES: dict[str, str] = {"op11_multi_index": OP11_SQL, "op12_hard_negatives": OP12_SQL}
