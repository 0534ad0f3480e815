"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, language, packing, quality, secret_scan, simhash, substring_repeats, topk, toxicity, window_repeats
from cubeloom.llm._common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_ranks() -> dict[str, str]:
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, coverage, longest): each document and the benchmark items it holds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")).where(F.size("contamination") > 0)
    hit = found.select("doc_id", F.explode("contamination").alias("c"))
    return hit.select("doc_id", F.col("c.item").alias("item_id"), F.round("c.coverage", 6).alias("coverage"), F.col("c.longest").alias("longest"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    contents = language.fit_languages(docs, where=~held_out("doc_id", 4, 2))
    rows = language.identify_language(docs.select("doc_id", "text"), contents)
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, **tokenizer_ranks())
    slim = pieces.select("task", F.col("doc").alias("doc_id"), "piece", "start", "length", "local_rank", F.crc32("ids").alias("ids_crc32"))
    placed = packing.place_pieces(slim, capacity=1024)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, kind, value_sha256, score): each secret found, in whole texts."""
    forest = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan(docs, forest, path_col="source").select("doc_id", F.explode("secrets").alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start"), F.length("s.value").alias("length"), F.col("s.kind").alias("kind"), F.sha2("s.value", 256).alias("value_sha256"), F.round("s.score", 6).alias("score"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_repeats.find_repeats(_table(spark, sf_dir, "documents"), width=50)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"), where=~held_out("doc_id", 4, 2))
    rows = quality.score_quality(docs, model)
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_repeats.find_repeats(_table(spark, sf_dir, "documents"), width=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), where=~held_out("doc_id", 5, 0))
    rows = toxicity.score_toxicity(docs, model)
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_decontamination, op2_language, op3_packing, op4_topk, op5_simhash, op6_secrets, op7_suffix_dedup, op8_quality, op9_window_dedup, op10_toxicity)
    return {f.__name__: f for f in made}


#: Only where SQL runs over whole tables in reasonable time; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
