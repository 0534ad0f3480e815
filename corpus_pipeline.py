"""A training corpus from `documents`: toxic texts out, near-duplicates to one, benchmark leaks out, secrets masked,
what is left packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null texts are empty, and stay until packing; texts of any length are taken whole; of repeated rows one stays. Rows with a
null id can't be told apart by it: the near-duplicate stage keeps them. Columns beside doc_id and text may be missing or
have any name. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, packing, secret_scan, shingle_join, toxicity
from cubeloom.llm._common import held_out, materialize, unused
from cubeloom.llm.entry import tokenizer_path, tokenizer_ranks


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is fitted on labelled rows of the stage's own input."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out("doc_id", 5, 0))
    (score,) = unused(docs, "_toxic")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash or by 0.8 or more of their 5-word shingles the document with the least id stays: of
    several texts under that id the one with the least hash, of rows alike in both the one with the least hash."""
    text_hash, row_hash = unused(docs, "_text_hash", "_row_hash")
    found = shingle_join.near_copies(docs).where(F.col("doc_id").isNotNull())
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.doc_id", F.col("f.text_hash").alias(text_hash)).distinct()
    kept = docs.withColumn(text_hash, F.xxhash64("text")).join(first, ["doc_id", text_hash], "left_semi")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    one = kept.withColumn(row_hash, F.xxhash64(*plain)).groupBy("doc_id", text_hash).agg(F.min_by(F.struct(*docs.columns), F.col(row_hash)).alias(row_hash))
    return one.select(f"{row_hash}.*").unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item to 0.8 or more go."""
    (hits,) = unused(docs, "_hits")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col=hits)
    return found.where(F.size(hits) == 0).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [SECRET]; n_chars follows where it is a column. Every document stays."""
    forest = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    (secrets,) = unused(docs, "_secrets")
    path = "source" if "source" in docs.columns else None
    masked = secret_scan.redact(secret_scan.scan(docs, forest, path_col=path, out=secrets), secrets_col=secrets)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, in sequences of 1024 tokens."""
    pieces = packing.tokenize_pieces(docs, tokenizer_path(), capacity=1024, **tokenizer_ranks())
    slim = pieces.select("task", F.col("doc").alias("doc_id"), "piece", "start", "length", "local_rank", F.crc32("ids").alias("ids_crc32"))
    placed = packing.place_pieces(slim, capacity=1024)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No SQL can express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
