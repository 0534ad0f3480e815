"""Entities over the driver's tables: points (events, orders, customers), boxes (parts) and vectors (embeddings).

Each view exists twice: as a DataFrame, and as the SQL text of a common table expression for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where none is set: spark.checkpoint.dir, or a folder of this machine on a local master."""
    if spark.sparkContext.getCheckpointDir():
        return
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp()
    spark.sparkContext.setCheckpointDir(found)


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros("ts") - EPOCH_US
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (us / 1e6 / 2000).alias("z"), us.alias("us"), F.col("event_type").alias("kind"), "user_id")


EVENTS = f"ev AS (SELECT event_id AS id, value AS x, CAST(user_id AS DOUBLE) AS y, (epoch_us(ts) - {EPOCH_US}) / 1e6 / 2000 AS z, epoch_us(ts) - {EPOCH_US} AS us, event_type AS kind, user_id FROM events)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 250).alias("x"), days.alias("y"), F.col("o_custkey").cast("double").alias("z"), F.col("o_orderstatus").alias("kind"))


ORDERS = "od AS (SELECT o_orderkey AS id, o_totalprice / 250 AS x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, CAST(o_custkey AS DOUBLE) AS z, o_orderstatus AS kind FROM orders)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = 1 + F.col("p_size") % 10
    centre = [F.col("p_size") * 20.0, (F.col("p_retailprice") - 900) * 10, (F.col("p_partkey") % 1000).cast("double")]
    boxes = [(c - half).alias(f"min_{n}") for c, n in zip(centre, "xyz", strict=True)] + [(c + half).alias(f"max_{n}") for c, n in zip(centre, "xyz", strict=True)]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(n) for c, n in zip(centre, "xyz", strict=True)), half.cast("double").alias("half"), *boxes, F.col("p_brand").alias("kind"))


PARTS = (
    "pt AS (SELECT id, x, y, z, half, x - half AS min_x, y - half AS min_y, z - half AS min_z, x + half AS max_x, y + half AS max_y, z + half AS max_z, kind FROM "
    "(SELECT p_partkey AS id, p_size * 20.0::DOUBLE AS x, (p_retailprice - 900) * 10 AS y, CAST(p_partkey % 1000 AS DOUBLE) AS z, CAST(1 + p_size % 10 AS DOUBLE) AS half, p_brand AS kind FROM part))"
)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1000).alias("x"), F.col("c_custkey").cast("double").alias("y"), (F.col("c_nationkey") * 40.0).alias("z"), F.col("c_mktsegment").alias("kind"))


CUSTOMERS = "cu AS (SELECT c_custkey AS id, c_acctbal + 1000 AS x, CAST(c_custkey AS DOUBLE) AS y, c_nationkey * 40.0::DOUBLE AS z, c_mktsegment AS kind FROM customer)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("kind"))


VECTORS = "ve AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v, label AS kind FROM embeddings)"


def sql_morton(x: str, y: str, z: str, bits: int = 21) -> str:
    """Interleaving by adding bits one by one."""
    terms = [f"((((({c}) >> {b}) & 1)) << {3 * b + k})" for b in range(bits) for k, c in enumerate((x, y, z))]
    return "(" + " + ".join(terms) + ")"


def sql_index(v: str, level: int) -> str:
    return f"CAST(floor(({v}) / {1 << (21 - level)}) AS BIGINT)"


def sql_cell(x: str, y: str, z: str, level: int) -> str:
    return sql_morton(sql_index(x, level), sql_index(y, level), sql_index(z, level), max(1, level))


def sql_compact(code: str, axis: int, bits: int = 21) -> str:
    return "(" + " + ".join(f"((({code}) >> {3 * b + axis} & 1) << {b})" for b in range(bits)) + ")"
