"""Exact top-k search: tiled matrix products, a partial selection per tile, and a tree merge of the best lists.

Component x of a vector becomes floor(256 * x). Candidates are dealt to shards and queries to groups by a hash of their
id, both of bounded bytes; a (shard, group) cell multiplies its query matrix with its candidate matrix tile by tile and
keeps each query's k best of the tile. The lists of a query then merge in rounds of bounded fan-in.

Scores are exact integers: products run in float64 while every partial sum is below 2^53, else in Python integers. A
score that 64 bits can't hold is given, and ranked, as the nearest that they can. Ids are integers or text that reads as such.
Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part. Vectors of
different lengths have no product and never meet. Ties go to the smaller id; a row is no candidate of the query with
its own id; repeated ids are ranked as separate candidates. A query with no candidate has no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD = 32 << 20  # bytes of candidates of a shard, about
GROUP = 32 << 20  # bytes of queries of a group, about
LEAST = 2_048  # candidates of a shard while there are fewer shards than cores
TILE = 1024
FAN = 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): floor(256 * x) as a list of doubles, rows that take part only."""
    x = F.col(vector_col).cast("array<double>")
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are whole
    scaled = lambda e: whole(F.greatest(F.least(e * 256.0, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(x, scaled).alias("v"), x.alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad).select("id", F.size("v").alias("dim"), "v")


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """Rows (query, candidate, score): the k best of each query, ties to the smaller id, its own id left out."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= 2.0**53
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    for a in range(0, len(q_ids), TILE):
        ids = q_ids[a : a + TILE]
        lists = []
        for b in range(0, len(c_ids), 8 * TILE):
            part = c_ids[b : b + 8 * TILE]
            if exact:
                big = [[int(x) for x in row] for row in c[b : b + 8 * TILE]]
                score = np.array([[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in big] for row in q[a : a + TILE]], dtype=object)
            else:
                score = q[a : a + TILE] @ c[b : b + 8 * TILE].T
            own = part[None, :] == ids[:, None]
            for r in range(len(ids)):
                line, at = score[r], np.flatnonzero(~own[r])
                if len(at) > k:
                    least = np.partition(line[at], len(at) - k)[len(at) - k]
                    at = at[line[at] >= least]
                for j in at[np.argsort(-line[at], kind="stable")[:k]]:
                    lists.append((ids[r], part[j], max(-(1 << 63), min((1 << 63) - 1, int(line[j])))))
        yield pd.DataFrame(lists, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best candidates among vectors."""
    c, q = quantised(vectors, id_col, vector_col), quantised(queries, id_col, vector_col)
    rows, numbers = c.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, -(-8 * numbers // SHARD), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST)))
    groups = max(1, -(-8 * (q.agg(F.sum("dim")).first()[0] or 0) // GROUP))
    c = c.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = q.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dim", "shard", "group"]

    def cell(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(left) or not len(right):
            return empty
        made = list(_best(left["id"].to_numpy(), np.stack(left["v"].to_list()), right["id"].to_numpy(), np.stack(right["v"].to_list()), k))
        merged = pd.concat(made, ignore_index=True) if made else empty
        merged = merged.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return merged.groupby("query_id", sort=False).head(k)

    types = {c: t for c, t in (("dim", "int"), ("shard", "long"), ("group", "long"))}
    q = q.select("id", "v", *(F.col(x).cast(t) for x, t in types.items()))
    c = c.select("id", "v", *(F.col(x).cast(t) for x, t in types.items()))
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long")
    lists = shards
    while lists > FAN:  # merge FAN lists of a query at a time
        lists = -(-lists // FAN)
        part = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(lists))).orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
