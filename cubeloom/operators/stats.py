"""Statistics of cells and partitions, thresholds, clusters, refinement, deduplication of subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.functions import geom, keys
from cubeloom.operators import index

P = index.P


def entity_stats(df: DataFrame, level: int) -> DataFrame:
    """One row: nodes, entities, references, per_node, span."""
    cells = index.spanning_cells(df, level) if "min_x" in df.columns else index.with_cell(df, level)
    got = cells.agg(F.count_distinct("cell").alias("nodes"), F.count_distinct("id").alias("entities"), F.count("*").alias("refs"))
    return got.select("*", (F.col("refs") / F.col("nodes")).alias("per_node"), (F.col("refs") / F.col("entities")).alias("span"))


def merge_threshold(level, capacity: int, factor: float = 0.25) -> Column:
    return F.floor(capacity * factor * F.greatest(F.lit(0.5), 1 - 0.02 * keys.col(level))).cast("int")


def split_threshold(level, capacity: int, factor: float = 0.9) -> Column:
    return F.floor(capacity * factor * F.greatest(F.lit(0.7), 1 - 0.01 * keys.col(level))).cast("int")


def balance_stats(cells: DataFrame, capacity: int) -> DataFrame:
    """One row of (level, cell, n): nodes under and over their thresholds, the mean load and its population variance."""
    under, over = F.col("n") < merge_threshold("level", capacity), F.col("n") > split_threshold("level", capacity)
    return cells.agg(F.count("*").alias("nodes"), F.count_if(under).alias("under"), F.count_if(over).alias("over"), F.avg("n").alias("mean_load"), F.var_pop("n").alias("variance"))


def slice_density(df: DataFrame, z_low: float, z_high: float, cell: float) -> DataFrame:
    """(ix, iy, n): points of a slab on a square grid."""
    return df.where(F.col("z").between(z_low, z_high)).groupBy(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy")).agg(F.count("*").alias("n"))


def bounding_box(df: DataFrame) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in P))


def k_means(df: DataFrame, seeds: list[tuple[float, float, float]], rounds: int = 5) -> list[tuple[float, float, float]]:
    """Centres after `rounds` of Lloyd's iteration from given seeds; ties go to the first centre; an empty cluster keeps
    its centre. Each round is one aggregation of the points; the centres are the only state."""
    centres = list(seeds)
    for _ in range(rounds):
        rows = assign(df, centres).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in P)).collect()
        for r in rows:
            centres[r["cluster"]] = (r["x"], r["y"], r["z"])
    return centres


def assign(df: DataFrame, centres) -> DataFrame:
    """df with cluster (the nearest centre) and its distance."""
    d = [F.expr(geom.dist(P, tuple(map(repr, map(float, c))))) for c in centres]
    best = F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(k).alias("k")) for k, x in enumerate(d))))
    return df.withColumn("_best", best).withColumn("cluster", F.col("_best.k")).withColumn("cluster_distance", F.col("_best.d")).drop("_best")


def coherence(clustered: DataFrame, reach: float) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg("cluster_distance") / reach)).alias("coherence"))


def affinity(pairs: DataFrame) -> DataFrame:
    """(region, affinity, class) of interactions (region, other): the share within the region; 0.5 without any."""
    got = pairs.groupBy("region").agg(F.count_if(F.col("region") == F.col("other")).alias("i"), F.count("other").alias("n"))
    a = F.when(F.col("n") == 0, 0.5).otherwise(F.col("i") / F.col("n"))
    return got.select("region", a.alias("affinity"), F.when(a < 0.5, "drifting").when(a <= 0.8, "boundary").otherwise("core").alias("class"))


def grid_refinement(cells: DataFrame, refine: float, coarsen: float) -> DataFrame:
    """(ix, iy, iz, value) with error (the largest difference to a face neighbour) and action."""
    steps = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("abc", o, strict=True))) for o in keys.offsets("face")))
    near = cells.withColumn("_o", F.explode(steps)).select((F.col("ix") + F.col("_o.a")).alias("ix"), (F.col("iy") + F.col("_o.b")).alias("iy"), (F.col("iz") + F.col("_o.c")).alias("iz"), F.col("value").alias("other"))
    ends = near.groupBy("ix", "iy", "iz").agg(F.min("other").alias("_lo"), F.max("other").alias("_hi"))
    out = cells.join(ends, ["ix", "iy", "iz"], "left").withColumn("error", F.coalesce(F.greatest(F.abs(F.col("value") - F.col("_lo")), F.abs(F.col("value") - F.col("_hi"))), F.lit(0.0)))
    return out.withColumn("action", F.when(F.col("error") > refine, "refine").when(F.col("error") < coarsen, "coarsen").otherwise("keep")).drop("_lo", "_hi")


def subtree_classes(occupied: DataFrame, last: int, first: int = 0) -> DataFrame:
    """(level, classes, nodes): distinct subtree shapes of each level over occupied leaf cells (cell of level `last`):
    bottom-up, a node's signature is the hash of its children's octants and signatures, so equal subtrees are one."""
    level_nodes = occupied.select("cell").distinct().withColumn("signature", F.lit("leaf"))
    out = None
    for level in range(last, first - 1, -1):
        row = level_nodes.agg(F.count_distinct("signature").alias("classes"), F.count("*").alias("nodes")).select(F.lit(level).alias("level"), "classes", "nodes")
        out = row if out is None else out.unionByName(row)
        child = F.struct(F.col("cell").bitwiseAND(F.lit(7)).alias("o"), F.col("signature").alias("s"))
        grouped = level_nodes.groupBy(F.shiftright("cell", 3).alias("cell")).agg(F.sort_array(F.collect_list(child)).alias("c"))  # eight at most
        level_nodes = grouped.select("cell", F.sha2(F.to_json("c"), 256).alias("signature"))
    return out


def duplicates(df: DataFrame) -> DataFrame:
    """(id, regions): entities found in two regions or more."""
    return df.groupBy("id").agg(F.count_distinct("region").alias("regions")).where("regions >= 2")


def reconcile(df: DataFrame, log: DataFrame) -> DataFrame:
    """df (id, region) without the copies outside the source region of an entity's latest log record (id, source, seq);
    entities without a record keep all their copies."""
    last = log.groupBy("id").agg(F.max_by("source", "seq").alias("_keep"))
    return df.join(last, "id", "left").where(F.col("_keep").isNull() | (F.col("_keep") == F.col("region"))).drop("_keep")
