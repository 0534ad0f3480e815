"""Forests: trees are rows of a small table of boxes; entities carry a tree_id. Partitions, ghosts, balance, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import geom, keys
from cubeloom.operators import index

P, LOW, HIGH = index.P, index.LOW, index.HIGH
MOST_TREES = 10_000  # trees that are broadcast


def small(df: DataFrame, most: int = MOST_TREES) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def grid_tree(origin, cell, counts) -> Column:
    """Tree number of a point in a grid of trees; null outside (the upper faces are outside)."""
    out, inside = F.lit(0).cast("long"), F.lit(True)
    for axis, o, c, n in zip(P, origin, cell, counts, strict=True):
        i = F.floor((F.col(axis) - float(o)) / float(c)).cast("long")
        inside = inside & (i >= 0) & (i < n)
        out = out * n + i
    return F.when(inside, out)


def route(trees: DataFrame, box) -> DataFrame:
    """Trees whose box overlaps the query's."""
    low, high = tuple(map(repr, map(float, box[:3]))), tuple(map(repr, map(float, box[3:])))
    return trees.where(F.expr(geom.boxes_overlap(LOW, HIGH, low, high)))


def coverage(df: DataFrame) -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in P]
    return df.groupBy("tree_id").agg(F.count("*").alias("n"), *ends)


def density_actions(df: DataFrame, trees: DataFrame, most: int, least: int, density: float) -> DataFrame:
    """(tree_id, n, density, action): split over the count or density limit, merge under both lower ones, else keep."""
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    counts = df.groupBy("tree_id").agg(F.count("*").alias("n"))
    out = trees.join(counts, "tree_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("density", F.col("n") / volume)
    action = F.when((F.col("n") > most) | (F.col("density") > density), "split").when((F.col("n") < least) & (F.col("density") < 0.1 * density), "merge").otherwise("keep")
    return out.select("tree_id", "n", "density", action.alias("action"))


def load_class(df: DataFrame, high: float = 1.5, low: float = 0.5) -> DataFrame:
    """(tree_id, n, load): over or under the average by a factor. One row a tree meets the average: no window over all."""
    counts = df.groupBy("tree_id").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("_mean"))
    load = F.when(F.col("n") > F.col("_mean") * high, "over").when(F.col("n") < F.col("_mean") * low, "under").otherwise("even")
    return counts.crossJoin(F.broadcast(mean)).select("tree_id", "n", load.alias("load"))


def migration_plan(loads: DataFrame) -> DataFrame:
    """(source, target): the k-th most over-loaded tree sends to the k-th least loaded one. Trees are few."""
    over = loads.where("load = 'over'").withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "tree_id")))
    under = loads.where("load = 'under'").withColumn("k", F.row_number().over(Window.orderBy("n", "tree_id")))
    half = F.floor((F.col("a.n") - F.col("b.n")) / 2).cast("long")
    return over.alias("a").join(under.alias("b"), "k").select(F.col("a.tree_id").alias("source"), F.col("b.tree_id").alias("target"), half.alias("entities"))


def connections(trees: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(a < b, kind, distance): trees whose boxes touch: by how many axes of the common box are flat, OVERLAP, FACE, EDGE
    or VERTEX; distance is between centres."""
    a = trees.select(F.col("tree_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in (*LOW, *HIGH)))
    b = trees.select(F.col("tree_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in (*LOW, *HIGH)))
    sides = [tuple(f"{s}_{c}" for c in part) for s in "ab" for part in (LOW, HIGH)]
    flat = " + ".join(f"CASE WHEN least({h1}, {h2}) - greatest({l1}, {l2}) < {eps!r} THEN 1 ELSE 0 END" for l1, h1, l2, h2 in zip(*sides, strict=True))
    centre = [tuple(f"(({lo} + {hi}) / 2)" for lo, hi in zip(low, high, strict=True)) for low, high in (sides[:2], sides[2:])]
    met = a.join(small(b), F.expr(f"a < b AND {geom.boxes_overlap(*sides)}"))
    kind = F.get(F.array(*map(F.lit, ("OVERLAP", "FACE", "EDGE", "VERTEX"))), F.expr(flat))
    return met.select("a", "b", kind.alias("kind"), F.expr(geom.dist(*centre)).alias("distance"))


def ghosts(df: DataFrame, trees: DataFrame, width: float) -> DataFrame:
    """(id, source, target, distance): entities of a tree that are within `width` of another tree's box."""
    t = trees.select(F.col("tree_id").alias("target"), *LOW, *HIGH)
    d = geom.box_distance(P, LOW, HIGH)
    met = df.select("id", *P, F.col("tree_id").alias("source")).join(small(t), F.expr(f"source <> target AND {d} <= {width!r}"))
    return met.select("id", "source", "target", F.expr(d).alias("distance"))


def ghost_cells(cells: DataFrame, level: int, kind: str = "face") -> DataFrame:
    """(cell, owner, ghost_of): cells (cell, owner) that a neighbour cell of another owner needs as ghosts."""
    near = cells.withColumn("_n", F.explode(keys.neighbour_codes("cell", level, kind))).select(F.col("_n").alias("cell"), F.col("owner").alias("ghost_of"))
    return cells.join(near, "cell").where("owner <> ghost_of").select("cell", "owner", "ghost_of").distinct()


def balance_violations(leaves: DataFrame, last: int) -> DataFrame:
    """(level, cell, other_level, other_cell): face neighbours among leaves whose levels differ by more than one: the
    finer one's neighbour place lies in a coarser leaf."""
    out = None
    for level in range(2, last + 1):
        fine = leaves.where(F.col("level") == level).withColumn("_n", F.explode(keys.neighbour_codes("cell", level, "face")))
        for up in range(2, level + 1):
            coarse = leaves.where(F.col("level") == level - up).select(F.col("level").alias("other_level"), F.col("cell").alias("other_cell"))
            met = fine.withColumn("other_cell", F.shiftright("_n", 3 * up)).join(coarse, "other_cell").select("level", "cell", "other_level", "other_cell").distinct()
            out = met if out is None else out.unionByName(met)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node of each component by label propagation with pointer jumping, until nothing changes."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("m"))
        new = labels.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        hop = new.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = new.join(hop, F.col("root") == F.col("_n"), "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root")).checkpoint()
        changed = new.join(labels.withColumnRenamed("root", "_old"), "node").where("root <> _old").limit(1).count()
        labels = new
        if not changed:
            return labels


def hops(edges: DataFrame, start, most: int | None = None) -> DataFrame:
    """(node, hops): breadth-first distances from a node, to all that it reaches or to `most` hops."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], f"node {dict(both.dtypes)['u']}, hops int")
    frontier = seen
    k = 0
    while most is None or k < most:
        k += 1
        step = frontier.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
