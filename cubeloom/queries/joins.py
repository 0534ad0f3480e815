"""Collisions, neighbour and ghost joins, forests and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.functions import geom, keys
from cubeloom.operators import collide, forest, index
from cubeloom.queries import REGISTRY
from cubeloom.views import EVENTS, ORDERS, PARTS, sql_cell

add = REGISTRY.add
P, LOW, HIGH = index.P, index.LOW, index.HIGH

_PD = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _rounded(*columns: str) -> list:
    return [F.expr(geom.rounded(c)).alias(c) for c in columns]


@add(f"WITH {EVENTS} SELECT a.id AS id1, b.id AS id2, round({_PD}, 6) AS distance, round(CASE WHEN {_PD} = 0 THEN 0 ELSE 2 - {_PD} END, 6) AS depth, round((a.x + b.x) / 2, 6) AS contact_x FROM ev a JOIN ev b ON a.id < b.id AND a.y BETWEEN b.y - 2 AND b.y + 2 AND {_PD} <= 2")
def collide_points(spark, sf):
    got = collide.point_pairs(views.events(spark, sf), reach=2.0)
    return got.select("id1", "id2", *_rounded("distance", "depth", "contact_x"))


_SIDE = [tuple(f"{s}.{c}" for c in part) for s in "ab" for part in (LOW, HIGH)]
_BOXES = (
    f"WITH {PARTS}, p AS (SELECT a.id AS id1, b.id AS id2, a.x AS ax, b.x AS bx, " + ", ".join(f"a.max_{c} - b.min_{c} AS p{c}, b.max_{c} - a.min_{c} AS n{c}, (greatest(a.min_{c}, b.min_{c}) + least(a.max_{c}, b.max_{c})) / 2 AS c{c}" for c in "xyz")
    + " FROM pt a JOIN pt b ON a.id < b.id AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y AND a.min_z <= b.max_z AND b.min_z <= a.max_z), "
    "d AS (SELECT *, least(px, nx, py, ny, pz, nz) AS depth FROM p) "
)
_BOX_COLS = "id1, id2, round(cx, 6) AS contact_x, round(cy, 6) AS contact_y, round(cz, 6) AS contact_z, round(depth, 6) AS depth, CASE depth WHEN px THEN '+X' WHEN nx THEN '-X' WHEN py THEN '+Y' WHEN ny THEN '-Y' WHEN pz THEN '+Z' ELSE '-Z' END AS normal"


def _contact() -> list:
    return [*_rounded("contact_x", "contact_y", "contact_z", "depth"), F.col("normal")]


def _box_contacts(pairs):
    return pairs.select("id1", "id2", *_contact())


def _box_pairs(df):
    return collide.box_pairs(df, columns=_contact())


@add(_BOXES + f"SELECT {_BOX_COLS} FROM d ORDER BY depth DESC, id1, id2")
def collide_boxes(spark, sf):
    return _box_pairs(views.parts(spark, sf)).orderBy(F.desc("depth"), "id1", "id2")


@add(_BOXES + f"SELECT {_BOX_COLS} FROM d WHERE 12 IN (id1, id2) OR 77 IN (id1, id2)")
def collisions_of_entity(spark, sf):
    return _box_contacts(collide.box_pairs_of(views.parts(spark, sf), [12, 77]))


@add(_BOXES.replace("FROM pt a JOIN pt b ON", "FROM (SELECT * FROM pt WHERE min_x <= 600 AND max_x >= 200 AND min_y <= 700 AND max_y >= 100) a JOIN (SELECT * FROM pt WHERE min_x <= 600 AND max_x >= 200 AND min_y <= 700 AND max_y >= 100) b ON") + f"SELECT {_BOX_COLS} FROM d")
def collisions_in_region(spark, sf):
    return _box_pairs(index.in_box(views.parts(spark, sf), (200.0, 100.0, -1e6, 600.0, 700.0, 1e6)))


@add(_BOXES.replace("WHERE", "WHERE") + f"SELECT {_BOX_COLS} FROM d WHERE id1 % 2 = 0 AND NOT (id1 % 10 = 0 AND id2 % 10 = 0)")
def collisions_filtered(spark, sf):
    """Pair filters composed: one side by id, and pairs excluded only when both are in the set."""
    both = (F.col("id1") % 10 == 0) & (F.col("id2") % 10 == 0)
    return _box_pairs(views.parts(spark, sf)).where((F.col("id1") % 2 == 0) & ~both)


_NEAR = " AND ".join(f"o.{c} BETWEEN p.min_{c} - 5 AND p.max_{c} + 5" for c in "xyz")
_FACE = ", ".join(f"least(o.{c} - p.min_{c}, p.max_{c} - o.{c})" for c in "xyz")


@add(f"WITH {ORDERS}, {PARTS} SELECT o.id AS point_id, p.id AS box_id, round(least({_FACE}), 6) AS depth FROM od o JOIN pt p ON {_NEAR}")
def collide_points_with_boxes(spark, sf):
    got = collide.point_box_pairs(views.orders(spark, sf), views.parts(spark, sf), reach=5.0)
    return got.select("point_id", "box_id", F.round("depth", 6).alias("depth"))


_SPHERES = f"WITH {PARTS}, d AS (SELECT a.id AS id1, b.id AS id2, {_PD} AS d, a.half + b.half AS r FROM pt a JOIN pt b ON a.id < b.id AND abs(a.x - b.x) <= 20 AND {_PD} <= a.half + b.half) "


def _round_pairs(df, touch: str, depth: str):
    """Pairs by the box join that touch, and how deep."""
    got = collide.meeting(df, [*P, "half"], each=lambda pairs: pairs.where(F.expr(touch)).select("a_ids", "b_ids", F.expr(geom.rounded(depth)).alias("depth")))
    return got.select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), "depth")


@add(_SPHERES + "SELECT id1, id2, round(r - d, 6) AS depth FROM d")
def collide_spheres(spark, sf):
    """Spheres of radius half, by the box join and the sphere rule."""
    d = geom.dist(tuple(f"a_{c}" for c in P), tuple(f"b_{c}" for c in P))
    return _round_pairs(views.parts(spark, sf), f"{d} <= a_half + b_half", f"(a_half + b_half - {d})")


def _spheres_with_boxes(events, boxes):
    s = events.select("id", "x", (F.col("y") * 5).alias("y"), "z")
    near = collide.point_box_pairs(s, boxes, reach=12.0).select("point_id", "box_id")
    full = near.join(s.withColumnRenamed("id", "point_id"), "point_id").join(boxes.select(F.col("id").alias("box_id"), *LOW, *HIGH), "box_id")
    d = F.expr(geom.box_distance(P, LOW, HIGH))
    return full.where(d <= 12).select(F.col("point_id").alias("sphere_id"), "box_id", F.round(12 - d, 6).alias("depth"))


@add()
def collide_spheres_with_boxes_whole(spark, sf):
    return _spheres_with_boxes(views.events(spark, sf), views.parts(spark, sf))


@add()
def collide_capsules(spark, sf):
    """Upright capsules: segments of length half about the centre, radius half / 2."""
    d2 = geom.upright_distance2(tuple(f"a_{c}" for c in P), tuple(f"b_{c}" for c in P), "a_half / 2", "b_half / 2")
    r = "((a_half + b_half) / 2)"
    return _round_pairs(views.parts(spark, sf), f"{d2} <= {r} * {r}", f"({r} - sqrt({d2}))")


_VEL = ("(id % 7 - 3) * 4.0", "(id % 5 - 2) * 4.0", "(id % 3 - 1) * 4.0")
_IMPACT = geom.impact_time(tuple(f"(b.{c} - a.{c})" for c in "xyz"), tuple(f"(b.v{c} - a.v{c})" for c in "xyz"), "(a.half + b.half)")


@add(f"WITH {PARTS}, m AS (SELECT *, " + ", ".join(f"CAST({v} AS DOUBLE) AS v{c}" for v, c in zip(_VEL, "xyz", strict=True)) + f" FROM pt), h AS (SELECT a.id AS id1, b.id AS id2, {_IMPACT} AS t FROM m a JOIN m b ON a.id < b.id AND abs(a.x - b.x) <= 60) SELECT id1, id2, round(t, 6) AS t FROM h WHERE t IS NOT NULL")
def continuous_collision(spark, sf):
    m = views.parts(spark, sf).select("id", *P, F.col("half").alias("radius"), *(F.expr(f"CAST({v} AS DOUBLE)").alias(f"v{c}") for v, c in zip(_VEL, "xyz", strict=True)))
    return collide.swept_sphere_hits(m).select("id1", "id2", *_rounded("t"))


@add(
    _BOXES.replace("), d AS", "), d AS", 1)
    + "SELECT id1, id2, round(CASE WHEN vn > 0 AND depth <= 0.01 THEN 0 ELSE -1.5 * vn / (1 / (1 + id1 % 4)::DOUBLE + 1 / (1 + id2 % 4)::DOUBLE) END, 6) AS j FROM (SELECT id1, id2, depth, CAST(id2 % 7 - id1 % 7 AS DOUBLE) * CASE WHEN bx >= ax THEN 1 ELSE -1 END AS vn FROM d)"
)
def collision_impulses(spark, sf):
    """Impulses along x (from the first to the second centre) of colliding boxes moving along x."""
    p = collide.box_pairs(views.parts(spark, sf), carry=("x",)).select("id1", "id2", "depth", F.col("a_x").alias("ax"), F.col("b_x").alias("bx"))
    zero = F.lit(0.0)
    p = p.withColumns({"nx": F.when(F.col("bx") >= F.col("ax"), 1.0).otherwise(-1.0), "ny": zero, "nz": zero, "v1x": (F.col("id1") % 7).cast("double"), "v2x": (F.col("id2") % 7).cast("double"), "v1y": zero, "v2y": zero, "v1z": zero, "v2z": zero, "m1": (1 + F.col("id1") % 4).cast("double"), "m2": (1 + F.col("id2") % 4).cast("double")})
    return collide.responses(p).select("id1", "id2", *_rounded("j"))


# --- forests --------------------------------------------------------------------------------------------------------

#: A grid of 4 x 3 x 2 trees over the orders' box, part of which lies outside.
ORIGIN, CELL, COUNTS = (0.0, 0.0, 0.0), (500.0, 800.0, 800.0), (4, 3, 2)
_TREE = "CASE WHEN floor(x / 500) BETWEEN 0 AND 3 AND floor(y / 800) BETWEEN 0 AND 2 AND floor(z / 800) BETWEEN 0 AND 1 THEN CAST((floor(x / 500) * 3 + floor(y / 800)) * 2 + floor(z / 800) AS BIGINT) END"
_IN_TREE = f"it AS (SELECT *, {_TREE} AS tree_id FROM od)"
_TREES = "trees AS (SELECT CAST((i * 3 + j) * 2 + k AS BIGINT) AS tree_id, i * 500.0::DOUBLE AS min_x, j * 800.0::DOUBLE AS min_y, k * 800.0::DOUBLE AS min_z, (i + 1) * 500.0::DOUBLE AS max_x, (j + 1) * 800.0::DOUBLE AS max_y, (k + 1) * 800.0::DOUBLE AS max_z FROM range(4) a(i), range(3) b(j), range(2) c(k))"


def trees(spark):
    rows = [((i * 3 + j) * 2 + k, i * 500.0, j * 800.0, k * 800.0, (i + 1) * 500.0, (j + 1) * 800.0, (k + 1) * 800.0) for i in range(4) for j in range(3) for k in range(2)]
    return spark.createDataFrame(rows, "tree_id long, " + ", ".join(f"{c} double" for c in (*LOW, *HIGH)))


def in_trees(spark, sf):
    return views.orders(spark, sf).withColumn("tree_id", forest.grid_tree(ORIGIN, CELL, COUNTS))


@add(f"WITH {ORDERS}, {_IN_TREE} SELECT id, tree_id FROM it")
def forest_assign(spark, sf):
    return in_trees(spark, sf).select("id", "tree_id")


@add(f"WITH {_TREES} SELECT tree_id FROM trees WHERE min_x <= 600 AND max_x >= 200 AND min_y <= 700 AND max_y >= 100 AND min_z <= 500 AND max_z >= 0")
def forest_route(spark, sf):
    return forest.route(trees(spark), (200.0, 100.0, 0.0, 600.0, 700.0, 500.0)).select("tree_id")


@add(f"WITH {ORDERS}, {_IN_TREE} SELECT tree_id, COUNT(*) AS n, " + ", ".join(f"round({f}({c}), 6) AS {f.lower()}_{c}" for f in ("MIN", "MAX") for c in "xyz") + " FROM it WHERE tree_id IS NOT NULL GROUP BY tree_id")
def forest_coverage(spark, sf):
    got = forest.coverage(in_trees(spark, sf).where("tree_id IS NOT NULL"))
    return got.select("tree_id", "n", *(F.round(f"{f}_{c}", 6).alias(f"{f}_{c}") for f in ("min", "max") for c in "xyz"))


@add(f"WITH {ORDERS}, {_IN_TREE}, {_TREES}, c AS (SELECT tree_id, COUNT(*) AS n FROM it GROUP BY tree_id), d AS (SELECT t.tree_id, coalesce(n, 0) AS n, coalesce(n, 0) / ((max_x - min_x) * (max_y - min_y) * (max_z - min_z)) AS density FROM trees t LEFT JOIN c USING (tree_id)) SELECT tree_id, n, round(density, 12) AS density, CASE WHEN n > 700 OR density > 0.00001 THEN 'split' WHEN n < 200 AND density < 0.000001 THEN 'merge' ELSE 'keep' END AS action FROM d")
def forest_density(spark, sf):
    got = forest.density_actions(in_trees(spark, sf), trees(spark), 700, 200, 0.00001)
    return got.select("tree_id", "n", F.round("density", 12).alias("density"), "action")


_LOADS = f"{_IN_TREE}, c AS (SELECT tree_id, COUNT(*) AS n FROM it WHERE tree_id IS NOT NULL GROUP BY tree_id), l AS (SELECT tree_id, n, CASE WHEN n > avg(n) OVER () * 1.5 THEN 'over' WHEN n < avg(n) OVER () * 0.5 THEN 'under' ELSE 'even' END AS load FROM c)"


@add(f"WITH {ORDERS}, {_LOADS} SELECT * FROM l")
def forest_loads(spark, sf):
    return forest.load_class(in_trees(spark, sf).where("tree_id IS NOT NULL"))


@add(f"WITH {ORDERS}, {_LOADS}, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, tree_id) AS k FROM l WHERE load = 'over'), u AS (SELECT *, row_number() OVER (ORDER BY n, tree_id) AS k FROM l WHERE load = 'under') SELECT o.tree_id AS source, u.tree_id AS target, (o.n - u.n) // 2 AS entities FROM o JOIN u USING (k)")
def forest_migration_plan(spark, sf):
    return forest.migration_plan(forest.load_class(in_trees(spark, sf).where("tree_id IS NOT NULL")))


_TOUCH = "s AS (SELECT a.tree_id AS a, b.tree_id AS b, " + " + ".join(f"CASE WHEN least(a.max_{c}, b.max_{c}) - greatest(a.min_{c}, b.min_{c}) < 1e-6 THEN 1 ELSE 0 END" for c in "xyz") + " AS flat, sqrt(" + " + ".join(f"power((a.min_{c} + a.max_{c} - b.min_{c} - b.max_{c}) / 2, 2)" for c in "xyz") + ") AS d FROM trees a JOIN trees b ON a.tree_id < b.tree_id AND " + " AND ".join(f"a.min_{c} <= b.max_{c} AND b.min_{c} <= a.max_{c}" for c in "xyz") + ")"


@add(f"WITH {_TREES}, {_TOUCH} SELECT a, b, ['OVERLAP', 'FACE', 'EDGE', 'VERTEX'][flat + 1] AS kind, round(d, 6) AS distance FROM s")
def forest_connections(spark, sf):
    return forest.connections(trees(spark)).select("a", "b", "kind", F.round("distance", 6).alias("distance"))


@add(f"WITH {_TREES}, {_TOUCH} SELECT a, b FROM s WHERE d <= 800 AND 5 IN (a, b)")
def forest_trees_within(spark, sf):
    return forest.connections(trees(spark)).where("distance <= 800 AND (a = 5 OR b = 5)").select("a", "b")


_BOXD = " + ".join(f"power(greatest(t.min_{c} - it.{c}, it.{c} - t.max_{c}, 0), 2)" for c in "xyz")


@add(f"WITH {ORDERS}, {_IN_TREE}, {_TREES} SELECT id, it.tree_id AS source, t.tree_id AS target, round(sqrt({_BOXD}), 6) AS distance FROM it JOIN trees t ON it.tree_id <> t.tree_id AND sqrt({_BOXD}) <= 20")
def ghost_zone_replicas(spark, sf):
    got = forest.ghosts(in_trees(spark, sf).where("tree_id IS NOT NULL"), trees(spark), 20.0)
    return got.select("id", "source", "target", F.round("distance", 6).alias("distance"))


_OWNED = f"oc AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 14)} AS cell, {', '.join(f'{views.sql_index(c, 14)} AS c{c}' for c in 'xyz')}, {views.sql_index('x', 12)} AS owner FROM od)"


@add(f"WITH {ORDERS}, {_OWNED} SELECT DISTINCT b.cell, b.owner, a.owner AS ghost_of FROM oc a JOIN oc b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) + abs(a.cz - b.cz) = 1 AND a.owner <> b.owner")
def ghost_layer_cells(spark, sf):
    cells = index.with_cell(views.orders(spark, sf), 14).select("cell", keys.cell_index("x", 12).alias("owner")).distinct()
    return forest.ghost_cells(cells, 14)


@add(
    f"WITH {ORDERS}, f AS (SELECT DISTINCT {', '.join(f'{views.sql_index(c, 14)} AS {c}' for c in 'xyz')} FROM od WHERE x < 1000), c AS (SELECT DISTINCT {', '.join(f'{views.sql_index(c, 12)} AS {c}' for c in 'xyz')} FROM od WHERE x >= 1024) "
    f"SELECT DISTINCT 14 AS level, {views.sql_morton('f.x', 'f.y', 'f.z', 14)} AS cell, 12 AS other_level, {views.sql_morton('c.x', 'c.y', 'c.z', 12)} AS other_cell FROM f JOIN c ON "
    + " OR ".join(f"({' AND '.join(f'(f.{b} + ({s if a == b else 0})) // 4 = c.{b}' for b in 'xyz')})" for a in "xyz" for s in (-1, 1))
)
def balance_violations(spark, sf):
    o = views.orders(spark, sf)
    fine = index.nodes(o.where("x < 1000"), 14)
    leaves = fine.unionByName(index.nodes(o.where("x >= 1024"), 12)).select("level", "cell")
    return forest.balance_violations(leaves, 14)


_GRAPH = "e AS (SELECT DISTINCT o_custkey AS a, o_custkey * 7 % 1500 AS b FROM orders WHERE o_custkey % 3 = 0)"


def _order_components(spark, o):
    views.checkpoints(spark)
    return forest.components(o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 1500).alias("b")).distinct())


@add()
def graph_components_whole(spark, sf):
    return _order_components(spark, views.table(spark, sf, "orders"))


@add(f"WITH RECURSIVE {_TREES}, {_TOUCH}, u AS (SELECT a AS x, b AS y FROM s WHERE flat = 1 UNION SELECT b, a FROM s WHERE flat = 1), r(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT u.y, r.hops + 1 FROM r JOIN u ON u.x = r.node WHERE r.hops < 7) SELECT node, MIN(hops) AS hops FROM r GROUP BY node")
def graph_hops(spark, sf):
    views.checkpoints(spark)
    return forest.hops(forest.connections(trees(spark)).where("kind = 'FACE'").select("a", "b"), 0)


# --- regions --------------------------------------------------------------------------------------------------------


@add(f"WITH {_TREES} SELECT a.tree_id AS a, b.tree_id AS b, round(sqrt(" + " + ".join(f"power((a.min_{c} + a.max_{c} - b.min_{c} - b.max_{c}) / 2, 2)" for c in "xyz") + "), 6) AS distance FROM trees a JOIN trees b ON a.tree_id <> b.tree_id AND sqrt(" + " + ".join(f"power((a.min_{c} + a.max_{c} - b.min_{c} - b.max_{c}) / 2, 2)" for c in "xyz") + ") BETWEEN 800.0000001 AND 1000")
def region_ring_neighbours(spark, sf):
    """Regions whose centres are beyond the area of interest (800) but within its buffer (200)."""
    t = trees(spark).select("tree_id", *((F.col(a) + F.col(b)) .alias(c) for a, b, c in zip(LOW, HIGH, P, strict=True)))
    t = t.select("tree_id", *((F.col(c) / 2).alias(c) for c in P))
    a, b = t.select(F.col("tree_id").alias("a"), *(F.col(c).alias(f"a{c}") for c in P)), t.select(F.col("tree_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in P))
    d = geom.dist(("ax", "ay", "az"), ("bx", "by", "bz"))
    met = a.join(forest.small(b), F.expr(f"a <> b AND {d} > 800 AND {d} <= 1000"))
    return met.select("a", "b", F.round(F.expr(d), 6).alias("distance"))


@add(f"WITH {EVENTS}, {_TREES}, n AS (SELECT ev.id, tree_id, sqrt(" + " + ".join(f"power(ev.{c} * 3 - (min_{c} + max_{c}) / 2, 2)" for c in "xyz") + ") AS d FROM ev, trees) SELECT id, tree_id, round(d, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, tree_id) = 1")
def closest_region(spark, sf):
    e = views.events(spark, sf).select("id", *((F.col(c) * 3).alias(c) for c in P))
    t = trees(spark)
    centre = tuple(f"((min_{c} + max_{c}) / 2)" for c in "xyz")
    near = e.crossJoin(F.broadcast(t)).select("id", F.struct(F.expr(geom.dist(P, centre)).alias("d"), "tree_id").alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    return near.select("id", F.col("s.tree_id").alias("tree_id"), F.round("s.d", 6).alias("distance"))


_MOVE = f"{_IN_TREE}, m AS (SELECT id, tree_id AS held, x + (id % 5 - 2) * 150.0::DOUBLE AS x, y, z FROM it)"


@add(f"WITH {ORDERS}, {_MOVE}, n AS (SELECT id, held, {_TREE} AS target FROM m) SELECT id, held AS source, target FROM n WHERE held IS NOT NULL AND target IS NOT NULL AND held <> target")
def migration_check(spark, sf):
    m = in_trees(spark, sf).select("id", F.col("tree_id").alias("held"), (F.col("x") + (F.col("id") % 5 - 2) * 150.0).alias("x"), "y", "z")
    return m.withColumn("target", forest.grid_tree(ORIGIN, CELL, COUNTS)).where("held IS NOT NULL AND target IS NOT NULL AND held <> target").select("id", F.col("held").alias("source"), "target")


_OVER = ("greatest(x - (cx + 1) * 500 - 10, cx * 500 - x - 10, 0)", "greatest(y - (cy + 1) * 800 - 10, cy * 800 - y - 10, 0)")


@add(f"WITH {ORDERS}, m AS (SELECT id, floor(x / 500) AS cx, floor(y / 800) AS cy, x + (id % 5 - 2) * 150.0::DOUBLE AS x, y + (id % 3 - 1) * 200.0::DOUBLE AS y FROM od), o AS (SELECT *, {_OVER[0]} AS ox, {_OVER[1]} AS oy FROM m) SELECT id, CASE WHEN ox = 0 AND oy = 0 THEN 'NONE' WHEN ox >= oy THEN CASE WHEN x > cx * 500 THEN 'EAST' ELSE 'WEST' END ELSE CASE WHEN y > cy * 800 THEN 'NORTH' ELSE 'SOUTH' END END AS direction FROM o")
def migration_direction(spark, sf):
    """Side of the grid cell that a move crosses by more than 10; of two, the larger overshoot, x on ties."""
    o = views.orders(spark, sf)
    m = o.select("id", F.floor(F.col("x") / 500).alias("cx"), F.floor(F.col("y") / 800).alias("cy"), (F.col("x") + (F.col("id") % 5 - 2) * 150.0).alias("x"), (F.col("y") + (F.col("id") % 3 - 1) * 200.0).alias("y"))
    over = lambda c, i, size: F.greatest(F.col(c) - (F.col(i) + 1) * size - 10, F.col(i) * size - F.col(c) - 10, F.lit(0.0))
    ox, oy = over("x", "cx", 500), over("y", "cy", 800)
    way = F.when((ox == 0) & (oy == 0), "NONE").when(ox >= oy, F.when(F.col("x") > F.col("cx") * 500, "EAST").otherwise("WEST")).otherwise(F.when(F.col("y") > F.col("cy") * 800, "NORTH").otherwise("SOUTH"))
    return m.select("id", way.alias("direction"))


@add(f"WITH {EVENTS}, b AS (SELECT id, x, y, z FROM ev), s AS (SELECT a.id, COUNT(*) AS neighbours, AVG(b.x) AS cx, AVG(b.y) AS cy FROM b a JOIN b ON a.id <> b.id AND abs(a.x - b.x) <= 3 AND {_PD} <= 3 GROUP BY a.id) SELECT id, neighbours, round(cx, 6) AS cohesion_x, round(cy, 6) AS cohesion_y FROM s")
def flock_neighbours(spark, sf):
    """What flocking needs: the neighbours in the area of interest and their centre."""
    near = collide.neighbourhoods(views.events(spark, sf).select("id", *P), 3.0)
    return near.select("id", "neighbours", F.round("x", 6).alias("cohesion_x"), F.round("y", 6).alias("cohesion_y"))
