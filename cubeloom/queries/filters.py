"""Look-ups, region filters, planes, frustums, nearest neighbours and rays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.functions import geom, keys
from cubeloom.operators import index, search, visibility
from cubeloom.queries import REGISTRY
from cubeloom.views import CUSTOMERS, EVENTS, ORDERS, PARTS, sql_cell

add = REGISTRY.add
BOX = (200.0, 100.0, 100.0, 600.0, 700.0, 600.0)
B = [f"{v!r}::DOUBLE" for v in BOX]
P, LOW, HIGH = index.P, index.LOW, index.HIGH


@add(f"WITH {ORDERS} SELECT id, x FROM od WHERE id IN (SELECT id FROM od WHERE id % 97 = 3)")
def contains_ids(spark, sf):
    o = views.orders(spark, sf)
    return o.join(o.where("id % 97 = 3").select("id"), "id", "left_semi").select("id", "x")


@add(f"WITH {ORDERS} SELECT CAST(3 * id AS BIGINT) AS position, od.id, x, y, z, kind FROM od WHERE id % 50 = 1 ORDER BY position")
def fetch_by_ids(spark, sf):
    o = views.orders(spark, sf)
    return index.fetch(o, o.where("id % 50 = 1").select("id", (F.col("id") * 3).alias("position"))).select("position", "id", "x", "y", "z", "kind")


@add(f"WITH {ORDERS} SELECT id, x, y, z FROM od ORDER BY id LIMIT 25 OFFSET 75")
def paged_listing(spark, sf):
    return index.page(views.orders(spark, sf).select("id", "x", "y", "z"), 3, 25)


@add(f"WITH {ORDERS} SELECT id FROM od WHERE {sql_cell('x', 'y', 'z', 12)} = {views.sql_morton('3::BIGINT', '3::BIGINT', '1::BIGINT', 12)}")
def point_lookup(spark, sf):
    return index.lookup(views.orders(spark, sf), (1600.0, 1600.0, 700.0), 12).select("id")


@add(f"WITH {ORDERS} SELECT 11 AS level, {sql_cell('x', 'y', 'z', 11)} AS cell, COUNT(*) AS n FROM od WHERE {sql_cell('x', 'y', 'z', 11)} = {views.sql_morton('1::BIGINT', '1::BIGINT', '0::BIGINT', 11)} GROUP BY 2")
def enclosing_node(spark, sf):
    return index.enclosing(views.orders(spark, sf), (1600.0, 1600.0, 700.0), 11, 16)


@add(f"WITH {PARTS} SELECT id FROM pt WHERE min_x <= {B[3]} AND max_x >= {B[0]} AND min_y <= {B[4]} AND max_y >= {B[1]} AND min_z <= {B[5]} AND max_z >= {B[2]}")
def entities_in_region(spark, sf):
    return index.in_box(views.parts(spark, sf), BOX).select("id")


@add(f"WITH {ORDERS} SELECT id, round(sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000) + (z - 700) * (z - 700)), 6) AS distance FROM od WHERE sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000) + (z - 700) * (z - 700)) <= 400")
def radius_query(spark, sf):
    return index.in_sphere(views.orders(spark, sf), (1000.0, 1000.0, 700.0), 400.0).select("id", F.round("distance", 6).alias("distance"))


_NODES = f"nodes AS (SELECT cell, {', '.join(f'{views.sql_compact("cell", k, 13)} * 256.0::DOUBLE AS {a}' for k, a in enumerate('xyz'))} FROM (SELECT DISTINCT {sql_cell('x', 'y', 'z', 13)} AS cell FROM od))"


def _cells(spark, sf):
    return index.nodes(views.orders(spark, sf), 13).select("cell")


@add(f"WITH {ORDERS}, {_NODES} SELECT cell FROM nodes WHERE x >= 256 AND x + 256 <= 1200 AND y >= 300 AND y + 256 <= 1500 AND z >= 0 AND z + 256 <= 900")
def nodes_bounded_by_box(spark, sf):
    return index.nodes_inside_box(_cells(spark, sf), 13, (256.0, 300.0, 0.0, 1200.0, 1500.0, 900.0)).select("cell")


@add(f"WITH {ORDERS}, {_NODES} SELECT cell FROM nodes WHERE x < 1200 AND x + 256 > 256 AND y < 1500 AND y + 256 > 300 AND z < 900 AND z + 256 > 0")
def nodes_bounding_box(spark, sf):
    return index.nodes_meeting_box(_cells(spark, sf), 13, (256.0, 300.0, 0.0, 1200.0, 1500.0, 900.0)).select("cell")


def _axis(c: str, v: int, far: bool) -> str:
    d = f"greatest(abs({c} - {v}), abs({c} + 256 - {v}))" if far else f"greatest({c} - {v}, {v} - {c} - 256, 0)"
    return f"{d} * {d}"


@add(f"WITH {ORDERS}, {_NODES} SELECT cell FROM nodes WHERE {_axis('x', 1000, True)} + {_axis('y', 1000, True)} + {_axis('z', 700, True)} <= 490000")
def nodes_bounded_by_sphere(spark, sf):
    return index.nodes_inside_sphere(_cells(spark, sf), 13, (1000.0, 1000.0, 700.0), 700.0).select("cell")


@add(f"WITH {ORDERS}, {_NODES} SELECT cell FROM nodes WHERE {_axis('x', 1000, False)} + {_axis('y', 1000, False)} + {_axis('z', 700, False)} <= 90000")
def nodes_bounding_sphere(spark, sf):
    return index.nodes_meeting_sphere(_cells(spark, sf), 13, (1000.0, 1000.0, 700.0), 300.0).select("cell")


@add(
    f"WITH {ORDERS}, l AS (SELECT DISTINCT 11 AS level, {sql_cell('x', 'y', 'z', 11)} AS cell FROM od UNION ALL SELECT DISTINCT 12, {sql_cell('x', 'y', 'z', 12)} FROM od WHERE x < 1000) "
    "SELECT level, cell FROM l WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.level = l.level + 1 AND c.cell // 8 = l.cell)"
)
def leaf_cells(spark, sf):
    o = views.orders(spark, sf)
    cells = index.nodes(o, 11).unionByName(index.nodes(o.where("x < 1000"), 12)).select("level", "cell")
    return index.leaves(cells)


@add(f"WITH {ORDERS} SELECT id FROM od WHERE x - 512 * 2 BETWEEN 0 AND 512 AND y - 512 * 2 BETWEEN 0 AND 512 AND z - 512 BETWEEN 0 AND 512 AND x - 1024 >= y - 1024 AND y - 1024 >= z - 512")
def dop_point_in_tet(spark, sf):
    hit = keys.tet_contains("x", "y", "z", F.lit(1024.0), F.lit(1024.0), F.lit(512.0), F.lit(512.0), 0)
    return views.orders(spark, sf).where(hit).select("id")


PLANE = (0.6, 0.0, 0.8, -700.0)


def _value(x, y, z):
    return f"(0.6::DOUBLE * ({x}) + 0.8::DOUBLE * ({z}) - 700)"


@add(f"WITH {ORDERS}, d AS (SELECT id, {_value('x', 'y', 'z')} AS d FROM od) SELECT id, CASE WHEN abs(d) <= 1e-6 THEN 'ON_PLANE' WHEN d > 0 THEN 'POSITIVE_SIDE' ELSE 'NEGATIVE_SIDE' END AS side, round(d, 6) AS distance FROM d")
def plane_classes_points(spark, sf):
    return visibility.plane_query(views.orders(spark, sf), PLANE).select("id", "side", F.round("distance", 6).alias("distance"))


_EXT = f"e AS (SELECT id, {_value('min_x', 'min_y', 'min_z')} AS n, {_value('max_x', 'max_y', 'max_z')} AS f FROM pt)"


@add(f"WITH {PARTS}, {_EXT} SELECT id, CASE WHEN n * f <= 0 THEN 'INTERSECTING' WHEN n > 0 THEN 'POSITIVE_SIDE' ELSE 'NEGATIVE_SIDE' END AS side, round(CASE WHEN n * f <= 0 THEN CASE WHEN abs(n) < abs(f) THEN n ELSE f END WHEN n > 0 THEN n ELSE f END, 6) AS distance FROM e")
def plane_classes_boxes(spark, sf):
    return visibility.plane_query(views.parts(spark, sf), PLANE).select("id", "side", F.round("distance", 6).alias("distance"))


@add(f"WITH {ORDERS} SELECT id FROM od WHERE abs({_value('x', 'y', 'z')}) <= 25")
def plane_within_distance(spark, sf):
    return visibility.plane_query(views.orders(spark, sf), PLANE, 25.0).select("id")


@add(f"WITH {PARTS}, {_EXT} SELECT id FROM e WHERE n > 0")
def plane_positive_side(spark, sf):
    return visibility.plane_query(views.parts(spark, sf), PLANE).where("side = 'POSITIVE_SIDE'").select("id")


@add(f"WITH {PARTS}, {_EXT} SELECT id FROM e WHERE f < 0")
def plane_negative_side(spark, sf):
    return visibility.plane_query(views.parts(spark, sf), PLANE).where("side = 'NEGATIVE_SIDE'").select("id")


CAMERA = (0.0, 500.0, 500.0)
VIEW = visibility.frustum(CAMERA, (1000.0, 500.0, 500.0), (0.0, 0.0, 1.0), math.pi / 3, 1.0, 10.0, 800.0)
_T = repr(math.tan(math.pi / 6)) + "::DOUBLE"


@add(f"WITH {ORDERS} SELECT id FROM od WHERE x BETWEEN 10 AND 800 AND abs(y - 500) <= x * {_T} AND abs(z - 500) <= x * {_T}")
def frustum_cull_ids(spark, sf):
    return visibility.frustum_ids(views.orders(spark, sf), VIEW).select("id")


CUBE = visibility.box_frustum((100.0, 100.0, 100.0), (600.0, 700.0, 600.0))
_GAP = " + ".join(f"greatest(min_{c} - {v}, {v} - max_{c}, 0) * greatest(min_{c} - {v}, {v} - max_{c}, 0)" for c, v in (("x", 0), ("y", 500), ("z", 500)))
_CULL = (
    f"WITH {PARTS}, v AS (SELECT id, CASE WHEN min_x >= 100 AND max_x <= 600 AND min_y >= 100 AND max_y <= 700 AND min_z >= 100 AND max_z <= 600 THEN 'INSIDE' ELSE 'INTERSECTING' END AS view, round(sqrt({_GAP}), 6) AS distance "
    "FROM pt WHERE max_x > 100 AND min_x < 600 AND max_y > 100 AND min_y < 700 AND max_z > 100 AND min_z < 600) SELECT id, view, distance FROM v"
)


def _view(spark, sf):
    return visibility.frustum_view(views.parts(spark, sf), CUBE, CAMERA).select("id", "view", F.round("distance", 6).alias("distance"))


@add(_CULL + " ORDER BY distance, id")
def frustum_cull_sorted(spark, sf):
    return _view(spark, sf).orderBy("distance", "id")


@add(_CULL + " WHERE view = 'INSIDE'")
def frustum_cull_inside(spark, sf):
    return _view(spark, sf).where("view = 'INSIDE'")


@add(_CULL + " WHERE view = 'INTERSECTING'")
def frustum_cull_intersecting(spark, sf):
    return _view(spark, sf).where("view = 'INTERSECTING'")


@add(_CULL + " WHERE distance <= 400")
def frustum_cull_within_distance(spark, sf):
    return _view(spark, sf).where("distance <= 400")


@add(f"WITH {ORDERS}, t AS (SELECT *, floor(z / 4096.0::DOUBLE * 64) AS l FROM od) SELECT id FROM t WHERE (l + 1) * 64 > 500 AND l * 64 < 700")
def prism_vertical_layer(spark, sf):
    line = keys.line_index(F.col("z") / 4096.0, 6)
    return views.orders(spark, sf).where(((line + 1) * 64 > 500) & (line * 64 < 700)).select("id")


# --- nearest --------------------------------------------------------------------------------------------------------

_D = "sqrt((x - 1000) * (x - 1000) + (y - 1000) * (y - 1000) + (z - 700) * (z - 700))"


@add(f"WITH {ORDERS} SELECT id, round({_D}, 6) AS distance FROM od ORDER BY {_D}, id LIMIT 20")
def knn(spark, sf):
    return search.nearest(views.orders(spark, sf), (1000.0, 1000.0, 700.0), 20).select("id", F.round("distance", 6).alias("distance"))


@add(f"WITH {ORDERS} SELECT id, round({_D}, 6) AS distance FROM od WHERE {_D} <= 120 AND kind = 'F' ORDER BY {_D}, id LIMIT 20")
def knn_matching_within(spark, sf):
    return search.nearest(views.orders(spark, sf).where("kind = 'F'"), (1000.0, 1000.0, 700.0), 20, 120.0).select("id", F.round("distance", 6).alias("distance"))


_KNN = (
    "p AS (SELECT id AS q_id, x AS px, y AS py, z AS pz FROM cu WHERE id % 15 = 0), d AS (SELECT q_id, id, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS d FROM p, od), "
    "r AS (SELECT q_id, id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, id) AS rank FROM d) SELECT q_id, id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"
)


def _probes(spark, sf):
    return views.customers(spark, sf).select(F.col("id").alias("q_id"), "x", "y", "z")


@add(f"WITH {ORDERS}, {CUSTOMERS}, {_KNN}")
def knn_join(spark, sf):
    return search.nearest_join(views.orders(spark, sf), _probes(spark, sf).where("q_id % 15 = 0"), 5).select("q_id", "id", F.round("distance", 6).alias("distance"), "rank")


@add(f"WITH {ORDERS}, {CUSTOMERS}, {_KNN.replace(' WHERE id % 15 = 0', '')}")
def knn_join_by_cells(spark, sf):
    """Of every customer, by the plan for many probes: rings of cells, widened for the probes that need it."""
    views.checkpoints(spark)
    return search.nearest_join(views.orders(spark, sf), _probes(spark, sf), 5, level=13).select("q_id", "id", F.round("distance", 6).alias("distance"), "rank")


# --- rays -----------------------------------------------------------------------------------------------------------

_S3 = math.sqrt(3.0)
RAYS = [(1, 0.0, 0.0, 0.0, 1 / _S3, 1 / _S3, 1 / _S3, 5000.0), (2, 0.0, 500.0, 450.0, 1.0, 0.0, 0.0, 5000.0), (3, 1000.0, 1000.0, 400.0, -0.6, -0.8, 0.0, 900.0), (4, 300.0, 0.0, 0.0, 0.0, 0.6, 0.8, 400.0)]
_RAY_SQL = "rays(ray_id, ox, oy, oz, dx, dy, dz, most) AS (VALUES " + ", ".join("(" + f"{r[0]}::BIGINT, " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in RAYS) + ")"


def _rays(spark):
    return spark.createDataFrame(RAYS, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, most double")




def _slab_sql(most: str) -> str:
    """Entry distance of a ray into a box, from the rule: the last of the entries of the three slabs, unless the first of
    the exits or `most` comes before it; an axis with |d| < 1e-6 only asks whether the origin is between the planes."""
    enter, leave = [], []
    for c in "xyz":
        inside = f"o{c} >= min_{c} AND o{c} <= max_{c}"
        enter.append(f"CASE WHEN abs(d{c}) < 1e-6 THEN (CASE WHEN {inside} THEN 0.0 ELSE 1e308 END) WHEN d{c} > 0 THEN (min_{c} - o{c}) / d{c} ELSE (max_{c} - o{c}) / d{c} END")
        leave.append(f"CASE WHEN abs(d{c}) < 1e-6 THEN (CASE WHEN {inside} THEN 1e308 ELSE -1.0 END) WHEN d{c} > 0 THEN (max_{c} - o{c}) / d{c} ELSE (min_{c} - o{c}) / d{c} END")
    first = f"greatest(0.0, {', '.join(enter)})"
    return f"CASE WHEN {first} <= least({most}, {', '.join(leave)}) THEN {first} END"


_BOX_HIT = _slab_sql("most")
_HITS = f"WITH {PARTS}, {_RAY_SQL}, h AS (SELECT ray_id, id, {_BOX_HIT} AS t FROM pt, rays) "


@add(_HITS + "SELECT ray_id, id, round(t, 6) AS t FROM h WHERE t IS NOT NULL ORDER BY ray_id, t, id")
def ray_all(spark, sf):
    return search.ray_hits(views.parts(spark, sf), _rays(spark)).select("ray_id", "id", F.round("t", 6).alias("t")).orderBy("ray_id", "t", "id")


@add(_HITS + "SELECT ray_id, id, round(t, 6) AS t FROM h WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY t, id) = 1")
def ray_first(spark, sf):
    return search.first_hits(search.ray_hits(views.parts(spark, sf), _rays(spark))).select("ray_id", "id", F.round("t", 6).alias("t"))


@add(_HITS + "SELECT ray_id, id, round(t, 6) AS t FROM h WHERE t <= 300")
def ray_within(spark, sf):
    rays = _rays(spark).withColumn("most", F.least("most", F.lit(300.0)))
    return search.ray_hits(views.parts(spark, sf), rays).select("ray_id", "id", F.round("t", 6).alias("t"))


@add(
    f"WITH {ORDERS}, {_RAY_SQL}, c AS (SELECT ray_id, id, most, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS t, (x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz) AS m FROM od, rays), "
    "h AS (SELECT ray_id, id, CASE WHEN m <= 900 THEN 0 ELSE t - sqrt(greatest(900 - (m - t * t), 0)) END AS hit, m, t, most FROM c) SELECT ray_id, id, round(hit, 5) AS t FROM h WHERE m <= 900 OR (t >= 0 AND 900 - (m - t * t) >= 0 AND hit BETWEEN 0 AND most)"
)
def ray_points(spark, sf):
    """Points as spheres of radius 30."""
    return search.ray_hits(views.orders(spark, sf), _rays(spark), radius=30.0).select("ray_id", "id", F.round("t", 5).alias("t"))


_TRI = (("1000.0", "0.0", "0.0"), ("0.0", "1000.0", "0.0"), ("0.0", "0.0", "1000.0"))


@add("WITH " + EVENTS + f" SELECT id, round({geom.ray_triangle(('x', 'y', 'z'), ('0.6::DOUBLE', '0.0::DOUBLE', '0.8::DOUBLE'), *_TRI)}, 6) AS t FROM ev WHERE ({geom.ray_triangle(('x', 'y', 'z'), ('0.6::DOUBLE', '0.0::DOUBLE', '0.8::DOUBLE'), *_TRI)}) IS NOT NULL")
def ray_triangle(spark, sf):
    e = views.events(spark, sf).withColumn("t", F.expr(geom.ray_triangle(("x", "y", "z"), ("0.6D", "0.0D", "0.8D"), *_TRI)))
    return e.where("t IS NOT NULL").select("id", F.round("t", 6).alias("t"))


@add(f"WITH {ORDERS} SELECT id FROM od WHERE x / 3000 + y / 2400 + z / 1500 <= 1")
def point_in_tetrahedron(spark, sf):
    a, b, c, d = ("0.0D", "0.0D", "0.0D"), ("3000.0D", "0.0D", "0.0D"), ("0.0D", "2400.0D", "0.0D"), ("0.0D", "0.0D", "1500.0D")
    return views.orders(spark, sf).where(F.expr(geom.in_tetrahedron(P, a, b, c, d, eps=1e-12))).select("id")


# --- visibility -----------------------------------------------------------------------------------------------------

PAIRS = [(1, 0.0, 400.0, 400.0, 1000.0, 500.0, 500.0), (2, 500.0, 0.0, 0.0, 500.0, 900.0, 900.0), (3, 10.0, 10.0, 10.0, 20.0, 30.0, 20.0), (4, 900.0, 900.0, 500.0, 100.0, 200.0, 450.0)]
_PAIR_SQL = (
    "pairs(pair, ox, oy, oz, tx, ty, tz) AS (VALUES " + ", ".join("(" + f"{r[0]}::BIGINT, " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in PAIRS) + "), "
    "pd AS (SELECT *, sqrt((tx - ox) * (tx - ox) + (ty - oy) * (ty - oy) + (tz - oz) * (tz - oz)) AS dd FROM pairs), pr AS (SELECT *, (tx - ox) / dd AS dx, (ty - oy) / dd AS dy, (tz - oz) / dd AS dz FROM pd)"
)
_LOS = (
    f"WITH {PARTS}, {_PAIR_SQL}, h AS (SELECT pair, id, dd, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS s, {_slab_sql('dd')} AS t FROM pt, pr), "
    "o AS (SELECT pair, id, t, least(1.0, 0.5 * (s / greatest(t, 1)) * (s / greatest(t, 1))) * CASE WHEN t / dd < 0.1 OR t / dd > 0.9 THEN 0.5 ELSE 1 END AS ratio, CASE WHEN t > dd THEN 'behind' WHEN t < 0.05 * dd THEN 'before_observer' WHEN s / greatest(t, 1e-9) > 0.5 THEN 'full' ELSE 'partial' END AS occlusion FROM h WHERE t IS NOT NULL) "
)


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "pair long, ox double, oy double, oz double, tx double, ty double, tz double")


@add(_LOS + "SELECT pair, id, round(t, 5) AS t, round(CAST(ratio AS DOUBLE), 6) AS ratio, occlusion FROM o ORDER BY ratio DESC, pair, id")
def occluders(spark, sf):
    got = visibility.occluders(views.parts(spark, sf), _pairs(spark))
    return got.select("pair", "id", F.round("t", 5).alias("t"), F.round("ratio", 6).alias("ratio"), "occlusion").orderBy(F.desc("ratio"), "pair", "id")


@add(_LOS + "SELECT p.pair, round(least(1.0, coalesce(SUM(CAST(ratio AS DOUBLE)), 0)), 5) AS occluded, COUNT(id) AS n, least(1.0, coalesce(SUM(CAST(ratio AS DOUBLE)), 0)) < 0.5 AS clear FROM pairs p LEFT JOIN o USING (pair) GROUP BY p.pair")
def line_of_sight(spark, sf):
    return visibility.line_of_sight(views.parts(spark, sf), _pairs(spark)).select("pair", F.round("occluded", 5).alias("occluded"), "n", "clear")


@add(_LOS + "SELECT id, COUNT(*) AS n FROM o GROUP BY id ORDER BY n DESC, id LIMIT 5")
def top_occluders(spark, sf):
    return visibility.occluders(views.parts(spark, sf), _pairs(spark)).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(5)


@add(_LOS + "SELECT occlusion, COUNT(*) AS n, COUNT(DISTINCT pair) AS pairs FROM o GROUP BY occlusion")
def visibility_statistics(spark, sf):
    return visibility.occluders(views.parts(spark, sf), _pairs(spark)).groupBy("occlusion").agg(F.count("*").alias("n"), F.count_distinct("pair").alias("pairs"))


@add(f"WITH {ORDERS}, d AS (SELECT id, x - 100 AS a, y - 100 AS b, z - 100 AS c FROM od), e AS (SELECT id, sqrt(a * a + b * b + c * c) AS d, (a + b + c) / sqrt(3.0::DOUBLE) AS f FROM d) SELECT id, round(d, 6) AS distance FROM e WHERE d <= 1500 AND (d = 0 OR f >= cos(0.35::DOUBLE) * d)")
def view_cone(spark, sf):
    """Distance and angle only, as in its SQL; visible_entities also has the line of sight."""
    return visibility.in_cone(views.orders(spark, sf), (100.0, 100.0, 100.0), (1.0, 1.0, 1.0), 0.35, 1500.0).select("id", F.round("distance", 6).alias("distance"))


@add()
def visible_entities(spark, sf):
    """Boxes in a cone that no other box hides."""
    return visibility.visible_in_cone(views.parts(spark, sf), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 0.8, 1500.0).select("id", F.round("distance", 6).alias("distance"))


@add(
    f"WITH {PARTS}, v(pair, ox, oy, oz) AS (VALUES (1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (2, 900, 100, 500), (3, 300, 800, 100)), pd AS (SELECT *, sqrt((500 - ox) * (500 - ox) + (500 - oy) * (500 - oy) + (500 - oz) * (500 - oz)) AS dd FROM v), pr AS (SELECT *, (500 - ox) / dd AS dx, (500 - oy) / dd AS dy, (500 - oz) / dd AS dz FROM pd), "
    + _LOS.split("pr AS", 1)[1].split("FROM pd), ", 1)[1].rstrip()
    + " SELECT pair, round(CASE WHEN coalesce(r, 0) < 0.5 THEN 1 ELSE 1 - least(1.0, r) END * greatest(0.1, 1000 / dd) / (1 + 0.1 * coalesce(n, 0)), 5) AS score FROM pd LEFT JOIN (SELECT pair, SUM(CAST(ratio AS DOUBLE)) AS r, COUNT(*) AS n FROM o GROUP BY pair) USING (pair)"
)
def vantage_points(spark, sf):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 900.0, 100.0, 500.0), (3, 300.0, 800.0, 100.0)], "pair long, ox double, oy double, oz double")
    return visibility.vantage_scores(views.parts(spark, sf), (500.0, 500.0, 500.0), points).select("pair", F.round("score", 5).alias("score"))
