"""Cell keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.functions import keys
from cubeloom.operators import index
from cubeloom.plans import intervals
from cubeloom.queries import REGISTRY
from cubeloom.views import CUSTOMERS, EVENTS, ORDERS, sql_cell, sql_compact, sql_index, sql_morton

add = REGISTRY.add
LEVEL = 14
SIZE = 1 << (21 - LEVEL)


@add(f"WITH {ORDERS} SELECT id, {sql_morton('CAST(floor(x) AS BIGINT)', 'CAST(floor(y) AS BIGINT)', 'CAST(floor(z) AS BIGINT)')} AS code FROM od")
def morton_encode(spark: SparkSession, sf: str) -> DataFrame:
    return views.orders(spark, sf).select("id", keys.morton(F.floor("x"), F.floor("y"), F.floor("z")).alias("code"))


@add(f"WITH {ORDERS}, c AS (SELECT id, {sql_cell('x', 'y', 'z', 21)} AS code FROM od) SELECT id, {sql_compact('code', 0)} AS ix, {sql_compact('code', 1)} AS iy, {sql_compact('code', 2)} AS iz FROM c")
def morton_decode(spark, sf):
    c = views.orders(spark, sf).select("id", keys.morton_decode(keys.cell_code("x", "y", "z", 21)).alias("p"))
    return c.select("id", F.col("p.x").alias("ix"), F.col("p.y").alias("iy"), F.col("p.z").alias("iz"))


@add(f"WITH {ORDERS} SELECT id, {sql_morton(*(f'({sql_index(c, LEVEL)} * {SIZE})' for c in 'xyz'))} AS code FROM od")
def morton_world_code(spark, sf):
    return views.orders(spark, sf).select("id", keys.world_code("x", "y", "z", LEVEL).alias("code"))


@add(f"WITH {ORDERS} SELECT {LEVEL} AS level, {sql_cell('x', 'y', 'z', LEVEL)} AS cell, COUNT(*) AS n FROM od GROUP BY ALL")
def cells_with_entities(spark, sf):
    return index.nodes(views.orders(spark, sf), LEVEL)


@add(f"WITH {ORDERS}, c AS (SELECT id, {sql_cell('x', 'y', 'z', LEVEL)} AS code FROM od) SELECT id, {sql_morton(*(f'({sql_compact("code", k, LEVEL)} >> 1)' for k in range(3)), bits=LEVEL)} AS parent, {sql_morton(*(f'({sql_compact("code", k, LEVEL)} >> 3)' for k in range(3)), bits=LEVEL)} AS third FROM c")
def morton_parent(spark, sf):
    c = index.with_cell(views.orders(spark, sf), LEVEL)
    return c.select("id", keys.parent_code("cell").alias("parent"), keys.parent_code("cell", 3).alias("third"))


@add(f"WITH {EVENTS}, c AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 15)} AS cell FROM ev) SELECT cell, k AS child, cell * 8 + k AS code FROM c, range(8) r(k)")
def morton_children(spark, sf):
    c = index.with_cell(views.events(spark, sf), 15).select("cell").distinct()
    return c.select("cell", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")).alias("child")).select("cell", "child", keys.child_code("cell", "child").alias("code"))


_OFFSETS = "o AS (SELECT a.a, b.a AS b, c.a AS c FROM (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(a), (VALUES (-1), (0), (1)) c(a))"


def _neighbour_sql(most: int) -> str:
    parts = [f"{sql_compact('cell', k, 13)} AS c{k}" for k in range(3)]
    moved = sql_morton("(c0 + a)", "(c1 + b)", "(c2 + c)", 13)
    return (
        f"WITH {ORDERS}, cells AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 13)} AS cell FROM od), {_OFFSETS}, d AS (SELECT cell, {', '.join(parts)} FROM cells) "
        f"SELECT d.cell, COUNT(*) AS neighbours, COUNT(e.cell) AS occupied FROM d JOIN o ON abs(a) + abs(b) + abs(c) BETWEEN 1 AND {most} AND c0 + a BETWEEN 0 AND 8191 AND c1 + b BETWEEN 0 AND 8191 AND c2 + c BETWEEN 0 AND 8191 "
        f"LEFT JOIN cells e ON e.cell = {moved} GROUP BY d.cell"
    )


def _neighbours(spark, sf, kind):
    cells = index.with_cell(views.orders(spark, sf), 13).select("cell").distinct()
    near = cells.withColumn("near", F.explode(keys.neighbour_codes("cell", 13, kind)))
    hit = cells.select(F.col("cell").alias("other"))
    return near.join(hit, F.col("near") == F.col("other"), "left").groupBy("cell").agg(F.count("*").alias("neighbours"), F.count("other").alias("occupied"))


@add(_neighbour_sql(1))
def neighbour_cells_face(spark, sf):
    return _neighbours(spark, sf, "face")


@add(_neighbour_sql(2))
def neighbour_cells_edge(spark, sf):
    return _neighbours(spark, sf, "edge")


@add(_neighbour_sql(3))
def neighbour_cells_vertex(spark, sf):
    return _neighbours(spark, sf, "vertex")


@add(f"WITH {ORDERS}, c AS (SELECT id, {sql_cell('x', 'y', 'z', 12)} AS cell FROM od) SELECT id, cell, CAST(cell AS HUGEINT) * 512 <= {sql_cell('x', 'y', 'z', 15)} AND {sql_cell('x', 'y', 'z', 15)} <= CAST(cell AS HUGEINT) * 512 + 511 AS inside, cell * 512 AS first, cell * 512 + 511 AS last FROM c JOIN od USING (id)")
def descendant_range(spark, sf):
    c = index.with_cell(index.with_cell(views.orders(spark, sf), 15, "fine"), 12)
    first, last = keys.first_descendant("cell", 3), keys.last_descendant("cell", 3)
    return c.select("id", "cell", F.col("fine").between(first, last).alias("inside"), first.alias("first"), last.alias("last"))


BOX = (500.0, 300.0, 100.0, 1200.0, 1500.0, 900.0)


@add(f"WITH {ORDERS} SELECT id, x, y, z FROM od WHERE x BETWEEN {BOX[0]} AND {BOX[3]} AND y BETWEEN {BOX[1]} AND {BOX[4]} AND z BETWEEN {BOX[2]} AND {BOX[5]}")
def range_by_code_intervals(spark, sf):
    return index.in_box(views.orders(spark, sf), BOX).select("id", "x", "y", "z")


_IX = [range(int(BOX[k] // 128), int(BOX[k + 3] // 128) + 1) for k in range(3)]


@add(
    f"WITH g AS (SELECT {sql_morton('a', 'b', 'c', 14)} AS code FROM range({_IX[0].start}, {_IX[0].stop}) x(a), range({_IX[1].start}, {_IX[1].stop}) y(b), range({_IX[2].start}, {_IX[2].stop}) z(c)), "
    "i AS (SELECT code, code - row_number() OVER (ORDER BY code) AS g FROM g) SELECT MIN(code) AS first, MAX(code) AS last FROM i GROUP BY g"
)
def litmax_bigmin_intervals(spark, sf):
    return spark.createDataFrame(intervals.world_box_intervals(BOX, LEVEL), "first long, last long")


@add(
    f"WITH g AS (SELECT {sql_morton('a', 'b', 'c', 14)} AS code FROM range({_IX[0].start}, {_IX[0].stop}) x(a), range({_IX[1].start}, {_IX[1].stop}) y(b), range({_IX[2].start}, {_IX[2].stop}) z(c)), "
    "i AS (SELECT code, code - row_number() OVER (ORDER BY code) AS g FROM g) SELECT MIN(code) AS first, MAX(code) AS last FROM i GROUP BY g"
)
def cells_of_box_merged(spark, sf):
    """The same runs by enumerating the cells and merging neighbours (gaps and islands); the box is a query's, not data."""
    from pyspark.sql import Window

    axes = [F.explode(F.sequence(F.lit(r.start), F.lit(r.stop - 1))) for r in _IX]
    g = spark.range(1).select(axes[0].alias("a")).select("a", axes[1].alias("b")).select("a", "b", axes[2].alias("c")).select(keys.morton("a", "b", "c").alias("code"))
    g = g.withColumn("g", F.col("code") - F.row_number().over(Window.orderBy("code")))
    return g.groupBy("g").agg(F.min("code").alias("first"), F.max("code").alias("last")).drop("g")


@add(f"WITH {EVENTS}, c AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 21)} AS code FROM ev), m AS (SELECT code, greatest({sql_compact('code', 0)}, {sql_compact('code', 1)}, {sql_compact('code', 2)}) AS top FROM c) SELECT code, CAST(CASE WHEN code = 0 THEN 0 ELSE greatest(0, least(21, 24 - CASE WHEN top = 0 THEN 0 ELSE length(bin(top)) END)) END AS INTEGER) AS level FROM m")
def level_of_code(spark, sf):
    c = views.events(spark, sf).select(keys.cell_code("x", "y", "z", 21).alias("code")).distinct()
    return c.select("code", keys.level_of_world_code("code").alias("level"))


def _type_sql(level: int) -> str:
    size = 1 << (21 - level)
    u, v, w = (f"({c} - floor({c} / {size}) * {size})" for c in "xyz")
    # by the greatest offset in the cell, then the middle one; shared faces go to the lowest type
    return (
        f"CASE WHEN {u} >= {v} AND {v} >= {w} THEN 0 WHEN {v} >= {u} AND {u} >= {w} THEN 1 WHEN {w} >= {u} AND {u} >= {v} THEN 2 "
        f"WHEN {w} >= {v} AND {v} >= {u} THEN 3 WHEN {u} >= {w} AND {w} >= {v} THEN 4 WHEN {v} >= {w} AND {w} >= {u} THEN 5 END"
    )


@add(f"WITH {ORDERS} SELECT id, {sql_cell('x', 'y', 'z', 14)} AS cell, {_type_sql(14)} AS type FROM od")
def tet_locate(spark, sf):
    return index.with_cell(views.orders(spark, sf), 14).select("id", "cell", keys.tet_type("x", "y", "z", 14).alias("type"))


@add(f"WITH {ORDERS}, t AS (SELECT {sql_cell('x', 'y', 'z', 13)} AS cell, {_type_sql(13)} AS type FROM od) SELECT cell, type, COUNT(*) AS n FROM t GROUP BY ALL")
def tet_cells(spark, sf):
    t = index.with_cell(views.orders(spark, sf), 13).withColumn("type", keys.tet_type("x", "y", "z", 13))
    return t.groupBy("cell", "type").agg(F.count("*").alias("n"))


@add("SELECT 0 AS violations")
def tet_partition_violations(spark, sf):
    """Points of no type, or of several without lying on a shared face."""
    size = 128.0
    t = views.orders(spark, sf)
    u, v, w = ((F.col(c) - F.floor(F.col(c) / size) * size) for c in "xyz")
    hits = sum((keys.in_type(u, v, w, k).cast("int") for k in range(6)), F.lit(0))
    face = (u == v) | (v == w) | (u == w)
    return t.where((hits == 0) | ((hits > 1) & ~face)).agg(F.count("*").cast("int").alias("violations"))


_STEP = "(" + " UNION ALL ".join(f"SELECT {t} AS t, {o} AS o, {keys.TYPE_STEP[t][o]} AS nt" for t in range(6) for o in range(8)) + ")"


def _path_sql(level: int) -> str:
    octant = f"((cx >> ({level} - w.k - 1)) & 1) + 2 * ((cy >> ({level} - w.k - 1)) & 1) + 4 * ((cz >> ({level} - w.k - 1)) & 1)"
    return (
        f"WITH RECURSIVE {ORDERS}, c AS (SELECT DISTINCT {', '.join(f'{sql_index(a, level)} AS c{a}' for a in 'xyz')} FROM od), s AS (SELECT * FROM {_STEP}), "
        f"w(cx, cy, cz, k, t, lo, hi) AS (SELECT cx, cy, cz, 0, 0, 0::BIGINT, 0::BIGINT FROM c UNION ALL "
        f"SELECT cx, cy, cz, w.k + 1, s.nt, CASE WHEN w.k < 10 THEN lo + (({octant}) * 8 + s.nt) * (1::BIGINT << (6 * (w.k % 10))) ELSE lo END, CASE WHEN w.k >= 10 THEN hi + (({octant}) * 8 + s.nt) * (1::BIGINT << (6 * (w.k % 10))) ELSE hi END "
        f"FROM w JOIN s ON s.t = w.t AND s.o = {octant} WHERE w.k < {level}) "
    )


@add(_path_sql(14) + "SELECT cx, cy, cz, t AS type, lo, hi FROM w WHERE k = 14")
def tm_index(spark, sf):
    cells = views.orders(spark, sf).select(*(keys.cell_index(c, 14).alias(f"c{c}") for c in "xyz")).distinct()
    out = cells.withColumn("k", keys.tm_index("cx", "cy", "cz", 14))
    return out.select("cx", "cy", "cz", keys.tet_type_at("cx", "cy", "cz", 14).alias("type"), F.col("k.lo").alias("lo"), F.col("k.hi").alias("hi"))


@add(_path_sql(12) + f"SELECT cx * 512 AS x, cy * 512 AS y, cz * 512 AS z, (cx >> 1) * 1024 AS px, (cy >> 1) * 1024 AS py, (cz >> 1) * 1024 AS pz, t AS ptype FROM w WHERE k = 11")
def tet_parent(spark, sf):
    cells = views.orders(spark, sf).select(*((keys.cell_index(c, 12) * 512).alias(c) for c in "xyz")).distinct()
    p = cells.withColumn("p", keys.tet_parent("x", "y", "z", F.lit(0), 12))
    return p.select("x", "y", "z", *(F.col(f"p.{c}").alias(f"p{c}") for c in "xyz"), F.col("p.type").alias("ptype"))


#: From a cube's low corner to its high one, an edge at a time: by type, at which vertex x, y and z have grown.
_CORNERS = (
    "SELECT t, vertex, CAST(vertex >= gx AS INTEGER) AS a, CAST(vertex >= gy AS INTEGER) AS b, CAST(vertex >= gz AS INTEGER) AS c "
    "FROM (VALUES (0, 1, 2, 3), (1, 2, 1, 3), (2, 2, 3, 1), (3, 3, 2, 1), (4, 1, 3, 2), (5, 3, 1, 2)) g(t, gx, gy, gz), (VALUES (0), (1), (2), (3)) v(vertex)"
)


@add(f"WITH {ORDERS}, t AS (SELECT DISTINCT {', '.join(f'{sql_index(a, 12)} * 512 AS {a}' for a in 'xyz')}, {_type_sql(12)} AS type FROM od), k AS ({_CORNERS}) SELECT t.x, t.y, t.z, type, vertex, t.x + 512 * a AS vx, t.y + 512 * b AS vy, t.z + 512 * c AS vz FROM t JOIN k ON k.t = type")
def tet_vertices(spark, sf):
    t = views.orders(spark, sf).select(keys.tet_type("x", "y", "z", 12).alias("type"), *((keys.cell_index(c, 12) * 512).alias(c) for c in "xyz")).distinct()
    v = t.select("x", "y", "z", "type", F.posexplode(keys.tet_vertices("x", "y", "z", F.lit(512), "type")).alias("vertex", "v"))
    return v.select("x", "y", "z", "type", "vertex", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.col("v.z").alias("vz"))


@add("SELECT 0 AS violations")
def tet_face_neighbour_violations(spark, sf):
    """Faces whose neighbour's neighbour across the face it names is not the tetrahedron itself."""
    t = views.orders(spark, sf).select(keys.tet_type("x", "y", "z", 12).alias("type"), *((keys.cell_index(c, 12) * 512).alias(c) for c in "xyz")).distinct()
    # the generator keeps the first step's expressions out of the second's
    four = F.array(*(keys.tet_face_neighbour("x", "y", "z", F.lit(512), "type", face) for face in range(4)))
    faces = t.withColumn("n", F.explode(four)).where("n IS NOT NULL")
    back = None
    for face in range(4):
        b = keys.tet_face_neighbour(F.col("n.x"), F.col("n.y"), F.col("n.z"), F.lit(512), F.col("n.type"), face)
        back = F.when(F.col("n.face") == face, b) if back is None else back.when(F.col("n.face") == face, b)
    bad = faces.withColumn("b", back).where(F.expr("b IS NULL OR b.x <> x OR b.y <> y OR b.z <> z OR b.type <> type"))
    return bad.agg(F.count("*").cast("int").alias("violations"))


def _lca_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE length(bin(xor({a}, {b}))) END"


@add(f"WITH {ORDERS}, p AS (SELECT id, {', '.join(f'CAST(floor({c}) AS BIGINT) AS {c}' for c in 'xyz')} FROM od) SELECT id, 21 - greatest({_lca_sql('x', '1000::BIGINT')}, {_lca_sql('y', '1000::BIGINT')}, {_lca_sql('z', '700::BIGINT')}) AS level FROM p")
def common_ancestor_level(spark, sf):
    p = views.orders(spark, sf).select("id", *(F.floor(c).cast("long").alias(c) for c in "xyz"))
    return p.select("id", keys.common_level("x", "y", "z", F.lit(1000), F.lit(1000), F.lit(700)).cast("long").alias("level"))


@add(f"WITH {EVENTS}, c AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 19)} AS cell FROM ev) SELECT cell // 8 AS family, COUNT(*) AS members, COUNT(*) = 8 AS complete FROM c GROUP BY 1")
def family_merge_test(spark, sf):
    c = index.with_cell(views.events(spark, sf), 19).select("cell").distinct()
    return c.groupBy(keys.parent_code("cell").alias("family")).agg(F.count("*").alias("members"), (F.count("*") == 8).alias("complete"))


W = 4096.0
_TRI = "t AS (SELECT id, x / 4096.0::DOUBLE AS a, y / 4096.0::DOUBLE AS b, z / 4096.0::DOUBLE AS c FROM od)"


@add(f"WITH {ORDERS}, {_TRI}, q AS (SELECT *, CAST(floor(a * 64) AS BIGINT) AS qx, CAST(floor(b * 64) AS BIGINT) AS qy FROM t) SELECT id, CAST(CASE WHEN (a * 64 - qx) + (b * 64 - qy) > 1 THEN 1 ELSE 0 END AS BIGINT) AS type, qx, qy, least(qx, qy) AS n, CAST(floor(c * 64) AS BIGINT) AS line FROM q")
def prism_key_split(spark, sf):
    o = views.orders(spark, sf)
    t = o.withColumn("t", keys.triangle_split(F.col("x") / W, F.col("y") / W, 6))
    return t.select("id", F.col("t.type").alias("type"), F.col("t.x").alias("qx"), F.col("t.y").alias("qy"), F.col("t.n").alias("n"), keys.line_index(F.col("z") / W, 6).alias("line"))


@add(
    f"WITH {ORDERS}, {_TRI}, q AS (SELECT *, CAST(floor(a * 64) AS BIGINT) AS qx, CAST(floor(b * 64) AS BIGINT) AS qy FROM t WHERE a + b < 1), "
    "r AS (SELECT *, CASE WHEN qx + qy >= 64 THEN qx * 63 // (qx + qy) ELSE qx END AS tx FROM q), s AS (SELECT *, CASE WHEN qx + qy >= 64 THEN 63 - tx ELSE qy END AS ty FROM r) "
    "SELECT id, tx + ty * 4096 + least(64 - tx - ty, 63) * 16777216 + ((tx + ty) % 2) * 68719476736 AS triangle, CAST(floor(c * 64) AS BIGINT) AS line FROM s"
)
def prism_key_index(spark, sf):
    o = views.orders(spark, sf).where(F.col("x") / W + F.col("y") / W < 1)
    t = o.withColumn("t", keys.triangle_parity(F.col("x") / W, F.col("y") / W, 6))
    return t.select("id", keys.triangle_index(F.col("t"), 6).alias("triangle"), keys.line_index(F.col("z") / W, 6).alias("line"))


@add(
    f"WITH RECURSIVE {CUSTOMERS}, q AS (SELECT id, {', '.join(f'CAST(floor(greatest(0.0, least(1.0, {c} / 16384.0::DOUBLE)) * 1023) AS BIGINT) AS {c}' for c in 'xyz')} FROM cu), "
    "h(id, i, x, y, z, h) AS (SELECT id, 9, x, y, z, 0::BIGINT FROM q UNION ALL SELECT id, i - 1, "
    + ", ".join(
        f"CASE WHEN o IN (1, 2) THEN {swap} WHEN o IN (3, 4) THEN {turn} WHEN o IN (5, 6) THEN {both} ELSE {same} END"
        for swap, turn, both, same in (("z", "m - x", "m - z", "x"), ("y", "y", "y", "y"), ("x", "m - z", "m - x", "z"))
    )
    + ", h * 8 + [0, 1, 3, 2, 7, 6, 4, 5][o + 1] FROM (SELECT *, (1::BIGINT << i) - 1 AS m, CAST(CASE WHEN x & (1::BIGINT << i) <> 0 THEN 4 ELSE 0 END + CASE WHEN y & (1::BIGINT << i) <> 0 THEN 2 ELSE 0 END + CASE WHEN z & (1::BIGINT << i) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS o FROM h WHERE i >= 0)) "
    "SELECT id, h AS hilbert FROM h WHERE i = -1"
)
def hilbert_index(spark, sf):
    return views.customers(spark, sf).select("id", keys.hilbert("x", "y", "z", 0.0, 16384.0, bits=10).alias("hilbert"))


@add(f"WITH {ORDERS} SELECT id, " + " + ".join(f"((CAST(floor(x) AS BIGINT) >> {b}) & 1) * {1 << 2 * b} + ((CAST(floor(y) AS BIGINT) >> {b}) & 1) * {2 << 2 * b}" for b in range(12)) + " AS code FROM od")
def morton_2d(spark, sf):
    return views.orders(spark, sf).select("id", keys.interleave([F.floor("x"), F.floor("y")], 12).alias("code"))


@add(f"WITH {ORDERS}, c AS (SELECT {sql_cell('x', 'y', 'z', 12)} AS cell FROM od) SELECT cell, COUNT(*) AS n FROM c GROUP BY cell ORDER BY cell")
def curve_ordered_scan(spark, sf):
    return index.nodes(views.orders(spark, sf), 12).select("cell", "n").orderBy("cell")


@add(f"WITH {ORDERS} SELECT {sql_cell('x', 'y', 'z', 14)} AS cell, COUNT(*) AS n FROM od WHERE x BETWEEN {BOX[0]} AND {BOX[3]} AND y BETWEEN {BOX[1]} AND {BOX[4]} AND z BETWEEN {BOX[2]} AND {BOX[5]} GROUP BY 1 ORDER BY n DESC, cell LIMIT 100")
def densest_cells_in_box(spark, sf):
    """Orders per cell inside a box, the densest hundred."""
    return index.with_cell(index.in_box(views.orders(spark, sf), BOX), LEVEL).groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell").limit(100)
