"""Planes, frustums, lines of sight and view cones. Query shapes are Python values and become literals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions import geom
from cubeloom.operators import index

P, LOW, HIGH = index.P, index.LOW, index.HIGH


def _lit(v) -> str:
    return f"({float(v)!r})"


def plane_through(p1, p2, p3) -> tuple[float, float, float, float]:
    """Unit-normal plane through three points; raises ValueError if they are in line."""
    u, v = ([b - a for a, b in zip(p1, q, strict=True)] for q in (p2, p3))
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return plane_at(p1, n)


def plane_at(point, normal) -> tuple[float, float, float, float]:
    size = math.sqrt(sum(c * c for c in normal))
    if size < 1e-12:
        raise ValueError("a plane needs a normal")
    n = [c / size for c in normal]
    return (*n, -sum(a * b for a, b in zip(n, point, strict=True)))


def frustum(position, look_at, up, fov_y: float, aspect: float, near: float, far: float) -> list[tuple]:
    """Six planes with outward normals of a perspective view (fov_y in radians)."""

    def unit(v):
        s = math.sqrt(sum(c * c for c in v))
        return [c / s for c in v]

    def cross(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    f = unit([b - a for a, b in zip(position, look_at, strict=True)])
    r = unit(cross(f, up))
    u = cross(r, f)
    ty = math.tan(fov_y / 2)
    tx = ty * aspect
    along = lambda k, v, s: [s * (a - k * b) for a, b in zip(v, f, strict=True)]
    sides = [along(tx, r, 1), [-a - tx * b for a, b in zip(r, f, strict=True)], along(ty, u, 1), [-a - ty * b for a, b in zip(u, f, strict=True)]]
    planes = [plane_at(position, n) for n in sides]
    planes.append(plane_at([p + near * c for p, c in zip(position, f, strict=True)], [-c for c in f]))
    planes.append(plane_at([p + far * c for p, c in zip(position, f, strict=True)], f))
    return planes


def box_frustum(low, high) -> list[tuple]:
    """The six planes of an axis-aligned (orthographic) view volume."""
    out = []
    for k in range(3):
        n = [0.0] * 3
        n[k] = 1.0
        out += [(*[-c for c in n], float(low[k])), (*n, -float(high[k]))]
    return out


def _planes(planes):
    return [tuple(map(_lit, p)) for p in planes]


def plane_query(df: DataFrame, plane, tolerance: float = 0.0) -> DataFrame:
    """Entities classified by a plane with signed distance; with a tolerance, those within it or crossing only."""
    plane = tuple(map(_lit, plane))
    kind, distance = geom.plane_class(plane, LOW, HIGH, max(tolerance, 1e-6))
    value = geom.plane_value(plane, P)
    near = max(tolerance, 1e-6)
    point = f"CASE WHEN abs({value}) <= {near!r} THEN 'ON_PLANE' WHEN {value} > 0 THEN 'POSITIVE_SIDE' ELSE 'NEGATIVE_SIDE' END"
    bounded = "min_x" in df.columns
    out = df.withColumn("side", F.expr(f"CASE WHEN min_x IS NULL THEN {point} ELSE {kind} END" if bounded else point))
    out = out.withColumn("distance", F.expr(f"CASE WHEN min_x IS NULL THEN {value} ELSE {distance} END" if bounded else value))
    return out if tolerance == 0 else out.where((F.abs("distance") <= tolerance) | (F.col("side") == "INTERSECTING"))


def frustum_ids(df: DataFrame, planes) -> DataFrame:
    """Entities whose position is in the frustum."""
    return df.where(F.expr(geom.frustum_point(_planes(planes), P)))


def frustum_view(df: DataFrame, planes, camera) -> DataFrame:
    """Entities whose bounds meet the frustum: INSIDE or INTERSECTING, with the distance of the camera to them."""
    q = _planes(planes)
    c = tuple(map(_lit, camera))
    point = geom.frustum_point(q, P)
    bounded = "min_x" in df.columns
    low = tuple(f"coalesce({a}, {p})" for a, p in zip(LOW, P, strict=True)) if bounded else P
    high = tuple(f"coalesce({a}, {p})" for a, p in zip(HIGH, P, strict=True)) if bounded else P
    meets = geom.frustum_box_meets(q, low, high)
    kept = df.where(F.expr(f"CASE WHEN {low[0]} = {high[0]} AND {low[1]} = {high[1]} AND {low[2]} = {high[2]} THEN {point} ELSE {meets} END"))
    kept = kept.withColumn("view", F.expr(f"CASE WHEN {geom.frustum_box_inside(q, low, high)} THEN 'INSIDE' ELSE 'INTERSECTING' END"))
    return kept.withColumn("distance", F.expr(geom.box_distance(c, low, high)))


#: Size of a point, block limit, and where along the line an occluder counts half.
POINT_SIZE, BLOCKED, ENDS = 1.0, 0.5, (0.1, 0.9)


DIRECTIONS, WIDE = (256, 64, 16, 4), 4  # cells of a unit of direction, and most of an axis that a box is looked for in
ALL = "sequence(-2L, 1L)"  # the cells of a whole axis where a unit is one cell


def _toward(df: DataFrame, p: DataFrame, eye, radius: float) -> DataFrame:
    """df joined with segments p from one eye, less what no segment can hit: a box meets segments in the cells (x and y of
    the unit vector) of the directions that it covers. Cells are as fine as the box is narrow; a box near or around the eye
    covers all of the coarsest. A box with a bound that is not known meets none."""
    bounded = "min_x" in df.columns
    rows = df
    for c, a, b, e in zip(P, LOW, HIGH, eye, strict=True):
        rows = rows.withColumn(f"_l{c}", F.expr(f"coalesce({a}, {c} - {radius!r}) - {_lit(e)}" if bounded else f"{c} - {radius!r} - {_lit(e)}"))
        rows = rows.withColumn(f"_h{c}", F.expr(f"coalesce({b}, {c} + {radius!r}) - {_lit(e)}" if bounded else f"{c} + {radius!r} - {_lit(e)}"))
    rows = rows.where(" AND ".join(f"_l{c} IS NOT NULL AND _h{c} IS NOT NULL" for c in P))
    near, far = ({c: f"{f}" for c, f in zip(P, fs, strict=True)} for fs in ([f"pow(greatest(_l{c}, -_h{c}, 0D), 2)" for c in P], [f"pow(greatest(abs(_l{c}), abs(_h{c})), 2)" for c in P]))
    for c in P[:2]:
        rest = lambda of, c=c: " + ".join(v for k, v in of.items() if k != c)
        part = lambda v, of: f"{v} / greatest(sqrt({v} * {v} + {of}), 1e-300D)"
        rows = rows.withColumn(f"_u{c}", F.expr(f"CASE WHEN _l{c} >= 0 THEN {part(f'_l{c}', rest(far))} ELSE {part(f'_l{c}', rest(near))} END - 2e-6D"))
        rows = rows.withColumn(f"_v{c}", F.expr(f"CASE WHEN _h{c} >= 0 THEN {part(f'_h{c}', rest(near))} ELSE {part(f'_h{c}', rest(far))} END + 2e-6D"))
    wide = F.expr(f"CASE WHEN {' + '.join(near.values())} > 1e-6D THEN greatest({', '.join(f'_v{c} - _u{c}' for c in P[:2])}) ELSE 9D END")
    fine = " ".join(f"WHEN _wide <= {WIDE / n!r}D THEN {n}" for n in DIRECTIONS)
    rows = rows.withColumn("_wide", wide).withColumn("_n", F.expr(f"CASE {fine} ELSE 1 END"))
    keys = ["_n", "_cx", "_cy"]
    for c in P[:2]:
        rows = rows.withColumn(f"_c{c}", F.explode(F.expr(f"CASE WHEN _n = 1 THEN {ALL} ELSE sequence(CAST(floor(_u{c} * _n) AS BIGINT), CAST(floor(_v{c} * _n) AS BIGINT)) END")))
    at = p.withColumn("_n", F.explode(F.array(*map(F.lit, (*DIRECTIONS, 1))))).withColumns({f"_c{c}": F.expr(f"CAST(floor(d{c} * _n) AS BIGINT)") for c in P[:2]})
    # a given number of tasks: by their bytes few rows go to few, whose meetings are many times as many
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.select(*keys, *df.columns).repartition(tasks, *keys).join(at.repartition(tasks, *keys), keys).drop(*keys)


def occluders(df: DataFrame, pairs: DataFrame, radius: float = 0.1, few: bool = True, eye=None) -> DataFrame:
    """(pair, id, t, ratio, kind) of the entities on the segments of pairs (pair, ox.., tx..).

    ratio: half the squared angular size, at most 1, halved near the ends; kind: behind, before_observer, full, partial.
    The observer-target segments are few (a query's parameters) and broadcast, unless few is False. Many segments that
    all begin at `eye` meet entities by their direction."""
    o, t = ("ox", "oy", "oz"), ("tx", "ty", "tz")
    p = pairs.withColumn("_d", F.expr(geom.dist(o, t))).where("_d > 0")
    for axis, a, b in zip("xyz", o, t, strict=True):
        p = p.withColumn(f"d{axis}", (F.col(b) - F.col(a)) / F.col("_d"))
    d = ("dx", "dy", "dz")
    point = geom.ray_sphere(o, d, P, repr(radius), "_d")
    bounded = "min_x" in df.columns
    hit = f"CASE WHEN min_x IS NULL THEN {point} ELSE {geom.ray_box(o, d, LOW, HIGH, '_d')} END" if bounded else point
    size = f"CASE WHEN min_x IS NULL THEN {POINT_SIZE} ELSE greatest(max_x - min_x, max_y - min_y, max_z - min_z) END" if bounded else repr(POINT_SIZE)
    met = _toward(df, p, eye, radius) if eye else df.crossJoin(F.broadcast(p) if few else p)
    rows = met.withColumn("t", F.expr(hit)).where("t IS NOT NULL").withColumn("_size", F.expr(size))
    angular = "(_size / greatest(t, 1.0))"
    ratio = f"least(1.0, 0.5 * {angular} * {angular}) * CASE WHEN t / _d < {ENDS[0]} OR t / _d > {ENDS[1]} THEN 0.5 ELSE 1.0 END"
    kind = "CASE WHEN t > _d THEN 'behind' WHEN t < 0.05 * _d THEN 'before_observer' WHEN _size / greatest(t, 1e-9) > 0.5 THEN 'full' ELSE 'partial' END"
    return rows.withColumn("ratio", F.expr(ratio)).withColumn("occlusion", F.expr(kind)).select("pair", "id", "t", "ratio", "occlusion")


def line_of_sight(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, occluded, n, clear): the occlusion ratios summed up to 1; from 0.5 on the line is blocked."""
    sums = occluders(df, pairs).groupBy("pair").agg(F.sum("ratio").alias("_r"), F.count("*").alias("_n"))
    out = pairs.select("pair").join(sums, "pair", "left")
    occluded = F.least(F.lit(1.0), F.coalesce("_r", F.lit(0.0)))
    return out.select("pair", occluded.alias("occluded"), F.coalesce("_n", F.lit(0)).alias("n"), (occluded < BLOCKED).alias("clear"))


def in_cone(df: DataFrame, eye, direction, angle: float, reach: float) -> DataFrame:
    """Entities within reach whose direction is within `angle` (radians) of the view direction: cosines are compared."""
    e, v = tuple(map(_lit, eye)), tuple(map(_lit, direction))
    to = geom.minus(P, e)
    size = math.sqrt(sum(c * c for c in direction))
    d = geom.dist(P, e)
    near = df.withColumn("distance", F.expr(d)).where(F.col("distance") <= reach)
    return near.where(F.expr(f"distance = 0 OR {geom.dot(to, v)} >= {math.cos(angle)!r} * distance * {size!r}"))


def visible_in_cone(df: DataFrame, eye, direction, angle: float, reach: float) -> DataFrame:
    """Entities of in_cone that the eye sees: what lies on the line to their position (themselves included, full or
    partial) sums to less than 0.5, or is themselves alone."""
    # What stands at one place has one line, and boxes alike are one with their number and the least of their ids.
    bounds = [*P, *LOW, *HIGH] if "min_x" in df.columns else [*P]
    things = df.groupBy(*bounds).agg(F.struct(F.min("id").alias("one"), F.count("*").alias("n")).alias("id"))
    cone = in_cone(df, eye, direction, angle, reach)
    places = cone.where("distance >= 1e-6").select(*P).distinct()
    segments = places.select(F.struct(*P).alias("pair"), *(F.lit(float(v)).alias(c) for v, c in zip(eye, ("ox", "oy", "oz"), strict=True)), *(F.col(c).alias(f"t{c}") for c in P))
    distance = F.expr(geom.dist(tuple(f"pair.{c}" for c in P), tuple(map(_lit, eye))))
    hits = occluders(things, segments, eye=eye).where("occlusion IN ('full', 'partial')").where(F.col("t") < distance)
    sums = hits.groupBy("pair").agg(F.sum(F.col("ratio") * F.col("id.n")).alias("_r"), F.sum("id.n").alias("_n"), F.min("id.one").alias("_one"))
    hidden = sums.where(F.col("_r") >= BLOCKED).select(*(F.col(f"pair.{c}").alias(c) for c in P), F.when(F.col("_n") == 1, F.col("_one")).alias("_only"), F.lit(True).alias("_hidden"))
    met = cone.join(hidden, list(P), "left")
    return met.where(F.col("_hidden").isNull() | F.coalesce(F.col("_only") == F.col("id"), F.lit(False))).select(*cone.columns)


def vantage_scores(df: DataFrame, target, points: DataFrame) -> DataFrame:
    """(pair, score): candidate points (pair, ox..) ranked by how well they see the target."""
    t = dict(zip(("tx", "ty", "tz"), map(float, target), strict=True))
    pairs = points.withColumns({k: F.lit(v) for k, v in t.items()})
    seen = line_of_sight(df, pairs).join(pairs.withColumn("_d", F.expr(geom.dist(("ox", "oy", "oz"), ("tx", "ty", "tz")))).select("pair", "_d"), "pair")
    clear = F.when(F.col("clear"), 1.0).otherwise(1 - F.col("occluded"))
    return seen.select("pair", (clear * F.greatest(F.lit(0.1), 1000 / F.col("_d")) / (1 + 0.1 * F.col("n"))).alias("score"))
