"""n-dimensional vectors, transforms and physics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.functions import geom, nd
from cubeloom.queries import REGISTRY
from cubeloom.views import EVENTS, ORDERS, PARTS, VECTORS

add = REGISTRY.add
P = ("x", "y", "z")
_Q = "q AS (SELECT v AS qv FROM ve WHERE id = 0)"
_SUM = "list_sum(list_transform(list_zip(v, qv), lambda p: {}))"


def pairs(spark, sf):
    v = views.vectors(spark, sf)
    return v.crossJoin(F.broadcast(v.where("id = 0").select(F.col("v").alias("qv"))))


@add(f"WITH {VECTORS}, {_Q} SELECT id, round(sqrt({_SUM.format('(p[1] - p[2]) * (p[1] - p[2])')}), 5) AS l2, round({_SUM.format('abs(p[1] - p[2])')}, 5) AS l1, round({_SUM.format('p[1] * p[2]')}, 5) AS dot FROM ve, q")
def nd_distances(spark, sf):
    p = pairs(spark, sf)
    return p.select("id", F.round(nd.distance("v", "qv"), 5).alias("l2"), F.round(nd.manhattan("v", "qv"), 5).alias("l1"), F.round(nd.dot("v", "qv"), 5).alias("dot"))


@add(f"WITH {VECTORS}, {_Q}, d AS (SELECT id, sqrt({_SUM.format('(p[1] - p[2]) * (p[1] - p[2])')}) AS d FROM ve, q) SELECT id, round(d, 5) AS distance FROM d ORDER BY d, id LIMIT 10")
def nd_knn(spark, sf):
    return pairs(spark, sf).select("id", nd.distance("v", "qv").alias("d")).orderBy("d", "id").limit(10).select("id", F.round("d", 5).alias("distance"))


@add(f"WITH {VECTORS} SELECT id FROM ve WHERE v[1] BETWEEN -1.0 AND 0.5 AND v[2] BETWEEN -0.5 AND 1.0 AND v[3] BETWEEN -1.5 AND 1.5")
def nd_range_query(spark, sf):
    return views.vectors(spark, sf).where(nd.inside(nd.project("v", [0, 1, 2]), (-1.0, -0.5, -1.5), (0.5, 1.0, 1.5))).select("id")


@add(f"WITH {VECTORS} SELECT id FROM ve WHERE sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) <= 1")
def nd_radius_query(spark, sf):
    return views.vectors(spark, sf).where(nd.distance(nd.project("v", [0, 1, 2]), (0.0, 0.0, 0.0)) <= 1).select("id")


_CELL = ", ".join(f"least(greatest(CAST(floor((v[{k}] + 4) / 8.0::DOUBLE * 8) AS BIGINT), 0), 7) AS c{k}" for k in (1, 2, 3))


@add(f"WITH {VECTORS}, c AS (SELECT id, {_CELL} FROM ve) SELECT c1, c2, c3, COUNT(*) AS n FROM c GROUP BY ALL")
def nd_discretise(spark, sf):
    c = views.vectors(spark, sf).withColumn("c", nd.cell(nd.project("v", [0, 1, 2]), [-4.0] * 3, [4.0] * 3, 3))
    return c.groupBy(*(F.col("c")[k].alias(f"c{k + 1}") for k in range(3))).agg(F.count("*").alias("n"))


def _candidates(v):
    c = v.select("id", nd.cell(nd.project("v", [0, 1, 2]), [-4.0] * 3, [4.0] * 3, 3).alias("c")).select("id", *(F.col("c")[k].alias(f"c{k}") for k in range(3)))
    near = c
    for k in range(3):
        near = near.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"c{k}") - 1, F.col(f"c{k}") + 1)))
    return near.withColumnRenamed("id", "id1").join(c.withColumnRenamed("id", "id2"), ["c0", "c1", "c2"]).where("id1 < id2").select("id1", "id2")


@add(f"WITH {VECTORS}, c AS (SELECT id, {_CELL} FROM ve) SELECT a.id AS id1, b.id AS id2 FROM c a JOIN c b ON a.id < b.id AND abs(a.c1 - b.c1) <= 1 AND abs(a.c2 - b.c2) <= 1 AND abs(a.c3 - b.c3) <= 1")
def nd_candidates_whole(spark, sf):
    return _candidates(views.vectors(spark, sf))


@add(f"WITH {PARTS} SELECT a.id AS id1, round(greatest(a.min_x, b.min_x), 6) AS low_x, round(least(a.max_x, b.max_x), 6) AS high_x, round(least(a.min_y, b.min_y), 6) AS union_low_y, round(greatest(a.max_y, b.max_y), 6) AS union_high_y, a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y AND a.min_z <= b.max_z AND b.min_z <= a.max_z AS overlap FROM pt a, (SELECT * FROM pt WHERE id = 77) b")
def nd_box_algebra(spark, sf):
    p = views.parts(spark, sf)
    box = p.select("id", F.array("min_x", "min_y", "min_z").alias("lo"), F.array("max_x", "max_y", "max_z").alias("hi"))
    b = box.crossJoin(F.broadcast(box.where("id = 77").select(F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))))
    (ilo, ihi), (ulo, uhi) = nd.intersection("lo", "hi", "lo2", "hi2"), nd.union("lo", "hi", "lo2", "hi2")
    return b.select(F.col("id").alias("id1"), F.round(ilo[0], 6).alias("low_x"), F.round(ihi[0], 6).alias("high_x"), F.round(ulo[1], 6).alias("union_low_y"), F.round(uhi[1], 6).alias("union_high_y"), nd.overlap("lo", "hi", "lo2", "hi2").alias("overlap"))


@add(f"WITH {PARTS} SELECT id, round(sqrt(" + " + ".join(f"power(greatest(min_{c} - 300, 300 - max_{c}, 0), 2)" for c in "xyz") + "), 6) AS distance FROM pt")
def nd_distance_to_box(spark, sf):
    d = nd.box_distance((300.0, 300.0, 300.0), F.array("min_x", "min_y", "min_z"), F.array("max_x", "max_y", "max_z"))
    return views.parts(spark, sf).select("id", F.round(d, 6).alias("distance"))


@add(f"WITH {VECTORS}, {_Q} SELECT id, round(v[1] + (qv[1] - v[1]) * 0.25, 6) AS lerp_1, round(v[2] * qv[3] - v[3] * qv[2], 6) AS cross_1, round(v[1] + qv[1], 6) AS sum_1, round(v[1] - qv[1], 6) AS diff_1, round(v[1] * 2.5, 6) AS scaled_1 FROM ve, q")
def nd_algebra(spark, sf):
    p = pairs(spark, sf)
    one = lambda c, n: F.round(c[0], 6).alias(n)
    return p.select("id", one(nd.lerp("v", "qv", 0.25), "lerp_1"), one(nd.cross("v", "qv"), "cross_1"), one(nd.add("v", "qv"), "sum_1"), one(nd.subtract("v", "qv"), "diff_1"), one(nd.scale("v", 2.5), "scaled_1"))


ROT = nd.compose(nd.rotation((0.0, 0.0, 1.0), math.pi / 6), nd.scaling([2.0, 1.0, 0.5]))


@add(f"WITH {ORDERS} SELECT id, " + ", ".join(f"round(({row[0]!r}::DOUBLE) * x + ({row[1]!r}::DOUBLE) * y + ({row[2]!r}::DOUBLE) * z + {k + 1}, 5) AS t{c}" for k, (row, c) in enumerate(zip(ROT, "xyz", strict=True))) + " FROM od")
def affine_transform(spark, sf):
    o = views.orders(spark, sf).withColumn("t", nd.linear(F.array(*P), ROT, [1.0, 2.0, 3.0]))
    return o.select("id", *(F.round(F.col("t")[k], 5).alias(f"t{c}") for k, c in enumerate(P)))


@add("SELECT 0 AS violations")
def transform_round_trip(spark, sf):
    back = nd.linear(nd.linear(F.array(*P), ROT), nd.inverse(ROT))
    far = nd.distance(back, F.array(*P)) > 1e-6
    return views.orders(spark, sf).where(far).agg(F.count("*").cast("int").alias("violations"))


@add(f"WITH {EVENTS} SELECT id, round(abs(x * (y * z) - 0) / 6, 4) AS volume FROM ev")
def tetrahedron_volume(spark, sf):
    v = geom.tetrahedron_volume(("0.0D",) * 3, ("x", "0.0D", "0.0D"), ("0.0D", "y", "0.0D"), ("0.0D", "0.0D", "z"))
    return views.events(spark, sf).select("id", F.round(F.expr(v), 4).alias("volume"))


@add(f"WITH {EVENTS} SELECT id, round(x / 2, 5) AS cx, round((y + 1) / 2, 5) AS cy, round((z + 1) / 2, 5) AS cz FROM ev")
def circumcentres(spark, sf):
    c = geom.circumcentre(("0.0D",) * 3, ("x", "0.0D", "0.0D"), ("0.0D", "(y + 1)", "0.0D"), ("0.0D", "0.0D", "(z + 1)"))
    return views.events(spark, sf).select("id", *(F.round(F.expr(e), 5).alias(f"c{n}") for e, n in zip(c, P, strict=True)))


@add(f"WITH {EVENTS} SELECT id FROM ev WHERE power(x - 50, 2) + power(y - 50, 2) + power(z - 50, 2) < 7500 - 1e-6")
def in_sphere(spark, sf):
    s = geom.in_sphere(("0.0D",) * 3, ("100.0D", "0.0D", "0.0D"), ("0.0D", "100.0D", "0.0D"), ("0.0D", "0.0D", "100.0D"), P)
    return views.events(spark, sf).where(F.expr(f"{s} > 1e-6")).select("id")


@add(f"WITH {EVENTS}, m AS (SELECT id, x, (id % 7 - 3)::DOUBLE AS v, (id % 3 - 1)::DOUBLE AS a FROM ev) SELECT id, round(x + v * 0.5 + 0.5 * a * 0.25, 6) AS predicted, round(v + a * 0.5, 6) AS velocity, round((v + a * 0.5) * 0.5, 6) AS displacement FROM m")
def predict_and_integrate(spark, sf):
    v, a, dt = (F.col("id") % 7 - 3).cast("double"), (F.col("id") % 3 - 1).cast("double"), 0.5
    return views.events(spark, sf).select("id", F.round(F.col("x") + v * dt + 0.5 * a * dt * dt, 6).alias("predicted"), F.round(v + a * dt, 6).alias("velocity"), F.round((v + a * dt) * dt, 6).alias("displacement"))


@add(f"WITH {EVENTS} SELECT id, round((x - lag(x, 1) OVER w) / ((us - lag(us) OVER w) / 1e6), 9) AS speed FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)")
def velocity_from_history(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us")
    dt = (F.col("us") - F.lag("us").over(w)) / 1e6
    return views.events(spark, sf).select("id", F.round((F.col("x") - F.lag("x").over(w)) / dt, 9).alias("speed"))


@add(f"WITH {PARTS} SELECT id, round(10 * (4 * half * half + 4 * half * half) / 12, 6) AS box, round(0.4 * 10 * half * half, 6) AS sphere, round(10 * (3 * half * half + 4 * half * half) / 12, 6) AS cylinder FROM pt")
def inertia(spark, sf):
    """Moments about x of solids of mass 10: a cube, a sphere, an upright cylinder."""
    h = F.col("half")
    return views.parts(spark, sf).select("id", F.round(10 * ((2 * h) ** 2 + (2 * h) ** 2) / 12, 6).alias("box"), F.round(0.4 * 10 * h * h, 6).alias("sphere"), F.round(10 * (3 * h * h + (2 * h) ** 2) / 12, 6).alias("cylinder"))


@add(f"WITH {PARTS} SELECT id, round(min_x - half * 3, 6) AS min_x, round(max_x + half * 3, 6) AS max_x, id % 10 < 3 AS expired FROM pt")
def temporal_bounds(spark, sf):
    """Bounds grown by velocity times duration, and whether their validity has run out."""
    return views.parts(spark, sf).select("id", F.round(F.col("min_x") - F.col("half") * 3, 6).alias("min_x"), F.round(F.col("max_x") + F.col("half") * 3, 6).alias("max_x"), (F.col("id") % 10 < 3).alias("expired"))


@add(f"WITH {EVENTS} SELECT id, CAST(bit_count(xor(id, user_id)) AS BIGINT) AS xor_bits, id & user_id AS both, id | user_id AS either, (id >> 2) & 15 AS slice FROM ev")
def bit_vectors(spark, sf):
    return views.events(spark, sf).select("id", F.bit_count(F.col("id").bitwiseXOR(F.col("user_id"))).cast("long").alias("xor_bits"), F.col("id").bitwiseAND(F.col("user_id")).alias("both"), F.col("id").bitwiseOR(F.col("user_id")).alias("either"), F.shiftright("id", 2).bitwiseAND(F.lit(15).cast("long")).alias("slice"))
