"""Statistics, adaptive cells, clusters, refinement, duplicates; ingest as upserts."""

from __future__ import annotations


from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.operators import index, stats
from cubeloom.plans import intervals
from cubeloom.queries import REGISTRY
from cubeloom.views import CUSTOMERS, EVENTS, ORDERS, PARTS, sql_cell

add = REGISTRY.add
P = index.P


@add(f"WITH {ORDERS}, c AS (SELECT id, {sql_cell('x', 'y', 'z', 14)} AS cell FROM od) SELECT COUNT(DISTINCT cell) AS nodes, COUNT(DISTINCT id) AS entities, COUNT(*) AS refs, round(COUNT(*) / COUNT(DISTINCT cell), 6) AS per_node, 1.0::DOUBLE AS span FROM c")
def entity_stats(spark, sf):
    return stats.entity_stats(views.orders(spark, sf), 14).select("nodes", "entities", "refs", F.round("per_node", 6).alias("per_node"), "span")


_SPAN = " * ".join(f"(floor(max_{c} / 64) - floor(greatest(min_{c}, 0) / 64) + 1)" for c in "xyz")


@add(f"WITH {PARTS} SELECT id, CAST({_SPAN} AS BIGINT) AS cells FROM pt")
def spanning_cells(spark, sf):
    return index.spanning_cells(views.parts(spark, sf), 15).groupBy("id").agg(F.count("*").alias("cells"))


@add(f"WITH {PARTS} SELECT id, 2 * half > 0.5 * 16 AS balanced, 2 * half > 0.75 * 16 AS memory, 2 * half > 0.25 * 16 AS performance FROM pt")
def spanning_policy(spark, sf):
    size = F.col("half") * 2
    return views.parts(spark, sf).select("id", *(index.should_span(size, 16.0, p).alias(p) for p in ("balanced", "memory", "performance")))


_CELLS14 = f"c AS (SELECT 14 AS level, {sql_cell('x', 'y', 'z', 14)} AS cell, COUNT(*) AS n FROM od GROUP BY ALL)"


@add(f"WITH {ORDERS}, {_CELLS14} SELECT COUNT(*) AS nodes, CAST(COUNT(*) FILTER (n < floor(40 * 0.25 * greatest(0.5, 1 - 0.02 * level))) AS BIGINT) AS under, COUNT(*) FILTER (n > floor(40 * 0.9 * greatest(0.7, 1 - 0.01 * level))) AS over, round(AVG(n), 6) AS mean_load, round(var_pop(n), 5) AS variance FROM c")
def balance_stats(spark, sf):
    got = stats.balance_stats(index.nodes(views.orders(spark, sf), 14), 40)
    return got.select("nodes", "under", "over", F.round("mean_load", 6).alias("mean_load"), F.round("variance", 5).alias("variance"))


_FIRST, _LAST, _CAP = 10, 15, 60


@add(
    f"WITH {ORDERS}, f AS (SELECT id, {sql_cell('x', 'y', 'z', _LAST)} AS f FROM od), n AS (SELECT id, f, "
    + ", ".join(f"COUNT(*) OVER (PARTITION BY f >> {3 * (_LAST - k)}) AS n{k}" for k in range(_FIRST, _LAST + 1))
    + " FROM f) SELECT id, CASE "
    + " ".join(f"WHEN n{k} <= {_CAP} OR n{k} = n{k + 1} THEN {k}" for k in range(_FIRST, _LAST))
    + f" ELSE {_LAST} END AS level, CASE "
    + " ".join(f"WHEN n{k} <= {_CAP} OR n{k} = n{k + 1} THEN f >> {3 * (_LAST - k)}" for k in range(_FIRST, _LAST))
    + " ELSE f END AS cell FROM n"
)
def adaptive_cells(spark, sf):
    return index.adaptive_cells(views.orders(spark, sf), _CAP, _FIRST, _LAST)


@add(f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT {k} AS level, COUNT(DISTINCT {sql_cell('x', 'y', 'z', k)}) AS nodes, COUNT(*) AS entities FROM od" for k in range(10, 15)))
def nodes_by_level(spark, sf):
    fine = index.with_cell(views.orders(spark, sf), 14)
    per = fine.groupBy("cell").agg(F.count("*").alias("n"))
    rows = per.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("cell", 3 * (14 - k)).alias("cell")) for k in range(10, 15)))).alias("k"))
    return rows.groupBy(F.col("k.level").alias("level")).agg(F.count_distinct("k.cell").alias("nodes"), F.sum("n").alias("entities"))


@add(f"WITH {ORDERS} SELECT CAST(floor(x / 250) AS BIGINT) AS ix, CAST(floor(y / 250) AS BIGINT) AS iy, COUNT(*) AS n FROM od WHERE z BETWEEN 500 AND 700 GROUP BY 1, 2")
def slice_density(spark, sf):
    return stats.slice_density(views.orders(spark, sf), 500, 700, 250.0)


@add(f"WITH {ORDERS} SELECT " + ", ".join(f"{f}({c}) AS {f.lower()}_{c}" for f in ("MIN", "MAX") for c in "xyz") + " FROM od")
def bounding_box(spark, sf):
    return stats.bounding_box(views.orders(spark, sf))


@add(f"WITH {ORDERS}, b AS (SELECT COUNT(*) AS n, (max(x) - min(x) + max(y) - min(y) + max(z) - min(z)) / 3 AS s FROM od), c AS (SELECT *, CAST(ceil(ln(greatest(1, n // 100)) / ln(8) - 1e-12) AS INTEGER) AS l FROM b) SELECT n, greatest(5, least(15, CASE WHEN s > 10000 THEN greatest(5, l - 2) WHEN s > 1000 THEN greatest(6, l - 1) ELSE l END)) AS level FROM c")
def bulk_load_level(spark, sf):
    """One aggregation; the rule is applied on the driver."""
    r = views.orders(spark, sf).agg(F.count("*").alias("n"), *(F.max(c) - F.min(c) for c in P)).first()
    return spark.createDataFrame([(r["n"], intervals.level_for(r["n"], tuple(r[1:])))], "n long, level int")


SEEDS = [(200.0, 500.0, 200.0), (1500.0, 1500.0, 1000.0)]


def _lloyd(view: str, rounds: int) -> str:
    parts = [f"c0 AS (SELECT * FROM (VALUES {', '.join(f'({k}, ' + ', '.join(f'{v!r}::DOUBLE' for v in s) + ')' for k, s in enumerate(SEEDS))}) v(k, x, y, z))"]
    for r in range(rounds):
        d = f"SELECT {view}.id, {view}.x, {view}.y, {view}.z, k FROM {view}, c{r} c QUALIFY row_number() OVER (PARTITION BY {view}.id ORDER BY sqrt(power({view}.x - c.x, 2) + power({view}.y - c.y, 2) + power({view}.z - c.z, 2)), k) = 1"
        parts += [f"a{r} AS ({d})", f"c{r + 1} AS (SELECT k, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM a{r} GROUP BY k)"]
    return ", ".join(parts)


@add(f"WITH {ORDERS}, {_lloyd('od', 5)} SELECT k AS cluster, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM c5")
def k_means_centres(spark, sf):
    o = views.orders(spark, sf).select("id", *P)
    return spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(stats.k_means(o, SEEDS))], "cluster int, x double, y double, z double").select("cluster", *(F.round(c, 4).alias(c) for c in P))


@add(f"WITH {ORDERS}, d AS (SELECT id, sqrt(power(x - 200, 2) + power(y - 500, 2) + power(z - 200, 2)) AS a, sqrt(power(x - 1500, 2) + power(y - 1500, 2) + power(z - 1000, 2)) AS b FROM od) SELECT CASE WHEN a <= b THEN 0 ELSE 1 END AS cluster, COUNT(*) AS n, round(greatest(0, least(1, 1 - AVG(least(a, b)) / 2000)), 6) AS coherence FROM d GROUP BY 1")
def cluster_coherence(spark, sf):
    got = stats.coherence(stats.assign(views.orders(spark, sf), SEEDS), 2000.0)
    return got.select("cluster", "n", F.round("coherence", 6).alias("coherence"))


@add("WITH p AS (SELECT o_orderstatus AS region, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 5 < 3 THEN o_orderstatus ELSE 'other' END AS other FROM orders), a AS (SELECT region, CASE WHEN COUNT(other) = 0 THEN 0.5 ELSE COUNT(*) FILTER (region = other) / COUNT(other) END AS a FROM p GROUP BY region) SELECT region, round(CAST(a AS DOUBLE), 6) AS affinity, CASE WHEN a < 0.5 THEN 'drifting' WHEN a <= 0.8 THEN 'boundary' ELSE 'core' END AS class FROM a")
def affinity(spark, sf):
    o = views.table(spark, sf, "orders")
    other = F.when(F.col("o_custkey") % 3 == 0, None).when(F.col("o_custkey") % 5 < 3, F.col("o_orderstatus")).otherwise("other")
    return stats.affinity(o.select(F.col("o_orderstatus").alias("region"), other.alias("other"))).select("region", F.round("affinity", 6).alias("affinity"), "class")


_GRID = "g AS (SELECT CAST(floor(x / 400) AS BIGINT) AS ix, CAST(floor(y / 400) AS BIGINT) AS iy, CAST(floor(z / 400) AS BIGINT) AS iz, CAST(COUNT(*) AS DOUBLE) AS value FROM od GROUP BY 1, 2, 3)"


@add(f"WITH {ORDERS}, {_GRID}, e AS (SELECT g.ix, g.iy, g.iz, any_value(g.value) AS value, coalesce(max(abs(g.value - h.value)), 0) AS error FROM g LEFT JOIN g h ON abs(g.ix - h.ix) + abs(g.iy - h.iy) + abs(g.iz - h.iz) = 1 GROUP BY 1, 2, 3) SELECT *, CASE WHEN error > 60 THEN 'refine' WHEN error < 10 THEN 'coarsen' ELSE 'keep' END AS action FROM e")
def refinement_by_error(spark, sf):
    cells = views.orders(spark, sf).groupBy(*(F.floor(F.col(c) / 400).alias(f"i{c}") for c in P)).agg(F.count("*").cast("double").alias("value"))
    return stats.grid_refinement(cells, 60.0, 10.0)


@add(f"WITH {EVENTS}, a AS (SELECT id, kind AS region FROM ev UNION ALL SELECT id, 'copy' FROM ev WHERE id % 40 = 0 UNION ALL SELECT id, 'copy2' FROM ev WHERE id % 80 = 0) SELECT id, COUNT(DISTINCT region) AS regions FROM a GROUP BY id HAVING COUNT(DISTINCT region) >= 2")
def duplicate_entities(spark, sf):
    return stats.duplicates(_copies(spark, sf))


def _copies(spark, sf):
    e = views.events(spark, sf)
    return e.select("id", F.col("kind").alias("region")).unionByName(e.where("id % 40 = 0").select("id", F.lit("copy").alias("region"))).unionByName(e.where("id % 80 = 0").select("id", F.lit("copy2").alias("region")))


@add(f"WITH {EVENTS}, a AS (SELECT id, kind AS region FROM ev UNION ALL SELECT id, 'copy' FROM ev WHERE id % 40 = 0 UNION ALL SELECT id, 'copy2' FROM ev WHERE id % 80 = 0), l AS (SELECT id, kind AS source, 1 AS seq FROM ev WHERE id % 40 = 0 UNION ALL SELECT id, 'copy', 2 FROM ev WHERE id % 120 = 0), k AS (SELECT id, arg_max(source, seq) AS keep FROM l GROUP BY id) SELECT a.id, region FROM a LEFT JOIN k USING (id) WHERE keep IS NULL OR keep = region")
def reconcile_duplicates(spark, sf):
    e = views.events(spark, sf)
    log = e.where("id % 40 = 0").select("id", F.col("kind").alias("source"), F.lit(1).alias("seq")).unionByName(e.where("id % 120 = 0").select("id", F.lit("copy").alias("source"), F.lit(2).alias("seq")))
    return stats.reconcile(_copies(spark, sf), log)


@add(f"WITH RECURSIVE {EVENTS}, c AS (SELECT DISTINCT {sql_cell('x', 'y', 'z', 18)} AS cell FROM ev), l18 AS (SELECT cell, 'leaf' AS s FROM c), " + ", ".join(f"l{k} AS (SELECT cell >> 3 AS cell, md5(string_agg((cell & 7) || ':' || s, ',' ORDER BY cell & 7)) AS s FROM l{k + 1} GROUP BY 1)" for k in range(17, 12, -1)) + " " + " UNION ALL ".join(f"SELECT {k} AS level, COUNT(DISTINCT s) AS classes, COUNT(*) AS nodes FROM l{k}" for k in range(18, 12, -1)))
def subtree_dedup(spark, sf):
    return stats.subtree_classes(index.with_cell(views.events(spark, sf), 18), 18, 13)


# --- ingest ---------------------------------------------------------------------------------------------------------


@add(f"WITH {ORDERS}, n AS (SELECT id, x + 1 AS x, y, z, kind FROM od WHERE id % 10 = 0 UNION ALL SELECT id + 10000000, x, y, z, kind FROM od WHERE id % 100 = 1) SELECT * FROM od WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_entities(spark, sf):
    o = views.orders(spark, sf)
    n = o.where("id % 10 = 0").withColumn("x", F.col("x") + 1).unionByName(o.where("id % 100 = 1").withColumn("id", F.col("id") + 10_000_000))
    return index.upsert(o, n)


@add(f"WITH {ORDERS} SELECT * FROM od WHERE id % 7 <> 0")
def remove_entities(spark, sf):
    o = views.orders(spark, sf)
    return index.remove(o, o.where("id % 7 = 0").select("id"))


@add(f"WITH {PARTS} SELECT id, CASE WHEN id % 4 = 0 THEN y ELSE x END AS x, round(CASE WHEN id % 4 = 0 THEN min_x + (y - x) ELSE min_x END, 6) AS min_x, round(CASE WHEN id % 4 = 0 THEN max_x + (y - x) ELSE max_x END, 6) AS max_x FROM pt")
def move_entities(spark, sf):
    p = views.parts(spark, sf)
    to = p.where("id % 4 = 0").select("id", F.col("y").alias("x"), "y", "z")
    return index.moved(p, to).select("id", "x", F.round("min_x", 6).alias("min_x"), F.round("max_x", 6).alias("max_x"))


@add(f"WITH {EVENTS} SELECT user_id AS id, arg_max(x, us * 100000 + id) AS x, max(us * 100000 + id) AS seq FROM ev GROUP BY user_id")
def latest_state(spark, sf):
    e = views.events(spark, sf).select(F.col("user_id").alias("id"), "x", (F.col("us") * 100000 + F.col("id")).alias("seq"))
    return index.latest(e, "seq")


@add(f"WITH {CUSTOMERS}, s AS (SELECT id, {sql_cell('x', 'y', 'z', 13)} AS cell FROM cu) SELECT COUNT(DISTINCT cell) AS cells, COUNT(*) AS n, CAST(floor(COUNT(DISTINCT cell) * (COUNT(*) * 4 / COUNT(*)) * 1.2) AS BIGINT) AS estimate FROM s")
def node_estimate(spark, sf):
    r = index.with_cell(views.customers(spark, sf), 13).agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("n")).first()
    return spark.createDataFrame([(r["cells"], r["n"], intervals.estimate_nodes(4 * r["n"], r["n"], r["cells"]))], "cells long, n long, estimate long")


