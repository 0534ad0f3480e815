"""Hand-placed entities: nearest, rays, contacts, intervals, tetrahedra, updates."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubeloom.functions import geom, keys, nd
from cubeloom.operators import collide, forest, index, search, stats, visibility
from cubeloom.plans import intervals


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)], "id long, x double, y double, z double")


def boxes(spark, rows):
    made = [(i, *[(a + b) / 2 for a, b in zip(r[:3], r[3:], strict=True)], *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "id long, x double, y double, z double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


def test_nearest(spark):
    p = points(spark, [(0, 0, 0), (10, 0, 0), (0, 10, 0), (0, 0, 10), (1000, 1000, 1000)])
    got = [(r["id"], r["distance"]) for r in search.nearest(p, (0, 0, 0), 4).collect()]
    assert got == [(0, 0.0), (1, 10.0), (2, 10.0), (3, 10.0)]
    assert search.nearest(p.limit(0), (0, 0, 0), 4).count() == 0
    assert search.nearest(p, (0, 0, 0), 0).count() == 0


def test_nearest_is_complete_in_a_cluster(spark):
    p = points(spark, [(i % 5 * 0.1, i // 5 % 5 * 0.1, i // 25 * 0.1) for i in range(125)] + [(1000 + i,) * 3 for i in range(10)])
    assert search.nearest(p, (0.2, 0.2, 0.1), 10, 50.0).count() == 10


def test_nearest_join_by_cells_equals_all_pairs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(42)
    p = points(spark, [(rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(400)] + [(200_000, 5, 5)])
    q = p.where("id % 40 = 7").withColumnRenamed("id", "q_id")
    plain = sorted(map(tuple, search.nearest_join(p, q, 7).collect()))
    assert sorted(map(tuple, search.nearest_join(p, q, 7, level=14).collect())) == plain
    near = sorted(map(tuple, search.nearest_join(p, q, 7, 90.0).collect()))
    assert sorted(map(tuple, search.nearest_join(p, q, 7, 90.0, level=14).collect())) == near


def test_rays(spark):
    p = points(spark, [(100, 100, 100), (200, 200, 200), (300, 300, 300), (150, 150, 150), (150, 150, 150), (100, 300, 100)])
    s = 3**-0.5
    rays = spark.createDataFrame([(1, 50.0, 50.0, 50.0, s, s, s, 1e9), (2, 50.0, 50.0, 50.0, s, s, s, 200.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, most double")
    for level in (8, 11, 15):
        hits = sorted((r["ray_id"], round(r["t"], 3), r["id"]) for r in search.ray_hits(p, rays, level=level).collect())
        assert [h[2] for h in hits if h[0] == 1] == [0, 3, 4, 1, 2]
        assert [h[2] for h in hits if h[0] == 2] == [0, 3, 4]


def test_point_contact(spark):
    got = collide.point_pairs(points(spark, [(100, 100, 100), (100.05, 100.05, 100.05), (200, 200, 200)])).collect()
    assert [(r["id1"], r["id2"], round(r["depth"], 4)) for r in got] == [(0, 1, 0.0134)]
    same = collide.point_pairs(points(spark, [(5, 5, 5), (5, 5, 5)])).collect()
    assert [(r["depth"], r["contact_x"]) for r in same] == [(0.0, 5.0)]


def test_box_contact(spark):
    got = collide.box_pairs(boxes(spark, [(90, 90, 90, 110, 110, 110), (100, 100, 100, 120, 120, 120), (500, 0, 0, 501, 1, 1)])).collect()
    assert [(r["id1"], r["id2"], r["depth"], r["contact_x"], r["normal"]) for r in got] == [(0, 1, 10.0, 105.0, "+X")]


def test_box_pairs_are_found_once_at_any_level(spark):
    rng = random.Random(1)
    rows = [(x, y, z, x + rng.uniform(0, 90), y + rng.uniform(0, 90), z + rng.uniform(0, 90)) for x, y, z in ((rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(60))]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if all(rows[i][k] <= rows[j][k + 3] and rows[j][k] <= rows[i][k + 3] for k in range(3)))
    for level in (13, 15, 17):
        assert sorted((r["id1"], r["id2"]) for r in collide.box_pairs(boxes(spark, rows), level=level).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=6, max_size=6))
def test_intervals_cover_exactly_the_box(v):
    low, high = tuple(map(min, v[:3], v[3:])), tuple(map(max, v[:3], v[3:]))
    runs = intervals.box_intervals(low, high, 4)
    covered = {c for a, b in runs for c in range(a, b + 1)}
    assert covered == {intervals.morton_int(x, y, z) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1) for z in range(low[2], high[2] + 1)}
    assert all(b[0] - a[1] > 1 for a, b in zip(runs, runs[1:], strict=False))
    few = intervals.box_intervals(low, high, 4, most=2)
    assert len(few) <= 2 and covered <= {c for a, b in few for c in range(a, b + 1)}


def test_morton_round_trip(spark):
    rng = random.Random(7)
    rows = [(0, 0, 0), (2**21 - 1,) * 3] + [tuple(rng.randrange(2**21) for _ in range(3)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "x long, y long, z long").withColumn("code", keys.morton("x", "y", "z"))
    got = frame.select("x", "y", "z", "code", keys.morton_decode("code").alias("p")).collect()
    assert all((r["x"], r["y"], r["z"]) == tuple(r["p"]) and r["code"] == intervals.morton_int(r["x"], r["y"], r["z"]) for r in got)


def test_types_fill_the_cube(spark):
    lattice = [(x, y, z) for x in range(0, 129, 16) for y in range(0, 129, 16) for z in range(0, 129, 16)]
    p = points(spark, lattice)
    inside = [keys.tet_contains("x", "y", "z", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(128.0), k).cast("int").alias(f"t{k}") for k in range(6)]
    for r in p.select("x", "y", "z", *inside).collect():
        n = sum(r[f"t{k}"] for k in range(6))
        assert n >= 1
        assert n == 1 or len({r["x"], r["y"], r["z"]}) < 3
        assert n == 6 or len({r["x"], r["y"], r["z"]}) > 1


def test_outside_the_domain_has_no_cell(spark):
    got = index.with_cell(points(spark, [(-1, 0, 0), (2**21, 0, 0), (0, 0, 2**21 - 1)]), 10).collect()
    assert [r["cell"] is None for r in got] == [True, True, False]


def test_updates(spark):
    b = boxes(spark, [(0, 0, 0, 2, 2, 2), (5, 5, 5, 7, 7, 7)])
    to = spark.createDataFrame([(0, 11.0, 1.0, 1.0), (9, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    rows = {r["id"]: (r["x"], r["min_x"], r["max_x"]) for r in index.moved(b, to).collect()}
    assert rows == {0: (11.0, 10.0, 12.0), 1: (6.0, 5.0, 7.0)}
    assert {r["id"] for r in index.remove(b, to).collect()} == {1}


def test_plane_and_frustum(spark):
    with pytest.raises(ValueError):
        visibility.plane_through((0, 0, 0), (1, 1, 1), (2, 2, 2))
    b = boxes(spark, [(0, 0, 0, 2, 2, 2), (4, 0, 0, 6, 2, 2), (9, 0, 0, 10, 2, 2), (10, 0, 0, 12, 2, 2)])
    got = {r["id"]: (r["side"], r["distance"]) for r in visibility.plane_query(b, (1.0, 0.0, 0.0, -5.0)).collect()}
    assert got == {0: ("NEGATIVE_SIDE", -3.0), 1: ("INTERSECTING", 1.0), 2: ("POSITIVE_SIDE", 4.0), 3: ("POSITIVE_SIDE", 5.0)}
    view = {r["id"]: r["view"] for r in visibility.frustum_view(b, visibility.box_frustum((-1, -1, -1), (10, 3, 3)), (0, 0, 0)).collect()}
    assert view == {0: "INSIDE", 1: "INSIDE", 2: "INSIDE"}  # touching is outside


def test_forest(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    p = points(spark, [(5, 5, 5), (15, 5, 5), (9.5, 5, 5), (25, 5, 5)]).withColumn("tree_id", forest.grid_tree((0, 0, 0), (10, 10, 10), (2, 1, 1)))
    assert [r["tree_id"] for r in p.orderBy("id").collect()] == [0, 1, 0, None]
    trees = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 10.0, 10.0, 10.0), (1, 10.0, 0.0, 0.0, 20.0, 10.0, 10.0)], "tree_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    assert [tuple(r)[:3] for r in forest.ghosts(p.where("tree_id is not null"), trees, 1.0).collect()] == [(2, 0, 1)]
    assert [r["kind"] for r in forest.connections(trees).collect()] == ["FACE"]
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in forest.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {r["node"]: r["hops"] for r in forest.hops(edges, 1).collect()} == {1: 0, 2: 1, 3: 1}


def test_adaptive_cells_stop_when_all_share_a_child(spark):
    p = points(spark, [(1, 1, 1)] * 5 + [(1000, 1000, 1000)])
    got = {r["id"]: r["level"] for r in index.adaptive_cells(p, 3, 5, 12).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 1  # all fall into one child at level 5
    split = {r["id"]: r["level"] for r in index.adaptive_cells(p.unionByName(points(spark, [(2**20 + 5,) * 3])), 3, 1, 8).collect()}
    assert max(split.values()) <= 8


def test_planner_rules():
    assert intervals.recommend(1, 1, 9) == "tree" and intervals.recommend(100, 1, 1) == "curve" and intervals.recommend(1, 9, 1) == "curve"
    assert intervals.level_for(0, (1, 1, 1)) == 10 and intervals.level_for(5, (0, 1, 1)) == 15
    assert 1 << (21 - intervals.depth_of_radius(100.0)) in (64, 128)


def test_vector_axioms(spark):
    rng = random.Random(3)
    rows = [([rng.uniform(-5, 5) for _ in range(3)], [rng.uniform(-5, 5) for _ in range(3)], [rng.uniform(-5, 5) for _ in range(3)]) for _ in range(50)]
    f = spark.createDataFrame(rows, "a array<double>, b array<double>, c array<double>")
    d = {k: nd.distance(*k).alias("".join(k)) for k in (("a", "b"), ("b", "a"), ("a", "c"), ("c", "b"), ("a", "a"))}
    for r in f.select(*d.values()).collect():
        assert abs(r["ab"] - r["ba"]) < 1e-9 and r["aa"] == 0 and r["ab"] <= r["ac"] + r["cb"] + 1e-9
    m = nd.rotation((1, 2, 3), 0.7)
    assert abs(nd.determinant(m) - 1) < 1e-9
    with pytest.raises(ValueError):
        nd.inverse([[1.0, 2.0], [2.0, 4.0]])


def test_reconcile_and_subtrees(spark):
    held = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "id long, region string")
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, source string, seq long")
    assert sorted(map(tuple, stats.reconcile(held, log).collect())) == [(1, "b"), (2, "a"), (2, "c")]
    cells = spark.createDataFrame([(0,), (1,), (8,), (9,), (16,)], "cell long")
    got = {r["level"]: (r["classes"], r["nodes"]) for r in stats.subtree_classes(cells, 2, 1).collect()}
    assert got == {2: (1, 5), 1: (2, 3)}


def test_capsule_distance(spark):
    e = geom.segments_distance2(("0D", "0D", "0D"), ("0D", "0D", "10D"), ("3D", "-5D", "5D"), ("3D", "5D", "5D"))
    assert spark.range(1).select(F.expr(e)).first()[0] == 9.0


def test_nearest_join_by_tiles(spark, monkeypatch):
    """Ties to the smaller id, nulls and far points left out, more wanted than there are; no probes, no points."""
    monkeypatch.setattr(search, "TILE", 12)
    rows = [(k, float(k % 7), float(k % 5), float(k % 3)) for k in range(60)] + [(60, None, 1.0, 1.0), (None, 0.0, 0.0, 0.0), (61, float("nan"), 0.0, 0.0), (3, 100.0, 100.0, 100.0)]
    probes = [("a", 0.0, 0.0, 0.0), ("b", 3.2, 2.1, 1.0), ("c", None, 1.0, 1.0), ("d", 1000.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3)
    p = spark.createDataFrame(probes, "q_id string, x double, y double, z double")

    def brute(k, most):
        out = []
        for q, *at in probes:
            if None in at:
                continue
            dx, dy, dz = at  # in this order of sums, which decides near ties
            far = [(math.sqrt((r[1] - dx) * (r[1] - dx) + (r[2] - dy) * (r[2] - dy) + (r[3] - dz) * (r[3] - dz)), r[0]) for r in rows if r[0] is not None and None not in r and not any(math.isnan(v) for v in r[1:])]
            out += [(q, i, d, n + 1) for n, (d, i) in enumerate(sorted(x for x in far if most is None or x[0] <= most)[:k])]
        return sorted((q, n, i, round(d, 9)) for q, i, d, n in out)

    for k, most in ((1, None), (5, None), (5, 2.0), (100, None)):
        got = search.nearest_join(df, p, k, most).collect()
        assert sorted((r["q_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in got) == brute(k, most)
    assert search.nearest_join(df.limit(0), p, 2).count() == search.nearest_join(df, p.limit(0), 2).count() == search.nearest_join(df, p, 0).count() == 0
