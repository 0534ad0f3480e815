"""Queries over whole tables, against plain versions that leave no row out."""

import math
from collections import defaultdict

from cubeloom import views
from cubeloom.operators import visibility
from cubeloom.queries import filters, joins, load, motion, vectors


def test_neighbour_consistency_whole(spark, tmp_path):
    rows = [(k, k % 37) for k in range(1990, 2400)]
    spark.createDataFrame([(i, "2024-01-02 00:00:00", u, "a", 1.0) for i, u in rows], "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    known, expected = defaultdict(set), defaultdict(set)
    for i, u in rows:
        expected[u // 10].add(u)
        known[u // 10] |= {u} if i % 2 == 0 else set()
    got = {r["region"]: (r["known"], r["expected"]) for r in motion.neighbour_consistency_whole(spark, str(tmp_path)).collect()}
    assert got == {k: (len(known[k]), len(v)) for k, v in expected.items()}
    assert "neighbour_consistency_whole" in load().sql


def test_nd_candidates_whole(spark, tmp_path):
    rows = [(k, [(k * 7 % 80) / 10 - 4, (k * 3 % 80) / 10 - 4, (k % 80) / 10 - 4, 0.5], "a") for k in range(90, 170)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    cell = {r["vec_id"]: [min(max(int((x + 4) // 1), 0), 7) for x in r["embedding"][:3]] for r in v}
    want = {(a, b) for a in cell for b in cell if a < b and all(abs(p - q) <= 1 for p, q in zip(cell[a], cell[b], strict=True))}
    assert {tuple(r) for r in vectors.nd_candidates_whole(spark, str(tmp_path)).collect()} == want
    assert max(want) > (100, 100)


def test_collide_spheres_with_boxes_whole(spark, sf):
    boxes = [r.asDict() for r in views.parts(spark, sf).collect()]
    want = {}
    for e in views.events(spark, sf).collect():
        at = dict(x=e["x"], y=e["y"] * 5, z=e["z"])
        for p in boxes:
            d = sum(max(p[f"min_{c}"] - at[c], at[c] - p[f"max_{c}"], 0) ** 2 for c in "xyz") ** 0.5
            if d <= 12:
                want[e["id"], p["id"]] = 12 - d
    got = {(r["sphere_id"], r["box_id"]): r["depth"] for r in joins.collide_spheres_with_boxes_whole(spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert any(k[0] % 5 for k in want)


def test_graph_components_whole(spark, sf):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().collect():
        a, b = sorted((find(r[0]), find(r[0] * 7 % 1500)))
        root[b] = a
    assert {r["node"]: r["root"] for r in joins.graph_components_whole(spark, sf).collect()} == {x: find(x) for x in root}


def test_event_logs_whole(spark, sf):
    last, n = {}, defaultdict(int)
    for r in sorted(motion.events(spark, sf).collect(), key=lambda r: r["id"]):
        ts, _ = last.get(r["user_id"], (r["ts_ms"], ""))
        last[r["user_id"]] = max(ts, r["ts_ms"]), r["source"]
        n[r["user_id"]] += 1
    assert {r["id"]: (r["ts_ms"], r["source"]) for r in motion.migration_log_latest_whole(spark, sf).collect()} == last
    assert {r["id"]: r["updates"] for r in motion.ghost_lifecycle_whole(spark, sf).collect()} == dict(n)


def seen(boxes, eye, direction, angle, reach):
    """Ids in the cone and in line of sight, by slabs, over all pairs."""
    size, out = sum(c * c for c in direction) ** 0.5, set()
    for b in boxes:
        to = [b[c] - e for c, e in zip("xyz", eye, strict=True)]
        d = sum(c * c for c in to) ** 0.5
        if d > reach or d and sum(p * q for p, q in zip(to, direction, strict=True)) < math.cos(angle) * d * size:
            continue
        hits = []
        for o in boxes if d >= 1e-6 else []:
            enter, leave = 0.0, d
            for c, e, v in zip("xyz", eye, to, strict=True):
                v, lo, hi = v / d, o[f"min_{c}"] - e, o[f"max_{c}"] - e
                if v == 0:
                    enter = enter if lo <= 0 <= hi else math.inf
                else:
                    enter, leave = max(enter, min(lo / v, hi / v)), min(leave, max(lo / v, hi / v))
            if enter <= leave and 0.05 * d <= enter < d:
                s = max(o[f"max_{c}"] - o[f"min_{c}"] for c in "xyz") / max(enter, 1.0)
                hits.append((o["id"], min(1.0, s * s / 2) * (0.5 if enter / d < 0.1 or enter / d > 0.9 else 1.0)))
        if sum(r for _, r in hits) < 0.5 or [i for i, _ in hits] == [b["id"]]:
            out.add(b["id"])
    return out


def test_visible_in_cone(spark, sf):
    box = lambda i, x, y, z, h: dict(id=i, x=x, y=y, z=z) | {f"{e}_{c}": v + g * h for c, v in zip("xyz", (x, y, z), strict=True) for e, g in (("min", -1), ("max", 1))}
    made = [box(1, 20.0, 0.0, 0.0, 8.0), box(2, 60.0, 0.0, 0.0, 2.0), box(3, 40.0, 30.0, 0.0, 2.0), box(4, -30.0, 0.0, 0.0, 2.0), box(5, 0.0, -40.0, 0.0, 10.0)]
    args = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), 0.7, 100.0)
    frame = spark.createDataFrame([tuple(float(v) if k != "id" else v for k, v in b.items()) for b in made], list(made[0]))
    cone = {r["id"] for r in visibility.in_cone(frame, *args).collect()}
    got = {r["id"] for r in visibility.visible_in_cone(frame, *args).collect()}
    assert cone == {1, 2, 3} and got == {1, 3} == seen(made, *args)
    parts = [r.asDict() for r in views.parts(spark, sf).collect()]
    assert {r["id"] for r in filters.visible_entities(spark, sf).collect()} == seen(parts, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 0.8, 1500.0)
