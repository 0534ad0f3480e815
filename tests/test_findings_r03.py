"""What a review of the third round found: each test failed before."""

import pytest

from tests.test_findings_r02 import same_as_sql, some_orders, tables
from tests.test_whole import seen


def test_knn_join_by_cells_asks_for_every_customer(spark, tmp_path):
    people = spark.createDataFrame([(i, i % 5, float(i * 37 % 3000), "A") for i in range(80)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    folder = tables(tmp_path, spark, customer=people, orders=some_orders(spark, [(i, i * 7 % 300, i * 911 % 500_000, i * 13 % 900) for i in range(400)]))
    assert same_as_sql(spark, folder, "knn_join_by_cells") == 80 * 5


@pytest.mark.parametrize("copies", [1, 4])
def test_boxes_alike_and_lines_alike_are_met_once(spark, monkeypatch, copies):
    """Copies of boxes are one with a number, and their lines one; who is seen is as by brute force over all of them."""
    import numpy as np

    from cubeloom.operators import visibility

    r = np.random.default_rng(21)
    at = [(r.uniform(5, 300, 3).round(1), r.uniform(1, 9, 3).round(1)) for _ in range(150)]
    at += [(np.array([2.0, 1.0, 1.0]), np.array([3.0, 3.0, 3.0])), (np.array([400.0, 390.0, 380.0]), np.full(3, 90.0))]  # around the eye; wide
    made = [dict(id=1000 * k + i) | {f"{e}{c}": float(v + g * h) for e, g in (("", 0), ("min_", -1), ("max_", 1)) for c, v, h in zip("xyz", p, q, strict=True)} for k in range(copies) for i, (p, q) in enumerate(at)]
    frame = spark.createDataFrame([tuple(b.values()) for b in made], list(made[0]))
    met, plain = [], visibility.occluders

    def counted(df, pairs, *args, **named):
        met.append((df.count(), pairs.count()))
        return plain(df, pairs, *args, **named)

    monkeypatch.setattr(visibility, "occluders", counted)
    args = ((0.5, 0.25, 0.0), (1.0, 1.0, 1.0), 0.9, 900.0)
    got = [x["id"] for x in visibility.visible_in_cone(frame, *args).collect()]
    want = seen(made, *args)
    assert sorted(got) == sorted(want) and 0 < len(want) < len(made)
    assert max(met[0]) <= len(at)


def test_boxes_of_unknown_bounds_hide_nothing(spark):
    from cubeloom.operators import visibility

    names = ["id", "x", "y", "z", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]
    rows = [(1, 50.0, 0.0, 0.0, 49.0, -1.0, -1.0, 51.0, 1.0, 1.0), (2, 8.0, None, 0.0, 4.0, None, -4.0, 12.0, None, 4.0), (3, 8.0, 0.0, None, 4.0, -4.0, None, 12.0, 4.0, None)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'id' else 'double'}" for n in names))
    assert [r["id"] for r in visibility.visible_in_cone(frame, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), 0.7, 100.0).collect()] == [1]


def test_swept_spheres_of_a_cell_are_compared_without_a_join(spark, tmp_path):
    """Copies, ids in lists, and sizes unlike each other: row for row as by the SQL; the plan joins nothing."""
    from cubeloom.queries import load

    rows = [(1000 * k + i, "p", "Brand#1", "T", i % 6 + 4, 900.0 + i % 9 / 2) for k in range(12) for i in range(60)] + [(500, "p", "b", "T", None, 900.0), (501, "p", "b", "T", 3, None)]
    folder = tables(tmp_path, spark, part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    assert same_as_sql(spark, folder, "continuous_collision") > 3000
    assert "Join " not in load().queries["continuous_collision"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_swept_spheres_tile_by_tile(monkeypatch):
    """Few boxes and pairs at a time, cells in any order: each pair once, as by brute force over all ids."""
    import itertools

    import numpy as np
    import pyarrow as pa

    from cubeloom.operators import collide

    monkeypatch.setattr(collide, "TILE", 50)
    monkeypatch.setattr(collide, "PAIRS", 7)
    r = np.random.default_rng(8)
    p, v, radius, edges = r.uniform(0, 60, (3, 90)), r.integers(-2, 3, (3, 90)) * 4.0, r.uniform(1, 9, 90), (11.0, 13.0, 17.0)
    ids = [[1000 * k + i for k in range(i % 4 + 1)] for i in range(90)]
    low, high = np.minimum(p, p + v) - radius, np.maximum(p, p + v) + radius
    rows = []
    for i in range(90):
        for cell in itertools.product(*(range(int(low[c, i] // edges[c]), int(high[c, i] // edges[c]) + 1) for c in range(3))):
            rows.append([*low[:, i], *high[:, i], *p[:, i], *v[:, i], radius[i], ids[i], *cell])
    names = [*collide.LOW, *collide.HIGH, *"xyz", "vx", "vy", "vz", "radius", "ids", "_x", "_y", "_z"]
    table = pa.table({n: [row[c] for row in rows] for c, n in enumerate(names)})
    table = table.take(pa.array(r.permutation(len(rows))))
    got = {}
    for a, b, t in collide._swept_hits(table.to_batches(), edges):
        for x, y, z in zip(a.tolist(), b.tolist(), t.tolist(), strict=True):
            assert (x, y) not in got and x < y
            got[x, y] = z
    every = [(i, k) for k in range(90) for i in ids[k]]
    want = {}
    for (i, m), (j, n) in itertools.combinations(sorted(every), 2):
        t = collide._impact(p[:, [n]] - p[:, [m]], v[:, [n]] - v[:, [m]], radius[[m]] + radius[[n]])[0]
        if t == t:
            want[i, j] = t
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and any(t > 0 for t in want.values())
