"""Streams against their batch forms; mesh, voxel and log files."""

import struct

from pyspark.sql import functions as F

from cubeloom.sources import files
from cubeloom.streaming import batch, live


def run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def arriving(spark, frame, path):
    """The frame as a stream of two files."""
    half = frame.count() // 2
    low = frame.orderBy("id").limit(half)
    low.coalesce(1).write.mode("append").parquet(path)
    frame.join(low.select("id"), "id", "left_anti").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def clocks(spark):
    rows = [(i, "ab"[i % 2], (i if i % 5 else i - 4)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, source string, clock long")


def test_causal_stream_equals_batch(spark, tmp_path):
    e = clocks(spark)
    want = sorted((r["source"], r["id"], r["clock"]) for r in batch.causal(e, ["id"]).collect())
    assert sorted(run(live.causal(arriving(spark, e, str(tmp_path / "e"))), "causal", spark)) == want
    assert 0 < len(want) < 60


def test_density_stream_equals_batch(spark, tmp_path):
    n = [70, 95, 101, 95, 89, 70, 59, 62, 67, 80, 120, 50]
    e = spark.createDataFrame([(i, "r", i, v) for i, v in enumerate(n)], "id long, region string, seq long, n long")
    want = sorted(map(tuple, batch.density_states(e, 100, 60).collect()))
    assert [w[3] for w in want] == ["NORMAL", "APPROACHING_SPLIT", "NEEDS_SPLIT", "NEEDS_SPLIT", "NORMAL", "NORMAL", "NEEDS_MERGE", "NEEDS_MERGE", "NORMAL", "NORMAL", "NEEDS_SPLIT", "NEEDS_MERGE"]
    assert sorted(run(live.density_states(arriving(spark, e, str(tmp_path / "d")), 100, 60), "density", spark)) == want


def test_lamport_and_lateness(spark):
    e = spark.createDataFrame([(1, "a", 5, 10), (2, "a", 0, 11), (3, "a", 9, 8), (4, "a", 2, 9), (5, "a", 2, 10)], "id long, source string, remote long, bucket long")
    assert [r["lamport"] for r in batch.lamport(e, ["id"]).orderBy("id").collect()] == [6, 7, 10, 11, 12]
    assert [r["late"] for r in batch.late_class(e, ["id"]).orderBy("id").collect()] == ["in_order", "in_order", "rejected", "rollback", "rollback"]


def test_release_order_and_caps(spark):
    e = spark.createDataFrame([(1, "s", 3, 100), (2, "s", 1, 500), (3, "s", 2, 200)], "id long, source string, clock long, ts_ms long")
    assert {r["id"]: r["release_ms"] for r in batch.release(e, ["id"], 50).collect()} == {2: 550, 3: 550, 1: 550}
    g = spark.range(1200).select("id", F.lit("n").alias("neighbour"), (F.col("id") % 10).alias("bucket"))
    assert batch.newest_ghosts(g).count() == 1000
    assert batch.live_ghosts(g, 9).agg(F.min("bucket")).first()[0] == 4


def test_votes_and_limits(spark):
    b = spark.createDataFrame([(1, "m", True, 1), (1, "m", False, 2), (1, "n", True, 3), (2, "m", False, 1)], "proposal long, member string, yes boolean, seq long")
    assert sorted(map(tuple, batch.votes(b, 2).collect())) == [(1, 2, 0, "approved"), (2, 0, 1, "open")]
    e = spark.createDataFrame([(i, "s", 10 * i) for i in range(5)], "id long, source string, ts_ms long")
    assert [r["allowed"] for r in batch.over_limit(e, 1000, 2).orderBy("id").collect()] == [True, True, False, False, False]


def test_buckets_stream(spark, tmp_path):
    e = spark.createDataFrame([(i, "a", i * 50) for i in range(40)], "id long, source string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = run(live.buckets(arriving(spark, e, str(tmp_path / "b"))), "buckets", spark)
    assert got and all(n == 2 for _, _, n in got)


def test_obj_and_stl(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -1 -2 -3\n")
    v = files.obj_vertices(spark, str(tmp_path / "a.obj")).orderBy("vertex").collect()
    assert [(r["x"], r["y"], r["z"]) for r in v] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    f = files.obj_faces(spark, str(tmp_path / "a.obj")).orderBy("face").collect()
    assert [(r["a"], r["b"], r["c"]) for r in f] == [(1, 2, 3), (1, 3, 4), (4, 3, 2)]
    (tmp_path / "b.stl").write_text("solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid s\n")
    t = files.stl_triangles(spark, str(tmp_path / "b.stl")).collect()
    assert [[tuple(p) for p in r["vertices"]] for r in t] == [[(0, 0, 0), (1, 0, 0), (0, 1, 0)]]


def test_voxels_and_log(spark, tmp_path):
    (tmp_path / "c.vol").write_bytes(struct.pack("<3i", 2, 1, 2) + bytes([0, 7, 0, 9]))
    got = sorted((r["x"], r["y"], r["z"], r["value"]) for r in files.vol_voxels(spark, str(tmp_path / "c.vol")).collect())
    assert got == [(1, 0, 0, 7), (1, 0, 1, 9)]
    log = str(tmp_path / "log")
    files.write_log(spark.createDataFrame([(2, "b"), (1, "a")], "seq long, what string"), log)
    files.write_log(spark.createDataFrame([(3, "c")], "seq long, what string"), log)
    assert [r["what"] for r in files.replay_log(spark, log, "seq long, what string").collect()] == ["a", "b", "c"]
    assert [r["seq"] for r in files.replay_log(spark, log, "seq long, what string", after=2).collect()] == [3]
