"""Event-time operators over events: event_type is the source, event_id the order and clock, user_id the entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubeloom import views
from cubeloom.queries import REGISTRY
from cubeloom.streaming import batch
from cubeloom.views import EVENTS

add = REGISTRY.add

#: Clocks go back now and then; arrival is the order of id.
_CLOCK = "id - CASE WHEN id % 7 = 0 THEN 12 WHEN id % 11 = 0 THEN 3 ELSE 0 END"
_EV = f"{EVENTS}, e AS (SELECT id, kind AS source, us // 1000 AS ts_ms, {_CLOCK} AS clock, user_id, x, y, z FROM ev)"
#: Hour-long buckets, as the events are minutes apart.
HOUR = 3_600_000


def events(spark, sf):
    e = views.events(spark, sf)
    clock = F.col("id") - F.when(F.col("id") % 7 == 0, 12).when(F.col("id") % 11 == 0, 3).otherwise(0)
    return e.select("id", F.col("kind").alias("source"), F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), clock.alias("clock"), "user_id", "x", "y", "z")


@add(f"WITH {_EV} SELECT source, ts_ms // {HOUR} AS bucket, COUNT(*) AS n FROM e GROUP BY ALL")
def time_buckets(spark, sf):
    return events(spark, sf).groupBy("source", batch.bucket("ts_ms", HOUR).alias("bucket")).agg(F.count("*").alias("n"))


@add(f"WITH {_EV}, b AS (SELECT DISTINCT ts_ms // {HOUR} AS bucket, source FROM e) SELECT bucket, source FROM (SELECT DISTINCT bucket FROM b), (SELECT DISTINCT source FROM e) EXCEPT SELECT bucket, source FROM b")
def bucket_barrier_missing(spark, sf):
    e = events(spark, sf).withColumn("bucket", batch.bucket("ts_ms", HOUR))
    return batch.missing_sources(e, e.select("source").distinct())


@add(f"WITH {_EV}, b AS (SELECT id, source, (ts_ms - CASE WHEN id % 9 = 0 THEN {2 * HOUR} WHEN id % 13 = 0 THEN {9 * HOUR} ELSE 0 END) // {HOUR} AS bucket FROM e), n AS (SELECT *, max(bucket) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - bucket AS behind FROM b) SELECT id, CASE WHEN behind IS NULL OR behind <= 0 THEN 'in_order' WHEN behind <= 2 THEN 'rollback' ELSE 'rejected' END AS late FROM n")
def bounded_rollback(spark, sf):
    back = F.when(F.col("id") % 9 == 0, 2 * HOUR).when(F.col("id") % 13 == 0, 9 * HOUR).otherwise(0)
    e = events(spark, sf).withColumn("bucket", batch.bucket(F.col("ts_ms") - back, HOUR))
    return batch.late_class(e, ["id"]).select("id", "late")


@add(f"WITH {_EV}, s AS (SELECT *, max(clock) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e) SELECT id, source, clock FROM s WHERE seen IS NULL OR clock >= seen")
def causal_filter(spark, sf):
    return batch.causal(events(spark, sf), ["id"]).select("id", "source", "clock")


@add(f"WITH RECURSIVE {_EV}, r AS (SELECT id, source, (id * 7919) % 3000 AS remote, row_number() OVER (PARTITION BY source ORDER BY id) AS i FROM e), l(id, source, i, clock) AS (SELECT id, source, i, greatest(0, remote) + 1 FROM r WHERE i = 1 UNION ALL SELECT r.id, r.source, r.i, greatest(l.clock, r.remote) + 1 FROM l JOIN r ON r.source = l.source AND r.i = l.i + 1) SELECT id, source, clock AS lamport FROM l")
def lamport_clock(spark, sf):
    return batch.lamport(events(spark, sf).withColumn("remote", F.col("id") * 7919 % 3000), ["id"]).select("id", "source", "lamport")


@add(f"WITH {_EV} SELECT id, source, max(ts_ms) OVER (PARTITION BY source ORDER BY clock, id ROWS UNBOUNDED PRECEDING) + 250 AS release_ms FROM e")
def reorder_release(spark, sf):
    return batch.release(events(spark, sf), ["id"], 250).select("id", "source", "release_ms")


@add(f"WITH {_EV} SELECT id, source, user_id FROM e QUALIFY row_number() OVER (PARTITION BY source, user_id ORDER BY id) = 1")
def exactly_once_tokens(spark, sf):
    return batch.once(events(spark, sf), ["source", "user_id"], ["id"]).select("id", "source", "user_id")


def _log_latest(e):
    e = batch.once(e, ["id"], ["ts_ms"])
    return e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts_ms").alias("ts_ms"), F.max_by("source", "id").alias("source"))


@add(f"WITH {_EV} SELECT user_id AS id, max(ts_ms) AS ts_ms, arg_max(source, id) AS source FROM e GROUP BY user_id")
def migration_log_latest_whole(spark, sf):
    return _log_latest(events(spark, sf))


@add(f"WITH {_EV}, g AS (SELECT user_id AS neighbour, ts_ms // {HOUR * 24} AS bucket, COUNT(*) AS n FROM e GROUP BY ALL) SELECT *, bucket // 100 AS epoch, CAST(row_number() OVER (PARTITION BY neighbour ORDER BY bucket) AS INTEGER) AS version FROM g")
def ghost_batches(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("neighbour"), batch.bucket("ts_ms", HOUR * 24).alias("bucket"))
    return batch.ghost_batches(e)


@add(f"WITH {_EV}, m AS (SELECT max(ts_ms // {HOUR}) AS now FROM e) SELECT id, ts_ms // {HOUR} AS bucket FROM e, m WHERE ts_ms // {HOUR} >= now - 5")
def ghost_ttl(spark, sf):
    e = events(spark, sf).select("id", batch.bucket("ts_ms", HOUR).alias("bucket"))
    return batch.live_ghosts(e, e.agg(F.max("bucket")).first()[0])


@add(f"WITH {_EV} SELECT id, source FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts_ms // {HOUR} DESC, id DESC) <= 1000")
def ghost_cap(spark, sf):
    e = events(spark, sf).withColumn("bucket", batch.bucket("ts_ms", HOUR)).withColumn("neighbour", F.col("source"))
    return batch.newest_ghosts(e).select("id", "source")


def _lifecycle(e, updates):
    now = e.agg(F.max("ts_ms")).first()[0]
    return batch.ghost_states(updates.select(F.col("user_id").alias("id"), "ts_ms"), now, 25 * HOUR, 25 * HOUR)


@add(f"WITH {_EV}, m AS (SELECT max(ts_ms) AS now FROM e), s AS (SELECT user_id AS id, COUNT(*) AS updates, any_value(now) - max(ts_ms) AS age FROM e, m GROUP BY user_id) SELECT id, updates, CASE WHEN age > {50 * HOUR} THEN 'expired' WHEN age > {25 * HOUR} THEN 'stale' WHEN updates > 1 THEN 'active' ELSE 'created' END AS state FROM s")
def ghost_lifecycle_whole(spark, sf):
    e = events(spark, sf)
    return _lifecycle(e, e)


AT = 500 * HOUR
_STATE = "user_id AS id, ts_ms, x, y, z, (id % 7 - 3) * 0.01::DOUBLE AS vx, (id % 5 - 2) * 0.01::DOUBLE AS vy, (id % 3 - 1) * 0.01::DOUBLE AS vz"


def states(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("user_id").alias("id"), "ts_ms", "x", "y", "z", *(((F.col("id") % m - m // 2) * 0.01).alias(f"v{c}") for c, m in (("x", 7), ("y", 5), ("z", 3))))


@add(f"WITH {_EV}, s AS (SELECT {_STATE} FROM e), l AS (SELECT id, arg_max({{'t': ts_ms, 'x': x, 'y': y, 'z': z, 'vx': vx, 'vy': vy, 'vz': vz}}, ts_ms) AS s FROM s WHERE ts_ms <= {AT} GROUP BY id) SELECT id, " + ", ".join(f"round(s.{c} + s.v{c} * ({AT} - s.t) / 1000, 5) AS {c}" for c in "xyz") + " FROM l")
def dead_reckoning(spark, sf):
    return batch.dead_reckoning(states(spark, sf), AT).select("id", *(F.round(c, 5).alias(c) for c in "xyz"))


@add(f"WITH {_EV}, s AS (SELECT {_STATE} FROM e), w AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS dt, " + ", ".join(f"{c} - (lag({c}) OVER w + lag(v{c}) OVER w * (ts_ms - lag(ts_ms) OVER w) / 1000) AS d{c}" for c in "xyz") + " FROM s WINDOW w AS (PARTITION BY id ORDER BY ts_ms)) SELECT id, ts_ms, round(sqrt(dx * dx + dy * dy + dz * dz), 4) AS error, round(CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) > 0.001 THEN sqrt(dx * dx + dy * dy + dz * dz) / 3 ELSE 0 END, 4) AS per_frame FROM w")
def prediction_corrections(spark, sf):
    return batch.corrections(states(spark, sf)).select("id", "ts_ms", F.round("error", 4).alias("error"), F.round("per_frame", 4).alias("per_frame"))


@add(f"WITH {_EV} SELECT id, round(COUNT(*) OVER w * 1000.0::DOUBLE / greatest(ts_ms - MIN(ts_ms) OVER w, 1000), 9) AS rate FROM e WINDOW w AS (PARTITION BY source ORDER BY ts_ms RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)")
def sliding_rate(spark, sf):
    return batch.rates(events(spark, sf), 6 * HOUR).select("id", F.round("rate", 9).alias("rate"))


_FRESH = "CASE WHEN n > 100 THEN 'NEEDS_SPLIT' WHEN n > 90 THEN 'APPROACHING_SPLIT' WHEN n < 60 THEN 'NEEDS_MERGE' WHEN n < 66 THEN 'APPROACHING_MERGE' ELSE 'NORMAL' END"


@add(
    f"WITH RECURSIVE {_EV}, k AS (SELECT source AS region, ts_ms // {24 * HOUR} AS seq, COUNT(*) AS c FROM e GROUP BY 1, 2), c AS (SELECT region, seq, 40 + c + seq * 37 % 50 AS n FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY seq) AS i FROM c), "
    f"s(region, seq, n, i, state) AS (SELECT region, seq, n, i, {_FRESH} FROM r WHERE i = 1 UNION ALL SELECT r.region, r.seq, r.n, r.i, CASE WHEN s.state = 'NEEDS_SPLIT' AND r.n >= 90 THEN 'NEEDS_SPLIT' WHEN s.state = 'NEEDS_MERGE' AND r.n <= 66 THEN 'NEEDS_MERGE' ELSE {_FRESH.replace(' n ', ' r.n ')} END FROM s JOIN r ON r.region = s.region AND r.i = s.i + 1) SELECT region, seq, n, state FROM s"
)
def density_states(spark, sf):
    day = batch.bucket("ts_ms", 24 * HOUR)
    c = events(spark, sf).groupBy(F.col("source").alias("region"), day.alias("seq")).agg(F.count("*").alias("c"))
    return batch.density_states(c.select("region", "seq", (40 + F.col("c") + F.col("seq") * 37 % 50).alias("n")), 100, 60)


@add(f"WITH {_EV}, f AS (SELECT id % 200 AS proposal, user_id AS member, arg_min(x > 25, id) AS yes FROM e GROUP BY 1, 2), v AS (SELECT proposal, COUNT(*) FILTER (yes) AS yes, COUNT(*) FILTER (NOT yes) AS no FROM f GROUP BY proposal) SELECT *, CASE WHEN yes >= 25 THEN 'approved' WHEN no >= 25 THEN 'rejected' ELSE 'open' END AS outcome FROM v")
def committee_votes(spark, sf):
    e = events(spark, sf).select((F.col("id") % 200).alias("proposal"), F.col("user_id").alias("member"), (F.col("x") > 25).alias("yes"), F.col("id").alias("seq"))
    return batch.votes(e, 25)


def _lod(c):
    return F.when(c < 50, 0).when(c < 150, 1).when(c < 400, 2).otherwise(3)


_LOD = "CASE WHEN d < 50 THEN 0 WHEN d < 150 THEN 1 WHEN d < 400 THEN 2 ELSE 3 END"
_FRAMES = f"{EVENTS}, r AS (SELECT user_id AS region, AVG(x) AS x, AVG(z) AS z FROM ev GROUP BY 1), a AS (SELECT region, {_LOD} AS lod FROM (SELECT region, sqrt(power(region - 20, 2) + power(x - 50, 2)) AS d FROM r) WHERE d <= 100), b AS (SELECT region, {_LOD} AS lod FROM (SELECT region, sqrt(power(region - 60, 2) + power(x - 50, 2)) AS d FROM r) WHERE d <= 100)"


def _frame(spark, sf, at):
    r = views.events(spark, sf).groupBy(F.col("user_id").alias("region")).agg(F.avg("x").alias("x"))
    r = r.withColumn("d", F.sqrt(F.pow(F.col("region") - at, 2) + F.pow(F.col("x") - 50, 2))).where("d <= 100")
    return r.select("region", _lod(F.col("d")).alias("lod"))


@add(f"WITH {_FRAMES} SELECT region, lod FROM a")
def visible_regions(spark, sf):
    return _frame(spark, sf, 20)


@add(f"WITH {_FRAMES} SELECT coalesce(a.region, b.region) AS region, CASE WHEN a.region IS NULL THEN 'added' WHEN b.region IS NULL THEN 'removed' ELSE 'lod_changed' END AS change FROM a FULL JOIN b USING (region) WHERE a.lod IS DISTINCT FROM b.lod")
def viewport_diff(spark, sf):
    return batch.viewport_diff(_frame(spark, sf, 20), _frame(spark, sf, 60))


@add(f"WITH {_EV} SELECT id, row_number() OVER (PARTITION BY source, ts_ms // {6 * HOUR} ORDER BY ts_ms, id) <= 20 AS allowed FROM e")
def rate_limit(spark, sf):
    return batch.over_limit(events(spark, sf), 6 * HOUR, 20).select("id", "allowed")


@add(f"WITH {_EV}, r AS (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS n FROM e) SELECT source, MIN(x) FILTER (n <= 500) AS low, MAX(x) FILTER (n <= 500) AS high, quantile_disc(x, 0.5) FILTER (n <= 500) AS p50, quantile_disc(x, 0.99) FILTER (n <= 500) AS p99, round(AVG(x), 6) AS mean FROM r GROUP BY source")
def latency_stats(spark, sf):
    got = batch.latency(events(spark, sf).select("source", F.col("id").alias("seq"), F.col("x").alias("value")), 500)
    return got.select("source", "low", "high", "p50", "p99", F.round("mean", 6).alias("mean"))


@add(f"WITH {_EV}, s AS (SELECT user_id AS id, ts_ms, id AS o, ['OWNED', 'MIGRATING_OUT', 'DEPARTED', 'COMMITTED', 'ROLLBACK'][1 + id % 5] AS state FROM e), m AS (SELECT max(ts_ms) AS now FROM e) SELECT id, arg_max(state, o) AS state, arg_max(state, o) IN ('MIGRATING_OUT', 'DEPARTED') AND any_value(now) - max(ts_ms) > {24 * HOUR} AS timed_out FROM s, m GROUP BY id")
def migration_states(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("ts_ms")).first()[0]
    names = F.array(*map(F.lit, ("OWNED", "MIGRATING_OUT", "DEPARTED", "COMMITTED", "ROLLBACK")))
    s = e.select(F.col("user_id").alias("id"), "ts_ms", F.col("id").alias("o"), F.get(names, (F.col("id") % 5).cast("int")).alias("state"))
    return batch.last_states(s, "o", 24 * HOUR, now)


@add(f"WITH {_EV} SELECT source, CASE WHEN 0.6::DOUBLE * x + 0.8::DOUBLE * y - 100 >= 0 THEN 'right' ELSE 'left' END AS side, COUNT(*) AS n FROM e GROUP BY ALL")
def split_by_plane(spark, sf):
    side = F.when(0.6 * F.col("x") + 0.8 * F.col("y") - 100 >= 0, "right").otherwise("left")
    return events(spark, sf).groupBy("source", side.alias("side")).agg(F.count("*").alias("n"))


def _consistency(e):
    known, expected = F.count_distinct(F.when(F.col("id") % 2 == 0, F.col("user_id"))), F.count_distinct("user_id")
    got = e.groupBy(F.floor(F.col("user_id") / 10).alias("region")).agg(known.alias("known"), expected.alias("expected"))
    return got.select("*", F.round(F.least(F.lit(1.0), F.col("known") / F.col("expected")), 6).alias("consistency"))


@add(f"WITH {_EV} SELECT user_id // 10 AS region, COUNT(DISTINCT user_id) FILTER (id % 2 = 0) AS known, COUNT(DISTINCT user_id) AS expected, round(least(1, COUNT(DISTINCT user_id) FILTER (id % 2 = 0) / COUNT(DISTINCT user_id)), 6) AS consistency FROM e GROUP BY 1")
def neighbour_consistency_whole(spark, sf):
    return _consistency(events(spark, sf))
