"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, all of them.

SimHash links (3 words, 3 bits) come first: they join most copies with few edges. What they leave apart is found by an
exact join: of two sets that similar, the first size - ceil(0.8 size) + 1 shingles share one, whatever the common order.
Shingles that a sample finds often stand last in that order; the sample decides the cost, never the result. Candidate
pairs pass bounds that lose no pair and are then verified on whole sets.
The number of first shingles that a pair shares bounds what it can share in all, and so does the distance of parity bits.
The first round pairs each set with the likeliest first holder of its shingles, the second all that share one and are
still in different components.

Words as in SimHash; a text of fewer than five has one shingle, its whole word sequence. Shingles are 64-bit hashes.

Null texts are empty; texts without words link as their fingerprints do. Rows with a null id link like any other. Texts
of any length are read whole. No rows: no groups. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm._common import bytes_of, forget, materialize, mix64, small, tidied
from cubeloom.llm.components import components
from cubeloom.llm.simhash import fingerprint, links

WIDTH = 5
SAMPLE = 5_000  # documents whose shingles set the order
MOST_BROADCAST = 1_000_000  # hashes of texts to verify that are broadcast
FEW = 16  # holders of a shingle that are paired by a join
BLOCK = 2_048  # holders of a shingle that meet in a task
EARLY = 16  # crowded shingles of a set that tell whether a pair has met before
_WORDS = 8  # of 64 parity bits
_BITS = [f"b{k}" for k in range(_WORDS)]


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)
    n = max(1, len(h) - WIDTH + 1) if len(h) else 0
    out = np.full(n, min(len(h), WIDTH), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(WIDTH, len(h))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 7)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(parts) if parts else []))


def _common(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more of a sample's documents hold, sorted, and how many."""

    def apply(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([shingles(t) for t in bytes_of(batch.column(text_col))]))], ["token"])

    some = docs.select(text_col).orderBy(F.xxhash64(text_col)).limit(SAMPLE).mapInArrow(tidied(apply), "token long")
    often = some.groupBy("token").count().where("count >= 3").orderBy(F.desc("count"), "token").limit(200_000).toArrow()  # not as Python rows
    token, n = often["token"].to_numpy().astype(np.int64).view(np.uint64), often["count"].to_numpy().astype(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    often, counts = _common(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for batch in small(batches):
            texts = bytes_of(batch.column(text_col))
            sets, first, parity = [shingles(t) for t in texts], [], np.zeros((len(texts), _WORDS), np.uint64)
            for i, s in enumerate(sets):
                at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                rank = np.where(often[at] == s, counts[at], 0) if len(often) else np.zeros(len(s), np.int64)
                first.append(s[np.lexsort((s, rank))][: len(s) - -(-4 * len(s) // 5) + 1])
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * _WORDS - 1), minlength=64 * _WORDS) & 1
                parity[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), _signed([fingerprint(t, 3) for t in texts]), _signed([_key(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), _lists(first), *(_signed(parity[:, k].copy()) for k in range(_WORDS))],
                [id_col, "text_hash", "fp", "key", "size", "first", *_BITS],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias(text_col), F.xxhash64(text_col).alias("_hash"))
    return rows.mapInArrow(tidied(apply), f"`{id_col}` {kind}, text_hash long, fp long, key long, size int, first array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _verified(docs: DataFrame, rows: DataFrame, sets: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (k1, k2) of (k1, k2, n1, n2) whose sets are similar to 0.8 or more."""
    side = lambda k: sets.select(F.col("key").alias(f"k{k}"), *(F.col(b).alias(f"{b}_{k}") for b in _BITS))
    near = pairs.join(side(1), "k1").join(side(2), "k2")
    apart = sum((F.bit_count(F.col(f"{b}_1").bitwiseXOR(F.col(f"{b}_2"))) for b in _BITS), F.lit(0))
    near = materialize(near.where(9 * apart <= F.col("n1") + F.col("n2")).select("k1", "k2", "n1", "n2"), "near")
    keys = near.select(F.col("k1").alias("key")).union(near.select("k2"))
    wanted = materialize(rows.join(keys.distinct(), "key", "left_semi").groupBy("key").agg(F.min("text_hash").alias("_wanted")).select("_wanted").distinct(), "wanted")
    if wanted.count() <= MOST_BROADCAST:  # else by a shuffle
        wanted = F.broadcast(wanted)

    def apply(batches):
        seen = set()
        for batch in small(batches):
            made = {_key(s): s for s in map(shingles, bytes_of(batch.column(text_col)))}
            keep = [k for k in made if k not in seen]
            seen.update(keep)
            yield pa.RecordBatch.from_arrays([_signed(keep), _lists([made[k] for k in keep])], ["key", "tokens"])

    texts = docs.select(text_col).join(wanted, F.xxhash64(text_col) == F.col("_wanted"), "left_semi")
    whole = materialize(texts.mapInArrow(tidied(apply), "key long, tokens array<long>").groupBy("key").agg(F.first("tokens").alias("tokens")), "tokens")
    side = lambda k: whole.select(F.col("key").alias(f"k{k}"), F.col("tokens").alias(f"t{k}"))
    shared = F.size(F.array_intersect("t1", "t2"))
    out = near.join(side(1), "k1").join(side(2), "k2").where(9 * shared >= 4 * (F.col("n1") + F.col("n2"))).select("k1", "k2")
    return forget(materialize(out, "similar"), near, whole)


def _crowds(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (k1, k2, n1, n2, c) of sets in different components that pass the bounds of size, position and parity bits; c:
    the shingles of many holders that they share among their first. Holders meet in blocks, and what fails the bounds never
    leaves a block. Nor does a pair that shares one of the EARLY first crowded shingles of both before the one they meet at:
    it passes where it meets first, so most pairs leave once, not once a shingle."""
    crowded = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"].alias("crowded"))
    crowded = materialize(crowded, "crowded")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = held.join(sets.select("key", *_BITS), "key").join(crowded.select("key", F.slice("crowded", 1, EARLY).alias("early")), "key")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def meet(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        key, size, pos, c, mine = (table[x].to_numpy().astype(np.int64) for x in ("key", "size", "pos", "c", "mine"))
        words = np.stack([table[b].to_numpy() for b in _BITS]).view(np.uint64)  # bitwise_count would take off a sign
        token = table["token"][0].as_py()
        early = [e[: e.index(token)] if token in e else e for e in table["early"].to_pylist()]  # in the order of all sets: those before this one
        number = {e: k for k, e in enumerate(sorted({x for e in early for x in e}))}
        before = np.full((len(early), max(map(len, early), default=0)), -1, np.int64)
        for k, e in enumerate(early):
            before[k, : len(e)] = [number[x] for x in e]
        left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        out = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left) if len(np.unique(c)) > 1 else 0, 128):
            i, j = left[at : at + 128, None], right[None, :]
            total = size[i] + size[j]
            ok = (c[i] != c[j]) & (9 * (np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])) >= 4 * total)
            ok &= (key[i] < key[j]) if low == high else (key[i] != key[j])
            x, y = np.nonzero(ok)
            x, y = left[at + x], right[y]
            apart = np.zeros(len(x), np.int64)
            for w in words:
                apart += np.bitwise_count(w[x] ^ w[y])
            near = 9 * apart <= size[x] + size[y]
            x, y = x[near], y[near]
            for own in before.T:
                new = (own[x] < 0) | (before[y] != own[x][:, None]).all(axis=1)
                x, y = x[new], y[new]
            out.append(np.stack([x, y], axis=1))
        pair = np.concatenate(out)
        x, y = pair[:, 0], pair[:, 1]
        swap = key[x] > key[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pa.table({"k1": key[x], "k2": key[y], "n1": size[x].astype(np.int32), "n2": size[y].astype(np.int32)})

    pairs = rows.groupBy("token", "low", "high").applyInArrow(meet, "k1 long, k2 long, n1 int, n2 int").distinct()
    side = lambda k: crowded.select(F.col("key").alias(f"k{k}"), F.col("crowded").alias(f"t{k}"))
    return pairs.join(side(1), "k1").join(side(2), "k2").select("k1", "k2", "n1", "n2", F.size(F.array_intersect("t1", "t2")).cast("long").alias("c"))


def near_copies(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, text_hash, component, component_id): one row per row of docs; text_hash is the text's xxhash64, component
    names the group and component_id is its least non-null id (two groups may have rows of one id)."""
    rows = materialize(_sets(docs, id_col, text_col), "sets")
    linked = components(links(rows.select("fp").distinct()))
    roots = rows.select("key", "fp").distinct().join(linked, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    roots = materialize(roots, "roots")
    one = roots.groupBy("key").agg(F.min("root").alias("root"))
    edges = roots.select("key", F.col("root").alias("u")).join(one, "key").select("u", F.col("root").alias("v")).where("u <> v").distinct()
    sets = materialize(rows.where("size > 0").groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "first", *_BITS))), "shingles")
    # a shingle that many documents hold stands last in the order, so few of its holders have it among their first
    held = sets.select("key", F.posexplode("first").alias("pos", "token"))
    several = held.withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1").select("token", "key", "pos", "n")
    alone = materialize(several, "several")
    several = forget(materialize(alone.join(sets.select("key", "size"), "key").join(one, "key"), "held"), alone)
    # what the sets may share beside the first shingles that they share: no more than follows the longer first part
    bound = "9 * (c + (4 * greatest(n1, n2) + 4) div 5 - 1) >= 4 * (n1 + n2)"

    # round 1: each set with the one of the first holders of its shingles that shares most of them, and of the last
    heads = several.groupBy("token").agg(*(f(F.struct("key", "root", "size")).alias(f"h{k}") for k, f in enumerate((F.min, F.max))))
    near = several.join(heads, "token")
    stars = []
    for k in (0, 1):
        star = near.withColumn("h", F.col(f"h{k}")).where("key <> h.key AND root <> h.root AND 5 * size >= 4 * h.size AND 5 * h.size >= 4 * size")
        star = star.groupBy(F.col("h.key").alias("k1"), F.col("key").alias("k2"), F.col("h.size").alias("n1"), F.col("size").alias("n2")).agg(F.count("*").alias("c"))
        stars.append(star.groupBy("k2").agg(F.max(F.struct("c", "k1", "n1", "n2")).alias("b")).select("k2", "b.*").where(bound).select("k1", "k2", "n1", "n2"))
    found = _verified(docs, rows, sets, stars[0].union(stars[1]).distinct(), text_col)
    label = lambda k: one.select(F.col("key").alias(f"k{k}"), F.col("root").alias("uv"[k - 1]))
    edges = materialize(edges.unionByName(found.join(label(1), "k1").join(label(2), "k2").select("u", "v")), "edges")
    joined = components(edges).select("node", F.col("root").alias("top"))

    # round 2: all that share a shingle and are in different components; shingles of few holders by a join
    now = several.join(joined, F.col("root") == F.col("node"), "left").select("key", "size", "pos", "token", "n", F.coalesce("top", "root").alias("c"))
    rare = now.where(F.col("n") <= FEW)
    a, b = (rare.select("token", F.col("key").alias(f"k{k}"), F.col("size").alias(f"n{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    met = a.join(b, "token").where("k1 < k2 AND c1 <> c2 AND 5 * n1 >= 4 * n2 AND 5 * n2 >= 4 * n1").groupBy("k1", "k2", "n1", "n2").agg(F.count("*").alias("c"))
    met = met.unionByName(_crowds(now.where(F.col("n") > FEW), sets))
    met = met.groupBy("k1", "k2", "n1", "n2").agg(F.sum("c").alias("c")).where(bound).select("k1", "k2", "n1", "n2")
    found = _verified(docs, rows, sets, met, text_col)
    last = components(edges.unionByName(found.join(label(1), "k1").join(label(2), "k2").select("u", "v")))

    named = roots.select("fp", "root").distinct().join(last.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("top"))
    named = materialize(named, "tops")
    least = rows.join(named, "fp").groupBy("top").agg(F.min(id_col).alias("component_id"))
    found = named.join(least, "top").select("fp", F.col("top").alias("component"), "component_id")
    return rows.select(id_col, "text_hash", "fp").join(found, "fp").select(id_col, "text_hash", "component", "component_id")
