"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of `width` words (repeats included) hashed
with XXH64 (seed 42); a bit is 1 if set in over half of the hashes. A text of fewer words has one shingle, its whole
word sequence; a text without words (null included) has the fingerprint zero and is linked like any other.

Links: two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one of the two 32-bit segments.
Each distinct fingerprint enters a segment's table under its segment, and probes the table under each value of the
Hamming ball of radius 1 that has a bit less (of two segments one bit apart, one has the bit less). Buckets hold
distinct fingerprints, are searched by complete distance, and return a spanning tree of what they link, never all pairs.

Repeated rows and equal texts share a fingerprint and are counted once in the search. Null ids: such rows keep their
fingerprint; their component is the least non-null id linked, null if there is none. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import by_bucket, bytes_of, labels_of, materialize, mix64, partitions, tidied
from cubeloom.llm.components import components

RADIUS = 3
BLOCK = 32_768  # distinct fingerprints that a bucket searches directly
_PROBES_A_TASK = 8_000_000


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, text_col="text", width: int = 3, out="fingerprint") -> DataFrame:
    """docs with their fingerprint as a (signed) long, without the text."""
    keep = [c for c in docs.columns if c not in (text_col, out)]
    schema = docs.select(*keep).withColumn(out, F.lit(0).cast("long")).schema

    def apply(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in bytes_of(batch.column(text_col))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(prints.view(np.int64))], [*keep, out])

    return docs.select(*keep, text_col).mapInArrow(tidied(apply), schema)


def _search(prints: np.ndarray, bits: int = 16):
    """(other, root) pairs that span what distance <= RADIUS links among distinct fingerprints."""
    if len(prints) < 2:
        return
    if len(prints) > BLOCK and bits >= 4:  # some of the words of `bits` bits is equal in linked ones
        for k in range(0, 64, bits):
            word = (prints >> np.uint64(k)) & np.uint64((1 << bits) - 1)
            order = np.argsort(word, kind="stable")
            for part in np.split(prints[order], np.flatnonzero(np.diff(word[order])) + 1):
                yield from _search(part, bits // 2 if len(part) > BLOCK else 0)
        return
    left = np.sort(prints)
    while len(left):  # breadth-first from the least one left
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for k in range(0, len(frontier), 64):
                rest = np.flatnonzero(~near)
                near[rest] = (np.bitwise_count(left[rest] ^ frontier[k : k + 64, None]) <= RADIUS).any(axis=0)
            frontier, left = left[near], left[~near]
            for x in frontier:
                yield x, root


def _probe(prints: np.ndarray):
    """(key, fingerprint, in the table) of every table entry and probe."""
    keys, of, table = [], [], []
    for segment in (0, 1):
        value = (prints >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
        mark = np.uint64(segment << 32)
        keys.append(value | mark)
        of.append(prints)
        table.append(np.ones(len(prints), bool))
        for bit in range(32):
            has = np.flatnonzero((value >> np.uint64(bit)) & np.uint64(1))
            keys.append((value[has] ^ np.uint64(1 << bit)) | mark)
            of.append(prints[has])
            table.append(np.zeros(len(has), bool))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(table)


def links(prints: DataFrame) -> DataFrame:
    """(u, v): edges that connect exactly the distinct fingerprints (column fp, long) that distance <= 3 connects."""
    spark = prints.sparkSession
    n = max(partitions(spark), -(-prints.count() * 36 // _PROBES_A_TASK))

    label = labels_of(n)

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 20_000):
                key, of, table = _probe(fp[k : k + 20_000])
                bucket = (mix64(key) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(n) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label[b] for b, _ in rows], pa.int32()), *(pa.array([a[at].tobytes() for _, at in rows], pa.binary()) for a in (key, of, table))],
                    ["bucket", "keys", "prints", "tables"],
                )

    def search(batches):
        keys, of, table = [], [], []
        for batch in batches:
            for column, to, kind in (("keys", keys, np.uint64), ("prints", of, np.uint64), ("tables", table, bool)):
                to += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
        if not keys:
            return
        key, of, table = np.concatenate(keys), np.concatenate(of), np.concatenate(table)
        order = np.argsort(key, kind="stable")
        key, of, table = key[order], of[order], table[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        found = []
        for a, b in zip(*(x[(ends - starts > 1) & np.maximum.reduceat(table, starts)] for x in (starts, ends)), strict=True):
            found += _search(np.unique(of[a:b]))
        pairs = np.unique(np.array(found, dtype=np.uint64).reshape(-1, 2), axis=0).view(np.int64)
        for k in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 50_000, c]) for c in (0, 1)], ["u", "v"])

    dealt = prints.select("fp").mapInArrow(tidied(deal), "bucket int, keys binary, prints binary, tables binary")
    return by_bucket(dealt, n, "bucket").mapInArrow(tidied(search), "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", width: int = 3) -> DataFrame:
    """(id_col, fingerprint long, component_id): one row per row of docs."""
    printed = materialize(with_fingerprint(docs.select(id_col, text_col), text_col=text_col, width=width, out="fp"), "prints")
    distinct = printed.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(distinct))
    named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(first, "root").select("fp", "component_id")
    return printed.join(by_print, "fp").select(id_col, F.col("fp").alias("fingerprint"), "component_id")
