"""Benchmark decontamination by greedy string tiling.

Words: A-Z lower-cased, ASCII punctuation taken as white space, split at ASCII white space. A document and a benchmark
item are compared if they share a seed, a run of `min_match` words. Tiling then marks, again and again, the longest
match of words not yet marked in either text, found by running Karp-Rabin hashing at a falling search length, until
none of `min_match` words is left. The share of the item's words that are marked is its coverage; reordering the
passage's parts does not lower it. A document is contaminated by the items it covers to `threshold` or more.

Every match of `min_match` words or more lies in runs of shared seeds, so the document is cut down to those runs first,
and an item is passed over only if even its seeded words stay below the threshold.

Nulls: null or empty texts match nothing; items of fewer than `min_match` words have no seed and match nothing; items
with a null id are not used. Item ids are integers or text that reads as such. Repeated documents are judged each on its
own, repeated items each by their id. No documents: no rows; no benchmark: no hits. A text of any length is one row's
work. A column of the result's name is replaced; all others stay.
"""

from __future__ import annotations

import heapq
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import bytes_of, mix64, small, tidied, unused

MOST_BENCHMARK_BYTES = 16 << 20  # of benchmark text that is broadcast at a time
_TABLE = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 32 if chr(b) in string.punctuation else b for b in range(256))
_B = 1_000_003
_MASK = (1 << 61) - 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _longest(a: list[int], b: list[int], free_a: list[bool], free_b: list[bool], length: int):
    """Running Karp-Rabin: the free matches of `length` or more as (size, start in a, start in b); at one that is more than
    twice as long the search stops, and its size comes back as the next length."""

    def windows(x, free):
        run = h = 0
        top = pow(_B, length - 1, _MASK)
        for k, word in enumerate(x):
            if not free[k]:
                run = h = 0
                continue
            if run >= length:
                h = (h - x[k - length] * top) % _MASK
            h = (h * _B + word) % _MASK
            run += 1
            if run >= length:
                yield k - length + 1, h

    table: dict[int, list[int]] = {}
    for p, h in windows(b, free_b):
        table.setdefault(h, []).append(p)
    found, done = [], {}
    for s, h in windows(a, free_a):
        for p in table.get(h, ()):
            if done.get(s - p, -1) > s:  # within a longer match on this diagonal
                continue
            size = 0
            while s + size < len(a) and p + size < len(b) and a[s + size] == b[p + size] and free_a[s + size] and free_b[p + size]:
                size += 1
            if size < length:
                continue
            done[s - p] = s + size
            if size > 2 * length:
                return size, []
            found.append((size, s, p))
    return 0, found


def tile(a: list[int], b: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (size, start in a, start in b) of greedy string tiling; words of a that are 0 match nothing."""
    free_a, free_b = [w != 0 for w in a], [True] * len(b)
    tiles, length = [], max(min_match, min(len(a), len(b)) // 2)
    while True:
        more, found = _longest(a, b, free_a, free_b, length)
        if more:
            length = more
            continue
        queue = [(-size, s, p) for size, s, p in found]  # the longest first, then the earliest
        heapq.heapify(queue)
        while queue:
            size, s, p = heapq.heappop(queue)
            size = -size
            if all(free_a[s : s + size]) and all(free_b[p : p + size]):
                tiles.append((size, s, p))
                free_a[s : s + size] = [False] * size
                free_b[p : p + size] = [False] * size
                continue
            k = 0
            while k < size:  # what earlier tiles have left of it goes back into the queue
                run = 0
                while k + run < size and free_a[s + k + run] and free_b[p + k + run]:
                    run += 1
                if run >= length:
                    heapq.heappush(queue, (-run, s + k, p + k))
                k += run + 1
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class Benchmark:
    """Items as word numbers, and a sorted table of their seeds."""

    def __init__(self, items: list[tuple[int, bytes]], min_match: int):
        self.min_match, self.number = min_match, {}
        self.ids, self.words, grams, owners = [], [], [], []
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if len(words) >= min_match:
                g = self._grams(np.array(words, dtype=np.uint64))
                grams.append(g)
                owners.append(np.full(len(g), len(self.ids)))
                self.ids.append(item)
                self.words.append(words)
        seed, owner = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.uint64), np.zeros(0, int))
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order]
        self.hint = np.zeros(1 << 20, dtype=bool)
        self.hint[self.seed & np.uint64((1 << 20) - 1)] = True

    def _grams(self, x: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(x) - self.min_match + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.min_match):
                h = h * np.uint64(_B) + x[k : k + len(h)]
        return mix64(h)

    def matches(self, text: bytes, threshold: float) -> list[tuple[int, float, int]]:
        """(item id, coverage, longest tile) of the items that the text covers to the threshold or more."""
        get = self.number.get
        x = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
        if len(x) < self.min_match or not len(self.seed):
            return []
        h = self._grams(x)
        at = np.flatnonzero(self.hint[h & np.uint64((1 << 20) - 1)])
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.seed, h[at], "left"), np.searchsorted(self.seed, h[at], "right")
        hits: dict[int, list[int]] = {}
        for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
            for k in set(self.owner[a:b].tolist()):
                hits.setdefault(k, []).append(int(p))
        out = []
        for k in sorted(hits):
            item = self.words[k]
            here = set(h[hits[k]].tolist())
            seeded = np.zeros(len(item), bool)
            for p, g in enumerate(self._grams(np.array(item, dtype=np.uint64)).tolist()):
                if g in here:
                    seeded[p : p + self.min_match] = True
            if seeded.sum() < threshold * len(item):
                continue
            parts, last = [], -1
            for p in hits[k]:  # the seeded runs, a 0 between two of them
                if p > last:
                    parts += [0] if parts else []
                    last = p
                parts += x[last : p + self.min_match].tolist()
                last = p + self.min_match
            tiles = tile(parts, item, self.min_match)
            covered = sum(t[0] for t in tiles) / len(item)
            if covered >= threshold:
                out.append((self.ids[k], covered, max(t[0] for t in tiles)))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", min_match: int = 5, threshold: float = 0.8, most_bytes: int = MOST_BENCHMARK_BYTES, out_col="contamination") -> DataFrame:
    """docs with a column out_col: array of (item, coverage, longest), empty for clean ones. No shuffle.

    The benchmark is broadcast in blocks of at most `most_bytes` of text (one item at least), whose number follows the
    benchmark's measured size; the documents pass each block in turn, so its size has no limit."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("body"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-total * 2 // most_bytes)) if total > most_bytes else 1
    kind = "array<struct<item:bigint,coverage:double,longest:int>>"
    out = docs.drop(out_col)
    made = unused(out, *(f"_tiles{b}" for b in range(blocks)))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().sort_by([("item", "ascending"), ("body", "ascending")])
        held = docs.sparkSession.sparkContext.broadcast(Benchmark(list(zip(rows["item"].to_pylist(), rows["body"].to_pylist(), strict=True)), min_match))
        column = made[block]
        keep = out.columns

        def apply(batches, held=held, keep=keep, column=column):
            for batch in small(batches):
                got = [[dict(zip(("item", "coverage", "longest"), m, strict=True)) for m in held.value.matches(t, threshold)] for t in bytes_of(batch.column(batch.schema.get_field_index(text_col)))]
                kind = pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("longest", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], [*keep, column])

        out = out.mapInArrow(tidied(apply), out.withColumn(column, F.lit(None).cast(kind)).schema)
    return out.withColumn(out_col, F.concat(*made)).drop(*made)
