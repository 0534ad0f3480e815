"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

Tokenizing cuts a text longer than the capacity into pieces of the capacity; its first piece takes the remainder. The
plan needs only how many pieces have each length, a histogram of at most `capacity` numbers: the large lengths are cut
into groups of equal cardinality and each group is rounded up to its largest length; configurations of the few rounded
sizes are chosen one after another, each the fullest for the largest size left (dynamic programming) and used as often
as the counts allow; actual lengths then take the groups' places, and small pieces go, longest first, to the sequence
whose room fits best. Planning is on the driver, its input and the plan bounded by the capacity. Pieces find their
place by their rank among those of their length: the rank within their task, known when it tokenizes, plus the counts
of the tasks before it. So no hot length is sorted or gathered anywhere.

Null texts are empty; an empty text still has its end token. Repeated rows are packed each. No rows: no pieces. Texts of
any length are encoded whole. Ids are integers or text that reads as such. place_pieces keeps all columns of pieces.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm._common import materialize, small, tidied

END = 2
_RUN = re.compile(r"\s\s|\s\Z")
MOST_OFFSET_ROWS = 400_000  # (task, length) counts that are broadcast; beyond, they are joined by a shuffle


class Encoder:
    """Ids of byte-level BPE as little-endian unsigned 32-bit bytes.

    In a text whose white space stands alone, a word with the blank before it is always encoded by itself, so such
    words are kept (bounded in number); every other text is encoded whole. With ranks_path, the same vocabulary as ranks
    (and the pattern that parts words), new words take the shorter way through it; the ids are the same."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str = "", most_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.words = Tokenizer.from_file(tokenizer_path), most_words, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not ranks_path:
            self.ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _RUN.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self.words
        out = list(map(known.get, rest))
        if None in out:
            if len(known) > self.most:
                known.clear()
            for k, (word, found) in enumerate(zip(rest, out, strict=True)):
                if found is None:
                    found = known.get(word)
                    out[k] = known[word] = found if found is not None else array("I", self.ids(" " + word)).tobytes()
        return self._whole(first) + b"".join(out) if first else b"".join(out)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, pattern: str = "", capacity: int = 1024, id_col="doc_id", text_col="text") -> DataFrame:
    """(task, doc, piece, start, length, local_rank, ids): the pieces, written to the shared folder.

    local_rank counts a task's pieces of one length; the table that is read back holds one attempt of each task."""

    # a worker keeps a broadcast value, and with it the encoder and the words it has met, from task to task
    kept = docs.sparkSession.sparkContext.broadcast({})

    def cut(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if "encoder" not in kept.value:
            kept.value["encoder"] = Encoder(tokenizer_path, ranks_path, pattern)
        encoder, task, ranks = kept.value["encoder"], TaskContext.get().partitionId(), {}
        for batch in small(batches):
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + END.to_bytes(4, "little")
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = min(n, (n % capacity or capacity) if at == 0 else capacity)
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    rows.append((task, doc, piece, at, length, rank, ids[4 * at : 4 * (at + length)]))
                    at, piece, size = at + length, piece + 1, size + 4 * length
                if size > 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["task", "doc", "piece", "start", "length", "local_rank", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(tidied(cut), "task int, doc long, piece int, start long, length int, local_rank long, ids binary"), "pieces")


def plan(counts: dict[int, int], capacity: int, *, groups: int = 256, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Places (length, first rank, last rank + 1, first sequence, offset): ranks [a, b) of a length go to the sequences
    first, first + 1, ... at the offset. Every piece has one place; sequences are numbered without gaps."""
    small = 7 * capacity // 16 if small is None else small
    used, places, sequences = dict.fromkeys(counts, 0), [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room -> blocks (first sequence, how many)
    rooms: list[int] = []

    def room(block: tuple[int, int], left: int) -> None:
        if left not in free:
            free[left] = []
            insort(rooms, left)
        free[left].append(block)

    def put(length: int, n: int, first: int, left: int) -> None:
        places.append((length, used[length], used[length] + n, first, capacity - left))
        used[length] += n

    large = [(size, n) for size, n in sorted(counts.items(), reverse=True) if n and size > small]
    # groups of equal cardinality, largest first; a group is a list of runs (length, count)
    total, made, pools = sum(n for _, n in large), 0, []
    per = max(1, -(-total // groups))
    for size, n in large:
        while n:
            if made % per == 0:
                pools.append([])
            take = min(n, per - made % per)
            pools[-1].append([size, take])
            made, n = made + take, n - take
    merged: dict[int, list] = {}
    for pool in pools:  # groups that round up to one size are one size
        merged.setdefault(pool[0][0], []).extend(pool)
    sizes = sorted(merged, reverse=True)
    left = {s: sum(n for _, n in merged[s]) for s in sizes}

    def fullest(top: int) -> dict[int, int]:
        """The configuration with `top` that fills the capacity best from what is left (bounded subset sums)."""
        space = capacity - top
        best: list[tuple[int, int] | None] = [None] * (space + 1)  # sum -> (last size, sum before)
        reach = [True] + [False] * space
        for s in sizes:
            have = left[s] - (s == top)
            if s > space or have <= 0:
                continue
            times = [0] * (space + 1)
            for x in range(s, space + 1):
                if not reach[x] and reach[x - s] and times[x - s] < have:
                    reach[x], times[x], best[x] = True, times[x - s] + 1, (s, x - s)
            if reach[space]:
                break
        x = max(k for k in range(space + 1) if reach[k])
        config = {top: 1}
        while x:
            s, x = best[x]
            config[s] = config.get(s, 0) + 1
        return config

    for top in sizes:
        while left[top]:
            config = fullest(top)
            times = min(left[s] // n for s, n in config.items())
            slots = [s for s, n in config.items() for _ in range(n)]
            for s, n in config.items():
                left[s] -= n * times
            while times:  # substitute: runs of actual lengths, as far as none changes
                n, heads = times, []
                for s in dict.fromkeys(slots):
                    heads.append((s, slots.count(s)))
                    while not merged[s][0][1]:
                        merged[s].pop(0)
                    n = min(n, max(1, merged[s][0][1] // heads[-1][1]))
                space = capacity
                for s, k in heads:
                    for _ in range(k):
                        while not merged[s][0][1]:
                            merged[s].pop(0)
                        run = merged[s][0]
                        n_here = n
                        assert run[1] >= n_here or n_here == 1
                        put(run[0], n_here, sequences, space)
                        run[1] -= n_here
                        space -= run[0]
                room((sequences, n), space)
                sequences, times = sequences + n, times - n
    for size, n in [(s, n) for s, n in sorted(counts.items(), reverse=True) if n and s <= small]:
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                k = capacity // size
                new = max(1, n // k)
                room((sequences, new), capacity)
                sequences += new
                continue
            space = rooms[k]
            first, many = free[space].pop()
            if not free[space]:
                del free[space]
                rooms.pop(k)
            take = min(n, many)
            put(size, take, first, space)
            room((first, take), space - size)
            if many > take:
                room((first + take, many - take), space)
            n -= take
    return places


def place_pieces(pieces: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; all their other columns stay, but for task and local_rank."""
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for p in sorted(places):
        by_length.setdefault(p[0], []).append(p)
    held = pieces.sparkSession.sparkContext.broadcast({size: np.array(p, dtype=np.int64) for size, p in by_length.items()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= MOST_OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("base", "local_rank", "task")
    keep = [c for c in ranked.columns if c != "rank"]

    def apply(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at, p = np.flatnonzero(length == size), held.value[int(size)]
                k = np.searchsorted(p[:, 1], rank[at], side="right") - 1
                sequence[at], offset[at] = p[k, 3] + rank[at] - p[k, 1], p[k, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(tidied(apply), schema)
