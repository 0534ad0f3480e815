"""Windows that several documents share, found by super-k-mer partitioning.

A text is a row of units (bytes or words); a window is `width` consecutive units. The minimiser of a window is the
least hash of its runs of `seed` units. Consecutive windows with one minimiser travel as one packed string, a
super-k-mer, to the bucket of their minimiser, so equal windows always meet. Four steps, in one plan without a driver:

1. deal: texts are dealt to tasks by a hash; each sends the distinct minimisers it has, with the least and greatest
   document that has them, to the minimisers' buckets; those of two documents or more come back to the tasks. Their
   number follows from the bytes of text (SHARE each), so a task's memory doesn't grow with the table.
2. pack: tasks send the distinct super-k-mers of those minimisers, packed and compressed, with their least and greatest
   document. A hot string is one entry a task, however many documents hold it.
3. decide: a bucket groups equal strings; where a minimiser has several strings, the operator's own method groups equal
   windows, block by block. What comes back: ranges of windows of a string, with the least document that has them.
4. mark: tasks mark the units under windows whose least document is below their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import by_bucket, labels_of, mix64, partitions, tidied, trim

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = (1 << 40) - 1
_SLICE = 1 << 18
_WHOLE = (1 << 32) - 1  # as a range's end: up to the string's last window
_SOME = 5_000  # strings hashed at a time
_CUT = 4_000  # strings cut by a longer seed at a time
SHARE = 8 << 20  # bytes of text a task holds, about
BLOCK = 1 << 21  # bytes of strings whose equal windows are found together, about
MOST = 1 << 17  # bytes of strings of one minimiser before it is cut again


class Hashes:
    """Hashes of any byte range of a buffer (a polynomial modulo 2^64, from prefix sums)."""

    _power = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        with np.errstate(over="ignore"):
            if len(Hashes._power) < n:
                for name, base in (("_power", _BASE), ("_inverse", _INVERSE)):
                    steps = np.full(n, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(Hashes, name, np.cumprod(steps))
            self.prefix = np.zeros(n, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes._power[: n - 1], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[ends] - self.prefix[starts]) * Hashes._inverse[starts]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[:n], x[width - have : width - have + n])
    return x[:n]


@dataclass
class Units:
    """Texts side by side: the bytes, each unit's first byte and end, and each unit's text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def byte_units(texts: list[bytes]) -> Units:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.arange(len(data) + 1)
    return Units(data, at[:-1], at[1:], np.repeat(np.arange(len(texts)), [len(t) for t in texts]))


def word_units(texts: list[bytes]) -> Units:
    """Words are parted by one blank, whatever white space stood there."""
    parts = [t.split() for t in texts]
    joined = b" ".join(w for p in parts for w in p)
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = np.flatnonzero(data == 32)
    n = sum(map(len, parts))
    start = np.append(0, blank + 1)[:n]
    end = np.append(blank, len(data))[:n]
    return Units(data, start, end, np.repeat(np.arange(len(texts)), [len(p) for p in parts]))


@dataclass
class Runs:
    """Super-k-mers: bucket number times 2^40 plus the minimiser's low bits, a hash of the string, the first and last
    window, and the string's byte range."""

    key: np.ndarray
    string: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray


def runs_of(u: Units, width: int, seed: int, buckets: int, salt: np.uint64 = np.uint64(0)) -> Runs:
    n = len(u.start) - width + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none.astype(np.uint64), none.astype(np.uint64), none, none, none, none)
    hashes = Hashes(u.data)
    low = _least(mix64(hashes.of(u.start[: len(u.start) - seed + 1], u.end[seed - 1 :]) ^ salt), width - seed + 1)
    inside = u.text[:n] == u.text[width - 1 :]
    starts = np.flatnonzero(inside & np.append(True, (low[1:] != low[:-1]) | ~inside[:-1]))
    stops = np.flatnonzero(inside & np.append((low[1:] != low[:-1]) | ~inside[1:], True))
    a, z = u.start[starts], u.end[stops + width - 1]
    bucket = (low[starts] >> np.uint64(40)) % np.uint64(buckets)
    return Runs((bucket << np.uint64(40)) | (low[starts] & np.uint64(_LOW)), hashes.of(a, z), starts, stops, a, z)


def _pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = b"".join(np.uint32(a.nbytes).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays) + tail)


def _unpack(blob: bytes, *kinds) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.uint32, len(kinds)), 4 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return [*out, raw[at:]]


def _five(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy()


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), dtype=np.uint8)
    out[:, :5] = x.reshape(-1, 5)
    return out.view("<u8").ravel()


def _rows(column: pa.ChunkedArray) -> list:
    return column.to_pylist()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _slices(table: pa.Table, units: Callable, width: int, seed: int, buckets: int):
    """Of each slice of a task's texts: ids (-1: null), the texts, units and runs."""
    ids = np.array([-1 if x is None else x for x in table["_id"].to_pylist()], dtype=np.int64)
    real = np.array(table["_id"].is_valid().to_pylist(), dtype=bool)
    texts = [x or b"" for x in table["_text"].to_pylist()]
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= _SLICE:
            size += len(texts[to])
            to += 1
        u = units(texts[at:to])
        yield at, ids[at:to], real[at:to], texts[at:to], u, runs_of(u, width, seed, buckets)
        at = to


def _spread(key: np.ndarray, documents: np.ndarray):
    """Distinct keys in order, with their least and greatest document and one place of each."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    if not len(starts):
        return k, documents, documents, order
    d = documents[order]
    return k[starts], np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts), order[starts]


def _by_bucket(key: np.ndarray, buckets: int):
    """(bucket, range) of sorted keys."""
    cuts = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40))
    return [(b, slice(cuts[b], cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _join_key(key: np.ndarray, string: np.ndarray) -> np.ndarray:
    return mix64(key) ^ string


def least_documents(keys: list, strings: list[bytes], firsts: list, units: Callable, width: int, seed: int, group_windows: Callable, block: int = BLOCK, most: int = MOST, finer: int | None = None):
    """(k, least): of each string the least document of each of its windows, over all strings of its key; None where the
    key has no other string. Strings stand by key, each once a key; keys go together into blocks of about `block`
    bytes, of which group_windows finds the equal windows. A key whose strings alone are over `most` is cut again by a longer
    seed: equal windows have equal minimisers of that too; seeds as long as windows leave one string a key. With `finer` all
    keys of several strings are cut once by seeds of that length, so that stretches no other string can share stay out."""
    def settled(those):
        if finer and seed < finer:
            return _finer(those, keys, strings, firsts, units, width, finer, group_windows, block, most)
        return _settled(those, keys, strings, firsts, units, width, group_windows)

    edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else [0]
    waiting: list[int] = []
    size = 0
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        bytes_here = sum(map(len, strings[a:z])) if z > a + 1 else 0
        if z == a + 1:
            yield a, None
        elif bytes_here > most and seed < width:
            yield from _cut_again(range(a, z), strings, firsts, units, width, seed, group_windows, block, most)
        else:
            waiting += range(a, z)
            size += bytes_here
            if size >= block:
                yield from settled(waiting)
                waiting, size = [], 0
    if waiting:
        yield from settled(waiting)


def _settled(those, keys, strings, firsts, units, width, group_windows):
    u = units([strings[k] for k in those])
    units_of = np.bincount(u.text, minlength=len(those))
    counts = units_of - width + 1
    of = np.repeat(np.arange(len(those)), counts)
    ends = np.cumsum(counts)
    at = np.arange(len(of)) + (np.cumsum(units_of) - units_of - (ends - counts))[of]
    key = np.array([keys[k] for k in those], dtype=np.uint64)
    same = group_windows(u, at, np.cumsum(np.append(False, key[1:] != key[:-1])))
    lowest = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, same, np.array([firsts[k] for k in those], dtype=np.int64)[of])
    for k, a, z in zip(those, ends - counts, ends, strict=True):
        yield k, lowest[same[a:z]]


def _finer(those, keys, strings, firsts, units, width, longer, group_windows, block, most):
    least, met = {}, []  # of each string; (class, string, owner, window of the owner)
    for at in range(0, len(those), _CUT):
        some = those[at : at + _CUT]
        u = units([strings[k] for k in some])
        r = runs_of(u, width, longer, 1, salt=np.uint64(0x9E6C63D0676A9A99))
        units_of = np.bincount(u.text, minlength=len(some))
        base, raw, of = np.cumsum(units_of) - units_of, u.data.tobytes(), u.text[r.first]
        least |= {k: np.full(n - width + 1, firsts[k], np.int64) for k, n in zip(some, units_of.tolist(), strict=True)}
        met.append((mix64(np.array([keys[k] for k in some], np.uint64)[of]) ^ r.key, np.array(some)[of], r.first - base[of], r.last - base[of] + 1, r.start, r.end, raw))
    key = np.concatenate([m[0] for m in met])
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    several = np.zeros(len(key), bool)  # a minimiser that is met once has windows like no others
    several[order] = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
    found: dict[tuple[int, bytes], int] = {}  # (class, string): the least document
    parts, at = [], 0
    for key, owner, first, stop, start, end, raw in met:
        use = np.flatnonzero(several[at : at + len(key)])
        at += len(key)
        for c, k, w, x, a, z in zip(*(v[use].tolist() for v in (key, owner, first, stop, start, end)), strict=True):
            name = (c, raw[a:z])
            found[name] = min(firsts[k], found.get(name, firsts[k]))
            parts.append((name, k, w, x))
    del met
    names = sorted(found)
    place = {name: i for i, name in enumerate(names)}
    decided = dict(least_documents([n[0] for n in names], [n[1] for n in names], [found[n] for n in names], units, width, longer, group_windows, block, most))
    for name, k, w, x in parts:
        got = decided[place[name]]
        least[k][w:x] = found[name] if got is None else got
    yield from least.items()


def _cut_again(those, strings, firsts, units, width, seed, group_windows, block, most):
    longer = min(width, seed + max(1, (width - seed + 1) // 2))
    found: dict[tuple[int, bytes], int] = {}  # (minimiser, string): the least document
    parts = []  # (minimiser, string, owner, window of the owner)
    least = {}
    for at in range(0, len(those), 1000):
        some = those[at : at + 1000]
        u = units([strings[k] for k in some])
        r = runs_of(u, width, longer, 1, salt=np.uint64(0x9E6C63D0676A9A99 * longer % (1 << 64)))
        units_of = np.bincount(u.text, minlength=len(some))
        base, raw = np.cumsum(units_of) - units_of, u.data.tobytes()
        least |= {k: np.empty(n - width + 1, np.int64) for k, n in zip(some, units_of.tolist(), strict=True)}
        for key, a, z, w in zip(r.key.tolist(), r.start.tolist(), r.end.tolist(), r.first.tolist(), strict=True):
            text = int(u.text[w])
            k, s = some[text], raw[a:z]
            found[key, s] = min(firsts[k], found.get((key, s), firsts[k]))
            parts.append((key, s, k, w - int(base[text])))
    names = sorted(found)
    place = {name: i for i, name in enumerate(names)}
    decided = dict(least_documents([n[0] for n in names], [n[1] for n in names], [found[n] for n in names], units, width, longer, group_windows, block, most))
    stops: dict[int, list] = {}
    for key, s, k, w in parts:
        stops.setdefault(k, []).append((w, (key, s)))
    for k, pieces in stops.items():
        pieces.sort()
        for (w, name), stop in zip(pieces, [*(p[0] for p in pieces[1:]), len(least[k])], strict=True):
            got = decided[place[name]]
            least[k][w:stop] = found[name] if got is None else got
        yield k, least[k]


def shared_windows(docs: DataFrame, *, units: Callable, width: int, seed: int, group_windows: Callable, finish: Callable, schema: str, id_col: str, text_col: str, finer: int | None = None) -> DataFrame:
    """Rows that `finish(ids, real, texts, units, covered)` makes of each slice of texts: a RecordBatch of `schema`.

    covered: of each unit, whether a window over it also starts in a document with a smaller id. Rows with a null id
    neither cover nor are covered. Rows of one id are one document. group_windows(units, first units of the windows, the
    minimiser's number of each string): a class number for each window, equal where windows of a minimiser are. finer: see
    least_documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // SHARE))
    label = labels_of(n)
    number = {int(x): k for k, x in enumerate(label)}
    labels = F.array(*(F.lit(int(x)) for x in label))
    dealt = by_bucket(rows.withColumn("_task", F.get(labels, F.pmod(F.xxhash64("_id", F.octet_length("_text")), F.lit(n)).cast("int"))), n, "_task")

    def deal(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, doc, real, _, u, r in _slices(table, units, width, seed, n):
            of = u.text[r.first]
            keys.append(r.key[real[of]])
            ids.append(doc[of][real[of]])
        key, least, most, _ = _spread(np.concatenate(keys), np.concatenate(ids))
        task = table["_task"][0].as_py()
        yield _batch([(int(label[b]), task, _pack(_five(key[s] & np.uint64(_LOW)), least[s], (most - least)[s].astype(np.int64))) for b, s in _by_bucket(key, n)], ["_bucket", "_from", "_blob"])

    def common(batches):
        got = [(b, t, _unpack(x, np.uint8, np.int64, np.int64)) for batch in batches for b, t, x in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_from", "_blob")), strict=True)]
        if not got:
            return
        key = np.concatenate([_eight(x[0]) for _, _, x in got])
        least = np.concatenate([x[1] for _, _, x in got])
        most = least + np.concatenate([x[2] for _, _, x in got])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        several = np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(most[order], starts)
        flag = np.empty(len(key), dtype=bool)
        flag[order] = np.repeat(several, np.diff(np.append(starts, len(key))))
        cuts = np.cumsum([0] + [len(x[1]) for _, _, x in got])
        rows = [(t, number[b], _pack(_five(key[a:z][flag[a:z]]))) for (b, t, _), a, z in zip(got, cuts[:-1], cuts[1:], strict=True) if flag[a:z].any()]
        yield _batch(rows, ["_task", "_bucket", "_blob"])

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_bucket", "_from", "_blob"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([], names)])
        wanted = np.sort(np.concatenate([(np.uint64(b) << np.uint64(40)) | _eight(_unpack(x, np.uint8)[0]) for b, x in zip(_rows(right["_bucket"]), _rows(right["_blob"]), strict=True)]))
        keys, strings, ids, lengths, parts = [], [], [], [], []
        for _, doc, real, _, u, r in _slices(left, units, width, seed, n):
            at = np.searchsorted(wanted, r.key).clip(max=len(wanted) - 1)
            use = np.flatnonzero((wanted[at] == r.key) & real[u.text[r.first]])
            key, least, most, one = _spread(_join_key(r.key[use], r.string[use]), doc[u.text[r.first[use]]])
            raw = u.data.tobytes()
            one = use[one]
            keys.append(r.key[one])
            strings.append(key)
            ids.append(np.stack([least, most]))
            lengths.append((r.end - r.start)[one])
            parts += [raw[a:z] for a, z in zip(r.start[one].tolist(), r.end[one].tolist(), strict=True)]
        key, (least, most), length = np.concatenate(keys), np.concatenate(ids, axis=1), np.concatenate(lengths)
        _, l, m, one = _spread(np.concatenate(strings), least)  # over the slices
        m = _spread(np.concatenate(strings), most)[2]
        order = np.argsort(key[one], kind="stable")
        one, l, m = one[order], l[order], m[order]
        task = left["_task"][0].as_py()
        rows = [
            (int(label[b]), task, _pack(_five(key[one[s]] & np.uint64(_LOW)), l[s], (m - l)[s].astype(np.int64), length[one[s]].astype(np.uint32), tail=b"".join(parts[i] for i in one[s].tolist())))
            for b, s in _by_bucket(key[one], n)
        ]
        trim()
        return pa.Table.from_batches([_batch(rows, names)])

    def decide(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, t, x in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "_from", "_blob")), strict=True):
                held.setdefault(number[b], []).append((t, x))
        for bucket in sorted(held):
            yield from decided_of(bucket, held.pop(bucket))

    def decided_of(bucket: int, blobs: list):
        entries = []  # (minimiser, string, least, greatest, task)
        for t, x in blobs:
            key, least, spread, length, tail = _unpack(x, np.uint8, np.int64, np.int64, np.uint32)
            ends = np.cumsum(length.astype(np.int64)).tolist()
            entries += zip(_eight(key).tolist(), (tail[a:z] for a, z in zip([0, *ends], ends, strict=False)), least.tolist(), (least + spread).tolist(), [t] * len(least), strict=True)
        entries.sort(key=lambda e: (e[0], e[1]))
        keys, strings, firsts, owner = [], [], [], []  # of distinct strings
        for e in entries:
            if not strings or keys[-1] != e[0] or strings[-1] != e[1]:
                keys.append(e[0])
                strings.append(e[1])
                firsts.append(e[2])
            firsts[-1] = min(firsts[-1], e[2])
            owner.append(len(strings) - 1)
        ranges: dict[int, list] = {}  # of each string: ranges of windows, each with the least document
        for k, least in least_documents(keys, strings, firsts, units, width, seed, group_windows, finer=finer):
            if least is None:
                ranges[k] = [(0, _WHOLE, firsts[k])]
            else:
                cut = np.append(0, np.flatnonzero(np.diff(least)) + 1)
                ranges[k] = list(zip(cut.tolist(), [*cut[1:].tolist(), len(least)], least[cut].tolist(), strict=True))
        ends = np.cumsum([len(s) for s in strings])
        joined = np.empty(len(strings), np.uint64)
        for a in range(0, len(strings), _SOME):  # the strings' hashes, as the tasks know them
            part = strings[a : a + _SOME]
            begin = ends[a] - len(strings[a])
            stop = ends[a : a + _SOME] - begin
            whole = Hashes(np.frombuffer(b"".join(part), dtype=np.uint8)).of(stop - [len(s) for s in part], stop)
            joined[a : a + _SOME] = _join_key((np.uint64(bucket) << np.uint64(40)) | np.array(keys[a : a + _SOME], dtype=np.uint64), whole)
        replies: dict[int, list] = {}
        for (_, _, _, most, task), k in zip(entries, owner, strict=True):
            for a, z, least in ranges[k]:
                if least < most:
                    replies.setdefault(task, []).append((k, a, z, least))
        rows = []
        for task, found in replies.items():
            x = np.array(found, dtype=np.int64)
            rows.append((task, _pack(joined[x[:, 0]], x[:, 1].astype(np.uint32), x[:, 2].astype(np.uint32), x[:, 3])))
        trim()
        yield _batch(rows, ["_task", "_blob"])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([finish(np.zeros(0, np.int64), np.zeros(0, bool), [], units([]), np.zeros(0, bool))])
        got = [_unpack(x, np.uint64, np.uint32, np.uint32, np.int64) for x in _rows(right["_blob"])]
        made = []
        if got:
            key, a, z, least = (np.concatenate([g[c] for g in got]) for c in range(4))
            order = np.argsort(key, kind="stable")
            key, a, z, least = key[order], a[order].astype(np.int64), z[order].astype(np.int64), least[order]
        for _, doc, real, texts, u, r in _slices(left, units, width, seed, n):
            change = np.zeros(len(u.start) + 1, dtype=np.int64)
            if got and len(r.key):
                joined = _join_key(r.key, r.string)
                lo, hi = np.searchsorted(key, joined, "left"), np.searchsorted(key, joined, "right")
                hi = np.where(real[u.text[r.first]], hi, lo)
                run = np.repeat(np.arange(len(lo)), hi - lo)
                at = np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]
                use = least[at] < doc[u.text[r.first[run]]]
                run, at = run[use], at[use]
                np.add.at(change, r.first[run] + a[at], 1)
                np.add.at(change, np.minimum(r.first[run] + z[at] - 1, r.last[run]) + width, -1)
            made.append(finish(doc, real, texts, u, np.cumsum(change)[:-1] > 0))
        trim()
        return pa.Table.from_batches(made)

    blobs = "_bucket int, _from int, _blob binary"
    back = by_bucket(dealt.mapInArrow(tidied(deal), blobs), n, "_bucket").mapInArrow(tidied(common), "_task int, _bucket int, _blob binary")
    packed = dealt.groupBy("_task").cogroup(back.groupBy("_task")).applyInArrow(pack, blobs)
    decided = by_bucket(packed, n, "_bucket").mapInArrow(tidied(decide), "_task int, _blob binary")
    return dealt.groupBy("_task").cogroup(decided.groupBy("_task")).applyInArrow(mark, schema)


def spans_of(covered: np.ndarray, text: np.ndarray, n: int) -> list[list[dict]]:
    """Of each text its maximal covered runs of units: start and length."""
    counts = np.bincount(text, minlength=n) if n else np.zeros(0, int)
    base = np.cumsum(counts) - counts
    edge = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    before = np.append(False, covered[:-1]) if len(covered) else covered
    starts = np.flatnonzero(covered & (edge | ~before))
    after = np.append(covered[1:], False) if len(covered) else covered
    last = np.append(edge[1:], True) if len(edge) else edge
    stops = np.flatnonzero(covered & (last | ~after)) + 1
    out: list[list[dict]] = [[] for _ in range(n)]
    for a, z in zip(starts.tolist(), stops.tolist(), strict=True):
        k = int(text[a])
        out[k].append({"start": a - int(base[k]), "length": z - a})
    return out
