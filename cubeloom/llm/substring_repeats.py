"""Suffix-array dedup: bytes under a string of `width` bytes that an earlier document (a smaller id) also has.

Texts are cut into strings so that equal windows of `width` bytes come to one minimiser (see superkmer); a string that
many documents hold is there once. A suffix array of a minimiser's strings is built by linear grouping, and neighbours in
it that agree on `width` bytes are the equal windows. A string with no other of its minimiser needs no sorting. Strings of
a minimiser are cut once more by longer seeds first, which leaves about half their bytes to sort.

Null texts are empty. Texts shorter than `width` are kept whole. Rows with a null id are kept whole and remove nothing.
Rows of one id count as one document and remove nothing from each other; of two documents with one text the one with
the larger id loses every byte (from `width` bytes on). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubeloom.llm.suffix_array import suffix_arrays
from cubeloom.llm.superkmer import Units, byte_units, shared_windows, spans_of

SEED = 20  # bytes of a seed
FINER = 42  # of those that cut a minimiser's strings once more before they are sorted


def same_windows(u: Units, at: np.ndarray, minimiser: np.ndarray, width: int) -> np.ndarray:
    """A class number for each window (its first byte): equal where the windows' bytes are. The strings of a minimiser are
    one text with a suffix array; windows that stand next to each other in it are compared, and nothing else tells which
    are equal."""
    joined = np.zeros(len(u.data) + len(minimiser), np.int16)  # 0 ends each string
    place = np.arange(len(u.data)) + u.text
    joined[place] = u.data
    joined[place] += 1
    lengths = np.bincount(minimiser, weights=np.bincount(u.text, minlength=len(minimiser)) + 1).astype(np.int64)
    suffixes = suffix_arrays(joined, lengths)
    window = np.zeros(len(joined), bool)
    window[place[at]] = True
    ranked = suffixes[window[suffixes]]  # window starts in suffix order, minimiser by minimiser
    rows = np.lib.stride_tricks.sliding_window_view(joined, width)
    new = np.ones(len(ranked), bool)
    for k in range(1, len(ranked), 20_000):
        part = ranked[k - 1 : k + 20_000]
        new[k : k + len(part) - 1] = (rows[part[1:]] != rows[part[:-1]]).any(axis=1)
    number = np.empty(len(joined), np.int64)
    number[ranked] = np.cumsum(new) - 1
    return number[place[at]]


def find_repeats(docs: DataFrame, *, width: int = 50, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, kept binary, n_bytes long, spans array<struct<start, length>>): one row per row of docs; kept are the
    bytes outside the spans, joined."""
    seed = min(SEED, width)

    def group_windows(u: Units, at: np.ndarray, minimiser: np.ndarray) -> np.ndarray:
        return same_windows(u, at, minimiser, width)

    def finish(ids, real, texts, u, covered):
        spans = spans_of(covered, u.text, len(texts))
        kept = []
        for text, gone in zip(texts, spans, strict=True):
            at, parts = 0, []
            for s in gone:
                parts.append(text[at : s["start"]])
                at = s["start"] + s["length"]
            kept.append(b"".join([*parts, text[at:]]) if gone else text)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~real), pa.array(kept, pa.large_binary()).cast(pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind)],
            [id_col, "kept", "n_bytes", "spans"],
        )

    schema = f"`{id_col}` long, kept binary, n_bytes long, spans array<struct<start:long,length:long>>"
    return shared_windows(docs, units=byte_units, width=width, seed=seed, group_windows=group_windows, finish=finish, schema=schema, id_col=id_col, text_col=text_col, finer=min(FINER, width))
