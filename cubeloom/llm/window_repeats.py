"""Substring dedup on words: words under a window of `width` words that an earlier document (a smaller id) also has.

Super-k-mer partitioning: consecutive windows sharing a minimiser travel as one packed string to its bucket, where the
windows that may be equal are sorted and counted exactly (see superkmer). Words are parted by ASCII white space.

Null texts have no words. Texts of fewer words than `width` are kept whole. Rows with a null id are kept whole and
remove nothing. Rows of one id count as one document. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubeloom.llm.superkmer import Units, shared_windows, spans_of, word_units

SEED = 4  # words of a seed


def same_windows(width: int):
    """A class number for each window: equal where the words are; windows are sorted and runs of equal ones counted off."""

    def group(u: Units, at: np.ndarray, minimiser: np.ndarray) -> np.ndarray:
        raw = u.data.tobytes()
        windows = [raw[a:z] for a, z in zip(u.start[at].tolist(), u.end[at + width - 1].tolist(), strict=True)]
        out, number, last = np.empty(len(windows), np.int64), -1, None
        key = list(zip(minimiser[u.text[at]].tolist(), windows, strict=True))
        for k in sorted(range(len(key)), key=key.__getitem__):
            if key[k] != last:
                last, number = key[k], number + 1
            out[k] = number
        return out

    return group


def find_repeats(docs: DataFrame, *, width: int = 13, id_col="doc_id", text_col="text") -> DataFrame:
    """(id_col, kept string, n_words long, spans array<struct<start, length>>): one row per row of docs; spans count
    words, kept are the words outside of them, joined by one blank."""
    seed = min(SEED, width)

    def finish(ids, real, texts, u, covered):
        spans = spans_of(covered, u.text, len(texts))
        raw = u.data.tobytes()
        counts = np.bincount(u.text, minlength=len(texts)) if texts else np.zeros(0, int)
        base = np.cumsum(counts) - counts
        kept = []
        for k, gone in enumerate(spans):
            at, stop, parts = int(base[k]), int(base[k] + counts[k]), []
            for s in [*gone, {"start": stop - int(base[k]), "length": 0}]:
                to = int(base[k]) + s["start"]
                if to > at:
                    parts.append(raw[u.start[at] : u.end[to - 1]])
                at = to + s["length"]
            kept.append(b" ".join(parts))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~real), pa.array(kept, pa.large_binary()).cast(pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(spans, kind)],
            [id_col, "kept", "n_words", "spans"],
        )

    schema = f"`{id_col}` long, kept string, n_words long, spans array<struct<start:long,length:long>>"
    return shared_windows(docs, units=word_units, width=width, seed=seed, group_windows=same_windows(width), finish=finish, schema=schema, id_col=id_col, text_col=text_col)
