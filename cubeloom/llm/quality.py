"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of the whole text (lengths, shares of character classes, repetition of words and lines, byte entropy) are
binned at quantiles; each tree of fixed depth is grown level by level from per-bin sums of gradients. The trees are
kept as flat arrays (feature, threshold, leaf value) and all rows walk them together, one numpy step a level.

Nulls: a null text has the statistics of an empty one. Labels other than 0 and 1 are not used. Without labels of both
kinds every text gets the (smoothed) share of label 1. Repeated rows are scored each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import bytes_of, sampled_ids, tidied

_CLASS = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 0] = _b >= 128
    _CLASS[_b, 1] = "a" <= _c <= "z"
    _CLASS[_b, 2] = "A" <= _c <= "Z"
    _CLASS[_b, 3] = "0" <= _c <= "9"
    _CLASS[_b, 4] = _b in (9, 10, 11, 12, 13, 32)
    _CLASS[_b, 5] = _c in ".,;:"
    _CLASS[_b, 6] = _c in "!?"
    _CLASS[_b, 7] = _c in "#$%&*@~^"
    _CLASS[_b, 8] = _c in "|{}[]<>\\/=_+"
N_STATS = 9 + 11


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(N_STATS)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts / len(text)
    out[:9] = share @ _CLASS
    seen = share[share > 0]
    out[9] = -(seen * np.log2(seen)).sum()
    out[10] = np.log1p(len(text))
    words = text.split()
    if words:
        n = len(words)
        distinct = set(words)
        out[11] = np.log1p(n)
        out[12] = sum(map(len, words)) / n
        out[13] = len(distinct) / n
        out[14] = len(distinct) / np.sqrt(n)
        out[15] = sum(map(bytes.__eq__, words[1:], words)) / n
        half = n // 2
        out[16] = len(set(words[half:]) & set(words[:half])) / max(1, len(set(words[half:]))) if half else 0
    lines = [x for x in text.split(b"\n") if x]
    if lines:
        out[17] = 1 - len(set(lines)) / len(lines)
        out[18] = np.log1p(len(text) / len(lines))
        out[19] = max(map(len, lines)) / len(text)
    return out


@dataclass(frozen=True)
class Forest:
    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray  # a row goes right where its value is above
    leaf: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - len(feature)] if node.size else 0
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 5.0) -> Forest:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    empty = Forest(base, np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not len(y) or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    z = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)  # within its level
        for level in range(depth):
            n = 2**level
            best, pick = np.full(n, 1e-6), [None] * n
            for f, column in enumerate(binned):
                key = node * bins + column
                gs = np.bincount(key, weights=g, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[:, len(cuts[f]) :] = 0
                gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
                at = gain.argmax(axis=1)
                for k in range(n):
                    if gain[k, at[k]] > best[k]:
                        best[k], pick[k] = gain[k, at[k]], (f, at[k])
            for k, found in enumerate(pick):
                if found:
                    feature[n - 1 + k], threshold[n - 1 + k] = found[0], cuts[found[0]][found[1]]
            at = n - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > threshold[at])
        gs, hs = np.bincount(node, weights=g, minlength=2**depth), np.bincount(node, weights=h, minlength=2**depth)
        leaf = -rate * gs / (hs + ridge)
        z += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(leaves))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", where=None, max_rows: int = 12_000) -> Forest:
    """Fits on at most `max_rows` labelled documents, picked by a hash of their id among those that meet `where`. The
    statistics are made on the executors; only the bounded sample's numbers come to the driver."""
    ids = sampled_ids(labels, id_col, label_col, max_rows, where)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")

    def measure(batches):
        for batch in batches:
            stats = [statistics(t) for t in bytes_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array([s.tolist() for s in stats], pa.list_(pa.float64()))], ["_id", "_label", "_stats"])

    id_type = dict(rows.dtypes)["_id"]
    got = rows.mapInArrow(tidied(measure), f"_id {id_type}, _label int, _stats array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["_id"], r["_stats"]))
    x = np.array([r["_stats"] for r in got]).reshape(-1, N_STATS)
    return boost(x, np.array([r["_label"] for r in got], dtype=np.float64))


def score_quality(docs: DataFrame, model: Forest, *, text_col="text", score_col="score") -> DataFrame:
    """docs with a column score_col: 0 to 1, higher where label 1 is likelier. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(score_col).withColumn(score_col, F.lit(0.0)).schema
    keep = [c for c in docs.columns if c != score_col]

    def apply(batches):
        for batch in batches:
            texts = bytes_of(batch.column(batch.schema.get_field_index(text_col)))
            x = np.array([statistics(t) for t in texts]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(held.value.score(x), pa.float64())], [*keep, score_col])

    return docs.mapInArrow(tidied(apply), schema)
