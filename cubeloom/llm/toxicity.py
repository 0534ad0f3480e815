"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z) UTF-8; their n-grams of 4, 6 and 8 bytes, with padding at both ends, are hashed to a fixed
number of features that are present or absent. Training counts each feature's presence in toxic and other texts, takes
the log ratio of the smoothed, normalised counts, and fits a logistic regression on presence times ratio. Scoring sums
the weights of a text's distinct features. How rare a feature's split may be by chance (chi square) and how strongly
weights are held down are chosen by cross-validation inside the training rows.

The sample to learn from has at most `max_rows` texts and `max_bytes` bytes. Features are made on the executors; counts
meet in one task there, the few features in use in another. Only chosen features and weights come to the driver.

Nulls: a null text scores as an empty one. Labels other than 0 and 1 and labels of null ids are not used, nor are those
of ids that are labelled both. Of rows with one id the least text is learned from. Without labels of both kinds every
text gets the (smoothed) share of toxic labels. Repeated rows are scored each on its own. Texts of any length are read
whole: one after another in pieces of bounded size, a feature of a text once. Of docs' columns only score_col is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import bounded_texts, bytes_of, slices, small, tidied, trim

ORDERS = (4, 6, 8)
BITS = 20
FOLDS = 4
CHANCE, RIDGE = (12.0, 40.0), (1e-4, 1e-3, 1e-2)  # tried in cross-validation: least chi square, penalty
PAD = b"\x00" * (max(ORDERS) - 1)
PIECE = 1 << 20  # bytes of a long text at a time
RANGE = 1 << 16  # features whose counts travel together


@dataclass(frozen=True)
class LinearModel:
    weights: np.ndarray  # of each hashed feature; 0: not used
    bias: float


def _keys(joined: np.ndarray, ends: np.ndarray, used: np.ndarray | None):
    keys = []
    with np.errstate(over="ignore"):
        code = np.full(len(joined), 0x811C9DC5, dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            code = code[: max(0, len(joined) - n + 1)] * np.uint32(0x01000193) + joined[n - 1 :]
            if n not in ORDERS:
                continue
            feature = code ^ (code >> np.uint32(15))
            feature = (feature * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            at = np.arange(len(feature)) if used is None else np.flatnonzero(used[feature])
            text = np.searchsorted(ends, at + n - 1 - len(PAD), side="right").clip(0, len(ends) - 1)
            keys.append((text.astype(np.int64) << BITS) | feature[at])
    return np.unique(np.concatenate(keys))


def _features(texts: list[bytes], used: np.ndarray | None = None):
    """(text, feature) of each distinct feature of each text, those marked in `used` only."""
    joined = np.frombuffer(PAD + b"".join(t.lower() + PAD for t in texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + len(PAD) for t in texts])
    if len(texts) == 1 and len(joined) > PIECE:
        over = max(ORDERS) - 1
        parts = [_keys(joined[a : a + PIECE + over].astype(np.uint32), np.array([len(joined)]), used) for a in range(0, len(joined) - over, PIECE)]
        keys = np.unique(np.concatenate(parts))
    else:
        keys = _keys(joined.astype(np.uint32), ends, used)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _counted(texts: list[bytes], labels: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Texts that have each feature, by fold and label; added to counts where there are some."""
    counts = np.zeros((2 * FOLDS, 1 << BITS), dtype=np.int32) if counts is None else counts
    group = np.array([2 * (zlib.crc32(t) % FOLDS) for t in texts], dtype=np.int64) + labels
    for a, b in slices(texts, 1 << 17):
        doc, feature = _features(texts[a:b])
        at, n = np.unique((group[a:b][doc] << BITS) | feature, return_counts=True)
        counts.reshape(-1)[at] += n.astype(np.int32)
    return counts


def _choice(counts: np.ndarray, totals: np.ndarray, n: np.ndarray, chance: float, most: int):
    """The features in use and their ratios. By label: counts of the features, their totals, texts."""
    share = (counts + 1.0) / (totals[:, None] + (1 << BITS))
    seen, total = counts.sum(axis=0), n.sum()
    expected = seen * (n[1] / total)
    chi = (counts[1] - expected) ** 2 / np.maximum(expected * (1 - seen / total) * n[0] / total, 1e-9)
    chi[(seen < 2) | (seen >= total)] = 0
    used = np.argsort(-chi, kind="stable")[:most]
    used = np.sort(used[chi[used] > chance])
    return used, np.log(share[1, used] / share[0, used])


def _solve(start: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray, ridge: float, steps: int = 60):
    """Weights and bias of the regularised logistic regression; text i has the features column[start[i]:start[i + 1]].
    L-BFGS with halved steps."""
    length = np.diff(start)
    some = np.flatnonzero(length > 0)  # reduceat can't sum nothing

    def value(x):
        z = np.full(len(y), x[-1])
        if len(some):
            z[some] += np.add.reduceat((x[:-1] * ratio)[column], start[some])
        p = _sigmoid(z)
        loss = float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * ridge * (x[:-1] @ x[:-1]))
        g = (p - y) / len(y)
        return loss, np.append(np.bincount(column, weights=np.repeat(g, length), minlength=len(ratio)) * ratio + ridge * x[:-1], g.sum())

    x = np.append(np.zeros(len(ratio)), np.log(y.sum() / (len(y) - y.sum())))
    loss, grad = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = grad.copy(), []
        for s, t in reversed(past):
            a.append((s @ d) / (s @ t))
            d -= a[-1] * t
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, t), k in zip(past, reversed(a), strict=True):
            d += s * (k - (t @ d) / (s @ t))
        size = 1.0 if past else min(1.0, 1.0 / max(np.abs(grad).max(), 1e-12))
        for _ in range(20):
            new, new_grad = value(x - size * d)
            if new <= loss - 1e-4 * size * (grad @ d):
                break
            size /= 2
        else:
            break
        s, t = -size * d, new_grad - grad
        done = loss - new < 1e-7 * max(1.0, abs(loss))
        x, loss, grad = x + s, new, new_grad
        if s @ t > 1e-12:
            past = [*past[-6:], (s, t)]
        if done:
            break
    return x[:-1], float(x[-1])


Chosen = dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]  # by fold left out (-1: none) and least chi square: features in use, ratios


def _chosen(names: np.ndarray, counts: np.ndarray, totals: np.ndarray, n: np.ndarray, most_features: int) -> Chosen:
    """What is tried in cross-validation. names: features of two texts or more, in order; counts: see _counted, of these;
    totals: sums over all features; n: texts by fold and label. Empty: there is nothing to learn."""
    if not n.sum(axis=0).all():
        return {}
    by_label, totals = counts.reshape(FOLDS, 2, -1), totals.reshape(FOLDS, 2)
    whole, total = by_label.sum(axis=0), totals.sum(axis=0)
    found = {(-1, c): _choice(whole, total, n.sum(axis=0), c, most_features) for c in CHANCE}
    found = {key: x for key, x in found.items() if len(x[0])}
    for f in range(FOLDS) if found else ():
        if (n.sum(axis=0) - n[f]).min() and n[f].sum():
            for _, c in [key for key in found if key[0] < 0]:
                found[f, c] = _choice(whole - by_label[f], total - totals[f], n.sum(axis=0) - n[f], c, most_features)
    return {key: (names[used], ratio) for key, (used, ratio) in found.items()}


def _union(chosen: Chosen) -> np.ndarray:
    return np.unique(np.concatenate([used for used, _ in chosen.values()]))


def _weighed(chosen: Chosen, start: np.ndarray, column: np.ndarray, folds: np.ndarray, y: np.ndarray):
    """Features in use, their weights, and the bias. Text i has the features column[start[i]:start[i + 1]] as places in
    _union(chosen)."""
    union = _union(chosen)
    choices = {c: x for (f, c), x in chosen.items() if f < 0}
    tried = {key: x for key, x in chosen.items() if key[0] >= 0}
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(start))

    def part(rows, used):
        """The rows' features in use, with new places."""
        place = np.full(len(union), -1, dtype=np.int32)
        place[np.searchsorted(union, used)] = np.arange(len(used))
        at = place[column]
        keep = (at >= 0) & rows[doc]
        count = np.bincount(doc[keep], minlength=len(y))[rows]
        return np.append(0, np.cumsum(count)), at[keep]

    loss = {(c, r): 0.0 for c in choices for r in RIDGE}
    for (f, c), (used, ratio) in tried.items():
        learn, test = part(folds != f, used), part(folds == f, used)
        for r in RIDGE:
            w, b = _solve(*learn, ratio, y[folds != f], r)
            z = np.bincount(np.repeat(np.arange(len(test[0]) - 1), np.diff(test[0])), weights=(w * ratio)[test[1]], minlength=len(test[0]) - 1) + b
            loss[c, r] += float(np.sum(np.logaddexp(0, z) - y[folds == f] * z))
    chance, ridge = min(loss, key=lambda k: (loss[k], -k[1], -k[0]))
    used, ratio = choices[chance]
    w, b = _solve(*part(np.ones(len(y), bool), used), ratio, y, ridge)
    return used, w * ratio, b


def _model(n: np.ndarray, found=None) -> LinearModel:
    """found: see _weighed; without it the (smoothed) share of toxic labels. n: texts by fold and label."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if found is None:
        rate = (n[:, 1].sum() + 1) / (n.sum() + 2)
        return LinearModel(weights, float(np.log(rate / (1 - rate))))
    weights[found[0]] = found[1]
    return LinearModel(weights, found[2])


def _by_fold(folds: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bincount(2 * folds + y, minlength=2 * FOLDS).reshape(FOLDS, 2)


def _sparse(texts: list[bytes], union: np.ndarray):
    """Of each text the places in union of the features it has."""
    mark = np.zeros(1 << BITS, dtype=bool)
    mark[union] = True
    out = []
    for a, b in slices(texts):
        doc, feature = _features(texts[a:b], mark)
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        at = np.searchsorted(union, feature).astype(np.int32)
        out += [at[x:z] for x, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _joined(parts: list[np.ndarray]):
    return np.cumsum([0, *map(len, parts)]), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def train(texts: list[bytes], labels: list[int], most_features: int = 20_000) -> LinearModel:
    """The whole fit in one place."""
    y = np.asarray(labels, dtype=np.int64)
    folds = np.array([zlib.crc32(t) % FOLDS for t in texts], dtype=np.int64)
    counts = _counted(texts, y)
    names, n = np.flatnonzero(counts.sum(axis=0) > 1), _by_fold(folds, y)
    chosen = _chosen(names, counts[:, names], counts.sum(axis=1), n, most_features)
    return _model(n, _weighed(chosen, *_joined(_sparse(texts, _union(chosen))), folds, y) if chosen else None)


def score_texts(model: LinearModel, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    used = model.weights != 0
    for a, b in slices(texts):
        doc, feature = _features(texts[a:b], used)
        out[a:b] = _sigmoid(np.bincount(doc, weights=model.weights[feature], minlength=b - a) + model.bias)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", where=None, max_rows: int = 6000, max_bytes: int = 32 << 20, most_features: int = 20_000) -> LinearModel:
    """Fits on at most `max_rows` labelled documents and `max_bytes` of text (whole texts, one at least), picked by a hash
    of their id among those that meet `where`."""
    sample = bounded_texts(docs, labels, id_col, text_col, label_col, where, max_rows, max_bytes)

    def count(batches):
        total = None
        for batch in small(batches):
            total = _counted(bytes_of(batch.column("_text")), np.array(batch.column("_label").to_pylist(), dtype=np.int64), total)
        if total is not None:
            for at in range(0, 1 << BITS, RANGE):
                blob = zstandard.ZstdCompressor(level=1).compress(total[:, at : at + RANGE].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([blob], pa.binary())], ["at", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in small(batches, 1):
            at, blob = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32).reshape(2 * FOLDS, -1)
            total[at] = total[at] + part if at in total else part
        for at, part in total.items():  # feature -1: the totals
            seen = np.flatnonzero(part.sum(axis=0) > 1)
            rows = np.stack([np.append(-1, at + seen), *(np.append(t.sum(dtype=np.int64), t[seen]) for t in part)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(rows.tobytes())], pa.binary())], ["part"])

    # ranges of counts travel as one value each: an aggregation by feature would hold all of them again, in every task
    made = sample.mapInArrow(tidied(count), "at int, counts binary").repartition((1 << BITS) // RANGE, "at")
    summed = made.mapInArrow(tidied(add), "part binary")
    head = sample.select("_label", (F.crc32("_text") % FOLDS).cast("int").alias("_fold")).groupBy("_label", "_fold").count().collect()
    n = np.zeros((FOLDS, 2), np.int64)
    for label, fold, texts in head:
        n[fold, label] = texts

    def choose(batches):  # in one task, as the counts are too many for the driver
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32).reshape(1 + 2 * FOLDS, -1) for b in batches for x in b.column(0).to_pylist()]
        if parts:
            parts.sort(key=lambda p: p[0, -1])  # ranges don't overlap; one without features has totals alone
            totals = sum(p[1:, 0].astype(np.int64) for p in parts)
            both = np.concatenate([p[:, 1:] for p in parts], axis=1)
            del parts
            found = _chosen(both[0], both[1:], totals, n, most_features)
            for (fold, chance), (used, ratio) in found.items():
                row = ([fold], pa.int32()), ([chance], pa.float64()), ([used.astype(np.int32).tobytes()], pa.binary()), ([ratio.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(*x) for x in row], ["fold", "chance", "used", "ratio"])

    rows = summed.repartition(1).mapInArrow(tidied(choose), "fold int, chance double, used binary, ratio binary").collect()
    rows = sorted(rows, key=lambda r: (r["fold"], r["chance"]))
    chosen = {(r["fold"], r["chance"]): (np.frombuffer(r["used"], np.int32), np.frombuffer(r["ratio"])) for r in rows}
    if not chosen:
        return _model(n)
    union = _union(chosen)

    def sparse(batches):
        for batch in small(batches):
            texts = bytes_of(batch.column("_text"))
            made, folds = _sparse(texts, union), [zlib.crc32(t) % FOLDS for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(folds, pa.int32()), pa.array([m.tobytes() for m in made], pa.binary())], ["_id", "_label", "_fold", "_at"])

    def weigh(batches):
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held).sort_by("_id") if held else None
        del held
        if table is not None:
            folds, y = (table[c].to_numpy().astype(np.int64) for c in ("_fold", "_label"))
            used, weight, bias = _weighed(chosen, *_joined([np.frombuffer(x.as_buffer(), np.int32) for x in table["_at"]]), folds, y)
            row = [used.astype(np.int32).tobytes()], [weight.tobytes()], [bias]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["used", "weight", "bias"])

    kind = sample.schema["_id"].dataType.simpleString()
    gathered = sample.mapInArrow(tidied(sparse), f"_id {kind}, _label int, _fold int, _at binary").repartition(1)
    used, weight, bias = gathered.mapInArrow(tidied(weigh), "used binary, weight binary, bias double").first()
    model = _model(n, (np.frombuffer(used, np.int32), np.frombuffer(weight), bias))
    trim()
    return model


def score_toxicity(docs: DataFrame, model: LinearModel, *, text_col="text", score_col="score") -> DataFrame:
    """docs with a column score_col: 0 to 1, higher where toxic is likelier. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(score_col).withColumn(score_col, F.lit(0.0)).schema
    keep = [c for c in docs.columns if c != score_col]

    def apply(batches):
        for batch in small(batches):
            texts = bytes_of(batch.column(batch.schema.get_field_index(text_col)))
            score = pa.array(score_texts(held.value, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), score], [*keep, score_col])

    return docs.mapInArrow(tidied(apply), schema)
