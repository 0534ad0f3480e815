"""The pipeline's near-duplicate stage against all pairs: none with a 5-word Jaccard similarity of 0.8 or more stays."""

import random

import pytest

import corpus_pipeline
from cubeloom.llm import shingle_join
from tests.llm.test_dedup import brute_fingerprint


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc -> least doc linked by 3 bits of SimHash or by shingles."""
    docs = {d: (brute_fingerprint(t), shingle_set(t)) for d, t in rows if d is not None}
    ids, root = sorted(docs), {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (p, s), (q, t) = docs[a], docs[b]
            if (p ^ q).bit_count() <= 3 or (s or t) and 5 * len(s & t) >= 4 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def made_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(20))
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e"), (5, "a b c d e a b c d e a b c d e")]
    for k in range(30):
        text = [word() for _ in range(rng.choice((6, 30, 80, 200)))] + line.split() * (k % 2)
        for _ in range(rng.randint(1, 6)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((10 + len(rows), " ".join(copy)))
    return rows


def crowd_rows():
    """Copies of one text with so many changes that few are similar, in chains; all share shingles of many holders."""
    rng = random.Random(4)
    stem = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(stem))]
    for k in range(1, 150):
        text = rows[rng.randrange(len(rows))][1].split() if rng.random() < 0.5 else list(stem)
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("which", ["table", "made", "crowd"])
def test_near_copies_are_complete(spark, sf, which, monkeypatch):
    if which == "crowd":
        monkeypatch.setattr(shingle_join, "FEW", 2)
        monkeypatch.setattr(shingle_join, "BLOCK", 13)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] if which == "table" else made_rows() if which == "made" else crowd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.near_copies(docs).collect()} == want
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert got == sorted(d for d in want if want[d] == d)


def test_near_copies_of_an_empty_table(spark):
    assert shingle_join.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_of_crowds_leave_once(spark, monkeypatch):
    """Sets that share 40 crowded shingles meet at each of them, but leave the blocks once a pair; c counts them all."""
    rows = [(t, key, 200, t, 20, key) for t in range(40) for key in range(20) if (t, key) != (0, 0)]
    held = spark.createDataFrame(rows, "token long, key long, size int, pos int, n long, c long")
    sets = spark.createDataFrame([(key, *[0] * 8) for key in range(20)], "key long, " + ", ".join(f"{b} long" for b in shingle_join._BITS))
    left = []
    distinct = type(held).distinct
    monkeypatch.setattr(type(held), "distinct", lambda df: left.append(df) or distinct(df))
    got = {(r["k1"], r["k2"]): r["c"] for r in shingle_join._crowds(held, sets).collect()}
    assert got == {(a, b): 40 - (a == 0) for a in range(20) for b in range(a + 1, 20)}
    assert left[0].count() == len(got)
