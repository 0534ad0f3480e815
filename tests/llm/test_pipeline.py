"""The pipeline's stages, each on what the one before kept, against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import decontaminate, toxicity
from cubeloom.llm._common import materialize
from tests.llm.test_dedup import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (900_001, "a b c", "en", "s", 5), (900_002, "A b  C", "en", "s", 5), (900_002, "A b  C", "en", "s", 5)], docs.schema)
    kept = [materialize(docs.unionByName(odd), "start")]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    return kept


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_toxicity(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = dict(spark.range(1_000_000, numPartitions=1).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("h")).where(F.col("id").isin([k for k in labels])).collect())
    train = sorted((r["doc_id"], (r["text"] or "").encode()) for r in before if r["doc_id"] in labels and not held[r["doc_id"]])
    model = toxicity.train([t for _, t in train], [labels[d] for d, _ in train])
    scores = toxicity.score_texts(model, [(r["text"] or "").encode() for r in before])
    want = sorted((repr(r) for r, s in zip(before, scores, strict=True) if s < 0.5))
    assert sorted(map(repr, after)) == want
    assert len(after) < len(before)


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before if r["doc_id"] is not None}
    first = brute_components(prints)
    want = sorted({repr(r) for r in before if r["doc_id"] is not None and first[r["doc_id"]] == r["doc_id"]} | set()) + [repr(r) for r in before if r["doc_id"] is None]
    assert sorted(map(repr, after)) == sorted(want)
    assert 900_001 in {r["doc_id"] for r in after} and 900_002 not in {r["doc_id"] for r in after}


def test_decontamination(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    items = [decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        words = b" " + b" ".join(decontaminate.words_of((text or "").encode())) + b" "
        return any(b" " + b" ".join(i) + b" " in words for i in items)

    gone = {repr(r) for r in before} - {repr(r) for r in after}
    assert {repr(r) for r in before if holds(r["text"])} <= gone
    grams = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    clean = [r for r in before if not grams & {tuple(w[k : k + 5]) for w in [decontaminate.words_of((r["text"] or "").encode())] for k in range(len(w) - 4)}]
    assert {repr(r) for r in clean} <= {repr(r) for r in after}


def test_secrets(steps):
    before, after = {r["doc_id"]: r for r in rows(steps[3]) if r["doc_id"] is not None}, {r["doc_id"]: r for r in rows(steps[4]) if r["doc_id"] is not None}
    assert steps[3].count() == steps[4].count()
    pattern = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    for doc, r in before.items():
        assert after[doc]["text"] == (r["text"] and pattern.sub("[SECRET]", r["text"]))


def test_packing(steps):
    texts = {r["doc_id"]: r["text"] for r in rows(steps[4]) if r["doc_id"] is not None}
    pieces = [r for r in steps[5].collect() if r["doc_id"] is not None]
    by_doc = {d: sum(r["length"] for r in pieces if r["doc_id"] == d) for d in texts}
    assert set(by_doc) == {r["doc_id"] for r in pieces}
    spaces = {}
    for r in steps[5].collect():
        spaces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in spaces.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
