"""Columns whose names clash with helpers, missing columns, ids with several texts, labels that disagree, huge values."""

import corpus_pipeline
from cubeloom.llm import decontaminate, secret_scan, topk, toxicity
from cubeloom.llm._common import sampled_ids

KEY = "AKIA" + "QW3ERTY5UIOPASDF"
ITEM = " ".join(f"w{i}" for i in range(20))


def test_contamination_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 7, "c"), (2, "clean", 8, "d")], "doc_id long, text string, _tiles0 int, contamination string")
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: (r["_tiles0"], r["contamination"], len(r["hits"])) for r in decontaminate.contamination(docs, bench, out_col="hits").collect()}
    assert got == {1: (7, "c", 1), 2: (8, "d", 0)}


def test_scan_keeps_other_columns(spark):
    forest = secret_scan.fit_forest(secret_scan.labelled_findings(spark))
    docs = spark.createDataFrame([(1, f"x {KEY} y", 1, 2, 3)], "doc_id long, text string, _candidates int, _PARTS int, _rows int")
    scanned = secret_scan.scan(docs, forest)
    assert scanned.columns == [*docs.columns, "secrets"]
    assert tuple(secret_scan.redact(scanned).first()) == (1, "x [SECRET] y", 1, 2, 3)


def test_stages_keep_clashing_columns(spark, sf):
    rows = [(1, f"note {KEY} end", 0.1, "a", "b", 5), (2, None, 0.2, "c", "d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxic double, _secrets string, _hits string, _text_hash int")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        assert sorted(map(tuple, stage(spark, docs, sf).collect())) == rows
    masked = corpus_pipeline.mask_secrets(spark, docs, sf)  # no column source
    assert sorted(map(tuple, masked.collect())) == [(1, "note [SECRET] end", 0.1, "a", "b", 5), rows[1]]


def test_texts_under_one_id_stay_apart(spark, sf):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, one, "x"), (7, two, "x"), (7, two, "x"), (8, one, "y"), (None, one, "z")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, one, "x"), (7, two, "x"), (None, one, "z")], key=str)


def test_labels_that_disagree_are_not_used(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (None, 1), (4, 5)], "doc_id long, toxic int")
    assert sorted(map(tuple, sampled_ids(labels, "doc_id", "toxic", 10).collect())) == [(2, 1), (3, 0)]
    assert sampled_ids(labels, "doc_id", "toxic", 1).count() == 1


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " + "bad " * (k % 2), 0) for k in range(40)] * 3, "doc_id long, text string, _label int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    few, all_of_it = (toxicity.fit_toxicity(docs, labels, max_bytes=n) for n in (1, 1 << 20))
    assert not few.weights.any()  # one text
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.dropDuplicates(), all_of_it).collect()}
    assert all((s >= 0.5) == bool(k % 2) for k, s in scores.items())


def test_a_long_text_scores_as_it_counts(monkeypatch):
    texts = [b"some words " * 300, b"other bad things " * 200, b"", b"x"]
    model = toxicity.train([b"good words here", b"bad things", b"good day", b"bad bad"] * 20, [0, 1, 0, 1] * 20)
    whole = toxicity.score_texts(model, texts)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert [float(toxicity.score_texts(model, [t])[0]) for t in texts] == whole.tolist()


def test_huge_components(spark):
    rows = [(50, [1e8, 1.0]), (1, [1e8, 2.0]), (2, [1e300, 1.0]), (3, [-1e300, 1.0]), (4, [1e308, -1e308]), (5, [3e16, 3.0]), (6, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, frame.where("vec_id = 50"), k=6).orderBy("rank").collect()]
    most = (1 << 63) - 1
    assert got == [(1, 1, most), (2, 2, most), (3, 4, most), (4, 5, most), (5, 6, 256 * 25_600_000_000 + 256 * 256), (6, 3, -most - 1)]
