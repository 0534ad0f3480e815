"""Classifiers, secrets: held-out accuracy and defined results for odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import entry, language, quality, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = query(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 20
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_toxicity_held_out(spark):
    assert accuracy(spark, entry.op10_toxicity, "toxic") >= 0.95


def test_quality_held_out(spark):
    assert accuracy(spark, entry.op8_quality, "quality") >= 0.9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = entry.op2_language(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


ODD = [(1, None, "x"), (2, "", None), (3, "12 34", "a"), (4, "word " * 60_000, None), (None, "Ünïcode", "b"), (4, "word", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    tox = toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none)).collect()
    good = quality.score_quality(odd, quality.fit_quality(odd, none)).collect()
    assert [r["score"] for r in tox] == [0.5] * len(ODD) == [r["score"] for r in good]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 0), (None, 1, 1), (9, 0, 0), (3, 7, None)], "doc_id long, toxic int, quality int")
    for got in (toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)), quality.score_quality(odd, quality.fit_quality(odd, labels))):
        assert all(0 <= r["score"] <= 1 for r in got.collect())
    empty = odd.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none)).count() == 0


def test_language_odd_rows(spark, odd):
    unlearned = language.identify_language(odd, {}).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    contents = {"aa": b"word word word wordy words", "bb": b"xyz zyx xxyyzz xyxyz"}
    got = [(r["lang_pred"], r["score"] > 0) for r in language.identify_language(odd, contents).collect()]
    assert got[:3] == [("und", False)] * 3
    assert got[3] == ("aa", True)
    assert language.fit_languages(odd.limit(0).withColumn("lang", F.lit("x"))) == {}


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.fit_forest(secret_scan.labelled_findings(spark))


def test_forest_on_findings_not_seen(spark, forest):
    rows = secret_scan.labelled_findings(spark, 9000).where("value is not null").subtract(secret_scan.labelled_findings(spark, 6000))
    made = rows.select("label", *(c.alias(n) for n, c in secret_scan.features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()))
    got = made.select("label", (secret_scan.vote(forest, lambda n: F.col(n)) >= 0.5).cast("int").alias("p")).collect()
    assert sum(r["label"] == r["p"] for r in got) / len(got) > 0.95


def test_secrets_in_the_table(spark):
    """Against the forms that secrets have in this table."""
    found = {(r["doc_id"], r["start"], r["length"]) for r in entry.op6_secrets(spark, SF).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for m in re.finditer(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}', r["text"]):
            want.add((r["doc_id"], m.start(), m.end() - m.start()))
    assert want
    assert len(found & want) >= 0.97 * len(want)
    assert len(found - want) <= 0.03 * len(want)


def test_scan_odd_rows_and_redact(spark, forest):
    key, other = "AKIA" + "QW3ERTY5UIOPASDF", "0641917ea4e9feb9cda83477b57ac2654884f485"
    texts = [None, "", "no secrets here", f"é {key} and token = \"{other}\" end", f"commit {other}", "x1" * 3000, f"password={key}"]
    docs = spark.createDataFrame([(i, t, "src", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, _parts int")
    scanned = secret_scan.scan(docs, forest, path_col="source")
    got = {r["doc_id"]: [(s["start"], s["value"]) for s in r["secrets"]] for r in scanned.collect()}
    assert got[0] == got[1] == got[2] == [] and got[4] == []
    assert got[3] == [(2, key), (2 + 20 + 14, other)]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(scanned).collect()}
    assert clean[3] == 'é [SECRET] and token = "[SECRET]" end'
    assert clean[0] is None and clean[2] == texts[2] and clean[6] == "password=[SECRET]"
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
