"""SimHash, byte and word repeats against brute force; suffix sorting against sorting."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import entry, simhash, substring_repeats, superkmer, window_repeats
from cubeloom.llm.components import components
from cubeloom.llm.suffix_array import _together, suffix_array, suffix_arrays


def rows_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), max_size=20))
def test_suffix_arrays(texts):
    symbols, lengths = np.array([x for t in texts for x in t], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
    want, at = [], 0
    for t in texts:
        want += [at + k for k in suffix_array(t)]
        at += len(t)
    assert suffix_arrays(symbols, lengths).tolist() == want
    if texts:
        assert _together(symbols, lengths).tolist() == want


def brute_bytes(rows, width=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if doc is not None and first.get(w, doc) >= doc:
                first[w] = doc
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if doc is not None and first[data[i : i + width]] < doc:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, width=13):
    first = {}
    parts = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in parts:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if doc is not None and first.get(w, doc) >= doc:
                first[w] = doc
    out = []
    for doc, words in parts:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if doc is not None and first[tuple(words[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (5, 13, 14, 20, 60, 200)]
    rows = [(None, passages[4]), (1, None), (2, ""), (3, "x"), (4, "a" * 300), (5, "b" + "a" * 120), (6, "ab" * 200), (7, "ba" * 100), (8, " \n\t"), (8, passages[5]), (8, passages[5]), (9, passages[5]), (None, passages[5])]
    for k in range(60):
        text = " ".join(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else word() for _ in range(rng.randint(1, 12)))
        rows.append((100 - k, text.replace(" ", "\n ", rng.randint(0, 1))))
    rows += [(200 + k, passages[5]) for k in range(40)]
    return rows


@pytest.mark.parametrize("which", ["table", "odd"])
def test_byte_repeats(spark, sf, which):
    rows = rows_of(spark, sf) if which == "table" else odd_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _task string, kept int").repartition(5)
    from pyspark.sql import functions as F

    got = substring_repeats.find_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n"), F.size("spans"), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("which", ["table", "odd"])
def test_word_repeats(spark, sf, which):
    rows = rows_of(spark, sf) if which == "table" else odd_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _task string, kept int").repartition(5)
    from pyspark.sql import functions as F

    got = window_repeats.find_repeats(docs).select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_words(rows)


@pytest.mark.parametrize("module", [substring_repeats, window_repeats])
def test_many_small_shares(spark, monkeypatch, module):
    """Texts dealt to more tasks than there are partitions."""
    monkeypatch.setattr(superkmer, "SHARE", 2_000)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = module.find_repeats(docs).collect()
    want = {(r[0], r[1]): r[-1] for r in (brute_bytes if module is substring_repeats else brute_words)(rows)}
    assert len(got) == len(rows) and {hashlib.sha256(bytes(r["kept"] if module is substring_repeats else r["kept"].encode())).hexdigest() for r in got} == set(want.values())


@pytest.mark.parametrize("block", [1, 300, 5_000, 1_000_000])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_least_documents(block, kind):
    """A minimiser with many strings is cut again, to the last window where it must be."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("ab") for _ in range(2))
    stem = [word() for _ in range(60)]
    units, width, seed = (superkmer.byte_units, 30, 8) if kind == "bytes" else (superkmer.word_units, 6, 2)
    group = (lambda u, at, minimiser: substring_repeats.same_windows(u, at, minimiser, width)) if kind == "bytes" else window_repeats.same_windows(width)
    made = {}
    for _ in range(80):
        text = list(stem)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = word()
        made.setdefault((rng.choice([3, 5]), " ".join(text[rng.randint(0, 20) : 40 + rng.randint(0, 20)]).encode()), rng.randint(1, 500))
    made[9, b"aa bb " * 10] = 4
    names = sorted(made)
    least = {}
    cut = lambda s: [s[i : i + width] for i in range(len(s) - width + 1)] if kind == "bytes" else [tuple(s.split()[i : i + width]) for i in range(len(s.split()) - width + 1)]
    for key, s in names:
        for w in cut(s):
            least[key, w] = min(made[key, s], least.get((key, w), 999))
    got = dict(superkmer.least_documents([n[0] for n in names], [n[1] for n in names], [made[n] for n in names], units, width, seed, group, block, block))
    assert got.pop(names.index((9, b"aa bb " * 10))) is None
    assert {k: v.tolist() for k, v in got.items()} == {k: [least[key, w] for w in cut(s)] for k, (key, s) in enumerate(names) if key != 9}


def test_queries_match_brute_force(spark, sf):
    rows = rows_of(spark, sf)
    assert sorted((tuple(r) for r in entry.op7_suffix_dedup(spark, sf).collect()), key=str) == brute_bytes(rows)
    assert sorted((tuple(r) for r in entry.op9_window_dedup(spark, sf).collect()), key=str) == brute_words(rows)


def test_repeats_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_repeats.find_repeats(docs).count() == 0
    assert window_repeats.find_repeats(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """doc -> least doc linked, by all pairs."""
    distinct = sorted(set(prints.values()))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    groups = defaultdict(list)
    for doc, p in prints.items():
        groups[find(p)].append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def test_simhash_query(spark, sf):
    rows = rows_of(spark, sf)
    prints = {doc: brute_fingerprint(text) for doc, text in rows}
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.op5_simhash(spark, sf).collect()}
    assert got == {doc: (f"{prints[doc]:016x}", want[doc]) for doc in prints}


@pytest.mark.parametrize("block", [32_768, 4])
def test_links_are_complete(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            prints.add(p)
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = components(simhash.links(frame)).collect()
    got = defaultdict(set)
    for r in found:
        got[r["root"]].add(r["node"] % (1 << 64))
    want = defaultdict(set)
    for doc, least in brute_components({p: p for p in prints}).items():
        want[least].add(doc)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(200)}}


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d"), (3, None), (2, " \n"), (5, ""), (7, "A B c D"), (7, "a b c d"), (9, "one"), (8, "word " * 50_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = {(r["doc_id"], r["fingerprint"] % (1 << 64)): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    want = {(d, brute_fingerprint(t)) for d, t in rows}
    assert set(got) == want
    assert got[(3, 0)] == got[(2, 0)] == got[(5, 0)] == 2
    assert got[(None, brute_fingerprint("a b c d"))] == 7
