"""Top-k, packing and decontamination against brute force and round trips."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from cubeloom.llm import decontaminate, entry, packing, topk


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 50:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in entry.op4_topk(spark, sf).collect()) == brute_top(rows)


def test_top_k_odd(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "FAN", 2)
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (250, []), (300, [1.0, None, 2.0, 1.0]), (350, [1.0, float("nan"), 2.0, 1.0]), (400, [1.0, float("inf"), 2.0, 1.0]), (None, [1.0] * 4), (450, [1.0, 2.0]), (500, [1e9, 1e9, 1e8, 3.0]), (550, [1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 50 = 0")).collect())
    assert got == brute_top(rows)
    empty = frame.limit(0)
    assert topk.top_k(empty, empty).count() == 0


def check_packing(rows, texts, capacity=1024):
    tokenizer = Tokenizer.from_file(entry.tokenizer_path())
    spaces, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        spaces[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for found in spaces.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at, want = 0, []
        while at < len(ids):
            length = (len(ids) % capacity or capacity) if at == 0 else capacity
            want.append((len(want), at, length, zlib.crc32(np.array(ids[at : at + length], dtype="<u4").tobytes())))
            at += length
        assert sorted(by_doc[doc]) == want
    return len(spaces), sum(r["length"] for r in rows)


def test_packing_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    used, tokens = check_packing(entry.op3_packing(spark, sf).collect(), texts)
    assert used <= 1.05 * tokens / 1024 + 2


def test_packing_odd(spark, tmp_path):
    texts = {1: None, 2: "", 3: " ", 4: "a  b\n\n c ", 5: "<|endoftext|> x", 6: "word " * 5000, 7: "x", 8: "don't stop  ", 9: "é ü 漢字\n", 10: " lead", 11: "a \n b"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    docs.withColumn("length", docs.doc_id).write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(entry.op3_packing(spark, str(tmp_path)).collect(), texts)
    (tmp_path / "e").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert entry.op3_packing(spark, str(tmp_path / "e")).count() == 0


def test_encoders_agree_on_the_whole_vocabulary():
    """Every token as a word of its own, and words that two tokens make: the vocabulary's ranks give the tokenizer's ids."""
    encoder, tokenizer = packing.Encoder(entry.tokenizer_path(), **entry.tokenizer_ranks()), Tokenizer.from_file(entry.tokenizer_path())
    tokens = [tokenizer.decode([i], skip_special_tokens=False).strip() for i in range(tokenizer.get_vocab_size())]
    rng = random.Random(8)
    words = [" " + w for w in {*tokens, *("".join(rng.sample(tokens, 2)) for _ in range(20_000))} if w and not any(c.isspace() for c in w) and not any(s in w for s in encoder.special)]
    assert len(words) > 50_000
    assert [list(encoder.ids(w)) for w in words] == [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def test_grouping_rounds_and_loses_little():
    rng = np.random.default_rng(0)
    sizes = np.clip(np.exp(rng.normal(5.5, 0.8, 30_000)).astype(int), 1, 1024)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    used = {g: max(first + z - a for _, a, z, first, _ in packing.plan(counts, 1024, groups=g)) for g in (16, 256)}
    assert used[16] > used[256]  # fewer sizes, more room lost
    assert used[256] <= 1.001 * -(-int(sizes.sum()) // 1024)


def test_plan_places_everything():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 101, 3000), rng.integers(45, 60, 500), np.array([100] * 9), np.array([1])):
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        for groups in (4, 16_384):
            ranks, rooms = defaultdict(list), defaultdict(list)
            for length, a, z, first, offset in packing.plan(counts, 100, groups=groups):
                ranks[length] += range(a, z)
                for k in range(z - a):
                    rooms[first + k].append((offset, length))
            assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
            assert sorted(rooms) == list(range(len(rooms)))
            for found in rooms.values():
                at = 0
                for offset, length in sorted(found):
                    assert offset == at
                    at += length
                assert at <= 100


def brute_tiles(a, b, least):
    """Greedy string tiling as first published: the longest free matches, marked in turn."""
    free_a, free_b, covered = [w != 0 for w in a], [True] * len(b), 0
    while True:
        longest, found = least, []
        for s in range(len(a)):
            for p in range(len(b)):
                k = 0
                while s + k < len(a) and p + k < len(b) and a[s + k] == b[p + k] and free_a[s + k] and free_b[p + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(s, p)]
                elif k == longest:
                    found.append((s, p))
        if not found:
            return covered
        for s, p in found:
            if all(free_a[s : s + longest]) and all(free_b[p : p + longest]):
                free_a[s : s + longest] = free_b[p : p + longest] = [False] * longest
                covered += longest


def test_tiling_matches_plain_tiling():
    rng = random.Random(2)
    for _ in range(300):
        b = [rng.randint(1, 4) for _ in range(rng.randint(3, 30))]
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 10))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b))
            a += b[k : k + rng.randint(1, 15)]
        tiles = decontaminate.tile(a, b, 3)
        assert sum(t[0] for t in tiles) == brute_tiles(a, b, 3)
        assert all(a[s : s + n] == b[p : p + n] for n, s, p in tiles)


def test_contamination(spark):
    words = [f"w{i}" for i in range(40)]
    item, other = " ".join(words), " ".join(f"v{i}" for i in range(20))
    texts = [
        None, "", "w0 w1 w2", "intro. " + item.upper() + "! outro", " ".join(words[20:] + ["x"] * 50 + words[:20]),  # whole, reordered
        " ".join(words[:24]), " ".join(f"w{i} z" for i in range(40)), item + " " + other, " ".join(words[:10] + ["q"] + words[10:25] + ["r"] + words[30:40]),
    ]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (None, item), (4, "w0 w1"), (5, "")], "item_id long, text string")
    for most in (1 << 20, 60):  # in one block and in several
        got = {r["doc_id"]: {(c["item"], round(c["coverage"], 3)) for c in r["contamination"]} for r in decontaminate.contamination(docs, bench, most_bytes=most).collect()}
        assert got == {0: set(), 1: set(), 2: set(), 3: {(1, 1.0)}, 4: {(1, 1.0)}, 5: set(), 6: set(), 7: {(1, 1.0), (2, 1.0)}, 8: {(1, 0.875)}}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert all(not r["contamination"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_decontamination_query(spark, sf):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in bench.items() if t in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in entry.op1_decontamination(spark, sf).where("coverage = 1").collect()}
    assert want <= got
    # by plain tiling, every document with every item
    numbers = {}
    plain = set()
    seq = lambda t: [numbers.setdefault(w, len(numbers) + 1) for w in decontaminate.words_of((t or "").encode())]
    items = {i: seq(t) for i, t in bench.items()}
    grams = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in items.items()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x = seq(r["text"])
        have = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        for i, b in items.items():
            if len(have & grams[i]) and len(x) < 3000 and brute_tiles(x, b, 5) >= 0.8 * len(b):
                plain.add((r["doc_id"], i))
    short = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(seq(r["text"])) < 3000}
    assert plain == {(r["doc_id"], r["item_id"]) for r in entry.op1_decontamination(spark, sf).collect() if r["doc_id"] in short}
