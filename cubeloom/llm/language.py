"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary of sample text. A text is lower-cased and cut into pieces of PIECE
bytes, each is compressed with every dictionary, and the language with the smallest total wins (ties: the one with more
documents where it was learned). The margin is how much smaller the best total is than the second, as a share of the second; a text whose margin is below
`margin` is not accepted.

Results: a null text, or one without any letter, is `und` with score 0 and not accepted; so is every text where nothing
could be learned. With one language only, the score is 1. Language names that differ in case only are different ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm._common import tidied

PIECE = 4096
LEVEL = 6


def fit_languages(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", where=None, max_docs: int = 200, dict_bytes: int = 32_768) -> dict[str, bytes]:
    """lang -> dictionary content, the most frequent language first. About `max_docs` documents of each language, picked by a hash of their id, are
    sampled (bounded); in hash order they fill `dict_bytes` bytes of dictionary, a sixty-fourth of it from any one document.
    The bounds hold for the training sample alone; classified texts are whole."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    kept = F.lit(False)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    for lang, n in counts.items():
        kept = kept | ((F.col("_lang") == lang) & (draw < max(1, 1_000_000 * max_docs // n)))
    share = dict_bytes // 64
    got = rows.where(kept).select("_lang", "_id", F.xxhash64("_id").alias("_h"), F.substring(F.encode(F.lower("_text"), "UTF-8"), 1, share).alias("_part")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["_lang"], r["_h"], str(r["_id"]), r["_part"]))
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        parts, size = [], 0
        for r in got:
            if r["_lang"] == lang and size < dict_bytes:
                parts.append(r["_part"])
                size += len(r["_part"])
        content = b"\n".join(parts)[:dict_bytes]
        if len(content) >= 8:
            out[lang] = content
    return out


def _compressors(contents: dict[str, bytes]):
    made = []
    for lang in contents:
        held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: str | None, compressors) -> tuple[str, float]:
    if not text or not compressors or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = text.lower().encode("utf-8", "surrogatepass")
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    totals = [sum(len(c.compress(p)) for p in pieces) for _, c in compressors]
    best = int(np.argmin(totals))
    if len(totals) == 1:
        return compressors[0][0], 1.0
    second = min(t for k, t in enumerate(totals) if k != best)
    return compressors[best][0], (second - totals[best]) / second


def identify_language(docs: DataFrame, contents: dict[str, bytes], *, text_col="text", margin: float = 0.01, out=("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the language, the margin and whether the margin is wide enough. One pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(contents)
    keep = [c for c in docs.columns if c not in out]
    schema = docs.select(*keep).withColumns({out[0]: F.lit(""), out[1]: F.lit(0.0), out[2]: F.lit(True)}).schema

    def apply(batches):
        compressors = _compressors(held.value)
        for batch in batches:
            got = [classify(t, compressors) for t in batch.column(text_col).to_pylist()]
            langs, scores = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([lang != "und" and s >= margin for lang, s in got], pa.bool_())],
                [*keep, *out],
            )

    return docs.mapInArrow(tidied(apply), schema)
