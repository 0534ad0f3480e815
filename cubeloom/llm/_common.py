"""What the operators share: the shared folder, stable row samples, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cubeloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages don't depend on this one's executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cubeloom_path = path
    return out


def forget(result: DataFrame, *done: DataFrame) -> DataFrame:
    """Removes tables of materialize() that nothing reads any more; gives back result."""
    spark = result.sparkSession
    for df in done:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cubeloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores in front as no column of df needs (letters' case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labels_of(n: int) -> np.ndarray:
    """n ints of which repartition(n, column) sends each to a partition of its own: Spark deals an int by its Murmur3
    hash (seed 42) modulo n, so consecutive numbers would share partitions and leave others empty."""
    found, size = np.full(n, -1, dtype=np.int32), 8 * n + 64
    while (found < 0).any():
        x = np.arange(size, dtype=np.uint32)
        with np.errstate(over="ignore"):
            k = x * np.uint32(0xCC9E2D51)
            k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
            h = np.uint32(42) ^ k
            h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(4)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
        found[h.view(np.int32).astype(np.int64)[::-1] % n] = x[::-1]
        size *= 4
    return found


def by_bucket(df: DataFrame, n: int, column: str) -> DataFrame:
    """Deals rows into n partitions by an int column of labels_of(n): one label, one partition."""
    return df.repartition(n, column)


def held_out(id_col: str, mod: int, remainder: int):
    """crc32 of the id as text, mod `mod`, equals `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def sampled_ids(labels: DataFrame, id_col: str, label_col: str, max_rows: int, where=None) -> DataFrame:
    """At most max_rows labelled ids, chosen by a hash of the id: the same ones whatever the row order. An id labelled 0
    and 1 is not used."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label"), F.max(F.col(label_col).cast("int")).alias("_most"))
    return rows.where("_label = _most").select("_id", "_label").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)


def bounded_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where, max_rows: int, max_bytes: int) -> DataFrame:
    """(_id, _label, _text binary) of sampled_ids, written to the shared folder: texts whole, in the order of the ids'
    hashes as far as max_bytes goes (one at least); of rows with one id the least text; null texts are empty."""
    ids = sampled_ids(labels, id_col, label_col, max_rows, where)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    rows = rows.join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    kept = materialize(rows, "sample")
    sizes = sorted((r[0], r[1], r[2]) for r in kept.select(F.xxhash64("_id"), "_id", F.octet_length("_text")).collect())
    total = np.cumsum([s for _, _, s in sizes])
    if len(sizes) and total[-1] > max_bytes:
        first = [r[1] for r in sizes[: max(1, int(np.searchsorted(total, max_bytes, side="right")))]]
        few = docs.sparkSession.createDataFrame([(x,) for x in first], f"_id {kept.schema['_id'].dataType.simpleString()}")
        kept = kept.join(F.broadcast(few), "_id", "left_semi").select("_id", "_label", "_text")
    return kept


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column's UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 1 << 19):
    """Ranges of texts of about `most` bytes together, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def small(batches, rows: int = 500):
    """The same rows in batches of few: texts are turned into Python objects a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def tidied(step):
    """A step for mapInArrow that gives freed memory back to the system when its task begins (what a step before it kept
    is freed by then) and when it ends: workers live on, idle."""

    def run(batches):
        trim()
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
