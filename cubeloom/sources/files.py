"""Mesh, voxel and log files as DataFrames. Columnar files are Spark's own: df.write.parquet and spark.read.parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NUMBER = r"[-+0-9.eE]+"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines with their number. A mesh file is one unit, so it is read whole; many files are many tasks."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def obj_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(file, vertex, x, y, z): the `v` lines of Wavefront files, numbered from 1 in each file."""
    v = _lines(spark, path).where(F.col("line").rlike(r"^\s*v\s"))
    at = F.split(F.trim("line"), r"\s+")
    w = Window.partitionBy("file").orderBy("n")
    return v.select("file", F.row_number().over(w).alias("vertex"), *(at[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")))


def obj_faces(spark: SparkSession, path: str) -> DataFrame:
    """(file, face, a, b, c): triangles of the `f` lines; polygons become fans; negative numbers count from the end of
    the vertices read so far."""
    rows = _lines(spark, path).where(F.col("line").rlike(r"^\s*[vf]\s"))
    w = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("_seen", F.count_if(F.col("line").rlike(r"^\s*v\s")).over(w)).where(F.col("line").rlike(r"^\s*f\s"))
    number = lambda e: F.split(e, "/")[0].cast("int")
    at = F.transform(F.slice(F.split(F.trim("line"), r"\s+"), F.lit(2), F.size(F.split(F.trim("line"), r"\s+")) - 1), lambda e: F.when(number(e) < 0, F.col("_seen").cast("int") + number(e) + 1).otherwise(number(e)))
    fan = rows.withColumn("_v", at).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_v") - 2)))
    return fan.select("file", F.row_number().over(Window.partitionBy("file").orderBy("n", "_k")).alias("face"), F.col("_v")[0].alias("a"), F.get("_v", F.col("_k")).alias("b"), F.get("_v", F.col("_k") + 1).alias("c"))


def stl_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(file, face, vertices): triangles of ASCII STL files; vertices are three structs in order."""
    v = _lines(spark, path).where(F.col("line").rlike(r"^\s*vertex\s"))
    at = F.split(F.trim("line"), r"\s+")
    place = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    v = v.withColumn("_p", place).select("file", F.floor(F.col("_p") / 3).cast("int").alias("face"), F.struct((F.col("_p") % 3).alias("k"), *(at[k + 1].cast("double").alias(c) for k, c in enumerate("xyz"))).alias("v"))
    return v.groupBy("file", "face").agg(F.transform(F.sort_array(F.collect_list("v")), lambda e: F.struct(e["x"], e["y"], e["z"])).alias("vertices"))  # three each


def vol_voxels(spark: SparkSession, path: str, threshold: int = 1) -> DataFrame:
    """(file, x, y, z, value): voxels at or above the threshold of .vol files: a text header that names X, Y and Z (and
    ends in a line with a dot), or three little-endian 32-bit sizes, then a byte a voxel, x fastest."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import numpy as np

        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                head = re.match(rb"(?s)(.*?\n\.\n)", content[:4096])
                if head:
                    size = [int(re.search(rb"(?m)^%c:\s*(\d+)" % c, head[1])[1]) for c in b"XYZ"]
                    at = head.end()
                else:
                    size, at = list(struct.unpack("<3i", content[:12])), 12
                cube = np.frombuffer(content, np.uint8, size[0] * size[1] * size[2], at).reshape(size[2], size[1], size[0])
                z, y, x = np.nonzero(cube >= threshold)
                yield pd.DataFrame({"file": file, "x": x, "y": y, "z": z, "value": cube[z, y, x].astype("int32")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, x long, y long, z long, value int")


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replay_log(spark: SparkSession, path: str, schema: str, after: int | None = None) -> DataFrame:
    """Log rows in order of seq, those after a checkpoint only; broken lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("seq").isNotNull())
    return (rows if after is None else rows.where(F.col("seq") > after)).orderBy("seq")


def stream_nodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nodes that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)
