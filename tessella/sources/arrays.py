"""Readers and writers: arrays as long tables, text graphs, ragged lists, contours, frames of image files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.storage import stage

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.StringType)


def load_array(spark: SparkSession, path: str, item: str = "double") -> DataFrame:
    """A Parquet table of subscripts and ``value``, the value cast to ``item``; 64-bit and nested values are refused."""
    df = spark.read.parquet(path)
    kind = df.schema["value"].dataType
    if not isinstance(kind, NUMERIC):
        raise TypeError(f"values of type {kind.simpleString()} aren't supported")
    return df.withColumn("value", F.col("value").cast(item))


def read_scalar(df: DataFrame, column: str = "value"):
    """The first value by subscripts, -1 if there is none; text isn't a scalar."""
    if isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError("text isn't a scalar")
    row = df.orderBy(*[c for c in ("t", "z", "y", "x") if c in df.columns]).select(column).first()
    return -1 if row is None else row[0]


def store_array(df: DataFrame, path: str, item: str = "double") -> None:
    df.withColumn("value", F.col("value").cast(item)).write.mode("overwrite").parquet(path)


def to_arrays(df: DataFrame, key: str) -> DataFrame:
    """``key, values``: a frame's values as one array in scan order (y, then x)."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("values"))


def from_arrays(df: DataFrame, key: str, width: int) -> DataFrame:
    """``key, x, y, v`` from arrays in scan order."""
    e = df.select(key, F.posexplode("values").alias("i", "v"))
    return e.select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")


def dense_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``id`` = 0, 1, 2, ... in the order of the columns, without bringing all rows into one task.

    Rows are range-partitioned and sorted once; each partition's offset is the sum of the counts before it.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    parts = stage(parts, "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # as many rows as partitions
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(counts.select("_p", first.alias("_first"))), "_p").withColumn("id", (F.col("_i") + F.col("_first")).cast("bigint")).drop("_p", "_i", "_first")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices key, edges src dst w) of a text graph: N, N keys, E, then E lines ``src dst w``; an unknown vertex is an error.

    The two counts say which lines are which, so lines are numbered by file position.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    lines = stage(lines, "graph-lines")
    fields = F.split("line", r"\s+")
    keys = lines.where(F.size(fields) == 1)
    first = keys.orderBy("at").first()
    vertices = keys.where(F.col("at") > first["at"]).orderBy("at").limit(int(first["line"])).select(F.col("line").cast("bigint").alias("key"))
    edges = lines.where(F.size(fields) == 3).select(fields[0].cast("bigint").alias("src"), fields[1].cast("bigint").alias("dst"), fields[2].cast("double").alias("w"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key"))
    if not ends.join(vertices, "key", "left_anti").isEmpty():
        raise ValueError("an edge names an unknown vertex")
    return vertices, edges


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """The same format, as one text file."""
    part = lambda df, line, k: df.select(line.alias("value"), F.lit(k).alias("k"))
    n = vertices.agg(F.count("*").cast("string").alias("v"))
    m = edges.agg(F.count("*").cast("string").alias("v"))
    rows = part(n, F.col("v"), 0).union(part(vertices, F.col("key").cast("string"), 1)).union(part(m, F.col("v"), 2)).union(part(edges, F.concat_ws(" ", "src", "dst", "w"), 3))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def write_motion_log(df: DataFrame, path: str, title: str) -> None:
    """Text log: title, header, then ``x y frame`` lines in order."""
    rows = df.select(F.lit(2).alias("k"), "frame", "y", "x", F.concat_ws(" ", "x", "y", "frame").alias("value"))
    head = df.sparkSession.createDataFrame([(0, 0, 0, 0, title), (1, 0, 0, 0, "x y frame")], "k int, frame int, y int, x int, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("k", "frame", "y", "x").select("value").write.mode("overwrite").text(path)


def gather(grid: DataFrame, cells: DataFrame, attribute: str, default) -> DataFrame:
    """``grid`` with the cells' attribute, ``default`` where there is none; cells outside the grid are ignored."""
    on = ["frame", "x", "y"]
    return grid.select(*on).join(cells.select(*on, attribute), on, "left").withColumn(attribute, F.coalesce(attribute, F.lit(default)))


def lookup(grid: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with ``v`` and ``success``: bounds-checked access, 0 and false outside."""
    on = ["frame", "x", "y"]
    j = places.join(grid.select(*on, F.col("v")), on, "left")
    return j.withColumns({"success": F.col("v").isNotNull(), "v": F.coalesce("v", F.lit(0))})


def skeleton_graph(points: DataFrame, edges: DataFrame) -> DataFrame:
    """1-based undirected edges as directed ones between the points' ids, both ways."""
    known = edges.select((F.col("a") - 1).alias("src"), (F.col("b") - 1).alias("dst"))
    known = known.join(points.select(F.col("id").alias("src")), "src", "left_semi").join(points.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.select("src", "dst").union(known.select("dst", "src")).distinct()


def undirected_rows(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst").select((F.col("src") + 1).alias("a"), (F.col("dst") + 1).alias("b"))


def _decode(batches: Iterator[pd.DataFrame], rate: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for frame, content in zip(batch["frame"], batch["content"], strict=True):
            image = parse_netpbm(content)
            gray = image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.int64)
            h, w = gray.shape[0] // rate, gray.shape[1] // rate
            small = gray[: h * rate, : w * rate].reshape(h, rate, w, rate).mean(axis=(1, 3))
            y, x = np.mgrid[0:h, 0:w]
            yield pd.DataFrame({"frame": frame, "x": x.ravel(), "y": y.ravel(), "v": np.rint(small).astype(np.int32).ravel()})


def parse_netpbm(data: bytes) -> np.ndarray:
    """A binary PGM (P5) or PPM (P6) image with 8-bit samples."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    width, height, channels = int(fields[1]), int(fields[2]), {b"P5": 1, b"P6": 3}[fields[0]]
    image = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image


def read_frames(spark: SparkSession, path: str, decimation: int = 1) -> DataFrame:
    """``frame, x, y, v``: gray pixels of frame files named with their number (``...12.ppm``), area-averaged by ``decimation``."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int").alias("frame"), "content")
    return files.mapInPandas(lambda it: _decode(it, decimation), "frame int, x int, y int, v int")
