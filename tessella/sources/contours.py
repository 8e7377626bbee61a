"""Contours as tables: plain points, points with quadratic-segment coefficients, and snapshots of moving vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.sequences import polygon_measures
from tessella.sources.arrays import dense_ids

PLAIN = {"contour_id": "bigint", "seq": "bigint", "x": "double", "y": "double", "strength": "double"}
SEGMENTS = {**{k: v for k, v in PLAIN.items() if k != "strength"}, "a": "double", "b": "double", "c": "double", "d": "double", "strength": "double"}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns in order and of their types; a missing coefficient or strength is 0."""
    have = set(df.columns)
    if missing := {"contour_id", "seq", "x", "y"} - have:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    return df.select(*[(F.col(c) if c in have else F.lit(0.0)).cast(t).alias(c) for c, t in columns.items()])


def load_contours(spark: SparkSession, path: str, segments: bool = False) -> DataFrame:
    return _typed(spark.read.parquet(path), SEGMENTS if segments else PLAIN)


def store_contours(df: DataFrame, path: str, segments: bool = False) -> None:
    """Clustered by contour, so that a contour's points are read together."""
    out = _typed(df, SEGMENTS if segments else PLAIN)
    out.repartition("contour_id").sortWithinPartitions("contour_id", "seq").write.mode("overwrite").parquet(path)


def snapshot(vertices: DataFrame, time: float) -> DataFrame:
    """``ring, seq, x, y, projected, created`` of vertices (ring, seq, x, y, vx, vy, created) moved to ``time``; those created later are left out."""
    gone = F.lit(float(time)) - F.col("created")
    at = lambda p, v: (F.col(p) + F.col(v) * gone).alias(p)
    return vertices.where(F.col("created") <= time).select("ring", "seq", at("x", "vx"), at("y", "vy"), F.lit(float(time)).alias("projected"), "created")


def by_area(rings: DataFrame, key: str = "contour_id") -> DataFrame:
    """Adds ``area`` and ``nth``: rings numbered from the largest area, ties by key."""
    area = polygon_measures(rings.withColumnRenamed(key, "contour_id")).select(F.col("contour_id").alias(key), "area")
    ranked = dense_ids(area.withColumn("_below", -F.col("area")), ["_below", key])
    return rings.join(ranked.select(key, "area", (F.col("id") + 1).alias("nth")), key)
