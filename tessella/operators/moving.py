"""From gray frames to moving edges, in batches and in streams that carry the last frame along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators import grouped as U
from tessella.operators import joins as J
from tessella.operators import stencil as S
from tessella.plans.storage import new_path, stage

RATIO = 0.7
SHARE = 0.5


def edge_tracks(grid: DataFrame, percent: float = 0.7, ratio: float = RATIO) -> DataFrame:
    """``frame, track, seq, x, y, strength``: hysteresis tracks of the smoothed gradient, whose upper threshold is a percentile of each frame."""
    grad = stage(S.gradient(S.separable(grid, S.gaussian_kernel(1.0, 5))), "gradient")
    level = A.percentile_threshold(grad, ["frame"], "g", percent)
    tracks = stage(U.canny_tracks(S.non_maximum_suppression(grad).join(level, "frame"), ratio), "tracks")
    return tracks.join(grad.select("frame", "x", "y", F.col("g").alias("strength")), ["frame", "x", "y"])


def edge_maps(tracks: DataFrame, share: float = SHARE) -> DataFrame:
    """``frame, x, y, edge, strength, moving, moving_strength``: cells of edges; edge and moving are 255 or 0, moving are the tracks of which over
    ``share`` have no edge at the same place in the frame before. A cell that isn't listed is 0 in all four maps."""
    tracks = stage(tracks, "tracks")
    moving = J.moving_share(tracks, share).select("frame", "track", F.lit(True).alias("m"))
    cells = tracks.join(moving, ["frame", "track"], "left").groupBy("frame", "x", "y").agg(F.max("strength").alias("strength"), F.max(F.coalesce("m", F.lit(False))).alias("m"))
    return cells.select("frame", "x", "y", F.lit(255).alias("edge"), "strength", F.when(F.col("m"), 255).otherwise(0).alias("moving"), F.when(F.col("m"), F.col("strength")).otherwise(0.0).alias("moving_strength"))


def stream_edge_maps(pixels: DataFrame, path: str, checkpoint: str):
    """Start a query that writes the edge maps of a stream of pixels ``frame, x, y, v`` below ``path``, a folder a batch.

    Frames come whole and in order. A batch is worked on together with the last frame of the batch before, which is kept next to the results, so that the
    maps are those of one batch over all frames. A batch that is repeated writes the same again.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = stage(batch.select("frame", "x", "y", "v"), "pixels")
        edge = fresh.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
        if edge["lo"] is None:
            before = _last(spark, path, number)
            if before is not None:
                before.write.mode("overwrite").parquet(f"{path}/last/batch={number:08d}")
            return
        before = _last(spark, path, number)
        grid = fresh if before is None else fresh.unionByName(before)
        maps = edge_maps(edge_tracks(grid)).where(F.col("frame") >= edge["lo"])
        maps.write.mode("overwrite").parquet(f"{path}/maps/batch={number:08d}")
        fresh.where(F.col("frame") == edge["hi"]).write.mode("overwrite").parquet(f"{path}/last/batch={number:08d}")

    return pixels.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)


def _last(spark, path: str, number: int) -> DataFrame | None:
    return spark.read.schema("frame int, x int, y int, v int").parquet(f"{path}/last/batch={number - 1:08d}") if number else None


def run_edge_maps(pixels: DataFrame) -> DataFrame:
    """The maps of all frames that are there now, by the stream."""
    spark = pixels.sparkSession
    path = new_path(spark, "edge-maps")
    stream_edge_maps(pixels, path, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    schema = "frame int, x int, y int, edge int, strength double, moving int, moving_strength double"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/maps")
