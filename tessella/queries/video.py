"""Queries over the pixels as a video: written to files and read back, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import moving as M
from tessella.plans.storage import new_path
from tessella.queries import query
from tessella.queries.stencil import P, fx
from tessella.sources import video as V
from tessella.sources.bindings import pixels


def _written(spark, sf) -> str:
    path = new_path(spark, "video")
    V.write_video(V.frames_of(pixels(spark, sf), "events"), path, frames_per_file=7)
    return path


@query(P + " SELECT 'events' AS video, frame, x, y, least(v, 255) AS v FROM pixels")
def video_pixels(spark, sf):
    """Frames written as video files and read by ranges of bytes."""
    return V.pixels_of(V.read_video(spark, _written(spark, sf), range_bytes=4096))


@query(P + " SELECT frame, x // 2 AS x, y // 2 AS y, round_even(avg(least(v, 255)), 0)::INT AS v FROM pixels GROUP BY ALL")
def video_decimated(spark, sf):
    return V.pixels_of(V.read_video(spark, _written(spark, sf)), decimation=2).select("frame", "x", "y", "v")


@query()
def stream_edge_maps(spark, sf):
    """Moving edges of a stream of video frames, as 255 / 0 maps and with their strength; tests hold it against the batch."""
    frames = V.stream_video(spark, _written(spark, sf))
    maps = M.run_edge_maps(V.pixels_of(frames).select("frame", "x", "y", "v"))
    return maps.select("frame", "x", "y", "edge", fx("strength", "strength"), "moving", fx("moving_strength", "moving_strength"))


@query()
def video_edge_maps(spark, sf):
    grid = V.pixels_of(V.read_video(spark, _written(spark, sf))).select("frame", "x", "y", F.col("v"))
    maps = M.edge_maps(M.edge_tracks(grid))
    return maps.select("frame", "x", "y", "edge", fx("strength", "strength"), "moving", fx("moving_strength", "moving_strength"))
