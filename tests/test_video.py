"""Video files as a source, a stream and a sink; moving edges of a stream against those of a batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import moving as M
from tessella.sources import video as V


def header(more="Cmono", w=3, h=2):
    return f"YUV4MPEG2 W{w} H{h} F30:1 Ip A1:1 {more}\n".encode()


def test_headers():
    assert V.parse_header(header("C420jpeg", 5, 3)[:-1]) == (5, 3, 15 + 2 * 3 * 2, 0)
    assert V.parse_header(header("C444", 5, 3)[:-1]) == (5, 3, 45, 0)
    assert V.parse_header(header("C422", 5, 3)[:-1]) == (5, 3, 15 + 2 * 3 * 3, 0)
    assert V.parse_header(header("C411", 5, 3)[:-1]) == (5, 3, 15 + 2 * 2 * 3, 0)
    assert V.parse_header(b"YUV4MPEG2 W4 H4 XFIRST12 XC=9") == (4, 4, 24, 12)
    for bad in (b"RIFF", b"YUV4MPEG2 W4", b"YUV4MPEG2 W4 H4 C420p10", b"YUV4MPEG2 W4 H4 C444alpha", b"YUV4MPEG2 Wx H4 Cmono"):
        with pytest.raises(ValueError):
            V.parse_header(bad)


def test_foreign_files(spark, tmp_path):
    """Files of other formats in the folder are left alone; chroma planes are passed over."""
    frames = [bytes(range(k, k + 6)) for k in (0, 100, 200)]
    (tmp_path / "a.y4m").write_bytes(header("C444") + b"".join(b"FRAME\n" + f + b"\x80" * 12 for f in frames))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.y4m").write_bytes(header() + b"FRAME\n" + frames[1])
    (tmp_path / "none.y4m").write_bytes(header())
    (tmp_path / "note.txt").write_bytes(b"x")
    for size in (1, 1 << 20):
        got = V.read_video(spark, str(tmp_path), size).collect()
        assert sorted((r.video, r.frame, r.width, r.height, bytes(r.gray)) for r in got) == sorted([("a", k, 3, 2, f) for k, f in enumerate(frames)] + [("b", 0, 3, 2, frames[1])])
    assert V.read_video(spark, f"file://{tmp_path}/a.y4m", 1).rdd.getNumPartitions() == 3
    assert V.read_video(spark, f"{tmp_path}/absent").count() == 0
    (tmp_path / "cut.y4m").write_bytes(header() + b"FRAME\nabc")
    with pytest.raises(Exception, match="cut off"):
        V.read_video(spark, str(tmp_path)).count()
    (tmp_path / "cut.y4m").write_bytes(header() + b"FRAMEX" + frames[0])
    with pytest.raises(Exception, match="no frame where"):
        V.read_video(spark, str(tmp_path)).count()


def test_round_trip(spark, tmp_path):
    """Two videos, one with a gap, in files of two frames at most; values are clamped."""
    rng = random.Random(3)
    image = {(v, f, x, y): rng.randrange(-5, 300) for v, fs in (("a", range(-1, 5)), ("b", (2, 3, 7))) for f in fs for x in range(4) for y in range(3)}
    df = spark.createDataFrame([(*k, n) for k, n in image.items()], "video string, frame int, x int, y int, v int")
    frames = V.frames_of(df.where("video = 'a'"), "a").unionByName(V.frames_of(df.where("video = 'b'"), "b"))
    V.write_video(frames, str(tmp_path / "v"), frames_per_file=2, ranges=3)
    names = sorted(p.name for p in (tmp_path / "v").iterdir())
    assert len(names) >= 5 and all(n.endswith(".y4m") for n in names)
    got = {(r.video, r.frame, r.x, r.y): r.v for r in V.pixels_of(V.read_video(spark, str(tmp_path / "v"))).collect()}
    assert got == {k: min(255, max(0, n)) for k, n in image.items()}
    bad = spark.createDataFrame([("c", 0, 2, 2, bytearray(b"abc"))], V.SCHEMA)
    with pytest.raises(Exception, match="not 2 x 2"):
        V.write_video(bad, str(tmp_path / "w"))
    assert not list((tmp_path / "w").iterdir())


def moving_square(frames, size=18, side=6):
    """A square that stands still and one that goes one cell a frame."""
    out = []
    for f in frames:
        image = np.zeros((size, size), int)
        image[2:8, 2:8] = 200
        image[10:16, f : f + side] = 150
        out += [(f, x, y, int(image[y, x])) for x in range(size) for y in range(size)]
    return out


def test_stream_equals_batch(spark, tmp_path):
    """Frames come in three runs of one stream; a file grows between two of them, and its last frame is cut off at first."""
    schema = "frame int, x int, y int, v int"
    everything = spark.createDataFrame(moving_square(range(8)), schema)
    path, out = tmp_path / "v", str(tmp_path / "out")
    path.mkdir()
    data = {r.frame: bytes(r.gray) for r in V.frames_of(everything).collect()}
    file = lambda first, frames: b"YUV4MPEG2 W18 H18 Cmono XFIRST%d\n" % first + b"".join(b"FRAME\n" + data[f] for f in frames)
    (path / "v-0.y4m").write_bytes(file(0, range(3)) + b"FRAME\n" + data[3][:50])
    pixels = V.pixels_of(V.stream_video(spark, str(path))).select("frame", "x", "y", "v")

    def run():
        M.stream_edge_maps(pixels, out, f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    run()
    (path / "v-0.y4m").write_bytes(file(0, range(5)))
    run()
    (path / "v-5.y4m").write_bytes(file(5, range(5, 8)))
    run()
    run()  # nothing new
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/maps")
    want = M.edge_maps(M.edge_tracks(everything))
    keys = ["frame", "x", "y", "edge", "moving"]
    value = lambda df: sorted((*[r[k] for k in keys], round(r.strength, 9), round(r.moving_strength, 9)) for r in df.collect())
    assert value(got) == value(want) and {r.frame for r in got.select("frame").distinct().collect()} == set(range(8))
    moving = got.where("moving = 255")
    assert moving.count() and moving.where("frame = 0").isEmpty() is False and moving.where((F.col("frame") > 0) & (F.col("y") < 8)).isEmpty()
