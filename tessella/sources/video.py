"""Uncompressed video (YUV4MPEG2 files) as a data source: batches, streams and a sink of gray frames.

A file is a text header and frames of one size, so that any range of frames can be read by itself: a batch scan is cut into ranges of bytes, a
stream's offset is the number of whole frames of each file. Gray is the first plane, whatever the colour format. Files are opened where
the tasks run, through the file systems that Arrow knows (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "video string, frame int, width int, height int, gray binary"
# Fixed values of the format: the signature, the line before each frame, and bytes per pixel of the colour formats (in halves).
SIGNATURE, FRAME = b"YUV4MPEG2", b"FRAME\n"
HALVES = {"mono": 2, "420": 3, "422": 4, "444": 6, "411": 3}
RANGE_BYTES = 64 << 20
FRAMES_PER_FILE = 100_000


@dataclass
class Video(InputPartition):
    """Frames ``first`` to ``stop`` of a file; ``offset`` is the number of its first frame."""

    path: str
    width: int
    height: int
    header: int
    record: int
    offset: int
    first: int
    stop: int


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)
    return fs.LocalFileSystem(), path


def parse_header(line: bytes) -> tuple[int, int, int, int]:
    """(width, height, bytes per frame, number of the first frame) of a header line."""
    words = line.decode("ascii", "replace").split(" ")
    if words[0].encode() != SIGNATURE:
        raise ValueError("not a YUV4MPEG2 file")
    fields = {w[0]: w[1:] for w in words[1:] if w and w[0] != "X"}
    first = next((int(w[6:]) for w in words if re.fullmatch(r"XFIRST-?\d+", w)), 0)
    colour = re.match(r"mono|4\d\d", fields.get("C", "420"))
    if not (fields.get("W", "").isdigit() and fields.get("H", "").isdigit() and colour) or colour[0] not in HALVES or re.search(r"p\d|mono\d|alpha", fields.get("C", "")):
        raise ValueError(f"not a format of 8-bit planes: {line!r}")
    width, height = int(fields["W"]), int(fields["H"])
    wide, high = {"420": (-(-width // 2), -(-height // 2)), "422": (-(-width // 2), height), "411": (-(-width // 4), height), "444": (width, height), "mono": (0, 0)}[colour[0]]
    return width, height, width * height + 2 * wide * high, first


def videos(path: str, partial: bool) -> list[Video]:
    """All files of a folder (or the one file) with the whole frames that they have now."""
    store, root = filesystem(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for f in sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".y4m")), key=lambda f: f.path):
        with store.open_input_file(f.path) as file:
            line, newline, _ = file.read(1024).partition(b"\n")
        if not newline:
            if partial:
                continue
            raise ValueError(f"{f.path}: no header")
        width, height, size, first = parse_header(line)
        record, header = len(FRAME) + size, len(line) + 1
        frames, rest = divmod(f.size - header, record)
        if rest and not partial:
            raise ValueError(f"{f.path}: the last frame is cut off")
        out.append(Video(f.path, width, height, header, record, first, 0, frames))
    return out


def read_range(path: str, part: Video) -> Iterator[pa.RecordBatch]:
    store, _ = filesystem(path)
    name = re.sub(r"(--?\d+)?\.y4m$", "", part.path.rpartition("/")[2])
    schema = pa.schema([("video", pa.string()), ("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("gray", pa.binary())])
    with store.open_input_file(part.path) as file:
        file.seek(part.header + part.first * part.record)
        for k in range(part.first, part.stop):
            record = file.read(part.record)
            if len(record) < part.record or not record.startswith(FRAME):
                raise ValueError(f"{part.path}: no frame where frame {k} should be")
            gray = record[len(FRAME) : len(FRAME) + part.width * part.height]
            yield pa.RecordBatch.from_pylist([{"video": name, "frame": part.offset + k, "width": part.width, "height": part.height, "gray": gray}], schema)


class VideoReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        out = []
        for v in videos(self.path, partial=False):
            step = max(1, self.size // v.record)
            out += [Video(**{**v.__dict__, "first": a, "stop": min(a + step, v.stop)}) for a in range(0, v.stop, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and getattr(partition, "path", None):
            yield from read_range(self.path, partition)


class VideoStreamReader(DataSourceStreamReader):
    """Offsets: the number of whole frames per file; files may grow and new ones may come."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {v.path: v.stop for v in videos(self.path, partial=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = {v.path: v for v in videos(self.path, partial=True)}
        return [Video(**{**known[p].__dict__, "first": start.get(p, 0), "stop": n}) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_range(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class VideoWriter(DataSourceArrowWriter):
    """A file per run of consecutive frames of a video within a task, of ``frames`` frames at most; files get their names when all tasks are done."""

    def __init__(self, path: str, frames: int, overwrite: bool) -> None:
        self.path, self.frames, self.overwrite = path, frames, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        store.create_dir(f"{root}/_temporary", recursive=True)
        files, out, last = [], None, None
        for batch in iterator:
            for r in batch.to_pylist():
                key = (r["video"], r["width"], r["height"], r["frame"])
                if len(r["gray"]) != r["width"] * r["height"]:
                    raise ValueError(f"frame {r['frame']} of {r['video']} has {len(r['gray'])} bytes, not {r['width']} x {r['height']}")
                if out is None or last != (*key[:3], key[3] - 1) or count == self.frames:
                    if out:
                        out.close()
                    held = f"{root}/_temporary/{uuid.uuid4().hex}"
                    files.append((held, f"{root}/{r['video']}-{r['frame']:09d}.y4m"))
                    out, count = store.open_output_stream(held), 0
                    out.write(SIGNATURE + f" W{r['width']} H{r['height']} F25:1 Ip A1:1 Cmono XFIRST{r['frame']}\n".encode())
                out.write(FRAME + r["gray"])
                last, count = key, count + 1
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = filesystem(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.base_name.endswith(".y4m"):
                    store.delete_file(f.path)
        for held, name in (f for m in messages if m for f in m.files):
            store.move(held, name)
        self._clean(store, root)

    def abort(self, messages: list) -> None:
        self._clean(*filesystem(self.path))

    @staticmethod
    def _clean(store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


class VideoSource(DataSource):
    """``spark.read.format("y4m")``, ``readStream`` and ``write``; options: path, rangeBytes (of a scan's partitions), framesPerFile."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def streamReader(self, schema) -> VideoStreamReader:  # noqa: N802
        return VideoStreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VideoWriter:
        return VideoWriter(self.options["path"], int(self.options.get("framesPerFile", FRAMES_PER_FILE)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoSource)


def frames_of(pixels: DataFrame, video: str = "video") -> DataFrame:
    """Frames (``SCHEMA``) of dense pixels ``frame, x, y, v``; values are clamped to 0 to 255."""
    byte = F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.col("v"))).cast("int")), 2, "0")
    rows = pixels.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", byte.alias("b")))).alias("p"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return rows.select(F.lit(video).alias("video"), F.col("frame").cast("int").alias("frame"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.unhex(F.array_join(F.col("p.b"), "")).alias("gray"))


def write_video(frames: DataFrame, path: str, frames_per_file: int = FRAMES_PER_FILE, ranges: int | None = None) -> None:
    """Write frames in order; a video longer than a task's range of frames becomes several files. A sink for batches."""
    register(frames.sparkSession)
    order = ["video", "frame"]
    placed = frames.repartitionByRange(ranges, *order) if ranges else frames.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).select("video", "frame", "width", "height", "gray").write.format("y4m").option("framesPerFile", frames_per_file).mode("append").save(path)


def read_video(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("y4m").option("rangeBytes", range_bytes).load(path)


def stream_video(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("y4m").load(path)


def _pixels(batches: Iterator[pa.RecordBatch], decimation: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            image = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
            h, w = r["height"] // decimation, r["width"] // decimation
            small = image[: h * decimation, : w * decimation].reshape(h, decimation, w, decimation).mean(axis=(1, 3))
            y, x = np.mgrid[0:h, 0:w]
            columns = [np.full(h * w, r["frame"]), x.ravel(), y.ravel(), np.rint(small).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([r["video"]] * (h * w)), *[pa.array(c.astype(np.int32)) for c in columns]], ["video", "frame", "x", "y", "v"])


def pixels_of(frames: DataFrame, decimation: int = 1) -> DataFrame:
    """``video, frame, x, y, v``: gray pixels, area-averaged by ``decimation``; works on batches and streams."""
    return frames.select("video", "frame", "width", "height", "gray").mapInArrow(lambda it: _pixels(it, decimation), "video string, frame int, x int, y int, v int")
