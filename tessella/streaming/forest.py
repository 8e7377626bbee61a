"""A spanning forest that follows a stream of frames, in keyed state.

Vertices are the dots of the last frames of a stream, edges join dots within a radius, weights grow with the difference of place,
time and velocity. Frames come and go, and the forest changes with them:

* A new frame brings edges. By the cycle rule an edge that is the heaviest of a cycle never enters the forest.
* A frame that leaves takes its edges along, and edges that lost a cycle to them may come back (cut rule). An edge leaves with its older dot,
  so that only cycles whose other edges leave no earlier rule it out for good. The state keeps, per oldest frame k, what the forest of frames from
  k on adds to that of the frames from k + 1 on: as many edges as dots per frame and window at most. Leaving frames are dropped with their layer;
  nothing is searched again.

A frame is handled when the watermark reaches its start, and a timer says so; rows that come after that are late and are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME_MS = 86_400_000
EPOCH = 1 << 15  # frames before frame 0 that have a time after zero
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spanning(edges: Iterable[tuple], root: dict) -> list[tuple]:
    """Of ``edges`` (w, p, q) those that the forest in ``root`` lacks, lightest first; ``root`` is a union-find over dots and is changed."""

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    taken = []
    for edge in sorted(edges):
        a, b = find(edge[1]), find(edge[2])
        if a != b:
            root[a] = b
            taken.append(edge)
    return taken


def layers(edges: dict[int, list[tuple]]) -> dict[int, list[tuple]]:
    """Per oldest frame the edges that stay: those of the least forest of all edges with that oldest frame or a later one."""
    kept, forest = {}, []
    for oldest in sorted(edges, reverse=True):
        own = set(edges[oldest])
        forest = spanning([*forest, *own], {})
        kept[oldest] = [e for e in forest if e in own]
    return kept


@cache
def rings(radius: int) -> list[list[tuple[int, int]]]:
    """Steps (dx, dy) of whole numbers up to ``radius``, those of one length together, the shortest first."""
    by = defaultdict(list)
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            by[dx * dx + dy * dy].append((dx, dy))
    return [by[d2] for d2 in sorted(by) if d2 <= radius * radius]


class Places:
    """Rows (id, x, y, ...), one a place, by where they are."""

    def __init__(self, rows: np.ndarray) -> None:
        key = rows[:, 1] * (1 << 32) + rows[:, 2]
        self.rows, self.key = rows[np.argsort(key)], np.sort(key)

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of the row at each x, y, -1 without one."""
        if not len(self.key):
            return np.full(len(x), -1)
        n = np.minimum(np.searchsorted(self.key, x * (1 << 32) + y), len(self.key) - 1)
        return np.where((self.rows[n, 1] == x) & (self.rows[n, 2] == y), n, -1)

    def nearest(self, x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
        """The number of the row nearest to each x, y (ties: the least id), -1 without one within ``reach``."""
        out, left = np.full(len(x), -1), np.arange(len(x))
        for ring in rings(reach):
            for dx, dy in ring:
                n, best = self.at(x[left] + dx, y[left] + dy), out[left]
                better = (n >= 0) & ((best < 0) | (self.rows[n, 0] < self.rows[best, 0])) if len(self.key) else n >= 0
                out[left] = np.where(better, n, best)
            left = left[out[left] < 0]
        return out


class Window:
    """The last frames of one stream. Dots of a frame at one place have the same way and so the same neighbours: the least id stands for them.

    ``dots``: (id, x, y, dx, dy) per frame, one a place; ``stars``: (id, other id) for the other dots of the frame's places; ``edges``: (w, p, q) per
    oldest frame between the least ids. Only edges within a place weigh nothing. They come first, so that those with the least id are in the forest; of two
    places' equally heavy edges the one between the least ids comes first.
    """

    def __init__(self, frames: int, back: int, radius: int, reach: int) -> None:
        self.frames, self.back, self.radius, self.reach = frames, back, radius, reach
        self.dots: dict[int, np.ndarray] = {}
        self.stars: dict[int, np.ndarray] = {}
        self.edges: dict[int, np.ndarray] = {}

    def _moved(self, frame: int, at: np.ndarray) -> np.ndarray:
        """Places (id, x, y) with their way from the nearest one within ``reach`` of the latest earlier frame that has one, zero without any."""
        way, left = np.zeros((len(at), 2), np.int64), np.arange(len(at))
        for k in range(1, self.back + 1):
            if frame - k in self.dots and len(left):
                before = Places(self.dots[frame - k])
                n = before.nearest(at[left, 1], at[left, 2], self.reach)
                way[left[n >= 0]] = at[left[n >= 0], 1:3] - before.rows[n[n >= 0], 1:3]
                left = left[n < 0]
        return np.hstack([at, way])

    def _met(self, frame: int, k: int) -> np.ndarray:
        """Edges between the places of ``frame`` and those of frame ``k``, each once."""
        a, b = self.dots[frame], Places(self.dots[k])
        out = [np.empty((0, 3), np.int64)]
        for dx, dy in (step for ring in rings(self.radius) for step in ring):
            if k < frame or (dx, dy) > (0, 0):
                n = b.at(a[:, 1] + dx, a[:, 2] + dy)
                u, v = a[n >= 0], b.rows[n[n >= 0]]
                w = dx * dx + dy * dy + ((u[:, 3:] - v[:, 3:]) ** 2).sum(axis=1) + (frame - k) ** 2
                out.append(np.column_stack([w, np.minimum(u[:, 0], v[:, 0]), np.maximum(u[:, 0], v[:, 0])]))
        return np.vstack(out)

    def add(self, frame: int, dots: Iterable[tuple]) -> np.ndarray:
        """Take in a frame's dots (id, x, y) and return the forest of the last ``frames`` frames as (w, p, q)."""
        d = np.asarray(dots, np.int64).reshape(-1, 3)
        d = d[np.lexsort((d[:, 0], d[:, 2], d[:, 1]))]
        first, again = np.ones(len(d), bool), np.zeros(len(d), bool)
        first[1:] = (d[1:, 1:] != d[:-1, 1:]).any(axis=1)
        again[1:] = ~first[1:] & (d[1:, 0] == d[:-1, 0])
        d, first = d[~again], first[~again]
        new = self._moved(frame, d[first])
        self.dots = {k: v for k, v in self.dots.items() if k > frame - self.back}
        self.stars = {k: v for k, v in self.stars.items() if k > frame - self.frames}
        self.edges = {k: v for k, v in self.edges.items() if k > frame - self.frames}
        self.dots[frame] = new
        self.stars[frame] = np.column_stack([d[first, 0][np.cumsum(first) - 1], d[:, 0]])[~first]
        # an id that is at several places may be joined to them by another of its dots already; all others' stars are in the forest
        live = [self.dots[k][:, 0] for k in self.dots if k > frame - self.frames] + [s[:, 1] for s in self.stars.values()]
        ids, times = np.unique(np.concatenate(live), return_counts=True)
        open_ = {k: np.isin(s[:, 1], ids[times > 1]) for k, s in self.stars.items()}
        own = defaultdict(list)
        for k in range(frame - self.frames + 1, frame + 1):
            if k in self.dots:
                stars = self.stars[k][open_[k]]
                loose = np.column_stack([np.zeros(len(stars), np.int64), stars])
                own[k] = [tuple(e) for e in np.vstack([self.edges.get(k, loose[:0]), self._met(frame, k), loose]).tolist()]
        kept = layers(own)
        self.edges = {k: np.array([e for e in v if e[0]], np.int64).reshape(-1, 3) for k, v in kept.items()}
        forest = np.array(spanning((e for v in kept.values() for e in v), {}), np.int64).reshape(-1, 3)
        stars = np.vstack([s[~open_[k]] for k, s in self.stars.items()])
        return np.vstack([forest, np.column_stack([np.zeros(len(stars), np.int64), stars])])


#: Rows of a batch that are held before they are put into the state.
HELD = 1_000_000


class ForestProcessor(StatefulProcessor):
    """State values are whole frames, or parts of them, as the bytes of their numbers: a frame is read and written once for each frame that it is in the window of."""

    def __init__(self, frames: int, back: int, radius: int, reach: int) -> None:
        self.args = (frames, back, radius, reach)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame int, part int", "dots binary")
        self.parts = handle.getMapState("parts", "frame int", "n int")
        self.window = handle.getMapState("window", "kind string, frame int", "rows binary")
        self.last = handle.getValueState("last", "frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        held, n = [], 0
        for part in rows:
            part = part if last is None else part[part["frame"] > last]
            held.append(part[["frame", "id", "x", "y"]].to_numpy(np.int64))
            n += len(part)
            if n > HELD:
                self._wait(np.vstack(held))
                held, n = [], 0
        if n:
            self._wait(np.vstack(held))
        yield pd.DataFrame()

    def _wait(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        frames, starts = np.unique(rows[:, 0], return_index=True)
        for frame, dots in zip(frames.tolist(), np.split(rows[:, 1:], starts[1:]), strict=True):
            n = self.parts.getValue((frame,))[0] if self.parts.containsKey((frame,)) else 0
            self.waiting.updateValue((frame, n), (dots.tobytes(),))
            self.parts.updateValue((frame,), (n + 1,))
            self.handle.registerTimer((frame + EPOCH) * FRAME_MS)

    def _taken(self, frame: int, parts: int) -> np.ndarray:
        dots = b"".join(bytes(self.waiting.getValue((frame, n))[0]) for n in range(parts))
        for n in range(parts):
            self.waiting.removeKey((frame, n))
        self.parts.removeKey((frame,))
        return np.frombuffer(dots, np.int64).reshape(-1, 3)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = expiredTimerInfo.getExpiryTimeInMs() // FRAME_MS - EPOCH
        ready = sorted((k[0], n[0]) for k, n in list(self.parts.iterator()) if k[0] <= upto)
        if not ready:
            yield pd.DataFrame()
            return
        window = Window(*self.args)
        kinds = {"dots": (window.dots, 5), "stars": (window.stars, 2), "edges": (window.edges, 3)}
        for (kind, frame), rows in list(self.window.iterator()):
            kinds[kind][0][frame] = np.frombuffer(bytes(rows[0]), np.int64).reshape(-1, kinds[kind][1])
        before = {(kind, frame) for kind, (held, _) in kinds.items() for frame in held}
        for frame, parts in ready:
            forest = window.add(frame, self._taken(frame, parts))
            yield pd.DataFrame({"stream": key[0], "frame": frame, "p": forest[:, 1], "q": forest[:, 2], "w": forest[:, 0]})
        now = {(kind, frame): rows for kind in kinds for frame, rows in getattr(window, kind).items()}
        for k in before - set(now):
            self.window.removeKey(k)
        for k, rows in now.items():
            if k not in before or k[0] == "edges":
                self.window.updateValue(k, (rows.tobytes(),))
        self.last.update((ready[-1][0],))

    def close(self) -> None:
        pass


def spanning_forests(dots: DataFrame, frames: int = 3, back: int = 5, radius: int = 5, reach: int = 19, late: str = "0 seconds") -> DataFrame:
    """``stream, frame, p, q, w`` for a stream of dots ``stream, frame, id, x, y`` (whole numbers): per frame the least spanning forest of the dots of
    its last ``frames`` frames.

    Dots within ``radius`` are joined; w is the sum of the squared differences of place, velocity and frame number, ties by ids, p < q. A dot's velocity
    is its way from the nearest dot (ties: the least id) within ``reach`` of the latest of the ``back`` frames before, else zero. Frames are taken
    when the watermark, ``late`` behind the newest frame, reaches them. Rows that repeat count once, rows with nulls are left out. State: the places of
    ``max(frames, back)`` frames per stream, their kept edges, and the ids of the other dots at these places. The session must use the RocksDB state store (``ROCKS``).
    """
    known = dots.select("stream", "frame", "id", "x", "y").dropna()
    known = known.withColumn("at", F.timestamp_millis((F.col("frame").cast("bigint") + EPOCH) * FRAME_MS)).withWatermark("at", late)
    processor = ForestProcessor(frames, max(frames, back), radius, reach)
    return known.groupBy("stream").transformWithStateInPandas(
        processor, "stream string, frame int, p bigint, q bigint, w bigint", outputMode="Append", timeMode="EventTime"
    )
