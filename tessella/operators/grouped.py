"""Order-dependent kernels over groups: ``applyInPandas`` keyed by frame, cluster or contour.

A group is one small object by construction (a frame's cluster, a contour); shuffles are on the group's key only. Where groups are many and
small (contours), they come as rows of arrays, so that Python is called once for a batch of them (``_each``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import kernels as K

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _xy(g: pd.DataFrame, *order: str) -> np.ndarray:
    return g.sort_values(list(order))[["x", "y"]].to_numpy(float)


def _each(df: DataFrame, key: str, columns: list[str], f: Callable, schema: str) -> DataFrame:
    """The rows that ``f(key, *columns)`` gives for each group, from lists of the group's values in the order of the columns; nulls are NaN."""
    held = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_g"))
    kinds = [c.split() for c in schema.split(", ")]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        g = b["_g"]
        ends, flat = g.offsets.to_pylist(), [g.values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(len(columns))]
        rows = [r for k, lo, hi in zip(b[key].to_pylist(), ends, ends[1:], strict=False) for r in f(k, *(c[lo:hi] for c in flat))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return held.mapInArrow(lambda batches: map(batch, batches), schema)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by key in as many partitions as shuffles have: kernels take long over few rows, which by their size would come to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def of_places(points: DataFrame, key: str, *columns) -> DataFrame:
    """``key, x, y``, the given aggregates: each place of a group once. Kernels to which a place counts once get these, so that Python sees no copies."""
    at = points.groupBy(key, "x", "y")
    return _spread(at.agg(*columns) if columns else points.select(key, "x", "y").distinct(), key)


def hull_points(points: DataFrame, key: str) -> DataFrame:
    """``key, seq, x, y``: hull vertices in order."""

    def f(k, g):
        h = K.convex_hull(g[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: k[0], "seq": range(len(h)), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    return of_places(points, key).groupBy(key).applyInPandas(f, f"{key} bigint, seq bigint, x double, y double")


def hull_density(points: DataFrame, key: str) -> DataFrame:
    """``key, n, density, area, n_hull``; density is n / area, null without area."""

    def f(k, g):
        h = K.convex_hull(g[["x", "y"]].to_numpy(float))
        a = K.polygon_area(h)
        return pd.DataFrame({key: [k[0]], "n": [g["n"].sum()], "density": [g["n"].sum() / a if a else None], "area": [a], "n_hull": [len(h)]})

    return of_places(points, key, F.count("*").alias("n")).groupBy(key).applyInPandas(f, f"{key} bigint, n bigint, density double, area double, n_hull bigint")


def triangulate(points: DataFrame, key: str) -> DataFrame:
    """``key, a, b, c``: Delaunay triangles by point id (a < b < c); points at one place count once."""

    def f(k, g):
        g = g.sort_values("id")
        ids = g["id"].to_numpy()
        rows = [tuple(sorted(int(ids[i]) for i in t)) for t in K.delaunay(g[["x", "y"]].to_numpy(float))]
        return pd.DataFrame(rows, columns=["a", "b", "c"]).assign(**{key: k[0]})[[key, "a", "b", "c"]]

    return of_places(points, key, F.min("id").alias("id")).groupBy(key).applyInPandas(f, f"{key} bigint, a bigint, b bigint, c bigint")


def convexity_measure(points: DataFrame, key: str, max_gap: float) -> DataFrame:
    def f(k, g):
        return pd.DataFrame({key: [k[0]], "convexity": [K.convexity(_xy(g, "x", "y"), max_gap)]})

    return of_places(points, key).groupBy(key).applyInPandas(f, f"{key} bigint, convexity double")


def optimal_assignment(costs: DataFrame, key: str, rows: str, cols: str, cost: str, missing: float = 1e4) -> DataFrame:
    """``key, row, col, cost``: least total cost one to one; absent pairs cost ``missing`` and aren't given out."""

    def f(k, g):
        r, c = sorted(g["r"].unique()), sorted(g["c"].unique())
        m = np.full((len(r), len(c)), missing)
        m[np.searchsorted(r, g["r"]), np.searchsorted(c, g["c"])] = g["w"]
        out = [(k[0], r[i], c[j], m[i, j]) for i, j in enumerate(K.assignment(m)[0]) if j >= 0 and m[i, j] < missing]
        return pd.DataFrame(out, columns=[key, "row", "col", "cost"])

    named = costs.selectExpr(key, f"`{rows}` AS r", f"`{cols}` AS c", f"`{cost}` AS w")
    return _spread(named, key).groupBy(key).applyInPandas(f, f"{key} bigint, row bigint, col bigint, cost double")


def warping_cost(pairs: DataFrame, key: str) -> DataFrame:
    """``key, cost``: dynamic time warping between the two sides (column side 0 / 1) of each key, points in the order of seq."""

    def f(k, side, seq, x, y):
        n = side.count(0)
        p = list(zip(x, y, strict=True))
        return [(k, K.dtw(p[:n], p[n:]) if 0 < n < len(p) else None)]

    return _each(pairs.where("side IN (0, 1)"), key, ["side", "seq", "x", "y"], f, f"{key} bigint, cost double")


def alignment_cost(pairs: DataFrame, key: str, skip: float, repeat: float, score) -> DataFrame:
    """``key, cost`` of aligning symbol sequences (columns side, seq, symbol); ``score`` is any function of two symbols."""

    def f(k, side, seq, symbol):
        n = side.count(0)
        return [(k, float(K.align(symbol[:n], symbol[n:], skip, repeat, score)) if 0 < n < len(symbol) else None)]

    return _each(pairs.where("side IN (0, 1)"), key, ["side", "seq", "symbol"], f, f"{key} bigint, cost double")


def thinned(grid: DataFrame, v: str = "v") -> DataFrame:
    """``frame, x, y, v``: each frame after two thinning passes in scan order."""

    def f(k, g):
        image = np.zeros((g["y"].max() + 1, g["x"].max() + 1))
        image[g["y"], g["x"]] = g["v"]
        return g.assign(v=K.thin(image)[g["y"], g["x"]])[["frame", "x", "y", "v"]]

    return grid.selectExpr("frame", "x", "y", f"CAST({v} AS DOUBLE) AS v").groupBy("frame").applyInPandas(f, "frame int, x int, y int, v double")


def canny_tracks(edges: DataFrame, ratio: float, min_length: int = 2) -> DataFrame:
    """``frame, track, seq, x, y``: hysteresis tracks of suppressed magnitudes ``kept`` with ``dx, dy`` and the frame's ``threshold``."""

    def f(k, g):
        shape = (g["y"].max() + 1, g["x"].max() + 1)
        mag, dx, dy = (np.zeros(shape) for _ in range(3))
        for a, c in ((mag, "kept"), (dx, "dx"), (dy, "dy")):
            a[g["y"], g["x"]] = g[c]
        high = float(g["threshold"].iloc[0])
        rows = [(k[0], t, s, x, y) for t, track in enumerate(K.edge_tracks(mag, dx, dy, high, high * ratio, min_length)) for s, (x, y) in enumerate(track)]
        return pd.DataFrame(rows, columns=["frame", "track", "seq", "x", "y"])

    return edges.select("frame", "x", "y", "kept", "dx", "dy", "threshold").groupBy("frame").applyInPandas(f, "frame int, track int, seq int, x int, y int")


def contour_sequence(cells: DataFrame, key: str) -> DataFrame:
    """``key, seq, x, y, error``: boundary cells of a region in walking order."""

    def f(k, g):
        path, error = K.follow_contour(zip(g["x"], g["y"], strict=True))
        return pd.DataFrame({key: k[0], "seq": range(len(path)), "x": [p[0] for p in path], "y": [p[1] for p in path], "error": error})

    return cells.select(key, "x", "y").groupBy(key).applyInPandas(f, f"{key} bigint, seq bigint, x int, y int, error int")


def max_flow(edges: DataFrame, key: str, source: int, sink: int) -> DataFrame:
    """``key, flow, cut_size``: largest flow between two vertices of each graph and the vertices on the source's side of a least cut."""

    def f(k, g):
        flow, side = K.max_flow(list(zip(g["src"], g["dst"], g["w"], strict=True)), source, sink)
        return pd.DataFrame({key: [k[0]], "flow": [float(flow)], "cut_size": [len(side)]})

    return edges.select(key, "src", "dst", "w").groupBy(key).applyInPandas(f, f"{key} bigint, flow double, cut_size bigint")


def depth_first(edges: DataFrame, key: str) -> DataFrame:
    """``key, id, discovered, finished, parent``."""

    def f(k, g):
        d = K.depth_first(zip(g["src"], g["dst"], strict=True))
        return pd.DataFrame([(k[0], n, a, b, p) for n, (a, b, p) in d.items()], columns=[key, "id", "discovered", "finished", "parent"]).astype({"parent": "Int64"})

    return edges.select(key, "src", "dst").groupBy(key).applyInPandas(f, f"{key} bigint, id bigint, discovered int, finished int, parent bigint")


def agglomerated(branches: DataFrame, thres: float, rate: float = 0.8, rounds: int = 5) -> DataFrame:
    """``frame, branch, grp``: branches (cx, cy, vx, vy, n) merged greedily per frame; grp is the least branch of the group."""

    def f(k, g):
        g = g.sort_values("branch")
        group = K.agglomerate(g[["cx", "cy"]], g[["vx", "vy"]], g["n"], thres, rate, rounds)
        return pd.DataFrame({"frame": k[0], "branch": g["branch"], "grp": g["branch"].to_numpy()[group]})

    return branches.select("frame", "branch", "cx", "cy", "vx", "vy", "n").groupBy("frame").applyInPandas(f, "frame int, branch bigint, grp bigint")


def smoothed(contours: DataFrame, rounds: int, weight: float = 0.5, closed: bool = False) -> DataFrame:
    def f(k, seq, x, y):
        return [(k, s, *p) for s, p in zip(seq, K.smooth_contour(list(zip(x, y, strict=True)), rounds, weight, closed).tolist(), strict=True)]

    return _each(contours, "contour_id", ["seq", "x", "y"], f, "contour_id bigint, seq bigint, x double, y double")


def fitted_circles(points: DataFrame, key: str) -> DataFrame:
    """``key, cx, cy, r, rss`` by geometric least squares; groups of fewer than three places are left out."""

    def f(k, g):
        p = _xy(g, "x", "y")
        rows = [(k[0], *K.fit_circle(p))] if len(p) >= 3 else []
        return pd.DataFrame(rows, columns=[key, "cx", "cy", "r", "rss"])

    return of_places(points, key).groupBy(key).applyInPandas(f, f"{key} bigint, cx double, cy double, r double, rss double")


def offset_rings(polygons: DataFrame, key: str, until: float) -> DataFrame:
    """``key, ring, seq, x, y``: the polygons (seq, x, y) after their edges have moved inwards by ``until``."""

    def f(k, g):
        rows = [(k[0], r, s, float(x), float(y)) for r, ring in enumerate(K.offset_polygon(_xy(g, "seq"), until)) for s, (x, y) in enumerate(ring)]
        return pd.DataFrame(rows, columns=[key, "ring", "seq", "x", "y"])

    return polygons.select(key, "seq", "x", "y").groupBy(key).applyInPandas(f, f"{key} bigint, ring int, seq int, x double, y double")


def triangulated_polygons(polygons: DataFrame, key: str) -> DataFrame:
    """``key, triangles, area``: ear clipping of ordered polygons and the triangles' area."""

    def f(k, seq, x, y):
        p = list(zip(x, y, strict=True))
        t = K.ear_clip(p)
        return [(k, len(t), float(sum(K.triangle_area(*(p[i] for i in c)) for c in t)))]

    return _each(polygons, key, ["seq", "x", "y"], f, f"{key} bigint, triangles bigint, area double")


def overlaps(pairs: DataFrame, key: str) -> DataFrame:
    """``key, area``: common area of two ordered polygons (column side 0 / 1) per key."""

    def f(k, g):
        a, b = ([tuple(q) for q in _xy(g[g["side"] == s], "seq")] for s in (0, 1))
        return pd.DataFrame({key: [k[0]], "area": [K.polygon_overlap(a, b)]})

    return pairs.select(key, "side", "seq", "x", "y").groupBy(key).applyInPandas(f, f"{key} bigint, area double")


def hulls_3d(points: DataFrame, key: str) -> DataFrame:
    """``key, a, b, c``: faces of the hull of points (id, x, y, z), by id."""

    def f(k, g):
        g = g.sort_values("id").drop_duplicates(["x", "y", "z"])
        ids = g["id"].to_numpy()
        rows = [(k[0], *(int(ids[i]) for i in t)) for t in K.convex_hull_3d(g[["x", "y", "z"]].to_numpy(float))]
        return pd.DataFrame(rows, columns=[key, "a", "b", "c"])

    return points.select(key, "id", "x", "y", "z").groupBy(key).applyInPandas(f, f"{key} bigint, a bigint, b bigint, c bigint")
