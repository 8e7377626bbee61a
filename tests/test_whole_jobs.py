"""Places where a query once looked at a part of its rows only, on fixtures where the rest matters."""

import datetime
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.operators import aggregates as A
from tessella.operators import kernels
from tessella.plans import catalog
from tessella.sources.bindings import SQL, pixels


def write_events(path, rows):
    """``rows``: (event_id, day, value, user_id)."""
    day0 = datetime.datetime(2024, 1, 1, 12)
    df = pd.DataFrame(rows, columns=["event_id", "day", "value", "user_id"])
    df["ts"] = [day0 + datetime.timedelta(days=int(d)) for d in df.pop("day")]
    df.astype({"event_id": "int64", "value": "float64", "user_id": "int64", "ts": "datetime64[us]"}).to_parquet(f"{path}/events.parquet")
    return str(path)


def test_link_weights_of_far_ids(spark, tmp_path):
    """Three dots with equal displacement: all six ordered pairs are links, however far apart their ids are."""
    starts = [(0, 10, 10), (150, 60, 60), (5000, 110, 110)]
    sf = write_events(tmp_path, [r for i, x, y in starts for r in ((i, 0, x, y), (i + 1, 1, x + 1, y))])
    got = catalog.queries()["link_weights"](spark, sf).collect()
    ids = [i for i, _, _ in starts]
    assert sorted((r.p, r.q, r.p2, r.q2) for r in got) == [(i, i + 1, j, j + 1) for i in ids for j in ids if i != j]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["link_weights"]).fetchall())


def planes(p, triples):
    """The points on the plane of each triple that has all points on one side, and some off it."""
    out = set()
    for i, j, k in triples:
        side = (p - p[i]) @ np.cross(p[j] - p[i], p[k] - p[i])
        if np.any(side) and (np.all(side <= 0) or np.all(side >= 0)):
            out.add(frozenset(np.flatnonzero(side == 0).tolist()))
    return out


def check_hull(p, faces):
    """A closed surface of outward faces that holds all points."""
    for a, b, c in faces:
        assert np.all((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a]) <= 0)
    edges = [e for a, b, c in faces for e in ((a, b), (b, c), (c, a))]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)


def test_hull_3d_of_many_points_in_a_plane():
    rng = np.random.default_rng(1)
    for _ in range(60):
        p = np.unique(rng.integers(0, rng.integers(2, 6), (rng.integers(1, 15), 3)), axis=0)
        faces = kernels.convex_hull_3d(p)
        check_hull(p, faces)
        assert planes(p, faces) == planes(p, combinations(range(len(p)), 3))
    assert len(kernels.convex_hull_3d([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])) == 12


def test_hull_3d_holds_all_cells(spark, sf_dir):
    faces, cells = defaultdict(list), defaultdict(dict)
    for r in catalog.queries()["hull_3d"](spark, sf_dir).collect():
        faces[r.g].append((r.a, r.b, r.c))
    for r in pixels(spark, sf_dir).collect():
        cells[r.frame][r.y * 32 + r.x] = (r.x, r.y, r.v)
    assert set(faces) == set(cells)
    for g, own in cells.items():
        p = np.array([own[i] for i in range(32 * 32)])
        check_hull(p, faces[g])
        assert {0, 31, 32 * 31, 32 * 32 - 1} <= {i for f in faces[g] for i in f}


def moved_in(ring, by):
    """A convex polygon, against the clock, cut by the line of each edge moved inwards."""
    out = ring
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        n = np.array([a[1] - b[1], b[0] - a[0]]) / np.hypot(b[0] - a[0], b[1] - a[1])
        depth = lambda q: (np.array(q) - a) @ n - by  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            dp, dq = depth(p), depth(q)
            if dp >= 0:
                out.append(p)
            if dp * dq < 0:
                out.append(tuple(np.array(p) + dp / (dp - dq) * (np.array(q) - p)))
    return out


def test_offset_polygons_of_all_clusters(spark, sf_dir):
    rings = defaultdict(list)
    for r in catalog.queries()["offset_polygons"](spark, sf_dir).orderBy("k", "ring", "seq").collect():
        rings[r.k, r.ring].append((r.x, r.y))
    dots = defaultdict(set)
    con = duckdb.connect()
    for t, x, y in con.execute(f"WITH {SQL['dots'].replace('events', f'read_parquet({chr(39)}{sf_dir}/events.parquet{chr(39)})')} SELECT t, x, y FROM dots").fetchall():
        dots[t * 100 + x // 50].add((x, y))
    want = {k: kernels.polygon_area(moved_in(kernels.convex_hull(p), 6.0)) for k, p in dots.items() if len(p) >= 3}
    want = {k: a for k, a in want.items() if a > 1e-6}
    got = {k: kernels.polygon_area(ring) for (k, _), ring in rings.items()}
    assert len(got) == len(rings) and len(want) > 10
    assert got == pytest.approx(want, abs=1e-6)


def test_pixels_of_all_days(spark, tmp_path):
    sf = write_events(tmp_path, [(0, -2, 20, 3), (1, 0, 20, 3), (2, 40, 600, 33), (3, 40, 600, 33)])
    got = {(r.frame, r.x, r.y): r.v for r in pixels(spark, sf).collect()}
    assert set(got) == {(t, x, y) for t in range(-2, 41) for x in range(32) for y in range(32)}
    assert {k: v for k, v in got.items() if v} == {(-2, 1, 3): 1, (0, 1, 3): 1, (40, 31, 1): 2}


def test_dominant_candidate_of_tied_sums(spark, tmp_path):
    """Two suppliers' discounts are the same numbers in another order, and their lines lie in many row groups and tasks: the query adds them as a table scan does."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    lines = "SELECT (k % 40)::BIGINT AS l_orderkey, (k // 40 % 3)::BIGINT AS l_suppkey, ((k // 120 * (2 * (k // 40 % 3) + 1) + k % 40) % 11) / 100 AS l_discount FROM range(118800) r(k)"
    con.execute(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = catalog.queries()["dominant_candidate"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["dominant_candidate"]).fetchall())
    shuffled = spark.createDataFrame([(3, 0.25), (2, -1e16), (4, None), (1, 1e16), (0, 1.5)], "i int, v double").repartition(4)
    assert shuffled.agg(A.sum_in_order("v", "i")).first()[0] == 1.5 + 1e16 - 1e16 + 0.25
