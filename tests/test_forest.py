"""The streaming forest against forests computed anew, over one batch and over many."""

import random

from pyspark.sql import functions as F

from tessella.streaming import forest, frames


def plain_forests(rows, window=3, back=5, radius=5, reach=19):
    """(frame, p, q, w) of one stream's rows (frame, id, x, y), each frame by itself."""
    place = {i: (f, x, y) for f, i, x, y in rows}
    moved = {}
    for i, (f, x, y) in place.items():
        near = [(f - g, (x - u) ** 2 + (y - v) ** 2, j) for j, (g, u, v) in place.items() if f - back <= g < f and (x - u) ** 2 + (y - v) ** 2 <= reach * reach]
        j = min(near, default=(0, 0, i))[2]
        moved[i] = (x - place[j][1], y - place[j][2])
    out = []
    for f in sorted({f for f, *_ in place.values()}):
        live = sorted(i for i, (g, *_) in place.items() if f - window < g <= f)
        edges = []
        for a in live:
            for b in live:
                (g, x, y), (h, u, v) = place[a], place[b]
                if a < b and (x - u) ** 2 + (y - v) ** 2 <= radius * radius:
                    (dx, dy), (du, dv) = moved[a], moved[b]
                    edges.append(((x - u) ** 2 + (y - v) ** 2 + (dx - du) ** 2 + (dy - dv) ** 2 + (g - h) ** 2, a, b))
        root = {i: i for i in live}
        for w, a, b in sorted(edges):
            if root[a] != root[b]:
                old, new = root[a], root[b]
                root = {k: new if r == old else r for k, r in root.items()}
                out.append((f, a, b, w))
    return sorted(out)


def drawn(seed, frames_=9, dots=14, size=26):
    rng = random.Random(seed)
    return [(f, 100 * f + k, rng.randrange(size), rng.randrange(size)) for f in range(frames_) if f != 4 for k in range(rng.randrange(dots))]


def test_layers_keep_what_later_forests_need():
    for seed in range(40):
        rows = drawn(seed)
        window, got = forest.Window(3, 5, 5, 19), []
        for f in sorted({r[0] for r in rows}):
            got += [(f, p, q, w) for w, p, q in window.add(f, [r[1:] for r in rows if r[0] == f])]
            assert sum(map(len, window.edges.values())) <= 3 * sum(len(v) for k, v in window.dots.items() if k > f - 3)
        assert sorted(got) == plain_forests(rows)


def test_window_holds_places():
    """Dots at few places: state and edges grow with the places; ids that are at several places count as one dot."""
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(f, 100 * f + k, rng.randrange(3) * 4, rng.randrange(2) * 9) for f in range(5) for k in range(40)]
        window, got = forest.Window(3, 5, 5, 19), []
        for f in range(5):
            got += [(f, p, q, w) for w, p, q in window.add(f, [r[1:] for r in rows if r[0] == f])]
            assert all(len(v) <= 6 for v in window.dots.values()) and all(len(v) <= 6 * 3 for v in window.edges.values())
        assert sorted(got) == plain_forests(rows)
    window = forest.Window(3, 5, 5, 19)
    assert sorted(map(tuple, window.add(0, [(5, 0, 0), (7, 0, 0), (9, 0, 0), (7, 4, 0), (9, 4, 0)]))) == [(0, 5, 7), (0, 5, 9)]
    assert sorted(map(tuple, window.add(1, [(7, 0, 0), (8, 0, 0)]))) == [(0, 5, 7), (0, 5, 9), (0, 7, 8)]


def test_forest_of_a_crowd():
    """Twenty thousand dots at two places of a frame, in seconds: pairs of them were 200 million."""
    dots = [(k, 4 * (k % 2), 0) for k in range(20_000)]
    forest_ = forest.Window(3, 5, 5, 19).add(0, dots)
    assert sorted(map(tuple, forest_.tolist())) == sorted([(0, k % 2, k) for k in range(2, 20_000)] + [(16, 0, 1)])


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_many_batches(spark, tmp_path):
    """A file a frame and batch; the second stream has repeated rows, nulls, frames before zero and one that comes late."""
    schema = "stream string, frame int, id bigint, x int, y int"
    a, b = drawn(1), [(f - 5, i, x, y) for f, i, x, y in drawn(2)]
    for f in range(-5, 9):
        rows = [("a", *r) for r in a if r[0] == f] + [("b", *r) for r in b if r[0] == f] * 2 + [("b", f, None, 1, 1), (None, f, 5, 1, 1)]
        if f == 8:
            rows.append(("b", -5, 77, 0, 0))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "dots"))
    found = frames.run_once(forest.spanning_forests(stream(spark, str(tmp_path / "dots"), schema)), "append", forest.ROCKS)
    got = found.where(F.col("stream") == "a").select("frame", "p", "q", "w").collect()
    assert sorted(map(tuple, got)) == plain_forests(a)
    got = found.where(F.col("stream") == "b").select("frame", "p", "q", "w").collect()
    assert sorted(map(tuple, got)) == plain_forests(b)
    assert spark.conf.get(frames.STORE_KEY) != forest.ROCKS
