"""Merges of growing regions against a plain run that grows step by step, and its parts on random graphs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import hierarchy as H
from tessella.operators import stencil as S
from tessella.operators.components import connected_components
from tessella.operators.envelope import COSTS, lower_envelope
from tessella.operators.graph import undirected


def classes(edges, nodes, step):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b, w in edges:
        if w <= step:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def plain_merges(edges, nodes, size):
    out, before = [], classes(edges, nodes, 0)
    for step in sorted({w for *_, w in edges}):
        now = classes(edges, nodes, step)
        parts = defaultdict(set)
        for n in nodes:
            parts[now[n]].add(before[n])
        for merged, names in parts.items():
            if len(names) > 1:
                total = sum(size[n] for n in nodes if now[n] == merged)
                out += [(step, merged, p, sum(size[n] for n in nodes if before[n] == p), total) for p in names]
        before = now
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_merges_with_many_equal_steps(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(1, 40))
    edges = [(*rng.sample(nodes, 2), rng.randint(1, 5)) for _ in range(60)] + [(100 + k, 101 + k, 9 - k) for k in range(6)] + [(200 + k, 201 + k, 1 + k) for k in range(6)]
    nodes += list(range(100, 107)) + list(range(200, 207))
    size = {n: 1 + n % 4 for n in nodes}
    df = undirected(spark.createDataFrame(edges, "src bigint, dst bigint, w int"))
    forest = H.merge_forest(df)
    lines = H.lineages(forest, spark.createDataFrame([(n,) for n in nodes], "id bigint"))
    for step in range(10):
        want = classes(edges, nodes, step)
        live = lines.where(F.col("since") <= step).groupBy("id").agg(F.max_by("name", "since").alias("name")).collect()
        assert {r.id: r.name for r in live} == want
    got = H.merges(forest, lines, spark.createDataFrame(list(size.items()), "id bigint, n bigint")).collect()
    assert sorted(map(tuple, got)) == plain_merges(edges, nodes, size)


def test_no_touches(spark):
    forest = H.merge_forest(spark.createDataFrame([], "src bigint, dst bigint, w int"))
    sources = spark.createDataFrame([(7,)], "id bigint")
    lines = H.lineages(forest, sources)
    assert forest.count() == 0 and [tuple(r) for r in lines.collect()] == [(7, 7, 0)]
    assert H.merges(forest, lines, sources.withColumn("n", F.lit(1))).count() == 0


def plain_growth(seeds, n, eight):
    """Per step the label image of grown cells (8-connected labels for the measure) by growing cell by cell."""
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not i or not j)]
    gen, front, step = {c: 1 for c in seeds}, set(seeds), 1
    while front:
        step += 1
        front = {(x + i, y + j) for x, y in front for i, j in near if 0 <= x + i < n and 0 <= y + j < n} - set(gen)
        gen |= dict.fromkeys(front, step)
    return gen


@pytest.mark.parametrize("eight", [True, False])
def test_growth(spark, eight):
    rng, n = np.random.default_rng(8), 14
    image = rng.random((n, n)) < 0.06
    seeds = [(int(x), int(y)) for y, x in np.argwhere(image)]
    grid = spark.createDataFrame([(0, x, y, int(image[y, x])) for x in range(n) for y in range(n)], "frame int, x int, y int, v int")
    cells = grid.where("v > 0").select("frame", "x", "y", (F.col("y") * n + F.col("x")).cast("bigint").alias("component"))
    regions = H.grown(grid, cells, "v > 0", eight).collect()
    gen = plain_growth(seeds, n, eight)
    assert {(r.x, r.y): r.gen for r in regions} == gen
    assert all(max(abs(r.x - r.source % n), abs(r.y - r.source // n)) + 1 == r.gen if eight else abs(r.x - r.source % n) + abs(r.y - r.source // n) + 1 == r.gen for r in regions)
    df = spark.createDataFrame(regions)
    touches = H.touches(df, eight)
    forest = H.merge_forest(touches)
    ids = [y * n + x for x, y in seeds]
    lines = H.lineages(forest, spark.createDataFrame([(i,) for i in ids], "id bigint"))
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not i or not j]
    for step in range(1, max(gen.values()) + 1):
        grown = {c for c, g in gen.items() if g <= step}
        label = {}
        for c in sorted(grown, key=lambda c: c[1] * n + c[0]):  # flood fill
            if c not in label:
                label[c], stack = c, [c]
                while stack:
                    x, y = stack.pop()
                    for i, j in near:
                        d = (x + i, y + j)
                        if d in grown and d not in label:
                            label[d] = c
                            stack.append(d)
        groups = defaultdict(set)
        for c in seeds:
            groups[label[c]].add(c[1] * n + c[0])
        live = lines.where(F.col("since") <= step).groupBy("id").agg(F.max_by("name", "since").alias("name")).collect()
        got = defaultdict(set)
        for r in live:
            got[r.name].add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and all(k == min(v) for k, v in got.items())
        if eight:
            rings = df.groupBy(F.col("source").alias("id"), "gen").agg(F.count("*").alias("n"))
            known = {r.name: (r.size, r.boundary) for r in H.measures(forest, lines, rings).where(F.col("step") == step).collect()}
            for root, members in groups.items():
                own = [c for c in grown if label[c] == root]
                edge = sum(gen[c] == step for c in own)
                assert known.get(min(members)) == ((len(own), edge) if edge else None)


@pytest.mark.parametrize("cost", sorted(COSTS))
def test_lower_envelope(cost):
    rng = np.random.default_rng(4)
    for trial in range(300):
        n, lines = rng.integers(1, 30), rng.integers(1, 5)
        places = np.sort(rng.choice(60, n, replace=False))
        a = rng.integers(0, 12, (lines, n)).astype(float) if trial % 2 else rng.random((lines, n)) * 15
        a[rng.random((lines, n)) < rng.random()] = np.nan
        spacing = (1.0, 0.5, 2.0)[trial % 3]
        best, which = lower_envelope(a, places, cost, spacing)
        every = COSTS[cost](a[:, :, None], np.abs(places[None, :, None] - places[None, None, :]) * spacing)
        want = np.where(np.isnan(every), np.inf, every).min(axis=1)
        assert np.allclose(np.where(np.isnan(best), np.inf, best), want, atol=1e-9) and ((which < 0) == np.isinf(want)).all()


def test_lower_envelope_is_linear():
    """Work per cell doesn't grow with the length of a line: four times the cells of a line, at most eight times the time."""
    import time

    took = []
    for n in (512, 2048):
        a, began = np.random.default_rng(1).random((256, n)) * 30, time.perf_counter()
        lower_envelope(a, np.arange(n), "l2")
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_lines_of_different_places(spark):
    rows = [(0, 0, y, None if y % 3 else 1.0) for y in range(7)] + [(0, 1, y, 2.0) for y in (5, 1, 9)] + [(0, 2, 4, None)]
    got = S.along(spark.createDataFrame(rows, "frame int, x int, y int, a double"), ["frame", "x"], "y", "a", "l1", keep=("y",)).collect()
    assert {(r.x, r.y): (r.d, r.of_y) for r in got if r.x == 1} == {(1, y): (2.0, y) for y in (1, 5, 9)}
    assert {(r.x, r.y): r.d for r in got if r.x != 1} == {(0, y): 1.0 + min(abs(y - k) for k in (0, 3, 6)) for y in range(7)} | {(2, 4): None}


def test_components_name_is_the_least(spark):
    got = connected_components(spark.createDataFrame([(9, 4), (4, 7)], "a bigint, b bigint"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(4, 4), (7, 4), (9, 4)}
