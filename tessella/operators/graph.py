"""Iterative graph operators over ``edges(src, dst, w)``: each round is a join and an aggregate over staged tables.

Loops stop at the fixed point. Rounds read the last round's table only, so lineage stays flat and a lost executor costs
one round. Edges keep a total order (w, src, dst), so results don't depend on scan order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.plans.storage import Rounds, release, stage


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, src < dst, the least weight of doubles; loops go."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return e.groupBy("src", "dst").agg(F.min("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one pass."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))))
    out = edges.withColumn("_e", ends).select(F.col("_e.s").alias("src"), F.col("_e.d").alias("dst"), *rest)
    return out.select(*edges.columns)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def without_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end in ``gone`` (column id)."""
    out = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti")
    return out.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def dense_labels(components: DataFrame, key: str | None = None) -> DataFrame:
    """Adds ``label``: 1, 2, ... in the order of the components' least ids, per ``key`` if given.

    Only the distinct components are ranked, not their members.
    """
    keys = [key] if key else []
    names = components.select(*keys, "component").distinct()
    ranked = names.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("component")))
    return components.join(ranked, [*keys, "component"])


FOREST_EDGES = 1_000_000


def _in_forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges u - v, the least first, are in their minimum spanning forest: Boruvka rounds over arrays."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, n = ends[: len(u)], ends[len(u) :], len(nodes)
    comp, left, kept = np.arange(n), np.flatnonzero(u != v), np.zeros(len(u), bool)
    while True:
        a, b = comp[u[left]], comp[v[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return kept
        best = np.full((2, n), len(u))
        # of repeated places the last value stays: backwards, that of the least edge
        best[0, a[::-1]], best[1, b[::-1]] = left[::-1], left[::-1]
        best = best.min(axis=0)
        own = np.flatnonzero(best < len(u))
        kept[best[own]] = True
        up = np.arange(n)
        a, b = comp[u[best[own]]], comp[v[best[own]]]
        up[own] = np.where(a == own, b, a)
        both = own[(up[up[own]] == own) & (own < up[own])]
        up[both] = both
        while not np.array_equal(up, up[up]):
            up = up[up]
        comp = up[comp]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's own edges: an edge that is the largest of a cycle here is so everywhere. Bounded: FOREST_EDGES at a time, and a forest of over
    half of that is given out. Edges without a weight are all given out."""
    held, size = [], 0

    def forest() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        src, dst, w = (t[c].to_numpy() for c in ("src", "dst", "w"))
        order = np.lexsort((dst, src, w))
        return t.take(pa.array(order[_in_forest(src[order], dst[order])]))

    for batch in batches:
        bare = batch["w"].is_null()
        if batch["w"].null_count:
            yield batch.filter(bare)
            batch = batch.filter(batch["w"].is_valid())
        held.append(batch)
        size += len(batch)
        if size > FOREST_EDGES:
            held = forest().to_batches()
            size = sum(map(len, held))
            if size > FOREST_EDGES // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from forest().to_batches()


def minimum_spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``src, dst, w``: Boruvka rounds. Each component picks its least outgoing edge by (w, src, dst); picks are joined by
    connected components. The number of components at least halves each round, and inner edges are dropped as they form. Before, each task
    takes off its edges what isn't in their own forest."""
    once = undirected(edges).select("src", "dst", "w")
    once = once.mapInArrow(_forests, once.schema)
    left = stage(once.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), "msf-edges")
    tree = None
    for _ in range(max_rounds):
        ends = left.select(F.explode(F.array("a", "b")).alias("c"), F.struct("w", "src", "dst", "a", "b").alias("e"))
        picks = stage(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "msf-picks")
        if picks.isEmpty():
            break
        tree = picks.select("src", "dst", "w") if tree is None else tree.union(picks.select("src", "dst", "w"))
        comp = stage(connected_components(picks, "a", "b"), "msf-components")
        named = left.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        named = named.select("src", "dst", "w", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        left = stage(named.where("a <> b"), "msf-edges")
    else:
        raise RuntimeError(f"the forest isn't complete after {max_rounds} rounds")
    return left.select("src", "dst", "w").limit(0) if tree is None else tree


def cut_components(edges: DataFrame, threshold: float) -> DataFrame:
    """Single linkage: components of the edges with w <= threshold; the same as cutting the spanning forest there."""
    return connected_components(edges.where(F.col("w") <= threshold))


def shortest_paths(edges: DataFrame, source: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``id, d, pred``: distances from the rows of ``source`` (column id) along directed edges, by relaxation of changed vertices only."""
    e = stage(edges.select("src", "dst", "w"), "sp-edges")
    known = stage(source.select("id", F.lit(0).cast(edges.schema["w"].dataType).alias("d"), F.lit(None).cast(edges.schema["src"].dataType).alias("pred"), F.lit(True).alias("fresh")), "sp")
    for _ in range(max_rounds):
        fresh = known.where("fresh")
        if fresh.isEmpty():
            return known.select("id", "d", "pred")
        offers = fresh.join(e, fresh["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), F.col("src").alias("pred"))).alias("o"))
        both = known.drop("fresh").join(offers, "id", "full")
        better = F.col("o.d").isNotNull() & (F.col("d").isNull() | (F.col("o.d") < F.col("d")))
        before, known = known, stage(both.select("id", F.when(better, F.col("o.d")).otherwise(F.col("d")).alias("d"), F.when(better, F.col("o.pred")).otherwise(F.col("pred")).alias("pred"), better.alias("fresh")), "sp")
        release(before)
    raise RuntimeError("no fixed point: the graph may have a negative cycle")


def no_negative_cycle(edges: DataFrame, rounds: int) -> DataFrame:
    """One row, ``no_negative_cycle``: true if distances from everywhere settle within ``rounds`` (the number of vertices)."""
    try:
        shortest_paths(edges, vertices(edges), rounds + 1)
        settled = True
    except RuntimeError:
        settled = False
    return edges.sparkSession.range(1).select(F.lit(settled).alias("no_negative_cycle"))


def all_pairs(edges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """``src, dst, d``: min-plus squaring until nothing changes, log2(longest path) rounds. Quadratic output by definition:
    for graphs whose closure fits, such as dimension tables."""
    nodes = vertices(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast("bigint").alias("d"))
    now = stage(edges.select("src", "dst", F.col("w").cast("bigint").alias("d")).union(nodes).groupBy("src", "dst").agg(F.min("d").alias("d")), "apsp")
    mark = None
    for _ in range(max_rounds):
        new = now.agg(F.count("*"), F.sum("d")).first()
        if new == mark:
            return now
        mark = new
        a, b = now.alias("a"), now.alias("b")
        before, now = now, stage(a.join(b, F.col("a.dst") == F.col("b.src")).groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).agg(F.min(F.col("a.d") + F.col("b.d")).alias("d")), "apsp")
        release(before)
    raise RuntimeError("no fixed point")


def levels(edges: DataFrame, seeds: DataFrame, max_level: int = 10_000) -> DataFrame:
    """``id, level``: breadth-first levels from the seeds (column id, level 0) along directed edges; a frontier join and an anti-join a round."""
    e = stage(edges.select("src", "dst").distinct(), "bfs-edges")
    seen = Rounds(edges.sparkSession, "bfs")
    front = seen.add(seeds.select("id", F.lit(0).alias("level")).distinct())
    for k in range(1, max_level + 1):
        reached = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        front = seen.add(reached.join(seen.all().select("id"), "id", "left_anti").select("id", F.lit(k).alias("level")))
        if front.isEmpty():
            return seen.all()
    raise RuntimeError(f"there are levels beyond {max_level}")


def topological_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``id, level``: longest path from a vertex without predecessors; vertices on cycles are left out (Kahn's peeling)."""
    e = stage(edges.select("src", "dst").distinct(), "topo-edges")
    left, out = stage(vertices(e), "topo"), Rounds(edges.sparkSession, "topo-levels")
    for k in range(max_rounds):
        ready = out.add(left.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(k).alias("level")))
        if ready.isEmpty():
            return out.all()
        before = left, e
        left = stage(left.join(ready, "id", "left_anti"), "topo")
        e = stage(e.join(ready.select(F.col("id").alias("src")), "src", "left_anti"), "topo-edges")
        for old in before:
            release(old)
    raise RuntimeError(f"there are levels beyond {max_rounds}")


def strong_components(edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``id, component`` (least member). Colouring: the largest id that reaches a vertex is its colour; what reaches the
    colour's own vertex backwards within the colour is its component; the rest goes on."""
    e = stage(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    left = stage(vertices(edges), "scc")
    done = Rounds(edges.sparkSession, "scc-found")
    done.add(left.select("id", F.col("id").alias("c")).limit(0))
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        colour = stage(left.select("id", F.col("id").alias("c")), "scc-colour")
        mark = None
        while mark != (mark := colour.agg(F.sum("c")).first()[0]):
            sent = e.join(colour, e["src"] == colour["id"]).select(F.col("dst").alias("id"), "c")
            old, colour = colour, stage(colour.union(sent).groupBy("id").agg(F.max("c").alias("c")), "scc-colour")
            release(old)
        src, dst = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inner = stage(e.join(src, "src").join(dst, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-inner")
        back = levels(inner, colour.where("id = c").select("id"))
        found = done.add(back.join(colour, "id").select("id", "c"))
        before = left, e, colour, inner
        left = stage(left.join(found, "id", "left_anti"), "scc")
        e = stage(without_vertices(e, found.select("id")), "scc-edges")
        for old in before:
            release(old)
    else:
        raise RuntimeError(f"vertices are left after {max_rounds} rounds")
    done = done.all()
    least = done.groupBy("c").agg(F.min("id").alias("component"))
    return done.join(least, "c").select("id", "component")


def steepest_next(pairs: DataFrame) -> DataFrame:
    """``id, next``: of ``pairs(id, other, d, d_other)`` the neighbour with the largest d_other above d, ties by least id."""
    up = pairs.where("d_other > d")
    return up.groupBy("id").agg(F.min_by("other", F.struct((-F.col("d_other")).alias("d"), "other")).alias("next"))


def follow(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``id, root, steps``: where the pointers (id, next) end, by pointer doubling: log2(longest chain) rounds."""
    ends = pointers.select(F.col("next").alias("id")).distinct().join(pointers.select("id"), "id", "left_anti")
    now = stage(pointers.select("id", F.col("next").alias("root"), F.lit(1).alias("steps")).union(ends.select("id", "id", F.lit(0))), "follow")
    for _ in range(max_rounds):
        a, b = now.alias("a"), now.alias("b")
        far = stage(a.join(b, F.col("a.root") == F.col("b.id")).select("a.id", "b.root", (F.col("a.steps") + F.col("b.steps")).alias("steps")), "follow")
        if far.agg(F.sum("steps")).first() == now.agg(F.sum("steps")).first():
            return far
        now = far
    raise RuntimeError("the pointers form a cycle")


def grow(cells: DataFrame, width: int, height: int, steps: list[tuple[int, int]], max_iter: int) -> DataFrame:
    """``frame, x, y, gen``: the iteration in which region growing reaches each empty cell (seeds: 1). Border seeds don't spread."""
    from tessella.operators.stencil import border, moved

    seen = Rounds(cells.sparkSession, "grow")
    seeds = seen.add(cells.select("frame", "x", "y", F.lit(1).alias("gen")).distinct())
    front = seeds.where(~border(F.col("x"), F.col("y"), width, height))
    for k in range(2, max_iter + 2):
        inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
        reached = moved(front, steps).where(inside).select("frame", "x", "y").distinct()
        front = seen.add(reached.join(seen.all(), ["frame", "x", "y"], "left_anti").withColumn("gen", F.lit(k)))
        if front.isEmpty():
            break
    return seen.all()


def flow_down(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id, saliency``: 1 at the ``start`` vertices; elsewhere the sum over ascendants of saliency / descendants, level by level."""
    e = stage(edges.select("src", "dst").distinct(), "flow-edges")
    degree = e.groupBy("src").agg(F.count("*").alias("n"))
    level = topological_levels(e)
    e = stage(e.join(degree, "src").join(level.select(F.col("id").alias("dst"), "level"), "dst").select("src", "dst", "n", "level"), "flow-edges")
    out = Rounds(edges.sparkSession, "flow")
    now = out.add(start.select("id", F.lit(1.0).alias("saliency")).distinct())
    top = e.agg(F.max("level")).first()[0] or 0
    for k in range(1, top + 1):
        ready = e.where(F.col("level") == k)
        new = ready.join(out.all(), F.col("src") == F.col("id"), "left").groupBy("dst").agg(F.sum(F.coalesce("saliency", F.lit(0.0)) / F.col("n")).alias("saliency"))
        new = new.select(F.col("dst").alias("id"), "saliency").join(now.select("id"), "id", "left_anti")
        out.add(new)
    return out.all()


def merge_events(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, merged, parts``: components that are joined from several of the threshold before (a dendrogram by levels)."""
    out, before = None, None
    for t in thresholds:
        now = stage(cut_components(edges, t), "dendrogram")
        if before is not None:
            parts = now.join(before.select("node", F.col("component").alias("old")), "node", "left").groupBy("component").agg(F.count_distinct(F.coalesce("old", "node")).alias("parts"))
            new = parts.where("parts > 1").select(F.lit(float(t)).alias("threshold"), F.col("component").alias("merged"), "parts")
            out = new if out is None else out.unionByName(new)
        before = now
    return out


def ancestors(links: DataFrame, depth: int) -> DataFrame:
    """``id, gen, anc``: distinct ancestors up to ``depth`` generations (gen 0: the vertex itself) over links (id, asc).

    Each generation is staged, so depth doesn't pile joins upon joins; it stops when a generation is empty.
    """
    links = stage(links.select("id", "asc").distinct(), "links")
    up = links.select(F.col("id").alias("anc"), "asc")
    out = Rounds(links.sparkSession, "ancestors")
    now = out.add(links.select("id").union(links.select("asc")).distinct().select("id", F.lit(0).alias("gen"), F.col("id").alias("anc")))
    for k in range(1, depth):
        now = out.add(now.join(up, "anc").select("id", F.lit(k).alias("gen"), F.col("asc").alias("anc")).distinct())
        if now.isEmpty():
            break
    return out.all()
