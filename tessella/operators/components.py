"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.storage import release, stage


FOREST_NODES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a task: each node that isn't a root once, with its root. Bounded: starts anew every FOREST_NODES nodes."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def found() -> pa.RecordBatch:
        rows = [(x, r) for x in list(root) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST_NODES:
            yield found()
            root.clear()
    yield found()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of an edge; component is the smallest id reachable.

    Ids are whole numbers. Rows with a null end are ignored; loops keep their node as its own component.
    Each round is two aggregates and two equi-joins; rounds grow with the logarithm of the longest path.
    """
    given = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    given = stage(given, "edges")
    # REBALANCE lets AQE make tasks of about the advisory size, so that a small graph is one task's union-find
    now = stage(given.where("u <> v").hint("rebalance").mapInArrow(_forest, "u bigint, v bigint").distinct(), "stars")
    for _ in range(max_rounds):
        if _is_star_forest(now):
            break
        before, now = now, stage(_small_star(_large_star(now)), "stars")
        release(before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    star = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(star, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _is_star_forest(e: DataFrame) -> bool:
    """No node has two parents, and no parent has one."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(e.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c = 1 AND p = 1)")
    return odd.isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
