"""How regions merge as they grow: a forest of merges, made by contraction, and what hangs on its nodes.

All regions grow by one ring of cells a step. Two touch at the step at which neighbouring cells of both are reached, so merging is single linkage
over these steps, and a spanning forest of the touches holds all of it. The merged region takes the name of its least member (the others
end). The forest of ends is made by contracting edges that are the earliest of both their regions; a round does that everywhere at
once, whatever the steps. What a region has at a step is added up over the lineages of its members, never over all steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import stencil as S
from tessella.operators.components import connected_components
from tessella.operators.graph import follow, minimum_spanning_forest
from tessella.plans.storage import release, stage


def grown(grid: DataFrame, members: DataFrame, seed: str, eight: bool = True) -> DataFrame:
    """``frame, x, y, gen, source``: the step (seeds: 1) at which growth reaches each cell of ``grid``, and a component that it is reached from.

    ``members``: frame, x, y, component of the seed cells, which are those where ``seed`` holds. Cells of frames without seeds are left out.
    """
    near = S.nearest_seeds(grid, "linf" if eight else "l1", seed)
    of = members.select("frame", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("component").alias("source"))
    return near.join(of, ["frame", "sx", "sy"]).select("frame", "x", "y", (F.col("d") + 1).cast("int").alias("gen"), "source")


def touches(regions: DataFrame, eight: bool = True) -> DataFrame:
    """``src, dst, w``: the step at which each two sources touch first, from cells ``frame, x, y, gen, source``."""
    sent = S.moved(regions, S.offsets(2, "causal" if eight else "causal_four"), ("gen", "source"))
    here = regions.select("frame", "x", "y", F.col("gen").alias("g"), F.col("source").alias("s"))
    both = sent.join(here, ["frame", "x", "y"]).where("source <> s")
    return both.groupBy(F.least("source", "s").alias("src"), F.greatest("source", "s").alias("dst")).agg(F.min(F.greatest("gen", "g")).alias("w"))


def merge_forest(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``id, into, step``: the step at which each region ends, and the least member of the region that it goes into; regions that never end are left out.

    ``edges``: src, dst, w. Regions that merge at one step go into one, however many they are.
    """
    left = stage(minimum_spanning_forest(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), "touches")
    ended = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        first = left.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.min("w").alias("first"))
        first = stage(first, "first-touches")
        named = left.join(first.select(F.col("c").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("c").alias("b"), F.col("first").alias("fb")), "b")
        comp = stage(connected_components(named.where("w = fa AND w = fb").select("a", "b"), "a", "b"), "merged")
        gone = comp.where("node <> component").join(first, F.col("node") == F.col("c")).select(F.col("node").alias("id"), F.col("component").alias("into"), F.col("first").alias("step"))
        before, ended = ended, stage(gone if ended is None else ended.unionByName(gone), "merge-forest")
        renamed = left.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        renamed = renamed.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "w").where("a <> b")
        old, left = left, stage(renamed, "touches")
        for done in (old, first, comp, before):
            if done is not None:
                release(done)
    else:
        raise RuntimeError(f"regions are left after {max_rounds} rounds")
    if ended is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("into"), F.col("w").alias("step"))
    # what merges at one step may do so in several rounds: go on to the last of them
    two = ended.select(F.col("id").alias("into"), F.col("step").alias("next_step"))
    same = ended.join(two, "into").where("step = next_step").select("id", F.col("into").alias("next"))
    if same.isEmpty():
        return ended
    last = follow(same).select("id", "root").join(ended.select(F.col("id").alias("root"), F.col("into").alias("last")), "root").select("id", "last")
    return stage(ended.join(last, "id", "left").select("id", F.coalesce("last", "into").alias("into"), "step"), "merge-forest")


def lineages(forest: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, name, since``: the names that each source (column id) goes by and the step from which on it does (its own: 0), by doubling."""
    every = stage(sources.select("id", F.col("id").alias("name"), F.lit(0).alias("since"), F.lit(0).alias("far")), "lineages")
    every, size = stage(every.unionByName(forest.select("id", F.col("into").alias("name"), F.col("step").cast("int").alias("since"), F.lit(1).alias("far"))), "lineages"), 1
    while not (edge := every.where(F.col("far") == size)).isEmpty():
        ahead = every.where("far > 0").select(F.col("id").alias("name"), F.col("name").alias("next"), F.col("since").alias("then"), F.col("far").alias("more"))
        farther = edge.join(ahead, "name").select("id", F.col("next").alias("name"), F.col("then").alias("since"), (F.col("far") + F.col("more")).alias("far"))
        old, every, size = every, stage(every.unionByName(farther), "lineages"), 2 * size
        release(old)
    return every.select("id", "name", "since")


def merges(forest: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """``step, merged, part, n_part, n_merged``: every region that takes part in a merge, with what it had before and all had after.

    ``sizes``: id, n of each source. The part that gives its name is a row as well.
    """
    entered = lines.join(sizes, "id").groupBy("name", "since").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("name").orderBy("since")
    entered = stage(entered.select("name", "since", "n", F.sum("n").over(by).alias("upto")), "entered")
    whole = entered.groupBy("name").agg(F.max("upto").alias("n_part"))
    ended = forest.select(F.col("step").cast("int").alias("step"), F.col("into").alias("merged"), F.col("id").alias("part")).join(whole.withColumnRenamed("name", "part"), "part")
    after = entered.where("since > 0").select(F.col("since").alias("step"), F.col("name").alias("merged"), F.col("n"), F.col("upto").alias("n_merged"))
    lasting = after.select("step", "merged", F.col("merged").alias("part"), (F.col("n_merged") - F.col("n")).alias("n_part"), "n_merged")
    return ended.join(after.drop("n"), ["step", "merged"]).select("step", "merged", "part", "n_part", "n_merged").unionByName(lasting)


def measures(forest: DataFrame, lines: DataFrame, rings: DataFrame) -> DataFrame:
    """``name, step, size, boundary, measure`` of regions at the steps at which they have a boundary: cells reached so far, cells reached at the step,
    and sqrt(2 pi size) / boundary. ``rings``: id, gen, n of each source. A region's steps are those before it ends."""
    ends = forest.select(F.col("id").alias("name"), F.col("step").alias("ends"))
    cells = lines.join(rings, "id").join(ends, "name", "left")
    cells = cells.withColumn("step", F.greatest("since", "gen")).where("ends IS NULL OR step < ends")
    per = cells.groupBy("name", "step").agg(F.sum("n").alias("came"), F.sum(F.when(F.col("gen") == F.col("step"), F.col("n"))).alias("boundary"))
    by = Window.partitionBy("name").orderBy("step")
    per = per.withColumn("size", F.sum("came").over(by)).where("boundary IS NOT NULL")
    return per.select("name", "step", "size", "boundary", (F.sqrt(2 * F.pi() * F.col("size")) / F.col("boundary")).alias("measure"))


def saved_regions(forest: DataFrame, lines: DataFrame, rings: DataFrame, threshold: float) -> DataFrame:
    """``name, step, size, boundary, measure``: regions at the step before they merge, whose measure is over the threshold and over that of
    the region that they merge into. A region without a boundary at its step has no measure and isn't saved, nor are those that merge into one."""
    known = stage(measures(forest, lines, rings), "measures")
    ended = forest.select(F.col("id").alias("name"), "into", F.col("step").cast("int").alias("at"))
    lasting = forest.select(F.col("into").alias("name"), "into", F.col("step").cast("int").alias("at")).distinct()
    parts = ended.unionByName(lasting).withColumn("step", F.col("at") - 1)
    after = known.select(F.col("name").alias("into"), F.col("step").alias("at"), F.col("measure").alias("after"))
    found = parts.join(known, ["name", "step"]).join(after, ["into", "at"])
    return found.where((F.col("measure") > threshold) & (F.col("measure") > F.col("after"))).select("name", "step", "size", "boundary", "measure")
