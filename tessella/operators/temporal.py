"""Temporal grouping of dots: branches, links between frames, velocities, and labels of what moves together.

All frames go through each step together; the only per-frame order is the link to the frame before. Matching starts from
zero velocity (every frame's links can be found at once), velocities follow from the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators import joins as J
from tessella.operators.components import connected_components
from tessella.operators.graph import ancestors, dense_labels
from tessella.plans.storage import stage


def branches(dots: DataFrame, dist_thres: float) -> DataFrame:
    """``dots`` (id, x, y, frame) with ``branch``: the least id of the dots of the frame reachable in steps up to ``dist_thres``."""
    return stage(J.point_components(dots, dist_thres, "branch"), "branches")


def summaries(dots: DataFrame) -> DataFrame:
    """``frame, branch, n, cx, cy, laxis, saxis, theta, rep``: centre, principal axes and the dot nearest to the centre."""
    g = A.principal_axes(dots.groupBy("frame", "branch").agg(*A.scatter()))
    far = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    rep = dots.join(g.select("frame", "branch", "cx", "cy"), ["frame", "branch"]).groupBy("frame", "branch").agg(F.min(F.struct(far.alias("far"), "id")).alias("r"))
    return g.join(rep.select("frame", "branch", F.col("r.id").alias("rep")), ["frame", "branch"])


def frame_pairs(dots: DataFrame, dist_thres: float) -> DataFrame:
    """``asc, branch, p, q, d2, px, py``: dots p of a frame and q of the next one that are nearer than ``dist_thres``, with their branches; of dots at one place
    the least. Written once: links and velocities are aggregates of it."""
    at = stage(J.places(dots, ("frame", "branch")), "places")
    before = at.withColumn("frame", F.col("frame") + 1)
    found = J.range_join(before, at, dist_thres, condition=J.d2("a", "b") < float(dist_thres * dist_thres))
    return stage(found.select(F.col("a.branch").alias("asc"), F.col("b.branch").alias("branch"), F.col("a.id").alias("p"), F.col("b.id").alias("q"), J.d2("a", "b").alias("d2"), F.col("a.x").alias("px"), F.col("a.y").alias("py")), "frame-pairs")


def links(dots: DataFrame, dist_thres: float, pairs: DataFrame | None = None) -> DataFrame:
    """``asc, branch``: branches of following frames where all dots of one have a dot of the other nearer than ``dist_thres``."""
    pairs = frame_pairs(dots, dist_thres) if pairs is None else pairs
    met = pairs.groupBy("asc", "branch").agg(F.count_distinct("p").alias("ps"), F.count_distinct("q").alias("qs"))
    size = J.places(dots, ("frame", "branch")).groupBy("branch").agg(F.count("*").alias("n"))
    met = met.join(size.select(F.col("branch").alias("asc"), F.col("n").alias("n_asc")), "asc").join(size, "branch")
    return stage(met.where("ps = n_asc OR qs = n").select("asc", "branch"), "links")


def split_merged(dots: DataFrame, dist_thres: float) -> DataFrame:
    """``id, x, y, frame, branch, asc, part`` for ``dots`` with branches: branches that several branches of the frame before went into are
    divided among these.

    A branch before matches one whose dots are within ``dist_thres`` of all its own. Of a branch with several matches each dot goes with the match
    that has the nearest dot, however far (ties: the least id); the dots of a match are a part, named by its least dot. Other branches are one part, ``asc``
    is their only match or null. Every dot is in one part.
    """
    before = dots.withColumn("frame", F.col("frame") + 1)
    found = J.directed_match(before, dots, dist_thres).select(F.col("a").alias("asc"), F.col("b").alias("branch"))
    counted = found.groupBy("branch").agg(F.count("*").alias("matches"), F.min("asc").alias("only"))
    matched = stage(found.join(counted, "branch"), "matches")
    several = matched.where("matches > 1").select("branch", "asc")
    # nearest dots within each merged branch: its name is the key of the join, so that other branches of the frame don't take part
    own = dots.join(several.select("branch").distinct(), "branch", "left_semi").select("id", "x", "y", F.col("branch").alias("frame"))
    theirs = several.join(dots.select(F.col("branch").alias("asc"), "id", "x", "y"), "asc").select("id", "x", "y", F.col("branch").alias("frame"), "asc")
    own, theirs = stage(own, "merged-dots"), stage(theirs, "merged-dots")
    near = J.nearest_any(own, theirs, dist_thres, stage).select("p", "q")
    chosen = near.join(theirs.select(F.col("id").alias("q"), "asc").distinct(), "q").select(F.col("p").alias("id"), "asc")
    one = matched.where("matches = 1").select("branch", "only")
    out = dots.join(chosen, "id", "left").join(one, "branch", "left").withColumn("asc", F.coalesce("asc", "only")).drop("only")
    out = stage(out, "divided")
    parts = out.groupBy(F.col("branch").alias("b"), F.col("asc").alias("a")).agg(F.min("id").alias("part"))
    return out.join(parts, (F.col("branch") == F.col("b")) & F.col("asc").eqNullSafe(F.col("a"))).select("id", "x", "y", "frame", "branch", "asc", "part")


def velocities(dots: DataFrame, linked: DataFrame, dist_thres: float, pairs: DataFrame | None = None) -> DataFrame:
    """``frame, branch, rooted, vx, vy``: centre minus the mean of the distinct ascendant dots nearest to its own dots (nearer than
    ``dist_thres``); zero without any."""
    pairs = frame_pairs(dots, dist_thres) if pairs is None else pairs
    pairs = pairs.select("branch", "asc", "q", F.struct("d2", "p", "px", "py").alias("m"))
    near = pairs.join(linked, ["branch", "asc"]).groupBy("branch", "q").agg(F.min("m").alias("m"))
    source = near.select("branch", "m.p", "m.px", "m.py").distinct().groupBy("branch").agg(F.avg("px").alias("qx"), F.avg("py").alias("qy"))
    centre = dots.groupBy("frame", "branch").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    rooted = linked.select("branch").distinct().withColumn("rooted", F.lit(True))
    out = centre.join(source, "branch", "left").join(rooted, "branch", "left")
    zero = F.lit(0.0)
    return out.select("frame", "branch", F.coalesce("rooted", F.lit(False)).alias("rooted"), F.coalesce(F.col("cx") - F.col("qx"), zero).alias("vx"), F.coalesce(F.col("cy") - F.col("qy"), zero).alias("vy"))


def velocity_links(v: DataFrame, merge_thres: float) -> DataFrame:
    """``src, dst`` between branches of a frame whose velocities differ by less than ``merge_thres`` (at most 1); of two branches
    without ascendants the difference is 1, so they don't link directly.

    Equal velocities are collapsed first. Branches without ascendants all stand at zero: each rooted branch near zero links
    to all of them, so they hang on one such hub. No frame's still dots are ever paired up.
    """
    if merge_thres > 1:
        raise ValueError("merge_thres is 1 at most")
    rooted = v.where("rooted")
    reps = stage(rooted.groupBy("frame", "vx", "vy").agg(F.min("branch").alias("rep")), "velocities")
    same = rooted.join(reps, ["frame", "vx", "vy"]).select(F.col("rep").alias("src"), F.col("branch").alias("dst"))
    points = reps.select(F.col("rep").alias("id"), F.col("vx").alias("x"), F.col("vy").alias("y"), "frame")
    near = J.range_join(points, points, merge_thres, condition=(F.col("a.id") < F.col("b.id")) & (J.d2("a", "b") < float(merge_thres * merge_thres)))
    hub = rooted.where(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") < merge_thres * merge_thres).groupBy("frame").agg(F.min("branch").alias("hub"))
    still = v.where("NOT rooted").join(hub, "frame").select(F.col("hub").alias("src"), F.col("branch").alias("dst"))
    # the hub stands for all rooted branches near zero, which are linked through any branch without ascendants
    slow = rooted.where(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") < merge_thres * merge_thres)
    any_still = v.where("NOT rooted").select("frame").distinct()
    around = slow.join(any_still, "frame", "left_semi").join(hub, "frame").select(F.col("hub").alias("src"), F.col("branch").alias("dst"))
    return same.union(near.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))).union(still).union(around)


def group_labels(dots: DataFrame, dist_thres: float = 3.0, merge_thres: float = 0.45, min_history: int = 2) -> DataFrame:
    """``id, x, y, frame, branch, label, n_descendants``: dots labelled 1, 2, ... per frame by which branches move together,
    in the order of the groups' least branches; frames before ``min_history`` have label 0."""
    d = branches(dots, dist_thres)
    pairs = frame_pairs(d, dist_thres)
    linked = links(d, dist_thres, pairs)
    v = stage(velocities(d, linked, dist_thres, pairs), "motion")
    comp = connected_components(velocity_links(v, merge_thres)).withColumnRenamed("node", "branch")
    named = v.select("frame", "branch").join(comp, "branch", "left").withColumn("component", F.coalesce("component", "branch"))
    labels = dense_labels(named, "frame").select("branch", "label")
    n_desc = linked.groupBy(F.col("asc").alias("branch")).agg(F.count("*").alias("n_descendants"))
    out = d.join(labels, "branch").join(n_desc, "branch", "left")
    return out.select("id", "x", "y", "frame", "branch", F.when(F.col("frame") < min_history, 0).otherwise(F.col("label")).alias("label"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def branch_table(dots: DataFrame, dist_thres: float = 3.0) -> DataFrame:
    """``frame, branch, cx, cy, vx, vy, n, n_desc, n_asc, laxis, saxis, theta, rep``."""
    d = branches(dots, dist_thres)
    pairs = frame_pairs(d, dist_thres)
    linked = links(d, dist_thres, pairs)
    v = velocities(d, linked, dist_thres, pairs)
    asc = linked.groupBy("branch").agg(F.count("*").alias("n_asc"))
    desc = linked.groupBy(F.col("asc").alias("branch")).agg(F.count("*").alias("n_desc"))
    out = summaries(d).join(v, ["frame", "branch"]).join(asc, "branch", "left").join(desc, "branch", "left").fillna(0, ["n_asc", "n_desc"])
    return out.select("frame", "branch", "cx", "cy", "vx", "vy", "n", "n_desc", "n_asc", "laxis", "saxis", "theta", "rep")


def history_difference(pairs: DataFrame, dots: DataFrame, linked: DataFrame, generations: int = 5, rate: float = 0.8) -> DataFrame:
    """``a, b, diff`` for ``pairs(a, b)`` of branches: per generation back, the displacement of the ancestors' centres less the mean
    displacement of the other generations, squared, weighted by rate^generation; root of the weighted mean. A generation without
    ancestors stands at the origin, as its empty centre does."""
    every = dots.select(F.col("branch").alias("id")).distinct()
    up = linked.select(F.col("branch").alias("id"), "asc")
    anc = ancestors(up, generations).unionByName(every.select("id", F.lit(0).alias("gen"), F.col("id").alias("anc"))).distinct()
    sums = dots.groupBy(F.col("branch").alias("anc")).agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    centre = anc.join(sums, "anc").groupBy("id", "gen").agg((F.sum("sx") / F.sum("n")).alias("cx"), (F.sum("sy") / F.sum("n")).alias("cy"))
    path = centre.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gen", F.struct("cx", "cy")))).alias("m"))
    at = lambda m, g, c: F.coalesce(F.try_element_at(m, F.lit(g))[c], F.lit(0.0))
    j = pairs.join(path.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(path.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    dx = [at("mb", g, "cx") - at("ma", g, "cx") for g in range(generations)]
    dy = [at("mb", g, "cy") - at("ma", g, "cy") for g in range(generations)]
    j = j.select("a", "b", F.array(*dx).alias("dx"), F.array(*dy).alias("dy"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, t: s + t)
    value, weight = F.lit(0.0), 0.0
    for g in range(generations):
        off = lambda c, g=g: F.get(c, F.lit(g)) - (total(c) - F.get(c, F.lit(g))) / (generations - 1)
        value, weight = value + rate**g * (off("dx") * off("dx") + off("dy") * off("dy")), weight + rate**g
    return j.select("a", "b", F.sqrt(value / weight).alias("diff"))
