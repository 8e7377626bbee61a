"""Particles on a grid: growth generations, links between them, core codes, labels that flow, inner regions, dots of light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import stencil as S
from tessella.operators.components import connected_components
from tessella.plans.storage import Rounds, stage


def depth_generations(cells: DataFrame, width: int, height: int, max_gen: int = 10_000) -> DataFrame:
    """``cells`` (frame, x, y, id) with ``gen``: 1 on the surface (not on the image border, a 4-neighbour missing), then one more for each
    step inwards over 4-neighbours; cells that no surface reaches have generation 0."""
    n = S.neighbour_counts(cells).where(~S.border(F.col("x"), F.col("y"), width, height) & (F.col("n4") < 4))
    seen = Rounds(cells.sparkSession, "generations")
    front = seen.add(cells.join(n.select("frame", "x", "y"), ["frame", "x", "y"], "left_semi").select("frame", "x", "y", "id", F.lit(1).alias("gen")))
    for k in range(2, max_gen + 1):
        near = S.moved(front.select("frame", "x", "y"), S.offsets(2, "four")).select("frame", "x", "y").distinct()
        front = seen.add(cells.join(near, ["frame", "x", "y"], "left_semi").join(seen.all().select("id"), "id", "left_anti").withColumn("gen", F.lit(k)))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"there are generations beyond {max_gen}")
    return cells.join(seen.all().select("id", "gen"), "id", "left").fillna(0, ["gen"])


def descendants(cells: DataFrame) -> DataFrame:
    """``asc, desc``: 8-neighbours one generation deeper at the least distance (ties kept)."""
    steps = S.offsets(2, "eight")
    far = F.element_at(F.array(*[F.lit(a * a + b * b) for a, b in steps]), F.col("k") + 1)
    sent = S.moved(cells, steps, ("id", "gen")).select("frame", "x", "y", F.col("id").alias("asc"), F.col("gen").alias("g"), far.alias("d2"))
    pairs = sent.join(cells.select("frame", "x", "y", "id", "gen"), ["frame", "x", "y"]).where(F.col("gen") == F.col("g") + 1)
    least = F.min("d2").over(Window.partitionBy("asc"))
    return pairs.withColumn("m", least).where("d2 = m").select("asc", F.col("id").alias("desc"))


def core_codes(cells: DataFrame, links: DataFrame, width: int, height: int) -> DataFrame:
    """Adds ``n_asc, n_desc, medial, core``: medial with two ascendants at least or no descendant; core 2 without descendants off the border, else 0."""
    asc = links.groupBy(F.col("desc").alias("id")).agg(F.count("*").alias("n_asc"))
    desc = links.groupBy(F.col("asc").alias("id")).agg(F.count("*").alias("n_desc"))
    out = cells.join(asc, "id", "left").join(desc, "id", "left").fillna(0, ["n_asc", "n_desc"])
    core = F.when(S.border(F.col("x"), F.col("y"), width, height), 0).when(F.col("n_desc") == 0, 2).otherwise(0)
    return out.withColumns({"medial": (F.col("n_asc") >= 2) | (F.col("n_desc") == 0), "core": core})


def flow_labels(cells: DataFrame, links: DataFrame, cores: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``id, label``: labels of ``cores`` (id, label) flow to ascendants, generation by generation; of several the least wins."""
    seen = Rounds(cells.sparkSession, "labels")
    now = seen.add(cores.select("id", "label"))
    for _ in range(rounds):
        new = links.join(now, links["desc"] == now["id"]).groupBy(F.col("asc").alias("id")).agg(F.min("label").alias("label"))
        now = seen.add(new.join(seen.all().select("id"), "id", "left_anti"))
        if now.isEmpty():
            return seen.all()
    raise RuntimeError(f"labels still flow after {rounds} rounds")


def inner_regions(cells: DataFrame, components: DataFrame, width: int, height: int) -> DataFrame:
    """Background cells to keep as outside: components that touch the border, less the cells with an 8-neighbour in none of them; per frame the
    largest component goes if it has over five times the cells of the second."""
    c = cells.join(components, "id")
    touching = c.where(S.border(F.col("x"), F.col("y"), width, height)).select("component").distinct()
    out = stage(c.join(touching, "component", "left_semi"), "outside")
    need = F.lit(9) - F.when((F.col("x") == 0) | (F.col("x") == width - 1), 3).otherwise(0) - F.when((F.col("y") == 0) | (F.col("y") == height - 1), 3).otherwise(0)
    corner = F.when(((F.col("x") == 0) | (F.col("x") == width - 1)) & ((F.col("y") == 0) | (F.col("y") == height - 1)), 1).otherwise(0)
    hits = S.moved(out.select("frame", "x", "y"), S.offsets(2, "nine")).groupBy("frame", "x", "y").agg(F.count("*").alias("n"))
    eroded = stage(out.join(hits, ["frame", "x", "y"]).where(F.col("n") == need + corner).drop("n"), "outside")
    size = eroded.groupBy("frame", "component").agg(F.count("*").alias("n"))
    by = Window.partitionBy("frame").orderBy(F.desc("n"), "component")
    ranked = size.withColumns({"nth": F.row_number().over(by), "second": F.lead("n").over(by)})
    gone = ranked.where("nth = 1 AND n > 5 * second").select("component")
    return eroded.join(gone, "component", "left_anti").select("frame", "x", "y", "component")


def particle_forest(cells: DataFrame, max_gap: float) -> DataFrame:
    """``src, dst, w``: spanning forest of particles: 8-neighbour edges and, between components, the closest pair nearer than ``max_gap``;
    w is the squared distance."""
    from tessella.operators import joins as J

    steps = S.offsets(2, "causal")
    weight = F.element_at(F.array(*[F.lit(a * a + b * b) for a, b in steps]), F.col("k") + 1)
    sent = S.moved(cells, steps, ("id",)).select("frame", "x", "y", F.col("id").alias("dst"), weight.alias("w"))
    near = stage(sent.join(cells.select("frame", "x", "y", F.col("id").alias("src")), ["frame", "x", "y"]).select("src", "dst", "w"), "near")
    comp = connected_components(near).withColumnRenamed("node", "id")
    points = stage(cells.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "near")
    far = J.closest_component_pairs(points, max_gap).where(F.col("d2") < max_gap * max_gap).select(F.col("p").alias("src"), F.col("q").alias("dst"), F.col("d2").alias("w"))
    return G.minimum_spanning_forest(near.union(far))


def light_state(connected: Column, candidates: Column, before: Column, after: Column) -> Column:
    """State of a point of light: Connected with a winning candidate, Seeking with candidates, Appeared with points after it only, else Isolated."""
    return F.when(connected, "Connected").when(candidates > 0, "Seeking").when((before == 0) & (after > 0), "Appeared").otherwise("Isolated")


def light_support(cand: DataFrame, sigma: float, floor: float) -> DataFrame:
    """``cand`` with ``prob`` after one multiplicative update of triple candidates (q with a point p before and r after, vx, vy, prob): fitness is
    sqrt(s1 s2), s = floor + sum over the neighbours' candidates of compatibility * prob; probabilities are normalised per q.

    The sums depend on the neighbour and the velocity alone: equal velocities of a q are added up first, and sums are made for distinct
    ones. With a column ``n`` a row stands for so many points p with the same values; p is null for points that are the q of no candidate.
    """
    count = F.col("n") if "n" in cand.columns else F.lit(1)
    mass = stage(cand.groupBy("q", "vx", "vy").agg(F.sum(F.col("prob") * count).alias("mass")), "masses")

    def side(end: str) -> DataFrame:
        a, b = cand.select(F.col(end).alias("e"), "vx", "vy").distinct().alias("a"), mass.alias("b")
        dx, dy = F.col("a.vx") - F.col("b.vx"), F.col("a.vy") - F.col("b.vy")
        fit = F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) * F.col("b.mass")
        return a.join(b, F.col("a.e") == F.col("b.q")).groupBy(F.col("a.e").alias(end), F.col("a.vx").alias("vx"), F.col("a.vy").alias("vy")).agg((floor + F.sum(fit)).alias(f"s_{end}"))

    j = cand.join(side("p"), ["p", "vx", "vy"], "left").join(side("r"), ["r", "vx", "vy"], "left")
    fit = F.sqrt(F.coalesce("s_p", F.lit(floor)) * F.coalesce("s_r", F.lit(floor))) * F.col("prob")
    j = j.withColumn("_f", fit)
    return j.select(*[c for c in cand.columns if c != "prob"], F.try_divide("_f", F.sum(F.col("_f") * count).over(Window.partitionBy("q"))).alias("prob"))
