"""Triangle meshes as half-edge tables with versions: faces carry the round at which they went, so every earlier state is a filter.

A half-edge runs from ``u`` to ``v`` along one face; its twin runs back along the face across. An edge whose twin is missing or gone is on the
boundary. Taking off a boundary edge takes its face along; it is safe if the vertex opposite is not on the boundary, as the mesh then stays
in one piece. Two safe edges only disturb each other if they have the same opposite vertex, so a round takes the longest one of each such vertex: a round
is worth as many single removals, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.storage import Rounds, release, stage


def grid_mesh(cells: DataFrame) -> DataFrame:
    """``mesh, face, a, b, c``: two triangles per square of four neighbouring cells, or the one whose corners are there. ``cells``: mesh, id, x, y;
    the face's number is twice the id of the square's first cell, plus one for the upper triangle."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    sent = cells.select("mesh", "id", "x", "y", corners.alias("o")).select("mesh", (F.col("x") - F.col("o.i")).alias("x"), (F.col("y") - F.col("o.j")).alias("y"), (F.col("o.i") + 2 * F.col("o.j")).alias("k"), "id")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("id")))
    square = sent.groupBy("mesh", "x", "y").agg(*[at(k).alias(f"p{k}") for k in range(4)])
    # a square without its first cell has an upper triangle at most, which is numbered by the cell to the right of that place
    lower = F.struct((2 * F.col("p0")).alias("face"), F.col("p0").alias("a"), F.col("p1").alias("b"), F.col("p2").alias("c"))
    upper = F.struct((2 * F.col("p1") + 1).alias("face"), F.col("p1").alias("a"), F.col("p3").alias("b"), F.col("p2").alias("c"))
    rows = square.select("mesh", F.explode(F.array(lower, upper)).alias("t")).select("mesh", "t.*")
    return rows.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")


def half_edges(faces: DataFrame, points: DataFrame) -> DataFrame:
    """``mesh, face, u, v, opp, twin, length2``: the sides of each face in its sense of rotation, the vertex opposite, the face across (null: none) and the squared
    length. ``faces``: mesh, face, a, b, c; ``points``: id, x, y, z."""
    sides = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("opp")) for u, v, w in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))])
    e = stage(faces.select("mesh", "face", F.explode(sides).alias("s")).select("mesh", "face", "s.*"), "half-edges")
    back = e.select("mesh", F.col("u").alias("v"), F.col("v").alias("u"), F.col("face").alias("twin"))
    p, q = (points.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]) for k in "uv")
    d = lambda c: (F.col(f"{c}u") - F.col(f"{c}v")) * (F.col(f"{c}u") - F.col(f"{c}v"))
    return e.join(back, ["mesh", "u", "v"], "left").join(p, "u").join(q, "v").select("mesh", "face", "u", "v", "opp", "twin", (d("x") + d("y") + d("z")).alias("length2"))


def boundary(edges: DataFrame) -> DataFrame:
    """Half-edges without a twin among ``edges`` (those of a state)."""
    back = edges.select("mesh", F.col("u").alias("v"), F.col("v").alias("u"))
    return edges.join(back, ["mesh", "u", "v"], "left_anti")


def peel(edges: DataFrame, gap2: float, gone: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``mesh, face, u, v, removed_at``: the faces that are taken off, with the boundary edge by which they are, and the round.

    ``edges`` is the table of ``half_edges``. In each round, of the safe boundary edges whose squared length is over ``gap2``, the longest of each opposite vertex
    goes (ties: the largest face). ``gone`` are removals to go on from; the result has them too.
    """
    removed = Rounds(edges.sparkSession, "removed-faces")
    known = edges.select("mesh", "face", "u", "v", F.lit(0).alias("removed_at")).limit(0) if gone is None else gone.select("mesh", "face", "u", "v", "removed_at")
    before = removed.add(known)
    last = before.agg(F.max("removed_at")).first()[0] or 0
    live = stage(edges.join(before, ["mesh", "face"], "left_anti"), "live-edges")
    for k in range(last + 1, last + max_rounds + 1):
        edge = stage(boundary(live), "boundary")
        exposed = edge.select("mesh", F.explode(F.array("u", "v")).alias("opp")).distinct()
        safe = edge.where(F.col("length2") > gap2).join(exposed, ["mesh", "opp"], "left_anti")
        longest = safe.groupBy("mesh", "opp").agg(F.max(F.struct("length2", "face", "u", "v")).alias("e"))
        new = removed.add(longest.select("mesh", "e.face", "e.u", "e.v", F.lit(k).alias("removed_at")))
        release(edge)
        if new.isEmpty():
            return removed.all()
        old, live = live, stage(live.join(new.select("mesh", "face"), ["mesh", "face"], "left_anti"), "live-edges")
        release(old)
    raise RuntimeError(f"edges are left after {max_rounds} rounds")


def state(edges: DataFrame, removed: DataFrame, at: int) -> DataFrame:
    """The half-edges that were there after round ``at`` (0: the whole mesh)."""
    return edges.join(removed.where(F.col("removed_at") <= at).select("mesh", "face"), ["mesh", "face"], "left_anti")


def restored(removed: DataFrame, at: int) -> DataFrame:
    """The removals up to round ``at``: with them the mesh is what it was then, and ``peel`` can go on from there."""
    return removed.where(F.col("removed_at") <= at)


def state_counts(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """``mesh, step, faces, boundary``: per mesh and round (0: before the first) how many faces and boundary edges there were. The boundary
    loses one edge and gains two with each face that goes."""
    whole = edges.groupBy("mesh").agg(F.count_distinct("face").alias("n"))
    outline = boundary(edges).groupBy("mesh").agg(F.count("*").alias("outline"))
    steps = removed.groupBy("mesh", F.col("removed_at").alias("step")).agg(F.count("*").alias("went"))
    every = whole.select("mesh", F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("went")).unionByName(steps)
    gone = every.alias("a").join(steps.alias("b"), (F.col("a.mesh") == F.col("b.mesh")) & (F.col("b.step") <= F.col("a.step")), "left")
    gone = gone.groupBy("a.mesh", "a.step").agg(F.coalesce(F.sum("b.went"), F.lit(0)).alias("gone"))
    return gone.join(whole, "mesh").join(outline, "mesh", "left").select("mesh", "step", (F.col("n") - F.col("gone")).alias("faces"), (F.coalesce("outline", F.lit(0)) + F.col("gone")).alias("boundary"))
