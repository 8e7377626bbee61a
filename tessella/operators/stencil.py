"""Array and stencil operators over long tables ``frame, x, y, v`` (dense grids) and ``frame, x, y`` (sparse cells).

Dense operators look along one axis at a time with windows: one shuffle per axis, whatever the kernel's size.
Sparse operators send each cell to its neighbours and aggregate there: one shuffle, no self-join.
"""

from __future__ import annotations

from itertools import product
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.envelope import along


# -- neighbourhoods ----------------------------------------------------------------------------------------------------
def offsets(ndim: int, kind: str = "eight") -> list[tuple[int, ...]]:
    """Neighbour offsets, first axis fastest. four: axis steps; eight: all 3^n - 1; nine: with the centre;
    causal / anticausal: those before / after in scan order; causal_four: the axis steps before; ten: eight in x, y and two in z."""
    every = [tuple(reversed(o)) for o in product((-1, 0, 1), repeat=ndim)]
    rank = lambda o: tuple(reversed(o))
    zero = (0,) * ndim
    if kind == "nine":
        return every
    if kind == "ten":
        if ndim != 3:
            raise ValueError("ten neighbours need three axes")
        return [o for o in every if o != zero and (o[2] == 0 or o[:2] == (0, 0))]
    steps = {
        "four": [o for o in every if sum(map(abs, o)) == 1],
        "eight": [o for o in every if o != zero],
        "causal": [o for o in every if rank(o) < rank(zero)],
        "anticausal": [o for o in every if rank(o) > rank(zero)],
        "causal_four": [o for o in every if sum(map(abs, o)) == 1 and rank(o) < rank(zero)],
    }
    return steps[kind]


def offset_table(spark, ndim: int, kind: str = "eight") -> DataFrame:
    names = ["dx", "dy", "dz", "dt"][:ndim]
    return spark.createDataFrame([(i, *o) for i, o in enumerate(offsets(ndim, kind))], "k int, " + ", ".join(f"{n} int" for n in names))


def moved(cells: DataFrame, steps: list[tuple[int, int]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Each cell at each offset: ``frame, x, y`` of the target, ``k``, and the columns to keep."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(steps)]))
    sent = cells.select("frame", "x", "y", *keep, at.alias("o"))
    return sent.select("frame", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.k").alias("k"), *keep)


def neighbour_counts(cells: DataFrame) -> DataFrame:
    """``frame, x, y, n4, n8`` of each cell: how many of its 4- and 8-neighbours exist."""
    steps = offsets(2, "nine")
    step4 = [k for k, o in enumerate(steps) if sum(map(abs, o)) == 1]
    centre = steps.index((0, 0))
    sent = moved(cells, steps)
    counted = sent.groupBy("frame", "x", "y").agg(
        F.count_if(F.col("k").isin(step4)).alias("n4"), F.count_if(F.col("k") != centre).alias("n8"), F.max(F.col("k") == centre).alias("here")
    )
    return counted.where("here").drop("here")


def border(x: Column, y: Column, width: int, height: int) -> Column:
    return (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)


# -- dense grids -------------------------------------------------------------------------------------------------------
def _axis(axis: str) -> Window:
    return Window.partitionBy("frame", "y").orderBy("x") if axis == "x" else Window.partitionBy("frame", "x").orderBy("y")


def ring(grid: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``ring``: the eight neighbours' values nw, n, ne, w, e, sw, s, se, null beyond the image. Two shuffles."""
    wx, wy = _axis("x"), _axis("y")
    rows = grid.withColumn("_row", F.array(F.lag(v).over(wx), F.col(v), F.lead(v).over(wx)))
    rows = rows.withColumns({"_up": F.lag("_row").over(wy), "_down": F.lead("_row").over(wy)})
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    parts = [at("_up", 0), at("_up", 1), at("_up", 2), at("_row", 0), at("_row", 2), at("_down", 0), at("_down", 1), at("_down", 2)]
    return rows.withColumn("ring", F.array(*parts)).drop("_row", "_up", "_down")


def gaussian_kernel(std: float, length: int, normalise: bool = True) -> list[float]:
    """exp(-(i - length // 2)^2 / (2 std^2)), summing to one if asked."""
    k = [exp(-((i - length // 2) ** 2) / (2 * std * std)) for i in range(length)]
    return [x / sum(k) for x in k] if normalise else k


def correlate(grid: DataFrame, kernel: list[float], axis: str, extension: str = "clamp", v: str = "v") -> DataFrame:
    """1-D correlation along an axis, the kernel's centre at length // 2. Beyond the image: the edge value (clamp) or zero."""
    by = _axis(axis)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(0.0)
    for k, g in enumerate(kernel):
        d = k - len(kernel) // 2
        near = F.col(v) if not d else (F.lead(v, d) if d > 0 else F.lag(v, -d)).over(by)
        edge = F.lit(0) if extension == "zero" else (F.last(v) if d > 0 else F.first(v)).over(whole)
        total = total + F.coalesce(near, edge) * F.lit(float(g))
    return grid.withColumn(v, total)


def separable(grid: DataFrame, kernel: list[float], extension: str = "clamp", v: str = "v") -> DataFrame:
    """The same kernel along x and then y: n + n products a cell in place of n * n."""
    return correlate(correlate(grid.withColumn(v, F.col(v).cast("double")), kernel, "x", extension, v), kernel, "y", extension, v)


def gradient(grid: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``dx, dy, g``: 3 x 3 weighted central differences and their length; zero on the border."""
    r = ring(grid, v)
    at = lambda i: F.get("ring", F.lit(i))
    dx = ((at(2) * 0.25 + at(4) * 0.5 + at(7) * 0.25) - (at(0) * 0.25 + at(3) * 0.5 + at(5) * 0.25)) / 2
    dy = ((at(5) * 0.25 + at(6) * 0.5 + at(7) * 0.25) - (at(0) * 0.25 + at(1) * 0.5 + at(2) * 0.25)) / 2
    r = r.withColumns({"dx": F.coalesce(dx, F.lit(0.0)), "dy": F.coalesce(dy, F.lit(0.0))})
    inner = ~F.exists("ring", lambda n: n.isNull())
    r = r.withColumns({"dx": F.when(inner, F.col("dx")).otherwise(0.0), "dy": F.when(inner, F.col("dy")).otherwise(0.0)})
    return r.withColumn("g", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).drop("ring")


def non_maximum_suppression(grad: DataFrame) -> DataFrame:
    """Adds ``kept``: g where it beats both values interpolated across the edge, else 0. Equality loses but on the
    two sides (north-east above a steep falling, south-west below a flat falling gradient) where it wins."""
    r = ring(grad, "g")
    n = dict(zip(("nw", "n", "ne", "w", "e", "sw", "s", "se"), (F.get("ring", F.lit(i)) for i in range(8)), strict=True))
    ux, uy, c = F.abs("dx"), F.abs("dy"), F.col("g")
    steep, same = ux < uy, F.col("dx") * F.col("dy") > 0
    major, minor = F.greatest(ux, uy), F.least(ux, uy)
    # the gradient leaves the ring between a cell on the nearer axis and one on a diagonal, minor / major of the way to the latter
    between = lambda axis, diagonal: (major - minor) * axis + minor * diagonal
    down = between(F.when(~steep, n["e"]).when(same, n["s"]).otherwise(n["n"]), F.when(same, n["se"]).otherwise(n["ne"]))
    up = between(F.when(~steep, n["w"]).when(same, n["n"]).otherwise(n["s"]), F.when(same, n["nw"]).otherwise(n["sw"]))
    lead_, first, second = major * c, down, up
    beats = F.when(~same & steep, (lead_ >= first) & (lead_ > second)).when(~same, (lead_ > first) & (lead_ >= second)).otherwise((lead_ > first) & (lead_ > second))
    inner = ~F.exists("ring", lambda x: x.isNull())
    return r.withColumn("kept", F.when(inner & beats, c).otherwise(0.0)).drop("ring")


def local_extrema(grid: DataFrame, largest: bool = True, strict: bool = False, v: str = "v") -> DataFrame:
    """The cells that are at least (strict: more than) all their neighbours, or at most (less than) for minima."""
    r = ring(grid, v)
    best = (F.array_max if largest else F.array_min)("ring")
    a, b = (F.col(v), best) if largest else (best, F.col(v))
    return r.where(a > b if strict else a >= b).drop("ring")


def laplacian(grid: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``laplace`` (neighbour sum - 4v), ``slope`` and ``angle`` from 4-neighbours; a missing one counts as the centre."""
    r = ring(grid, v)
    at = lambda i: F.coalesce(F.get("ring", F.lit(i)), F.col(v)).cast("double")
    dx, dy = (at(4) - at(3)) / 2, (at(6) - at(1)) / 2
    r = r.withColumns({"laplace": at(1) + at(3) + at(4) + at(6) - 4 * F.col(v), "slope": F.sqrt(dx * dx + dy * dy), "angle": F.atan2(dy, dx)})
    return r.drop("ring")


def centricity(grid: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``centricity``: the share of the 8 neighbours that are positive and smaller; up to two equal ones count too."""
    r = ring(grid, v)
    lower = F.size(F.filter("ring", lambda n: (n > 0) & (n < F.col(v))))
    same = F.size(F.filter("ring", lambda n: (n > 0) & (n == F.col(v))))
    return r.withColumn("centricity", (lower + F.when(same <= 2, same).otherwise(0)) / 8).drop("ring")


def distance_transform(grid: DataFrame, metric: str = "l2", seed: str = "v > 0", spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Adds ``d2`` (l2: squared) or ``d`` (l1, linf, octile) to the nearest seed of the frame; null if it has none.

    Along x the nearest seed on either side is a running value, along y the lower envelope of a column's costs: work is in
    proportion to the cells.
    """
    rows = grid.withColumn("_a", F.abs(F.col("x") - _nearest_along_x(seed)).cast("double") * spacing[0])
    found = along(rows, ["frame", "x"], "y", "_a", metric, spacing[1])
    return found.select("frame", "x", "y", F.col("d").alias("d2" if metric == "l2" else "d"))


def _nearest_along_x(seed: str) -> Column:
    """x of the nearest seed of the row of cells, the left one of two; null without any."""
    wx = _axis("x")
    left = F.last(F.when(F.expr(seed), F.col("x")), ignorenulls=True).over(wx)
    right = F.first(F.when(F.expr(seed), F.col("x")), ignorenulls=True).over(wx.rowsBetween(0, Window.unboundedFollowing))
    return F.when(F.coalesce(F.col("x") - left <= right - F.col("x"), left.isNotNull()), left).otherwise(right)


def nearest_seeds(grid: DataFrame, metric: str = "linf", seed: str = "v > 0") -> DataFrame:
    """``frame, x, y, d, sx, sy``: the distance to a nearest seed and that seed, for each cell of a frame with seeds."""
    rows = grid.withColumn("sx", _nearest_along_x(seed)).withColumn("_a", F.abs(F.col("x") - F.col("sx")).cast("double"))
    found = along(rows, ["frame", "x"], "y", "_a", metric, keep=("y", "sx"))
    return found.select("frame", "x", "y", "d", "sx", F.col("of_y").alias("sy")).where("d IS NOT NULL")


def generalized_distance_transform(grid: DataFrame, v: str = "v") -> DataFrame:
    """``frame, x, y, d``: least of 1/v - 1/max(v) + squared distance over the positive cells of the frame, one axis after the other."""
    top = F.max(v).over(Window.partitionBy("frame"))
    cells = grid.select("frame", "x", "y", F.when(F.col(v) > 0, 1 / F.col(v) - 1 / top).alias("_c"))
    rows = along(cells, ["frame", "y"], "x", "_c", "added").withColumnRenamed("d", "_c")
    return along(rows, ["frame", "x"], "y", "_c", "added").select("frame", "x", "y", "d")


def frame_difference(grid: DataFrame, v: str = "v") -> DataFrame:
    """Adds ``diff``: absolute change from the frame before; the first frame is left out."""
    by = Window.partitionBy("x", "y").orderBy("frame")
    return grid.withColumn("diff", F.abs(F.col(v) - F.lag(v).over(by))).where("diff IS NOT NULL")


def block_motion(diff: DataFrame, block: int = 4, threshold: int = 0, min_count: int | None = None) -> DataFrame:
    """``frame, x, y, n``: centres of tiles with at least ``min_count`` (block^2 / 5 + 1) cells whose diff is over the threshold."""
    min_count = block * block // 5 + 1 if min_count is None else min_count
    tile = lambda c: F.floor(F.col(c) / block).cast("int") * block + block // 2
    moving = diff.groupBy("frame", tile("x").alias("x"), tile("y").alias("y")).agg(F.count_if(F.col("diff") > threshold).alias("n"))
    return moving.where(F.col("n") >= min_count)


def smooth_over_time(grid: DataFrame, v: str = "v") -> DataFrame:
    """``frame, x, y, v, ema``: whole-number running mean ema/2 + v/2, each half cut to a whole number; starts at the first value. One fold over
    each cell's values in order."""
    cells = grid.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("frame", F.col(v).alias("v")))).alias("past"))
    half = lambda a: F.floor(a / 2).cast("int")
    first = F.array(F.get("past", F.lit(0))["v"])
    means = F.aggregate(F.slice("past", F.lit(2), F.size("past")), first, lambda s, p: F.array_append(s, half(F.element_at(s, -1)) + half(p["v"])))
    rows = F.zip_with("past", means, lambda p, m: F.struct(p["frame"].alias("frame"), p["v"].alias(v), m.alias("ema")))
    return cells.select("x", "y", F.inline(rows)).select("frame", "x", "y", v, "ema")


def resample(grid: DataFrame, width: int, height: int, new_width: int, new_height: int, v: str = "v") -> DataFrame:
    """Bilinear samples on a new grid with the same centre; coordinates beyond the image are clamped to it."""
    spark = grid.sparkSession
    place = lambda i, new, old: (F.col(i) - F.lit((new - 1) / 2.0)) * (old / new) + (old - 1) / 2.0
    target = spark.range(new_width * new_height).select((F.col("id") % new_width).cast("int").alias("nx"), F.floor(F.col("id") / new_width).cast("int").alias("ny"))
    target = target.select("nx", "ny", F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), place("nx", new_width, width))).alias("fx"), F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), place("ny", new_height, height))).alias("fy"))
    corners = target.select("nx", "ny", "fx", "fy", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c"))
    x, y = F.floor("fx") + F.col("c.a"), F.floor("fy") + F.col("c.b")
    weight = (1 - F.abs(F.col("fx") - x)) * (1 - F.abs(F.col("fy") - y))
    corners = corners.select("nx", "ny", x.cast("int").alias("x"), y.cast("int").alias("y"), weight.alias("w")).where("w > 0")
    # the target grid is as large as one image, however many frames there are
    return grid.join(corners, ["x", "y"]).groupBy("frame", F.col("nx").alias("x"), F.col("ny").alias("y")).agg(F.sum(F.col(v) * F.col("w")).alias(v))


# -- sparse cells ------------------------------------------------------------------------------------------------------
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilate(cells: DataFrame, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return moved(cells, CROSS).where(inside).select("frame", "x", "y").distinct()


def erode(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells whose whole cross is set; beyond the image counts as set."""
    need = F.lit(5) - ((F.col("x") == 0).cast("int") + (F.col("x") == width - 1).cast("int") + (F.col("y") == 0).cast("int") + (F.col("y") == height - 1).cast("int"))
    hits = moved(cells, CROSS).groupBy("frame", "x", "y").agg(F.count("*").alias("n"), F.max(F.col("k") == 0).alias("here"))
    return hits.where(F.col("here") & (F.col("n") >= need)).select("frame", "x", "y")


def skeleton(cells: DataFrame, width: int, height: int, stage, rounds: int = 10_000) -> DataFrame:
    """Morphological skeleton: collect what opening removes, erode, until nothing is left."""
    now, found = stage(cells.select("frame", "x", "y").distinct(), "skeleton"), None
    for _ in range(rounds):
        eroded = stage(erode(now, width, height), "skeleton")
        gone = now.join(dilate(eroded, width, height), ["frame", "x", "y"], "left_anti")
        found = gone if found is None else found.union(gone)
        if eroded.isEmpty():
            return found.distinct()
        now = eroded
    raise RuntimeError(f"the cells aren't eroded after {rounds} rounds")


def trace_shell(cells: DataFrame) -> DataFrame:
    """``frame, x, y, contacts``: empty cells with an occupied 8-neighbour, one ring beyond the image included."""
    steps = offsets(2, "nine")
    centre = steps.index((0, 0))
    hits = moved(cells, steps).groupBy("frame", "x", "y").agg(F.count("*").alias("contacts"), F.max(F.col("k") == centre).alias("here"))
    return hits.where("NOT here").drop("here")
