"""Array and stencil queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import stencil as S
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.sources.bindings import GRID, SQL, pixels

P = f"WITH {SQL['pixels']}"
KERNEL = S.gaussian_kernel(1.0, 5)


def fx(e: str, alias: str):
    return F.expr(fixed(e)).alias(alias)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).where("v >= 1")


@query(P + """, d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY frame)) AS diff FROM pixels)
SELECT frame, x // 4 * 4 + 2 AS x, y // 4 * 4 + 2 AS y, count(*) FILTER (WHERE diff > 0) AS n FROM d WHERE diff IS NOT NULL
GROUP BY ALL HAVING count(*) FILTER (WHERE diff > 0) >= 4""")
def frame_block_motion(spark, sf):
    return S.block_motion(S.frame_difference(pixels(spark, sf)), 4, 0)


@query(P + """ SELECT frame, x, y, v, CASE WHEN diff > 1 THEN 1 ELSE 0 END AS moving FROM
(SELECT *, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY frame)) AS diff FROM pixels) WHERE diff IS NOT NULL""")
def frame_diff_threshold(spark, sf):
    return S.frame_difference(pixels(spark, sf)).select("frame", "x", "y", "v", F.when(F.col("diff") > 1, 1).otherwise(0).alias("moving"))


def _conv_sql(extension: str) -> str:
    taps = ", ".join(f"({k - 2}, {g!r}::DOUBLE)" for k, g in enumerate(KERNEL))
    at = (lambda c: f"greatest(0, least({GRID - 1}, a.{c} + k.d))") if extension == "clamp" else (lambda c: f"a.{c} + k.d")
    return P + f""", k(d, g) AS (VALUES {taps}),
h AS (SELECT a.frame, a.x, a.y, sum(b.v * g) AS v FROM pixels a, k JOIN pixels b ON b.frame = a.frame AND b.y = a.y AND b.x = {at('x')} GROUP BY ALL),
o AS (SELECT a.frame, a.x, a.y, sum(b.v * g) AS v FROM h a, k JOIN h b ON b.frame = a.frame AND b.x = a.x AND b.y = {at('y')} GROUP BY ALL)
SELECT frame, x, y, {fixed('v')} AS v FROM o"""


@query(_conv_sql("clamp"))
def separable_convolution(spark, sf):
    return S.separable(pixels(spark, sf), KERNEL).select("frame", "x", "y", fx("v", "v"))


@query(_conv_sql("zero"))
def separable_convolution_zero(spark, sf):
    return S.separable(pixels(spark, sf), KERNEL, "zero").select("frame", "x", "y", fx("v", "v"))


GRAD = P + f""", m AS (SELECT a.frame, a.x, a.y,
  sum(b.v * (b.x - a.x) * (CASE WHEN b.y = a.y THEN 0.5 ELSE 0.25 END)) / 2 AS dx,
  sum(b.v * (b.y - a.y) * (CASE WHEN b.x = a.x THEN 0.5 ELSE 0.25 END)) / 2 AS dy, count(*) AS n
  FROM pixels a JOIN pixels b ON b.frame = a.frame AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 GROUP BY ALL),
g AS (SELECT frame, x, y, (CASE WHEN n = 9 THEN dx ELSE 0 END)::DOUBLE AS dx, (CASE WHEN n = 9 THEN dy ELSE 0 END)::DOUBLE AS dy, n FROM m),
grad AS (SELECT *, sqrt(dx * dx + dy * dy) AS g FROM g)"""


@query(GRAD + f" SELECT frame, x, y, {fixed('dx')} AS dx, {fixed('dy')} AS dy, {fixed('g')} AS g FROM grad")
def sobel_gradient(spark, sf):
    return S.gradient(pixels(spark, sf)).select("frame", "x", "y", fx("dx", "dx"), fx("dy", "dy"), fx("g", "g"))


@query(GRAD + f""", r AS (SELECT a.*, {', '.join(f"coalesce(max(b.g) FILTER (WHERE b.x = a.x + {dx} AND b.y = a.y + {dy}), 0) AS {n}" for n, dx, dy in
  (('nw', -1, -1), ('no', 0, -1), ('ne', 1, -1), ('w', -1, 0), ('e', 1, 0), ('sw', -1, 1), ('s', 0, 1), ('se', 1, 1)))}
  FROM grad a JOIN grad b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT frame, x, y, {fixed('''CASE WHEN n < 9 THEN 0 WHEN dx * dy > 0 AND abs(dx) < abs(dy) THEN
   CASE WHEN abs(dy * g) > abs(dx * se + (dy - dx) * s) AND abs(dy * g) > abs(dx * nw + (dy - dx) * no) THEN g ELSE 0 END
 WHEN dx * dy > 0 THEN CASE WHEN abs(dx * g) > abs(dy * se + (dx - dy) * e) AND abs(dx * g) > abs(dy * nw + (dx - dy) * w) THEN g ELSE 0 END
 WHEN abs(dx) < abs(dy) THEN CASE WHEN abs(dy * g) >= abs(dx * ne - (dy + dx) * no) AND abs(dy * g) > abs(dx * sw - (dy + dx) * s) THEN g ELSE 0 END
 ELSE CASE WHEN abs(dx * g) > abs(dy * ne - (dx + dy) * e) AND abs(dx * g) >= abs(dy * sw - (dx + dy) * w) THEN g ELSE 0 END END''')} AS kept FROM r""")
def nms_edges(spark, sf):
    return S.non_maximum_suppression(S.gradient(pixels(spark, sf))).select("frame", "x", "y", fx("kept", "kept"))


NBR = "FROM pixels a JOIN pixels b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL"


@query(P + f" SELECT a.frame, a.x, a.y, a.v {NBR} HAVING a.v > max(b.v)")
def local_maxima(spark, sf):
    return S.local_extrema(pixels(spark, sf), True, True)


@query(P + f" SELECT a.frame, a.x, a.y, a.v {NBR} HAVING a.v <= min(b.v)")
def local_minima(spark, sf):
    return S.local_extrema(pixels(spark, sf), False, False)


@query(P + f""", c AS (SELECT a.frame, a.x, a.y, a.v, count(*) FILTER (WHERE b.v > 0 AND b.v < a.v) AS l, count(*) FILTER (WHERE b.v > 0 AND b.v = a.v) AS s {NBR})
SELECT frame, x, y, (l + CASE WHEN s <= 2 THEN s ELSE 0 END) / 8::DOUBLE AS centricity FROM c""")
def centricity(spark, sf):
    return S.centricity(pixels(spark, sf)).select("frame", "x", "y", "centricity")


@query(P + f""", n AS (SELECT a.frame, a.x, a.y, a.v, coalesce(max(b.v) FILTER (WHERE b.x = a.x - 1 AND b.y = a.y), any_value(a.v)) AS w, coalesce(max(b.v) FILTER (WHERE b.x = a.x + 1 AND b.y = a.y), any_value(a.v)) AS e,
  coalesce(max(b.v) FILTER (WHERE b.x = a.x AND b.y = a.y - 1), any_value(a.v)) AS u, coalesce(max(b.v) FILTER (WHERE b.x = a.x AND b.y = a.y + 1), any_value(a.v)) AS d {NBR})
SELECT frame, x, y, (w + e + u + d - 4 * v)::DOUBLE AS laplace, {fixed('sqrt(((e - w) / 2.0) * ((e - w) / 2.0) + ((d - u) / 2.0) * ((d - u) / 2.0))')} AS slope, {fixed('atan2((d - u) / 2.0, (e - w) / 2.0)')} AS angle FROM n""")
def laplacian_slope_angle(spark, sf):
    return S.laplacian(pixels(spark, sf)).select("frame", "x", "y", "laplace", fx("slope", "slope"), fx("angle", "angle"))


def _dt_sql(cost: str, out: str) -> str:
    return P + f""" SELECT a.frame, a.x, a.y, {fixed(f'min({cost})')} AS {out} FROM pixels a LEFT JOIN pixels b ON a.frame = b.frame AND b.v >= 3 GROUP BY ALL"""


@query(_dt_sql("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)", "d2"))
def distance_transform_l2(spark, sf):
    return S.distance_transform(pixels(spark, sf), "l2", "v >= 3").select("frame", "x", "y", fx("d2", "d2"))


@query(_dt_sql("(2 * (a.x - b.x)) * (2 * (a.x - b.x)) + (a.y - b.y) * (a.y - b.y)", "d2"))
def distance_transform_spaced(spark, sf):
    return S.distance_transform(pixels(spark, sf), "l2", "v >= 3", (2.0, 1.0)).select("frame", "x", "y", fx("d2", "d2"))


@query(_dt_sql("abs(a.x - b.x) + abs(a.y - b.y)", "d"))
def distance_transform_l1(spark, sf):
    return S.distance_transform(pixels(spark, sf), "l1", "v >= 3").select("frame", "x", "y", fx("d", "d"))


@query(_dt_sql("greatest(abs(a.x - b.x), abs(a.y - b.y))", "d"))
def distance_transform_linf(spark, sf):
    return S.distance_transform(pixels(spark, sf), "linf", "v >= 3").select("frame", "x", "y", fx("d", "d"))


@query(_dt_sql("greatest(abs(a.x - b.x), abs(a.y - b.y)) + (sqrt(2) - 1) * least(abs(a.x - b.x), abs(a.y - b.y))", "d"))
def distance_transform_octile(spark, sf):
    return S.distance_transform(pixels(spark, sf), "octile", "v >= 3").select("frame", "x", "y", fx("d", "d"))


@query(P + f""", c AS (SELECT *, max(v) OVER (PARTITION BY frame) AS top FROM pixels)
SELECT a.frame, a.x, a.y, {fixed('min(1 / b.v::DOUBLE - 1 / b.top::DOUBLE + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} AS d
FROM pixels a LEFT JOIN c b ON a.frame = b.frame AND b.v > 0 GROUP BY ALL""")
def generalized_distance(spark, sf):
    return S.generalized_distance_transform(pixels(spark, sf)).select("frame", "x", "y", fx("d", "d"))


@query(P + """, c AS (SELECT * FROM pixels WHERE v >= 1)
SELECT a.frame, a.x, a.y, count(*) FILTER (WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1) AS n4, count(*) FILTER (WHERE (a.x, a.y) <> (b.x, b.y)) AS n8
FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def particle_neighbours(spark, sf):
    return S.neighbour_counts(cells(spark, sf))


@query(P + f""", c AS (SELECT * FROM pixels WHERE v >= 1),
n AS (SELECT a.frame, a.x, a.y, count(*) - 1 AS n4 FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY ALL)
SELECT frame, x, y, n4 FROM n WHERE n4 < 4 AND x BETWEEN 1 AND {GRID - 2} AND y BETWEEN 1 AND {GRID - 2}""")
def surface_particles(spark, sf):
    n = S.neighbour_counts(cells(spark, sf))
    return n.where((F.col("n4") < 4) & ~S.border(F.col("x"), F.col("y"), GRID, GRID)).select("frame", "x", "y", "n4")


MORPH = P + f""", c AS (SELECT frame, x, y FROM pixels WHERE v >= 1),
er AS (SELECT a.frame, a.x, a.y FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY ALL
       HAVING count(*) = 5 - (a.x = 0)::INT - (a.x = {GRID - 1})::INT - (a.y = 0)::INT - (a.y = {GRID - 1})::INT)"""


@query(MORPH + " SELECT * FROM er")
def erode(spark, sf):
    return S.erode(cells(spark, sf), GRID, GRID)


@query(P + " SELECT DISTINCT a.frame, a.x, a.y FROM pixels a JOIN pixels b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 WHERE b.v >= 3")
def dilate(spark, sf):
    return S.dilate(pixels(spark, sf).where("v >= 3"), GRID, GRID)


@query(MORPH + """ SELECT * FROM c EXCEPT SELECT p.frame, p.x, p.y FROM pixels p JOIN er ON p.frame = er.frame AND abs(p.x - er.x) + abs(p.y - er.y) <= 1""")
def skeleton_step(spark, sf):
    c = cells(spark, sf).select("frame", "x", "y")
    return c.join(S.dilate(S.erode(c, GRID, GRID), GRID, GRID), ["frame", "x", "y"], "left_anti")


@query()
def skeleton_full(spark, sf):
    return S.skeleton(cells(spark, sf), GRID, GRID, stage)


@query(P + """, c AS (SELECT * FROM pixels WHERE v >= 3), o(dx, dy) AS (SELECT * FROM range(-1, 2) a, range(-1, 2) b),
h AS (SELECT frame, x + dx AS x, y + dy AS y, count(*) AS contacts FROM c, o GROUP BY ALL)
SELECT h.frame, h.x::INT AS x, h.y::INT AS y, contacts FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.frame = h.frame AND c.x = h.x AND c.y = h.y)""")
def boundary_shell(spark, sf):
    return S.trace_shell(pixels(spark, sf).where("v >= 3"))


@query(P + " SELECT frame, x, y, list_reduce(list(v) OVER (PARTITION BY x, y ORDER BY frame), lambda a, b: a // 2 + b // 2) AS ema FROM pixels")
def temporal_smoothing(spark, sf):
    return S.smooth_over_time(pixels(spark, sf)).select("frame", "x", "y", "ema")


@query(P + f""", t AS (SELECT nx::INT AS nx, ny::INT AS ny, greatest(0, least(31, (nx - 9.5) * 1.6 + 15.5)) AS fx, greatest(0, least(31, (ny - 9.5) * 1.6 + 15.5)) AS fy FROM range(20) a(nx), range(20) b(ny)),
w AS (SELECT nx, ny, (floor(fx) + a)::INT AS x, (floor(fy) + b)::INT AS y, (1 - abs(fx - floor(fx) - a)) * (1 - abs(fy - floor(fy) - b)) AS w FROM t, range(2) p(a), range(2) q(b))
SELECT p.frame, nx AS x, ny AS y, {fixed('sum(v * w)')} AS v FROM w JOIN pixels p ON p.x = w.x AND p.y = w.y WHERE w > 0 GROUP BY ALL""")
def resample_bilinear(spark, sf):
    return S.resample(pixels(spark, sf), GRID, GRID, 20, 20).select("frame", "x", "y", fx("v", "v"))


@query(P + " SELECT frame, x // 4 AS x, y // 4 AS y, avg(v) AS v FROM pixels GROUP BY ALL")
def area_decimation(spark, sf):
    return pixels(spark, sf).groupBy("frame", F.floor(F.col("x") / 4).cast("int").alias("x"), F.floor(F.col("y") / 4).cast("int").alias("y")).agg(F.avg("v").alias("v"))
