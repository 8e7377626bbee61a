"""Join-shaped queries over dots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import joins as J
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.queries.stencil import fx
from tessella.sources.bindings import SQL, dots, pixels

D = f"WITH {SQL['dots']}"
R = "WITH RECURSIVE " + SQL["dots"]
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
#: components of the dots of a frame within distance 3, by reachability
COMP = R + f""", e AS (SELECT a.id AS u, b.id AS v FROM dots a JOIN dots b ON a.t = b.t AND {D2} <= 9),
reach(u, v) AS (SELECT id, id FROM dots UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
comp AS (SELECT u AS id, min(v) AS comp FROM reach GROUP BY u)"""


def framed(spark, sf):
    return dots(spark, sf).withColumnRenamed("t", "frame")


def with_components(spark, sf, radius: float = 3.0):
    return J.point_components(framed(spark, sf), radius)


@query(D + f" SELECT a.t AS frame, a.id AS src, b.id AS dst, {D2} AS d2 FROM dots a JOIN dots b ON a.t = b.t AND a.id < b.id AND {D2} <= 25")
def dot_range_pairs(spark, sf):
    return J.range_pairs(framed(spark, sf), 5.0)


@query(D + f""", c AS (SELECT b.t AS frame, a.id AS p, b.id AS q, {D2} AS d2 FROM dots a JOIN dots b ON b.t = a.t + 1 AND {D2} <= 50),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS nth FROM c) SELECT * FROM n WHERE nth <= 3""")
def knn_candidates(spark, sf):
    d = framed(spark, sf)
    return J.knn_in_range(d.withColumn("frame", F.col("frame") + 1), d, 3, 50**0.5)


@query(D + f""" SELECT a.t AS frame, a.id AS p, arg_min(b.id, ({D2}, b.id)) AS q, min({D2}) AS d2
FROM dots a JOIN dots b ON b.t = a.t - 1 GROUP BY ALL""")
def nearest_dot_prev_frame(spark, sf):
    d = framed(spark, sf)
    return J.nearest_any(d, d.withColumn("frame", F.col("frame") + 1), 8.0, stage)


@query(COMP + f""", p AS (SELECT dots.*, comp FROM dots JOIN comp USING (id)),
m AS (SELECT a.t AS frame, a.comp AS comp_a, b.comp AS comp_b, a.id AS p, b.id AS q, {D2} AS d2,
  row_number() OVER (PARTITION BY a.t, a.comp, b.comp ORDER BY {D2}, a.id, b.id) AS nth FROM p a JOIN p b ON a.t = b.t AND a.comp < b.comp AND {D2} <= 64)
SELECT frame, comp_a, comp_b, p, q, d2 FROM m WHERE nth = 1""")
def closest_component_pairs(spark, sf):
    return J.closest_component_pairs(with_components(spark, sf), 8.0)


@query(f"WITH {SQL['pixels']}" + """, c AS (SELECT frame, x, y FROM pixels WHERE v >= 1)
SELECT frame, x, y FROM c WHERE frame > 0 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.frame = c.frame - 1 AND b.x = c.x AND b.y = c.y)""")
def moving_dots_antijoin(spark, sf):
    c = pixels(spark, sf).where("v >= 1").select("frame", "x", "y")
    return J.without_predecessor(c)


@query(f"WITH {SQL['pixels']}" + """, c AS (SELECT frame, x, y FROM pixels WHERE v >= 1),
s AS (SELECT c.frame, c.y AS track, avg((b.x IS NULL)::INT) AS share FROM c LEFT JOIN c b ON b.frame = c.frame - 1 AND b.x = c.x AND b.y = c.y GROUP BY ALL)
SELECT * FROM s WHERE share > 0.5""")
def moving_edge_tracks(spark, sf):
    return J.moving_share(pixels(spark, sf).where("v >= 1").select("frame", "x", "y", F.col("y").alias("track")), 0.5)


@query(D + f""", f AS MATERIALIZED (SELECT a.id AS p, arg_min(b.id, ({D2}, b.id)) AS q FROM dots a JOIN dots b ON b.t = a.t AND a.id <> b.id AND {D2} <= 100 GROUP BY ALL)
SELECT a.p, a.q FROM f a JOIN f b ON a.p = b.q AND a.q = b.p AND a.p < a.q""")
def mutual_matches(spark, sf):
    d = framed(spark, sf)
    best = J.nearest_other(d, 10.0)
    return J.mutual(best.select("p", "q", F.lit(1.0).alias("w")), 0.5)


MATCH = COMP + f""", p AS (SELECT dots.*, comp FROM dots JOIN comp USING (id)),
n AS (SELECT a.t AS frame, a.comp AS a, b.comp AS b, a.id, min({D2}) AS d2 FROM p a JOIN p b ON b.t = a.t + 1 GROUP BY ALL),
m AS (SELECT frame, a, b, avg(sqrt(d2)) AS mean_d, sqrt(max(d2)) AS max_d, count(*) AS n FROM n GROUP BY ALL)"""


def _matches(spark, sf):
    b = stage(with_components(spark, sf).withColumnRenamed("comp", "branch"), "branches")
    return J.directed_match(b, b.withColumn("frame", F.col("frame") - 1), 6.0)


@query(MATCH + f" SELECT frame, a, b, {fixed('mean_d')} AS mean_d, {fixed('max_d')} AS max_d, n FROM m WHERE max_d <= 6")
def directed_chamfer(spark, sf):
    return _matches(spark, sf).select("frame", "a", "b", fx("mean_d", "mean_d"), fx("max_d", "max_d"), "n")


@query(MATCH + f""", k AS (SELECT b.t AS frame, a.comp AS a, b.comp AS b, b.id, min({D2}) AS d2 FROM p a JOIN p b ON b.t = a.t + 1 GROUP BY ALL),
r AS (SELECT a, b, sqrt(max(d2)) AS max_d FROM k GROUP BY ALL)
SELECT m.frame, m.a, m.b, {fixed('greatest(m.max_d, r.max_d)')} AS d FROM m JOIN r ON m.a = r.a AND m.b = r.b WHERE m.max_d <= 6 AND r.max_d <= 6""")
def hausdorff(spark, sf):
    b = stage(with_components(spark, sf).withColumnRenamed("comp", "branch"), "branches")
    after = b.withColumn("frame", F.col("frame") - 1)
    there = J.directed_match(b, after, 6.0)
    back = J.directed_match(after, b, 6.0).select("frame", F.col("b").alias("a"), F.col("a").alias("b"), F.col("max_d").alias("back"))
    return there.join(back, ["frame", "a", "b"]).select("frame", "a", "b", F.expr(fixed("greatest(max_d, back)")).alias("d"))


@query(MATCH + " SELECT frame, a, b FROM m WHERE mean_d < 2 AND max_d <= 6")
def branch_matches(spark, sf):
    return _matches(spark, sf).where("mean_d < 2").select("frame", "a", "b")


@query(D + f""", c AS (SELECT a.id AS p, b.id AS q, a.t - b.t AS back, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY a.t - b.t, {D2}, b.id) AS nth
FROM dots a JOIN dots b ON b.t BETWEEN a.t - 5 AND a.t - 1 AND {D2} <= 9) SELECT p, q, back::INT AS back, d2 FROM c WHERE nth = 1""")
def look_back_match(spark, sf):
    return J.look_back(framed(spark, sf), 3.0)


@query(D + """, p AS (SELECT t, x // 50 AS gx, avg(x) AS cx, avg(y) AS cy FROM dots GROUP BY ALL)
SELECT t AS frame, gx, arg_min(id, ((x - cx) * (x - cx) + (y - cy) * (y - cy), id)) AS medoid FROM dots JOIN p USING (t) WHERE dots.x // 50 = gx GROUP BY ALL""")
def cluster_medoid(spark, sf):
    d = framed(spark, sf).withColumn("gx", F.floor(F.col("x") / 50).cast("int"))
    by = Window.partitionBy("frame", "gx")
    c = d.withColumns({"cx": F.avg("x").over(by), "cy": F.avg("y").over(by)})
    far = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return c.groupBy("frame", "gx").agg(F.min_by("id", F.struct(far, F.col("id"))).alias("medoid"))
