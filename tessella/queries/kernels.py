"""Queries over order-dependent kernels; where SQL has a definition of the result, that is the oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.operators import aggregates as A
from tessella.operators import grouped as U
from tessella.operators import joins as J
from tessella.operators import sequences as Q
from tessella.operators import stencil as S
from tessella.operators import temporal as T
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.queries.graphs import nation_edges
from tessella.queries.spatial import framed
from tessella.queries.stencil import fx
from tessella.queries.temporal import BRANCHES
from tessella.sources.bindings import GRID, SQL, contours, pixels

GROUPS = f"WITH {SQL['dots']}, g AS (SELECT DISTINCT (t * 100 + x // 50)::BIGINT AS grp, x, y FROM dots)"
HULL = GROUPS + """, e AS (SELECT p.grp, p.x AS ax, p.y AS ay, q.x AS qx, q.y AS qy FROM g p JOIN g q ON p.grp = q.grp AND (p.x <> q.x OR p.y <> q.y)
 WHERE NOT EXISTS (SELECT 1 FROM g r WHERE r.grp = p.grp AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
   OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND NOT (r.x BETWEEN least(p.x, q.x) AND greatest(p.x, q.x) AND r.y BETWEEN least(p.y, q.y) AND greatest(p.y, q.y))))))"""


def groups(spark, sf):
    """Dots of a frame by 50 columns: the clusters that the grouped kernels work on."""
    d = framed(spark, sf)
    return d.withColumn("grp", (F.col("frame") * 100 + F.floor(F.col("x") / 50)).cast("bigint"))


@query(HULL + " SELECT grp, ax::DOUBLE AS x, ay::DOUBLE AS y FROM e UNION SELECT grp, any_value(x)::DOUBLE, any_value(y)::DOUBLE FROM g GROUP BY grp HAVING count(*) = 1")
def convex_hull_points(spark, sf):
    return U.hull_points(groups(spark, sf), "grp").select("grp", "x", "y")


@query(HULL + f""", a AS (SELECT grp, abs(sum(ax * qy - qx * ay)) / 2.0 AS area, count(*) AS h FROM e GROUP BY grp), n AS (SELECT (t * 100 + x // 50)::BIGINT AS grp, count(*) AS n FROM dots GROUP BY ALL)
SELECT grp, n, area::DOUBLE AS area, h AS n_hull, {fixed('n / area')} AS density FROM n JOIN a USING (grp) WHERE area > 0""")
def hull_density(spark, sf):
    h = U.hull_density(groups(spark, sf), "grp").where("area > 0")
    return h.select("grp", "n", "area", "n_hull", F.expr(fixed("n / area")).alias("density"))


@query(HULL + """, k AS (SELECT (i * 100 + j)::BIGINT AS dummy, i AS x, j AS y FROM range(0, 491) a(i), range(0, 150) b(j))
SELECT e.grp, count(*) AS cells FROM (SELECT grp, x, y FROM (SELECT DISTINCT grp FROM e), k WHERE x // 50 = grp % 100) c JOIN (SELECT grp, list({'a': ax, 'b': ay, 'c': qx, 'd': qy}) AS es, abs(sum(ax * qy - qx * ay)) AS s FROM e GROUP BY grp) e ON c.grp = e.grp
WHERE s > 0 AND len(list_filter(es, lambda z: (z.c - z.a) * (y - z.b) - (z.d - z.b) * (x - z.a) < 0)) = 0 GROUP BY e.grp""")
def painted_hulls(spark, sf):
    """Grid cells inside each cluster's hull: its points against all hull edges as an array, no join of cells with edges."""
    hull = U.hull_points(groups(spark, sf), "grp")
    ring = hull.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("h"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where(F.size("h") >= 3)
    cells = ring.withColumn("x", F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int")))).withColumn("y", F.explode(F.sequence(F.col("y0").cast("int"), F.col("y1").cast("int"))))
    nxt = F.concat(F.slice("h", 2, F.size("h") - 1), F.slice("h", 1, 1))
    left = F.zip_with("h", nxt, lambda a, b: (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"]) >= 0)
    return cells.where(F.forall(left, lambda v: v)).groupBy("grp").agg(F.count("*").alias("cells"))


@query()
def delaunay(spark, sf):
    return U.triangulate(groups(spark, sf), "grp")


@query()
def mesh_boundary(spark, sf):
    """Edges of the triangulation with one face, and whether the opposite vertex has no boundary edge."""
    tri = stage(U.triangulate(groups(spark, sf), "grp"), "triangles")
    e = tri.select("grp", F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("opp")) for u, v, w in (("a", "b", "c"), ("b", "c", "a"), ("a", "c", "b"))])).alias("e"))
    e = e.select("grp", "e.u", "e.v", "e.opp").groupBy("grp", "u", "v").agg(F.count("*").alias("faces"), F.max("opp").alias("opp")).where("faces = 1")
    exposed = e.select("grp", F.explode(F.array("u", "v")).alias("opp")).distinct().withColumn("hit", F.lit(True))
    return e.join(exposed, ["grp", "opp"], "left").select("grp", "u", "v", "opp", F.col("hit").isNull().alias("safe"))


@query()
def triangle_clusters(spark, sf):
    """Triangles joined over shared edges when their areas are alike (ratio over one half): components per mesh."""
    from tessella.operators.components import connected_components

    g = stage(U.of_places(groups(spark, sf), "grp", F.min("id").alias("id")), "places")
    at = lambda n: g.select("grp", F.col("id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    tri = stage(U.triangulate(g, "grp"), "triangles").join(at("a"), ["grp", "a"]).join(at("b"), ["grp", "b"]).join(at("c"), ["grp", "c"])
    area = F.abs(geo.cross((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("yb")), (F.col("xc"), F.col("yc")))) / 2
    tri = stage(tri.select("grp", "a", "b", "c", area.alias("area"), F.xxhash64("grp", "a", "b", "c").alias("t")), "triangles")
    sides = tri.select("t", "area", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")))).alias("e"))
    p, q = sides.alias("p"), sides.alias("q")
    alike = F.least("p.area", "q.area") > 0.5 * F.greatest("p.area", "q.area")
    pairs = p.join(q, (F.col("p.e") == F.col("q.e")) & (F.col("p.t") < F.col("q.t"))).where(alike).select(F.col("p.t").alias("src"), F.col("q.t").alias("dst"))
    comp = connected_components(pairs).withColumnRenamed("node", "t")
    named = tri.join(comp, "t", "left").withColumn("component", F.coalesce("component", "t"))
    return named.groupBy("grp", "component").agg(F.count("*").alias("triangles"), F.sum("area").alias("area")).select("grp", "triangles", "area")


@query()
def convexity_measure(spark, sf):
    return U.convexity_measure(groups(spark, sf), "grp", 20.0)


@query()
def optimal_assignment(spark, sf):
    """Branches of following frames matched one to one by the mean distance of their dots."""
    d = T.branches(framed(spark, sf), 3.0)
    m = J.directed_match(d, d.withColumn("frame", F.col("frame") - 1), 6.0)
    return U.optimal_assignment(m.withColumn("frame", F.col("frame").cast("bigint")), "frame", "a", "b", "mean_d")


@query(BRANCHES + """, w AS (SELECT frame, count(*) AS n FROM v GROUP BY frame) SELECT a.frame, least(a.n, b.n) AS most FROM w a JOIN w b ON b.frame = a.frame + 1""")
def assignment_bounds(spark, sf):
    """How many pairs an assignment between following frames can have at most."""
    n = T.branches(framed(spark, sf), 3.0).groupBy("frame").agg(F.count_distinct("branch").alias("n"))
    return n.join(n.select((F.col("frame") - 1).alias("frame"), F.col("n").alias("m")), "frame").select("frame", F.least("n", "m").alias("most"))


def _sides(spark, sf):
    c = contours(spark, sf).withColumn("pair", F.floor(F.col("contour_id") / 2).cast("bigint")).withColumn("side", (F.col("contour_id") % 2).cast("int"))
    both = c.groupBy("pair").agg(F.count_distinct("side").alias("k")).where("k = 2").select("pair")
    return c.join(both, "pair", "left_semi")


@query()
def dtw_cost(spark, sf):
    return U.warping_cost(_sides(spark, sf), "pair")


def circular(a: int, b: int) -> int:
    return min(abs(a - b), 8 - abs(a - b))


@query()
def alignment_cost(spark, sf):
    by = Window.partitionBy("contour_id").orderBy("seq")
    s = _sides(spark, sf).withColumns({"nx": F.lead("x").over(by), "ny": F.lead("y").over(by)}).where("nx IS NOT NULL")
    symbols = s.withColumn("symbol", Q.step_bin(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")) % 8)
    return U.alignment_cost(symbols, "pair", 0.5, 0.5, circular)


@query()
def thinned_images(spark, sf):
    return U.thinned(pixels(spark, sf)).where("v > 0")


def _canny(spark, sf):
    sm = S.separable(pixels(spark, sf), S.gaussian_kernel(1.0, 5))
    grad = stage(S.gradient(sm), "gradient")
    edges = S.non_maximum_suppression(grad)
    level = A.percentile_threshold(grad, ["frame"], "g", 0.7)
    return stage(U.canny_tracks(edges.join(level, "frame"), 0.7), "tracks")


@query()
def canny_tracks(spark, sf):
    return _canny(spark, sf)


@query()
def moving_edges(spark, sf):
    """Edge tracks of which over half the cells had no edge at the same place in the frame before."""
    return J.moving_share(_canny(spark, sf), 0.5)


@query()
def contour_sequence(spark, sf):
    """Walk round the shell of each frame's bright cells."""
    shell = S.trace_shell(pixels(spark, sf).where("v >= 3"))
    return U.contour_sequence(shell.withColumn("frame", F.col("frame").cast("bigint")), "frame")


@query()
def max_flow(spark, sf):
    e = nation_edges(spark, sf).withColumn("g", F.lit(0).cast("bigint"))
    return U.max_flow(e, "g", 0, 1)


@query()
def depth_first_times(spark, sf):
    return U.depth_first(nation_edges(spark, sf).withColumn("g", F.lit(0).cast("bigint")), "g")


@query()
def agglomerated_branches(spark, sf):
    return U.agglomerated(T.branch_table(framed(spark, sf)), 0.12)


@query()
def smoothed_contours(spark, sf):
    return U.smoothed(contours(spark, sf), 3)


@query()
def geometric_circles(spark, sf):
    return U.fitted_circles(groups(spark, sf), "grp")


@query()
def offset_polygons(spark, sf):
    """Hulls of all clusters after their edges have moved inwards."""
    h = U.hull_points(groups(spark, sf), "grp")
    return U.offset_rings(h.withColumnRenamed("grp", "k"), "k", 6.0)


@query(f"""WITH {SQL['contours']}, c AS (SELECT contour_id AS k, x, max(y) AS y FROM contours GROUP BY ALL),
s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY k ORDER BY x))
SELECT k, count(*) AS triangles, {fixed('20 * sum((x - px) * ((y + py) / 2 + 1))')} AS area FROM s GROUP BY k HAVING count(*) > 1""")
def triangulated_polygon(spark, sf):
    """The area under each customer's orders over time, closed by a base line at -1 and cut into triangles."""
    c = contours(spark, sf).groupBy(F.col("contour_id").alias("k"), "x").agg(F.max("y").alias("y"))
    ends = c.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi")
    base = ends.select("k", F.explode(F.array(F.struct(F.lit(-2).alias("seq"), F.col("lo").alias("x")), F.struct(F.lit(-1).alias("seq"), F.col("hi").alias("x")))).alias("p"))
    base = base.select("k", "p.seq", "p.x", F.lit(-1.0).alias("y"))
    top = c.join(ends, "k").select("k", (-F.col("x")).cast("int").alias("seq"), "x", "y")
    # the base from left to right, then the orders back from right to left
    top = top.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("seq")))
    return U.triangulated_polygons(base.unionByName(top), "k").withColumn("area", fx("20 * area", "area"))


@query()
def polygon_overlaps(spark, sf):
    """Common area of the hulls of neighbouring clusters' dots, shifted onto each other."""
    h = U.hull_points(groups(spark, sf), "grp").withColumn("x", F.col("x") % 50)
    big = h.groupBy("grp").agg(F.count("*").alias("n")).where("n >= 3").select("grp")
    h = stage(h.join(big, "grp", "left_semi"), "hulls")
    pairs = big.join(big.select((F.col("grp") - 100).alias("grp")), "grp", "left_semi")
    a = h.join(pairs, "grp", "left_semi").withColumn("side", F.lit(0))
    b = h.withColumn("grp", F.col("grp") - 100).join(pairs, "grp", "left_semi").withColumn("side", F.lit(1))
    return U.overlaps(a.unionByName(b), "grp")


@query()
def hull_3d(spark, sf):
    """Hulls of all cells of a frame in x, y, v."""
    p = pixels(spark, sf)
    return U.hulls_3d(p.select(F.col("frame").cast("bigint").alias("g"), (F.col("y") * GRID + F.col("x")).alias("id"), F.col("x"), F.col("y"), F.col("v").alias("z")), "g")
