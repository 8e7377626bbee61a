"""Temporal grouping, aggregates, clustering and solver queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregates as A
from tessella.operators import cluster as K
from tessella.operators import joins as J
from tessella.operators import temporal as T
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.queries.spatial import COMP, D2, framed
from tessella.queries.stencil import fx
from tessella.sources.bindings import SQL, contours, dots, features, pixels, table

P, D, C = f"WITH {SQL['pixels']}", f"WITH {SQL['dots']}", f"WITH {SQL['contours']}"

THETA = "atan2(CASE WHEN abs(2 * sxy) < 1e-9 THEN 0 ELSE 2 * sxy END, CASE WHEN abs(sxx - syy) < 1e-9 THEN 0 ELSE sxx - syy END) / 2"
BRANCHES = COMP + f""", p AS (SELECT id, x, y, t AS frame, comp AS branch FROM dots JOIN comp USING (id)),
m AS (SELECT a.branch AS a, b.branch AS b, a.id, min({D2}) AS d2 FROM p a JOIN p b ON b.frame = a.frame + 1 GROUP BY ALL),
k AS (SELECT b.branch AS b, a.branch AS a, b.id, min({D2}) AS d2 FROM p a JOIN p b ON b.frame = a.frame + 1 GROUP BY ALL),
link AS (SELECT a AS asc_, b AS branch FROM m GROUP BY ALL HAVING max(d2) < 9 UNION SELECT a, b FROM k GROUP BY ALL HAVING max(d2) < 9),
near AS (SELECT b.branch, b.id AS p, arg_min(a.id, ({D2}, a.id)) AS q FROM link JOIN p b ON b.branch = link.branch JOIN p a ON a.branch = link.asc_ WHERE {D2} < 9 GROUP BY ALL),
src AS (SELECT s.branch, avg(p.x) AS qx, avg(p.y) AS qy FROM (SELECT DISTINCT branch, q FROM near) s JOIN p ON p.id = s.q GROUP BY s.branch),
c AS (SELECT frame, branch, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM p GROUP BY ALL),
v AS (SELECT c.*, c.branch IN (SELECT branch FROM link) AS rooted, coalesce(cx - qx, 0) AS vx, coalesce(cy - qy, 0) AS vy FROM c LEFT JOIN src ON c.branch = src.branch)"""


@query(BRANCHES + """, ve AS (SELECT a.branch AS u, b.branch AS v FROM v a JOIN v b ON a.frame = b.frame AND (a.rooted OR b.rooted) AND (a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) < 0.45 * 0.45),
vr(u, v) AS (SELECT branch, branch FROM v UNION SELECT vr.u, ve.v FROM vr JOIN ve ON vr.v = ve.u),
g AS (SELECT u AS branch, min(v) AS comp FROM vr GROUP BY u),
l AS (SELECT v.branch, dense_rank() OVER (PARTITION BY frame ORDER BY comp)::INT AS label FROM v JOIN g ON v.branch = g.branch)
SELECT p.id, x, y, frame, p.branch, CASE WHEN frame < 2 THEN 0 ELSE label END AS label, (SELECT count(*) FROM link WHERE link.asc_ = p.branch) AS n_descendants FROM p JOIN l ON p.branch = l.branch""")
def flagship_group_labels(spark, sf):
    return T.group_labels(framed(spark, sf))


@query(BRANCHES + f""" SELECT frame, branch, {fixed('cx')} AS cx, {fixed('cy')} AS cy, {fixed('vx')} AS vx, {fixed('vy')} AS vy, n,
 (SELECT count(*) FROM link WHERE asc_ = v.branch) AS n_desc, (SELECT count(*) FROM link WHERE link.branch = v.branch) AS n_asc,
 {fixed('(sxx + syy + sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2')} AS laxis, {fixed('(sxx + syy - sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2')} AS saxis, {fixed(THETA)} AS theta FROM v""")
def branch_table(spark, sf):
    b = T.branch_table(framed(spark, sf))
    return b.select("frame", "branch", *[fx(c, c) for c in ("cx", "cy", "vx", "vy")], "n", "n_desc", "n_asc", *[fx(c, c) for c in ("laxis", "saxis", "theta")])


@query(BRANCHES + " SELECT asc_ AS \"asc\", branch FROM link")
def branch_links(spark, sf):
    return T.links(T.branches(framed(spark, sf), 3.0), 3.0)


@query(BRANCHES + f""", mt AS (SELECT a AS asc_, b AS branch FROM m GROUP BY ALL HAVING max(d2) <= 9), ct AS (SELECT branch, count(*) AS n, min(asc_) AS sole FROM mt GROUP BY branch),
nd AS (SELECT b.id, arg_min(a.branch, ({D2}, a.id)) AS asc_ FROM ct JOIN mt ON mt.branch = ct.branch JOIN p b ON b.branch = ct.branch JOIN p a ON a.branch = mt.asc_ WHERE ct.n > 1 GROUP BY b.id),
al AS (SELECT p.id, p.frame, p.branch, coalesce(nd.asc_, CASE WHEN ct.n = 1 THEN sole END) AS asc_ FROM p LEFT JOIN nd ON nd.id = p.id LEFT JOIN ct ON ct.branch = p.branch)
SELECT id, frame, branch, asc_ AS "asc", min(id) OVER (PARTITION BY branch, asc_) AS part FROM al""")
def split_branches(spark, sf):
    return T.split_merged(T.branches(framed(spark, sf), 3.0), 3.0).select("id", "frame", "branch", "asc", "part")


@query(BRANCHES + f""", pr AS (SELECT a.branch AS a, b.branch AS b FROM v a JOIN v b ON a.frame = b.frame AND a.branch < b.branch AND a.n >= 3 AND b.n >= 3),
an(id, gen, anc) AS (SELECT branch, 0, branch FROM v UNION SELECT an.id, an.gen + 1, link.asc_ FROM an JOIN link ON an.anc = link.branch WHERE an.gen < 4),
ce AS (SELECT an.id, an.gen, sum(p.x) / count(*)::DOUBLE AS cx, sum(p.y) / count(*)::DOUBLE AS cy FROM an JOIN p ON p.branch = an.anc GROUP BY ALL),
df AS (SELECT pr.a, pr.b, g.g, coalesce(cb.cx, 0) - coalesce(ca.cx, 0) AS dx, coalesce(cb.cy, 0) - coalesce(ca.cy, 0) AS dy FROM pr CROSS JOIN range(5) g(g) LEFT JOIN ce ca ON ca.id = pr.a AND ca.gen = g.g LEFT JOIN ce cb ON cb.id = pr.b AND cb.gen = g.g),
tt AS (SELECT a, b, sum(dx) AS sx, sum(dy) AS sy FROM df GROUP BY ALL)
SELECT a, b, {fixed('sqrt(sum(pow(0.8, g) * ((dx - (sx - dx) / 4) * (dx - (sx - dx) / 4) + (dy - (sy - dy) / 4) * (dy - (sy - dy) / 4))) / sum(pow(0.8, g)))')} AS diff FROM df JOIN tt USING (a, b) GROUP BY ALL""")
def history_difference(spark, sf):
    d = T.branches(framed(spark, sf), 3.0)
    linked = T.links(d, 3.0)
    big = d.groupBy("frame", "branch").agg(F.count("*").alias("n")).where("n >= 3")
    a, b = big.alias("a"), big.alias("b")
    pairs = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.branch") < F.col("b.branch"))).select(F.col("a.branch").alias("a"), F.col("b.branch").alias("b"))
    return T.history_difference(pairs, d, linked).select("a", "b", fx("diff", "diff"))


# -- aggregates --------------------------------------------------------------------------------------------------------
@query(P + " SELECT frame, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) AS span, count(*) FILTER (WHERE v > 0) AS more, count(*) FILTER (WHERE v < 2) AS less FROM pixels GROUP BY frame")
def extrema_counts(spark, sf):
    return pixels(spark, sf).groupBy("frame").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.max("v") - F.min("v")).alias("span"), F.count_if(F.col("v") > 0).alias("more"), F.count_if(F.col("v") < 2).alias("less"))


@query(P + f", c AS (SELECT *, avg(v) OVER (PARTITION BY frame) AS m FROM pixels) SELECT frame, {fixed('avg(v)')} AS mean, {fixed('avg(pow(v - m, 2))')} AS m2, {fixed('avg(pow(v - m, 3))')} AS m3, {fixed('avg(pow(v - m, 4))')} AS m4 FROM c GROUP BY frame")
def moments(spark, sf):
    m = A.moments(pixels(spark, sf), ["frame"], "v")
    return m.select("frame", *[fx(c, c) for c in ("mean", "m2", "m3", "m4")])


SCATTER = D + ", s AS (SELECT t AS frame, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM dots GROUP BY t)"


@query(SCATTER + f" SELECT frame, n, {fixed('cx')} AS cx, {fixed('cy')} AS cy, {fixed('(sxx + syy + sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2')} AS laxis, {fixed('(sxx + syy - sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / 2')} AS saxis, {fixed(THETA)} AS theta FROM s")
def pca_axes(spark, sf):
    s = A.principal_axes(framed(spark, sf).groupBy("frame").agg(*A.scatter()))
    return s.select("frame", "n", *[fx(c, c) for c in ("cx", "cy", "laxis", "saxis", "theta")])


@query(SCATTER + f" SELECT frame, {fixed('sxx * syy - sxy * sxy')} AS det, {fixed('1e4 * syy / (sxx * syy - sxy * sxy)')} AS ixx, {fixed('-1e4 * sxy / (sxx * syy - sxy * sxy)')} AS ixy, {fixed('1e4 * sxx / (sxx * syy - sxy * sxy)')} AS iyy FROM s WHERE sxx * syy - sxy * sxy > 1e-6")
def covariance_inverse(spark, sf):
    s = A.covariance_inverse(framed(spark, sf).groupBy("frame").agg(*A.scatter())).where("det > 1e-6")
    return s.select("frame", fx("det", "det"), fx("1e4 * ixx", "ixx"), fx("1e4 * ixy", "ixy"), fx("1e4 * iyy", "iyy"))


@query(f"WITH {SQL['features']}" + f" SELECT label, (i - 1)::INT AS i, (j - 1)::INT AS j, {fixed('covar_pop(vec[i], vec[j])')} AS cov FROM features, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY ALL")
def covariance_matrix(spark, sf):
    return A.covariance_matrix(features(spark, sf), "label", "vec").select("label", "i", "j", fx("cov", "cov"))


@query(P + f""", r AS (SELECT frame, v, min(v) OVER (PARTITION BY frame) AS lo, max(v) OVER (PARTITION BY frame) AS hi FROM pixels),
h AS (SELECT frame, lo, hi, floor(255 * (v - lo) / (hi - lo)::DOUBLE)::INT AS bin, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY frame) AS total, max(CASE WHEN bin = 0 THEN n END) OVER (PARTITION BY frame) AS b0 FROM h),
g AS (SELECT c.*, (SELECT arg_min(round(total * (1 - 0.3 / pow(2, k))), k) FROM range(40) s(k) WHERE round(total * (1 - 0.3 / pow(2, k))) >= b0) AS target FROM c)
SELECT frame, {fixed('min(bin) * (any_value(hi) - any_value(lo)) / 256.0 + any_value(lo)')} AS threshold FROM g WHERE upto > target GROUP BY frame""")
def gradient_percentile_threshold(spark, sf):
    return A.percentile_threshold(pixels(spark, sf), ["frame"], "v", 0.7).select("frame", fx("threshold", "threshold"))


@query(D + ", r AS (SELECT t AS frame, x, row_number() OVER (PARTITION BY t ORDER BY x, id) AS n FROM dots) SELECT frame, x FROM r WHERE n = 11")
def kth_smallest(spark, sf):
    return A.kth_smallest(framed(spark, sf), ["frame"], "x", 10, "id")


@query(D + " SELECT t AS frame, y % 10 AS grp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM dots GROUP BY ALL")
def bounding_boxes(spark, sf):
    return A.bounding_box(framed(spark, sf).withColumn("grp", F.col("y") % 10), ["frame", "grp"])


@query("WITH c AS (SELECT l_orderkey, l_suppkey, sum(l_discount) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN max(p) >= 1 - sum(p) THEN arg_max(l_suppkey, (p, -l_suppkey)) END AS winner, " + fixed("max(p)") + " AS prob FROM c GROUP BY l_orderkey")
def dominant_candidate(spark, sf):
    """A supplier's lines are added in their order in the table: suppliers with equal sums tie only if their rounding doesn't depend on how lines fall to tasks."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    c = li.groupBy("l_orderkey", "l_suppkey").agg(A.sum_in_order("l_discount", "file", "row").alias("p"))
    return A.dominant(c, "l_orderkey", "l_suppkey", "p").select("l_orderkey", "winner", fx("prob", "prob"))


@query(P + f" SELECT a.frame, {fixed('1 - count(b.x) / count(*)::DOUBLE')} AS coverage FROM (SELECT * FROM pixels WHERE v > 0) a LEFT JOIN (SELECT DISTINCT x, y FROM pixels WHERE v >= 4) b ON a.x = b.x AND a.y = b.y GROUP BY a.frame")
def coverage_share(spark, sf):
    p = pixels(spark, sf)
    return A.coverage(p.where("v > 0"), p.where("v >= 4"), "frame", ["x", "y"]).select("frame", fx("coverage", "coverage"))


@query(P + " SELECT frame, x, y, v FROM pixels QUALIFY row_number() OVER (PARTITION BY frame ORDER BY v DESC, y, x) <= 3")
def top_cells(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("v"), "y", "x"))
    return pixels(spark, sf).withColumn("n", nth).where("n <= 3").drop("n")


@query(P + ", k AS (SELECT frame, x, y, v, row_number() OVER (ORDER BY frame, y, x) - 1 AS id FROM pixels WHERE v > 0) SELECT id, frame, x, y, v FROM k")
def particle_map(spark, sf):
    from tessella.sources.arrays import dense_ids

    return dense_ids(pixels(spark, sf).where("v > 0"), ["frame", "y", "x"]).select("id", "frame", "x", "y", "v")


# -- clustering and solvers -------------------------------------------------------------------------------------------
def _kmeans_sql(k: int, rounds: int) -> str:
    near = "SELECT f.id, vec, arg_min(c, (list_distance(vec, centre), c)) AS c FROM features f, {} GROUP BY f.id, vec"
    sql = f"WITH {SQL['features']}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, vec AS centre FROM (SELECT * FROM features ORDER BY id LIMIT {k}))"
    for r in range(rounds):
        sql += f", a{r} AS ({near.format(f'c{r}')}), c{r + 1} AS (SELECT c, list(m ORDER BY i) AS centre FROM (SELECT c, i, avg(vec[i]) AS m FROM a{r}, range(1, 65) d(i) GROUP BY ALL) GROUP BY c)"
    return sql + f" SELECT id, c::INT AS c FROM ({near.format(f'c{rounds}')})"


@query(_kmeans_sql(10, 3))
def kmeans_fixed_iters(spark, sf):
    a, _ = K.kmeans(features(spark, sf), 10, 64, 3, tolerance=-1.0)
    return a.select("id", "c")


EM_START = [(0, 0.5, -0.5, -0.5, 1.0, 0.0, 1.0), (1, 0.5, 0.5, 0.5, 1.0, 0.0, 1.0)]


def _em_sql(rounds: int) -> str:
    rows = ", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in r)})" for k, *r in EM_START)
    sql = f"WITH {SQL['features']}, pt AS (SELECT id, vec[1] * 5 AS x, vec[2] * 5 AS y FROM features), p0(k, w, mx, my, sxx, sxy, syy) AS (VALUES {rows})"
    for r in range(rounds):
        sql += f""", d{r} AS (SELECT id, x, y, k, w * exp(-((syy * (x - mx) * (x - mx) - 2 * sxy * (x - mx) * (y - my) + sxx * (y - my) * (y - my)) / (sxx * syy - sxy * sxy)) / 2) / (2 * pi() * sqrt(sxx * syy - sxy * sxy)) AS d FROM pt, p{r}),
q{r} AS (SELECT *, d / sum(d) OVER (PARTITION BY id) AS r FROM d{r}),
p{r + 1} AS (SELECT k, sum(r) / count(*) AS w, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my, sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2) AS sxx, sum(r * x * y) / sum(r) - sum(r * x) / sum(r) * sum(r * y) / sum(r) AS sxy, sum(r * y * y) / sum(r) - pow(sum(r * y) / sum(r), 2) AS syy FROM q{r} GROUP BY k)"""
    return sql + " SELECT k, " + ", ".join(f"{fixed(c)} AS {c}" for c in ("w", "mx", "my", "sxx", "sxy", "syy")) + f" FROM p{rounds}"


@query(_em_sql(3))
def em_gaussian(spark, sf):
    pt = features(spark, sf).select((F.get("vec", F.lit(0)) * 5).alias("x"), (F.get("vec", F.lit(1)) * 5).alias("y"))
    start = spark.createDataFrame(EM_START, "k int, w double, mx double, my double, sxx double, sxy double, syy double")
    out = K.em_gaussian(pt, start, 3)
    return out.select("k", *[fx(c, c) for c in ("w", "mx", "my", "sxx", "sxy", "syy")])


@query(P + f""", s AS (SELECT frame, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, avg(v) AS mv, covar_pop(x, x) AS sxx, covar_pop(x, y) AS sxy, covar_pop(y, y) AS syy, covar_pop(x, v) AS sxv, covar_pop(y, v) AS syv FROM pixels GROUP BY frame),
b AS (SELECT *, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS b, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS c FROM s)
SELECT frame, {fixed('mv - b * mx - c * my')} AS a, {fixed('b')} AS b, {fixed('c')} AS c FROM b""")
def least_squares_plane(spark, sf):
    return K.plane_fit(pixels(spark, sf), ["frame"], F.col("x"), F.col("y"), F.col("v")).select("frame", *[fx(c, c) for c in "abc"])


@query(D + f""", s AS (SELECT t AS frame, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS mv, var_pop(x) AS sxx, covar_pop(x, y) AS sxy, var_pop(y) AS syy, covar_pop(x, x * x + y * y) AS sxv, covar_pop(y, x * x + y * y) AS syv FROM dots GROUP BY t),
b AS (SELECT *, (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS b, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS c FROM s)
SELECT frame, {fixed('b / 2')} AS cx, {fixed('c / 2')} AS cy, {fixed('sqrt(mv - b * mx - c * my + b * b / 4 + c * c / 4)')} AS r FROM b WHERE sxx * syy - sxy * sxy > 1e-6""")
def circle_fit(spark, sf):
    return K.circle_fit(framed(spark, sf), ["frame"]).where("r IS NOT NULL").select("frame", *[fx(c, c) for c in ("cx", "cy", "r")])


PAIRED = C + ", pr AS (SELECT a.contour_id, a.x, a.y, b.x AS u, b.y AS v FROM contours a JOIN contours b ON b.contour_id = a.contour_id + 1 AND a.seq = b.seq)"


def _paired(spark, sf):
    c = contours(spark, sf)
    nxt = c.select((F.col("contour_id") - 1).alias("contour_id"), "seq", F.col("x").alias("u"), F.col("y").alias("v"))
    return c.join(nxt, ["contour_id", "seq"])


@query(PAIRED + f" SELECT contour_id, {fixed('sum(x * u + y * v) / sum(x * x + y * y)')} AS a, {fixed('sum(x * v - y * u) / sum(x * x + y * y)')} AS b FROM pr GROUP BY contour_id")
def euclidean_registration(spark, sf):
    return K.similarity_fit(_paired(spark, sf), ["contour_id"]).select("contour_id", fx("a", "a"), fx("b", "b"))


@query(PAIRED + f""", s AS (SELECT contour_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, var_pop(x) AS sxx, covar_pop(x, y) AS sxy, var_pop(y) AS syy, covar_pop(x, u) AS sxu, covar_pop(y, u) AS syu FROM pr GROUP BY contour_id HAVING count(*) >= 4)
SELECT contour_id, {fixed('(sxu * syy - syu * sxy) / (sxx * syy - sxy * sxy)')} AS b, {fixed('(syu * sxx - sxu * sxy) / (sxx * syy - sxy * sxy)')} AS c FROM s""")
def affine_registration(spark, sf):
    """The x row of the affine map; the y row is the same fit with v."""
    p = _paired(spark, sf)
    enough = p.groupBy("contour_id").agg(F.count("*").alias("n")).where("n >= 4").select("contour_id")
    return K.plane_fit(p.join(enough, "contour_id", "left_semi"), ["contour_id"], F.col("x"), F.col("y"), F.col("u")).select("contour_id", fx("b", "b"), fx("c", "c"))


@query(C + f""", s AS (SELECT contour_id, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM contours GROUP BY contour_id HAVING count(*) >= 2), r AS (SELECT *, {THETA} AS theta FROM s)
SELECT a.contour_id, {fixed('b.cx - a.cx')} AS tx, {fixed('b.cy - a.cy')} AS ty, {fixed('b.theta - a.theta')} AS turn, {fixed('sqrt((b.sxx + b.syy) / (a.sxx + a.syy))')} AS scale FROM r a JOIN r b ON b.contour_id = a.contour_id + 1""")
def procrustes_registration(spark, sf):
    s = A.principal_axes(contours(spark, sf).groupBy("contour_id").agg(*A.scatter()).where("n >= 2"))
    b = s.select((F.col("contour_id") - 1).alias("contour_id"), *[F.col(c).alias(f"{c}2") for c in ("cx", "cy", "sxx", "syy", "theta")])
    j = s.join(b, "contour_id").withColumns({"tx": F.col("cx2") - F.col("cx"), "ty": F.col("cy2") - F.col("cy"), "turn": F.col("theta2") - F.col("theta"), "scale": F.sqrt((F.col("sxx2") + F.col("syy2")) / (F.col("sxx") + F.col("syy")))})
    return j.select("contour_id", *[fx(c, c) for c in ("tx", "ty", "turn", "scale")])


CAND = D + f""", c AS (SELECT a.t AS frame, a.id AS p, b.id AS q, (b.x - a.x)::DOUBLE AS vx, (b.y - a.y)::DOUBLE AS vy, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS nth FROM dots a JOIN dots b ON b.t = a.t + 1 AND {D2} <= 50),
cand AS (SELECT *, 1 / (count(*) OVER (PARTITION BY p) + 1)::DOUBLE AS prob FROM c WHERE nth <= 3)"""


def place_candidates(spark, sf):
    """``dots, at, cand``: the dots, their places, and ``frame, p, n, q, vx, vy, prob``: the candidates of each place, with its least dot p and how many dots
    have them, as those of a place have the same."""
    from pyspark.sql import Window

    d = framed(spark, sf)
    at = stage(J.places(d), "places")
    c = J.knn_of_places(at.withColumn("frame", F.col("frame") + 1), d, 3, 50**0.5).withColumn("frame", F.col("frame") - 1)
    c = c.join(at.select("frame", "x", "y", F.col("id").alias("p")), ["frame", "x", "y"])
    prob = 1 / (F.count("*").over(Window.partitionBy("p")) + 1)
    vx, vy = ((F.col(f"q{c}") - F.col(c)).cast("double").alias(f"v{c}") for c in "xy")
    return d, at, stage(c.select("frame", "p", "n", "q", vx, vy, prob.alias("prob")), "candidates")


def candidates(spark, sf):
    d, at, c = place_candidates(spark, sf)
    return J.of_places(d, at, c.drop("n").withColumn("f", F.col("frame"))).select(F.col("f").alias("frame"), "p", "q", "vx", "vy", "prob")


@query(CAND + f""", g AS (SELECT a.p, a.q, sum(exp(-((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 1.125) * b.prob * 0.25 * (b.vx - a.vx)) AS gx, sum(exp(-((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 1.125) * b.prob * 0.25 * (b.vy - a.vy)) AS gy
  FROM cand a JOIN cand b ON a.frame = b.frame AND a.p <> b.p AND (a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) <= 1.125 GROUP BY ALL)
SELECT cand.p, cand.q, {fixed('vx + 0.01 * coalesce(gx, 0)')} AS vx, {fixed('vy + 0.01 * coalesce(gy, 0)')} AS vy FROM cand LEFT JOIN g ON cand.p = g.p AND cand.q = g.q""")
def relaxation_step(spark, sf):
    d, at, c = place_candidates(spark, sf)
    moved = K.relax_velocities(c, 0.75, 0.01).select("p", "q", fx("vx", "vx"), fx("vy", "vy"))
    return J.of_places(d, at, stage(moved, "moved"))


@query(CAND + f""", s AS (SELECT a.p, a.q, count(*) AS s FROM cand a JOIN cand b ON a.frame = b.frame AND a.p <> b.p AND a.vx = b.vx AND a.vy = b.vy GROUP BY ALL),
k AS (SELECT cand.*, 1 - count(*) OVER (PARTITION BY cand.p) * prob AS none_, prob * coalesce(s.s, 0) AS v FROM cand LEFT JOIN s ON cand.p = s.p AND cand.q = s.q), t AS (SELECT *, sum(v) OVER (PARTITION BY p) AS t FROM k)
SELECT p, q, {fixed('CASE WHEN t > 1e-5 THEN v / (t + none_ * 0.5) ELSE 0 END')} AS prob, {fixed('CASE WHEN t > 1e-5 THEN none_ * 0.5 / (t + none_ * 0.5) ELSE 1 END')} AS none FROM t""")
def relaxation_probabilities(spark, sf):
    """Candidates supported by the others of the frame with the same velocity, counted per velocity, not paired up."""
    from pyspark.sql import Window

    d, at, c = place_candidates(spark, sf)
    every = c.groupBy("frame", "vx", "vy").agg(F.sum("n").alias("every"))
    own = F.count("*").over(Window.partitionBy("p", "vx", "vy"))
    support = c.join(every, ["frame", "vx", "vy"]).select("p", "q", (F.col("every") - own).alias("s"))
    none = 1 - F.count("*").over(Window.partitionBy("p")) * F.col("prob")
    found = K.relax_probabilities(c.select("p", "q", "prob", none.alias("none")), support, 0.5).select("p", "q", fx("prob", "prob"), fx("none", "none"))
    return J.of_places(d, at, stage(found, "supported"))


@query(D + " SELECT id FROM dots ORDER BY md5(id::VARCHAR || ':7'), id LIMIT 50")
def random_indices(spark, sf):
    return K.sample_ids(dots(spark, sf), "id", 50, "7")


@query(CAND + f""", w AS (SELECT a.p, a.q, b.p AS p2, b.q AS q2, exp(-((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 1.125) AS dd, b.prob * 0.25 AS e FROM cand a JOIN cand b ON a.frame = b.frame AND a.p <> b.p AND (a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) <= 1.125)
SELECT p, q, p2, q2, {fixed('e * dd / (e * dd + (1 - e) * 0.5)')} AS w FROM w""")
def link_weights(spark, sf):
    """Links of the candidates of all pairs of a frame's points whose velocities are within the distance."""
    c = stage(candidates(spark, sf), "candidates")
    pts = c.select("frame", F.col("vx").alias("x"), F.col("vy").alias("y"), "p", "q", "prob")
    pairs = J.range_join(pts, pts, 1.125**0.5, condition=F.col("a.p") != F.col("b.p"))
    rows = pairs.select(F.col("a.p").alias("p"), F.col("a.q").alias("q"), F.col("b.p").alias("p2"), F.col("b.q").alias("q2"), F.exp(-J.d2("a", "b") / 1.125).alias("dd"), F.col("b.prob").alias("prob"), F.lit(0.5).alias("link1"), F.lit(0.5).alias("link2"))
    return K.update_links(rows, 0.5).select("p", "q", "p2", "q2", fx("w", "w"))


