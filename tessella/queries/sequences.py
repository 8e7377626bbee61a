"""Queries over contours and scalar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.operators import sequences as Q
from tessella.queries import fixed, query
from tessella.queries.stencil import fx
from tessella.sources.bindings import SQL, contours, dots

C = f"WITH {SQL['contours']}"
NEXT = C + """, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py,
  first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY seq))"""


@query(NEXT + f""", s AS (SELECT contour_id, count(*) AS n, sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) AS s,
  sum(sqrt((coalesce(nx, fx) - x) * (coalesce(nx, fx) - x) + (coalesce(ny, fy) - y) * (coalesce(ny, fy) - y))) AS p FROM n GROUP BY contour_id)
SELECT contour_id, n, {fixed('CASE WHEN n < 3 THEN 0 ELSE abs(s) / 2 END')} AS area, {fixed('p')} AS perimeter,
 {fixed('CASE WHEN n < 8 OR p = 0 THEN 0 ELSE abs(s) / 2 / p END')} AS measure, (CASE WHEN abs(s) < 1e-6 THEN 0 ELSE sign(s) END)::INT AS orientation FROM s""")
def polygon_area_perimeter(spark, sf):
    return Q.polygon_measures(contours(spark, sf)).select("contour_id", "n", fx("area", "area"), fx("perimeter", "perimeter"), fx("measure", "measure"), "orientation")


@query(NEXT + f" SELECT contour_id, {fixed('sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)))')} AS length FROM n WHERE nx IS NOT NULL GROUP BY contour_id")
def arc_length(spark, sf):
    return Q.arc_length(contours(spark, sf)).select("contour_id", fx("length", "length"))


@query(NEXT + f" SELECT contour_id, seq, {fixed('atan2(coalesce(ny, y) - coalesce(py, y), coalesce(nx, x) - coalesce(px, x))')} AS angle FROM n")
def turning_angles(spark, sf):
    return Q.turning_angles(contours(spark, sf)).select("contour_id", "seq", fx("angle", "angle"))


BIN = """(CASE WHEN ny - y > 0.5 THEN 2 WHEN ny - y < -0.5 THEN 0 ELSE 1 END) * 3 + CASE WHEN nx - x > 0.5 THEN 2 WHEN nx - x < -0.5 THEN 0 ELSE 1 END"""


@query(NEXT + f" SELECT contour_id, {BIN} AS bin, count(*) AS n FROM n WHERE nx IS NOT NULL GROUP BY ALL")
def step_histogram(spark, sf):
    return Q.step_histogram(contours(spark, sf))


@query(NEXT + f""", h AS (SELECT contour_id, {BIN} AS bin, count(*) AS n FROM n WHERE nx IS NOT NULL GROUP BY ALL),
t AS (SELECT contour_id, sum(n) AS total FROM h GROUP BY contour_id),
p AS (SELECT t.contour_id, b.bin, (coalesce(h.n, 0) + 0.001) / (total + 0.009) AS p FROM t CROSS JOIN range(9) b(bin) LEFT JOIN h ON h.contour_id = t.contour_id AND h.bin = b.bin)
SELECT a.contour_id, {fixed('sum(a.p * ln(a.p / b.p))')} AS kl FROM p a JOIN p b ON b.contour_id = a.contour_id + 1 AND a.bin = b.bin GROUP BY a.contour_id""")
def kl_divergence(spark, sf):
    p = Q.smoothed_distribution(Q.step_histogram(contours(spark, sf)))
    nxt = p.select((F.col("contour_id") - 1).alias("contour_id"), F.col("pdf").alias("q"))
    return p.join(nxt, "contour_id").select("contour_id", Q.kl_divergence(F.col("pdf"), F.col("q")).alias("kl")).select("contour_id", fx("kl", "kl"))


@query(C + " SELECT contour_id, seq, x, y FROM contours WHERE seq % 3 = 0")
def sample_every_third(spark, sf):
    return Q.sample_every(contours(spark, sf), 3)


@query(C + """, s AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM contours)
SELECT contour_id, seq, x, y FROM s WHERE n <= 5 OR floor(seq * 5 / n::DOUBLE) <> floor((seq - 1) * 5 / n::DOUBLE)""")
def sample_fixed_size(spark, sf):
    return Q.sample_count(contours(spark, sf), 5)


@query(C + " SELECT contour_id, seq, floor(seq / ceil(count(*) OVER (PARTITION BY contour_id) / 3.0))::INT AS piece FROM contours")
def split_contours(spark, sf):
    return Q.split_even(contours(spark, sf), 3).select("contour_id", "seq", "piece")


@query(C + " SELECT contour_id, seq, (sum(CASE WHEN y < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY contour_id ORDER BY seq))::INT AS piece FROM contours")
def split_by_saliency(spark, sf):
    return Q.split_at(contours(spark, sf), F.col("y") < 50).select("contour_id", "seq", "piece")


@query(C + """, g AS (SELECT contour_id, seq, floor(x / 400)::INT AS gx, floor(y / 400)::INT AS gy FROM contours),
l AS (SELECT *, lag(gx) OVER w AS lx, lag(gy) OVER w AS ly FROM g WINDOW w AS (PARTITION BY contour_id ORDER BY seq))
SELECT contour_id, seq, gx, gy FROM l WHERE lx IS NULL OR lx <> gx OR ly <> gy""")
def grid_trace(spark, sf):
    return Q.drop_repeated_cells(contours(spark, sf), 400)


@query(C + f" SELECT contour_id, seq, {fixed('x - avg(x) OVER (PARTITION BY contour_id)')} AS x, {fixed('y - avg(y) OVER (PARTITION BY contour_id)')} AS y FROM contours")
def centred_contours(spark, sf):
    return Q.centred(contours(spark, sf)).select("contour_id", "seq", fx("x", "x"), fx("y", "y"))


@query(NEXT + f""", m AS (SELECT *, (CASE WHEN nx IS NULL THEN 1 ELSE greatest(1, ceil(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 100)) END)::INT AS m FROM n),
k AS (SELECT *, unnest(range(m))::INT AS k FROM m)
SELECT contour_id, seq, k, {fixed('x + coalesce((nx - x) * k / m, 0)')} AS x, {fixed('y + coalesce((ny - y) * k / m, 0)')} AS y FROM k""")
def densified_contours(spark, sf):
    return Q.densify(contours(spark, sf), 100).select("contour_id", "seq", "k", fx("x", "x"), fx("y", "y"))


@query(C + " SELECT contour_id, max(seq) OVER (PARTITION BY contour_id) - seq AS seq, x, y FROM contours")
def reversed_contours(spark, sf):
    return Q.reversed_sequence(contours(spark, sf))


@query(C + " SELECT contour_id, seq - 2 AS seq, x, y FROM contours WHERE seq BETWEEN 2 AND 5")
def extracted_fragments(spark, sf):
    return Q.extract(contours(spark, sf), 2, 5)


@query(C + " SELECT contour_id, len(list(x)) AS n, list(x ORDER BY seq)[1] AS x0, list(y ORDER BY seq)[-1] AS y1 FROM contours GROUP BY contour_id")
def ragged_contours(spark, sf):
    n = Q.nested(contours(spark, sf))
    return n.select("contour_id", F.size("points").cast("bigint").alias("n"), F.get("points", F.lit(0))["x"].alias("x0"), F.element_at("points", -1)["y"].alias("y1"))


@query(f"WITH {SQL['dots']}" + """, b AS (SELECT t, y, count(*) AS n FROM dots GROUP BY ALL),
l AS (SELECT t, y, n, (SELECT max(c.y) FROM b c WHERE c.t = b.t AND c.y < b.y AND c.n >= 4) AS l, (SELECT max(c.y) FROM b c WHERE c.t = b.t AND c.n >= 4) AS hi,
  (SELECT min(c.y) FROM b c WHERE c.t = b.t AND c.y > b.y AND c.n >= 4) AS r, (SELECT min(c.y) FROM b c WHERE c.t = b.t AND c.n >= 4) AS lo FROM b)
SELECT t, y, n, coalesce(l, hi) AS "left", coalesce(r, lo) AS "right" FROM l""")
def nearest_active_bins(spark, sf):
    b = dots(spark, sf).groupBy("t", "y").agg(F.count("*").alias("n"))
    return Q.nearest_active(b, "t", "y", F.col("n") >= 4)


@query(NEXT + f""", a AS (SELECT contour_id, seq, x, y, nx, ny, px, py, sqrt((px-x)*(px-x)+(py-y)*(py-y)) AS p, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS q, sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py)) AS r
 FROM n WHERE nx IS NOT NULL AND px IS NOT NULL)
SELECT contour_id, seq, {fixed('(px-x)*(ny-y)-(nx-x)*(py-y)')} AS turn, {fixed('CASE WHEN p*q = 0 THEN 0 ELSE acos(greatest(-1, least(1, (p*p+q*q-r*r)/(2*p*q)))) END')} AS angle,
 {fixed('CASE WHEN (p+q+r)/2*((p+q+r)/2-p)*((p+q+r)/2-q)*((p+q+r)/2-r) > 0 THEN sqrt((p+q+r)/2*((p+q+r)/2-p)*((p+q+r)/2-q)*((p+q+r)/2-r)) ELSE 0 END')} AS area, list_sort([p, q, r])[2] AS mid FROM a""")
def triangle_functions(spark, sf):
    c = contours(spark, sf)
    n = c.withColumns({"nx": Q.following("x"), "ny": Q.following("y"), "px": Q.preceding("x"), "py": Q.preceding("y")}).where("nx IS NOT NULL AND px IS NOT NULL")
    o, a, b = (F.col("x"), F.col("y")), (F.col("px"), F.col("py")), (F.col("nx"), F.col("ny"))
    p, q, r = (F.sqrt((u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1])) for u, v in ((a, o), (b, o), (b, a)))
    n = n.select("contour_id", "seq", G.cross(o, a, b).alias("turn"), G.visual_angle(a, b, o).alias("angle"), G.triangle_area(p, q, r).alias("area"), G.middle(p, q, r).alias("mid"))
    return n.select("contour_id", "seq", fx("turn", "turn"), fx("angle", "angle"), fx("area", "area"), "mid")


POLYGON = [(20, 10), (120, 15), (160, 70), (90, 60), (60, 130), (15, 90)]
EDGES = ", ".join(f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)))


@query(f"WITH {SQL['dots']}, e(e, ax, ay, tx, ty) AS (VALUES {EDGES})" + """ SELECT id, sum(CASE WHEN (ay > y) <> (ty > y) AND x < ax + (y - ay) * (tx - ax) / (ty - ay) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM dots, e GROUP BY id""")
def point_in_polygon(spark, sf):
    # the polygon is a literal of a few edges: they become one array, no join
    p = (F.col("x").cast("double"), F.col("y").cast("double"))
    crossings = [G.crosses_ray(p, (F.lit(float(a[0])), F.lit(float(a[1]))), (F.lit(float(b[0])), F.lit(float(b[1])))).cast("int") for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)]
    return dots(spark, sf).select("id", (sum(crossings[1:], crossings[0]) % 2 == 1).alias("inside"))


@query(f"WITH {SQL['dots']}, e(e, ax, ay, tx, ty) AS (VALUES {EDGES})" + f""", k AS (SELECT id, x, y, e.*, greatest(0, least(1, ((x - ax) * (tx - ax) + (y - ay) * (ty - ay)) / ((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)))) AS u FROM dots, e)
SELECT id, {fixed('min(sqrt((x - ax - u * (tx - ax)) * (x - ax - u * (tx - ax)) + (y - ay - u * (ty - ay)) * (y - ay - u * (ty - ay))))')} AS d FROM k GROUP BY id""")
def distance_to_segments(spark, sf):
    p = (F.col("x").cast("double"), F.col("y").cast("double"))
    ds = [G.distance_to_segment(p, (F.lit(float(a[0])), F.lit(float(a[1]))), (F.lit(float(b[0])), F.lit(float(b[1])))) for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)]
    return dots(spark, sf).select("id", F.least(*ds).alias("d")).select("id", fx("d", "d"))


@query(NEXT + f""", s AS (SELECT contour_id, seq, x, y, nx, ny FROM n WHERE nx IS NOT NULL), k AS (SELECT a.contour_id, a.seq AS i, b.seq AS j, (a.nx-a.x)*(b.ny-b.y)-(a.ny-a.y)*(b.nx-b.x) AS det,
 (b.x-a.x)*(b.ny-b.y)-(b.y-a.y)*(b.nx-b.x) AS s, (b.x-a.x)*(a.ny-a.y)-(b.y-a.y)*(a.nx-a.x) AS t FROM s a JOIN s b ON a.contour_id = b.contour_id AND a.seq + 1 < b.seq)
SELECT contour_id, i, j, {fixed('s / det')} AS s, {fixed('t / det')} AS t FROM k WHERE det <> 0 AND s / det BETWEEN 0 AND 1 AND t / det BETWEEN 0 AND 1""")
def self_intersections(spark, sf):
    s = Q.with_next(contours(spark, sf)).where("nx IS NOT NULL")
    a, b = s.alias("a"), s.alias("b")
    pt = lambda t, x, y: (F.col(f"{t}.{x}"), F.col(f"{t}.{y}"))
    u, v = G.segment_intersection(pt("a", "x", "y"), pt("a", "nx", "ny"), pt("b", "x", "y"), pt("b", "nx", "ny"))
    j = a.join(b, (F.col("a.contour_id") == F.col("b.contour_id")) & (F.col("a.seq") + 1 < F.col("b.seq")))
    j = j.select("a.contour_id", F.col("a.seq").alias("i"), F.col("b.seq").alias("j"), u.alias("s"), v.alias("t")).where("s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1")
    return j.select("contour_id", "i", "j", fx("s", "s"), fx("t", "t"))


@query(f"WITH {SQL['dots']}" + " SELECT id, x + 1048576 * y + 1048576 * 150 * t::BIGINT AS idx, x AS sx, y AS sy, t AS st FROM dots")
def linear_subscripts(spark, sf):
    d = dots(spark, sf)
    dims = (1 << 20, 150, 1 << 15)
    idx = G.linear_index(dims, F.col("x"), F.col("y"), F.col("t"))
    return d.select("id", idx.alias("idx")).select("id", "idx", *[c.alias(n) for c, n in zip(G.subscripts(dims, F.col("idx")), ("sx", "sy", "st"), strict=True)])


@query(NEXT + f""", p AS (SELECT *, (nx - px) AS ux, (ny - py) AS uy FROM n WHERE nx IS NOT NULL AND px IS NOT NULL)
SELECT contour_id, seq, {fixed('coalesce(ux / nullif(sqrt(ux * ux + uy * uy), 0), 0)')} AS ux, {fixed('exp(-(ux * ux + uy * uy) / 2e6)')} AS g, {fixed('1 / (1 + exp((sqrt(ux * ux + uy * uy) - 500) / 500))')} AS len, {fixed('(1 - cos(atan2(uy, ux))) / 2')} AS ang FROM p""")
def fitness_functions(spark, sf):
    c = contours(spark, sf).withColumns({"nx": Q.following("x"), "ny": Q.following("y"), "px": Q.preceding("x"), "py": Q.preceding("y")}).where("nx IS NOT NULL AND px IS NOT NULL")
    u = [F.col("nx") - F.col("px"), F.col("ny") - F.col("py")]
    n = c.select("contour_id", "seq", G.unit(u)[0].alias("ux"), F.exp(-G.dot(u, u) / 2e6).alias("g"), G.logistic_length(G.length(*u), 500).alias("len"), G.angle_term(F.atan2(u[1], u[0])).alias("ang"))
    return n.select("contour_id", "seq", *[fx(k, k) for k in ("ux", "g", "len", "ang")])
