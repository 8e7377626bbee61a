"""Particles, projections, lookups and the remaining sequence and similarity measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import geometry as geo
from tessella.operators import graph as G
from tessella.operators import joins as J
from tessella.operators import particles as R
from tessella.operators import sequences as Q
from tessella.operators import stencil as S
from tessella.operators.components import connected_components
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.queries.graphs import CELLS, NATION, cell_edges, cells, nation_edges
from tessella.queries.sequences import NEXT
from tessella.queries.spatial import D2, framed
from tessella.queries.stencil import fx
from tessella.queries.temporal import CAND, place_candidates
from tessella.sources import arrays
from tessella.sources.bindings import GRID, SQL, contours, dots, pixels, table

P, D, C = f"WITH {SQL['pixels']}", f"WITH {SQL['dots']}", f"WITH {SQL['contours']}"

GEN = CELLS + """, n AS (SELECT a.id, a.frame, a.x, a.y, count(*) - 1 AS n4 FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY ALL),
gr(id, gen) AS (SELECT id, 1 FROM n WHERE n4 < 4 AND x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30 UNION SELECT b.id, gr.gen + 1 FROM gr JOIN c a ON a.id = gr.id JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE gr.gen < 40 AND b.id NOT IN (SELECT id FROM n WHERE n4 < 4 AND x BETWEEN 1 AND 30 AND y BETWEEN 1 AND 30)),
ge AS (SELECT c.id, c.frame, c.x, c.y, coalesce(min(gen), 0)::INT AS gen FROM c LEFT JOIN gr ON c.id = gr.id GROUP BY ALL),
pr AS (SELECT a.id AS asc_, b.id AS desc_, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM ge a JOIN ge b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.gen = a.gen + 1),
li AS (SELECT asc_, desc_ FROM pr QUALIFY d2 = min(d2) OVER (PARTITION BY asc_))"""


def _generations(spark, sf):
    return stage(R.depth_generations(stage(cells(spark, sf), "cells"), GRID, GRID), "generations")


@query(GEN + " SELECT id::BIGINT AS id, frame, x, y, gen FROM ge")
def depth_generations(spark, sf):
    return _generations(spark, sf).select("id", "frame", "x", "y", "gen")


@query(GEN + " SELECT asc_::BIGINT AS \"asc\", desc_::BIGINT AS \"desc\" FROM li")
def closest_descendants(spark, sf):
    return R.descendants(_generations(spark, sf))


@query(GEN + """ SELECT id::BIGINT AS id, a AS n_asc, d AS n_desc, a >= 2 OR d = 0 AS medial, CASE WHEN x IN (0, 31) OR y IN (0, 31) THEN 0 WHEN d = 0 THEN 2 ELSE 0 END AS core
FROM (SELECT ge.*, (SELECT count(*) FROM li WHERE desc_ = id) AS a, (SELECT count(*) FROM li WHERE asc_ = id) AS d FROM ge)""")
def core_codes(spark, sf):
    g = _generations(spark, sf)
    return R.core_codes(g, R.descendants(g), GRID, GRID).select("id", "n_asc", "n_desc", "medial", "core")


@query(GEN + """, cores AS (SELECT id FROM ge WHERE id NOT IN (SELECT asc_ FROM li)), fl(id, label, k) AS (SELECT id, id, 0 FROM cores UNION SELECT li.asc_, fl.label, fl.k + 1 FROM fl JOIN li ON li.desc_ = fl.id)
SELECT id::BIGINT AS id, min(label)::BIGINT AS label FROM fl QUALIFY true GROUP BY id, k HAVING k = (SELECT min(k) FROM fl f WHERE f.id = fl.id)""".replace(" QUALIFY true", ""))
def flowed_labels(spark, sf):
    """Each particle gets the label of the nearest core below it, in steps; of several the least."""
    g = _generations(spark, sf)
    links = stage(R.descendants(g), "links")
    cores = g.select("id").join(links.select(F.col("asc").alias("id")), "id", "left_anti").withColumn("label", F.col("id"))
    return R.flow_labels(g, links, cores)


@query()
def particle_forest(spark, sf):
    return R.particle_forest(stage(cells(spark, sf), "cells"), 3.0)


@query(CELLS.replace("v >= 1", "v <= 0") + """, e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(u, v) AS (SELECT id, id FROM c UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u), comp AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY u),
o AS (SELECT c.*, component FROM c JOIN comp USING (id) WHERE component IN (SELECT component FROM c JOIN comp USING (id) WHERE x IN (0, 31) OR y IN (0, 31))),
er AS (SELECT a.frame, a.x, a.y, a.component FROM o a JOIN o b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.frame, a.x, a.y, a.component HAVING count(*) = (3 - (a.x IN (0, 31))::INT) * (3 - (a.y IN (0, 31))::INT)),
s0 AS (SELECT frame, component, count(*) AS n FROM er GROUP BY ALL), s AS (SELECT *, row_number() OVER w AS nth, lead(n) OVER w AS second FROM s0 WINDOW w AS (PARTITION BY frame ORDER BY n DESC, component))
SELECT frame, x, y, component::BIGINT AS component FROM er WHERE component NOT IN (SELECT component FROM s WHERE nth = 1 AND n > 5 * second)""")
def outer_regions(spark, sf):
    z = stage(pixels(spark, sf).where("v <= 0").select("frame", "x", "y", ((F.col("frame") * GRID + F.col("y")) * GRID + F.col("x")).cast("bigint").alias("id")), "cells")
    comp = connected_components(cell_edges(z)).withColumnRenamed("node", "id")
    full = z.select("id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return R.inner_regions(z, full, GRID, GRID)


@query(P + " SELECT frame, x, y, (v - 1) * 3 AS scaled, ((x - 16) % 32 + 32) % 32 AS cx, (y + 5) % 32 AS wy FROM pixels")
def adjusted_intensity(spark, sf):
    return pixels(spark, sf).select("frame", "x", "y", ((F.col("v") - 1) * 3).alias("scaled"), F.pmod(F.col("x") - 16, F.lit(32)).alias("cx"), F.pmod(F.col("y") + 5, F.lit(32)).alias("wy"))


@query(P + ", q AS (SELECT frame, x + 3 AS x, y - 2 AS y FROM pixels) SELECT q.frame, q.x, q.y, coalesce(p.v, 0) AS v, p.v IS NOT NULL AS success FROM q LEFT JOIN pixels p ON p.frame = q.frame AND p.x = q.x AND p.y = q.y")
def bounded_lookup(spark, sf):
    p = pixels(spark, sf)
    return arrays.lookup(p, p.select("frame", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"))).select("frame", "x", "y", "v", "success")


@query(P + " SELECT p.frame, p.x, p.y, coalesce(c.v, -1) AS v FROM pixels p LEFT JOIN (SELECT * FROM pixels WHERE v >= 3) c ON p.frame = c.frame AND p.x = c.x AND p.y = c.y")
def gathered_default(spark, sf):
    p = pixels(spark, sf)
    return arrays.gather(p, p.where("v >= 3"), "v", -1)


@query(P + " SELECT frame, len(a) AS n, a[1] AS v0, a[1024] AS v1023, list_sum(a)::BIGINT AS total FROM (SELECT frame, list(v ORDER BY y, x) AS a FROM pixels GROUP BY frame)")
def frame_arrays(spark, sf):
    a = arrays.to_arrays(pixels(spark, sf), "frame")
    return a.select("frame", F.size("values").cast("bigint").alias("n"), F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1023)).alias("v1023"), F.aggregate("values", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


@query(P + " SELECT frame, x, y, v FROM pixels")
def arrays_round_trip(spark, sf):
    return arrays.from_arrays(arrays.to_arrays(pixels(spark, sf), "frame"), "frame", GRID)


@query(D + """, b AS (SELECT id, floor((atan2(y - 75, x - 100) + pi()) / (2 * pi()) * 16)::INT AS bin, (x - 100) * (x - 100) + (y - 75) * (y - 75) AS d2, t FROM dots)
SELECT t, bin, count(*) AS n, arg_min(id, (d2, id)) AS first, max(d2) AS far FROM (SELECT *, least(bin, 15) AS b2 FROM b) GROUP BY t, bin""")
def angular_queues(spark, sf):
    """Dots about a click by direction, each bin a queue by distance."""
    d = dots(spark, sf)
    far = (F.col("x") - 100) * (F.col("x") - 100) + (F.col("y") - 75) * (F.col("y") - 75)
    bins = F.floor((F.atan2(F.col("y") - 75, F.col("x") - 100) + F.pi()) / (2 * F.pi()) * 16).cast("int")
    b = d.select("id", "t", bins.alias("bin"), far.alias("d2"))
    return b.groupBy("t", "bin").agg(F.count("*").alias("n"), F.min_by("id", F.struct("d2", "id")).alias("first"), F.max("d2").alias("far"))


@query(D + """, e(i, v) AS (VALUES (0, 5.0::DOUBLE), (1, 20.0), (2, 60.0), (3, 140.0), (4, 300.0)) SELECT id, (SELECT arg_min(i, (abs(v - x), i)) FROM e) AS bin FROM dots""")
def nearest_bin(spark, sf):
    edges = [5.0, 20.0, 60.0, 140.0, 300.0]
    best = F.array_min(F.array(*[F.struct(F.abs(F.lit(v) - F.col("x")).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(edges)]))
    return dots(spark, sf).select("id", best["i"].alias("bin"))


@query(D + " SELECT id, rank() OVER (PARTITION BY t ORDER BY x) AS rnk, dense_rank() OVER (PARTITION BY t ORDER BY x) AS dense, ntile(4) OVER (PARTITION BY t ORDER BY x, id) AS quarter FROM dots")
def frame_ranks(spark, sf):
    by = Window.partitionBy("t").orderBy("x")
    r = dots(spark, sf).select("id", F.rank().over(by).alias("rnk"), F.dense_rank().over(by).alias("dense"), F.ntile(4).over(Window.partitionBy("t").orderBy("x", "id")).alias("quarter"))
    return r.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("rnk", "dense", "quarter")])


@query(C + """, m AS (SELECT contour_id, avg(x) AS cx, avg(y) AS cy FROM contours GROUP BY ALL) SELECT contour_id, seq, row_number() OVER (PARTITION BY contour_id ORDER BY atan2(y - cy, x - cx), seq) AS nth FROM contours JOIN m USING (contour_id)""")
def angular_order(spark, sf):
    by = Window.partitionBy("contour_id")
    a = contours(spark, sf).withColumn("angle", F.atan2(F.col("y") - F.avg("y").over(by), F.col("x") - F.avg("x").over(by)))
    return a.select("contour_id", "seq", F.row_number().over(by.orderBy("angle", "seq")).cast("bigint").alias("nth"))


@query(NEXT + f""", l AS (SELECT contour_id, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS len, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM n GROUP BY contour_id)
SELECT a.contour_id, {fixed('(a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)')} AS translation, {fixed('abs(coalesce(a.len, 0) - coalesce(b.len, 0))')} AS len FROM l a JOIN l b ON b.contour_id = a.contour_id + 1""")
def contour_similarity(spark, sf):
    """Squared distance of the centres and difference in arc length of following contours."""
    n = Q.with_next(contours(spark, sf))
    m = n.groupBy("contour_id").agg(F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("len"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    b = m.select((F.col("contour_id") - 1).alias("contour_id"), *[F.col(c).alias(f"{c}2") for c in ("len", "cx", "cy")])
    j = m.join(b, "contour_id").fillna(0.0, ["len", "len2"])
    d = (F.col("cx") - F.col("cx2")) * (F.col("cx") - F.col("cx2")) + (F.col("cy") - F.col("cy2")) * (F.col("cy") - F.col("cy2"))
    return j.select("contour_id", d.alias("translation"), F.abs(F.col("len") - F.col("len2")).alias("len")).select("contour_id", fx("translation", "translation"), fx("len", "len"))


@query(C + f""", k AS (SELECT *, count(*) OVER (PARTITION BY contour_id) AS n FROM contours)
SELECT a.contour_id, {fixed('sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))')} AS total FROM k a JOIN k b ON b.contour_id = a.contour_id + 1 AND b.seq = floor(a.seq * b.n / a.n::DOUBLE) GROUP BY a.contour_id""")
def total_difference(spark, sf):
    """Distances of each point to the next contour's point at the same relative index, summed."""
    k = contours(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("contour_id")))
    b = k.select((F.col("contour_id") - 1).alias("contour_id"), F.col("seq").alias("s2"), F.col("x").alias("u"), F.col("y").alias("v"), "n")
    sizes = b.groupBy("contour_id").agg(F.max("n").alias("n2"))
    a = k.join(sizes, "contour_id").withColumn("s2", F.floor(F.col("seq") * F.col("n2") / F.col("n")))
    j = a.select("contour_id", "s2", "x", "y").join(b.select("contour_id", "s2", "u", "v"), ["contour_id", "s2"])
    return j.groupBy("contour_id").agg(F.sum(F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))).alias("total")).select("contour_id", fx("total", "total"))


@query(NEXT + f""", a AS (SELECT contour_id, seq, atan2(ny - y, nx - x) AS out_, atan2(y - py, x - px) AS in_, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS l FROM n WHERE nx IS NOT NULL AND px IS NOT NULL)
SELECT contour_id, {fixed('sum((1 - cos(out_ - in_)) / l)')} AS energy FROM a WHERE l > 0 GROUP BY contour_id""")
def elastica_energy(spark, sf):
    """Bending energy: turn of each point over the length that follows."""
    c = contours(spark, sf).withColumns({"nx": Q.following("x"), "ny": Q.following("y"), "px": Q.preceding("x"), "py": Q.preceding("y")}).where("nx IS NOT NULL AND px IS NOT NULL")
    turn = F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x")) - F.atan2(F.col("y") - F.col("py"), F.col("x") - F.col("px"))
    c = c.select("contour_id", turn.alias("t"), F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))).alias("l")).where("l > 0")
    return c.groupBy("contour_id").agg(F.sum((1 - F.cos("t")) / F.col("l")).alias("energy")).select("contour_id", fx("energy", "energy"))


@query(C + """, b AS (SELECT contour_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM contours GROUP BY ALL)
SELECT a.contour_id, CASE WHEN a.x1 < b.x0 THEN 'left' WHEN a.x0 > b.x1 THEN 'right' ELSE 'undetermined' END AS side, CASE WHEN a.y1 < b.y0 THEN 'front' WHEN a.y0 > b.y1 THEN 'back' ELSE 'undetermined' END AS depth FROM b a JOIN b ON b.contour_id = a.contour_id + 1""")
def relative_position(spark, sf):
    """All pairs of points agree on a side exactly when the extremes do, so no pairs are formed."""
    b = contours(spark, sf).groupBy("contour_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    n = b.select((F.col("contour_id") - 1).alias("contour_id"), *[F.col(c).alias(f"n{c}") for c in ("x0", "x1", "y0", "y1")])
    j = b.join(n, "contour_id")
    return j.select("contour_id", F.when(F.col("x1") < F.col("nx0"), "left").when(F.col("x0") > F.col("nx1"), "right").otherwise("undetermined").alias("side"),
                    F.when(F.col("y1") < F.col("ny0"), "front").when(F.col("y0") > F.col("ny1"), "back").otherwise("undetermined").alias("depth"))


@query(NATION + """, a(id, anc) AS (SELECT src, src FROM edges UNION SELECT dst, dst FROM edges UNION SELECT a.id, e.src FROM a JOIN edges e ON e.dst = a.anc AND e.src < e.dst),
r AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges EXCEPT SELECT dst FROM edges WHERE src < dst) SELECT a.id, count(*) AS roots FROM a JOIN r ON a.anc = r.id GROUP BY a.id""")
def ascendant_roots(spark, sf):
    """How many roots of the acyclic trade each vertex goes back to."""
    e = stage(nation_edges(spark, sf), "nations")
    up = e.where("src < dst").select(F.col("dst").alias("id"), F.col("src").alias("asc"))
    every = G.vertices(e)
    anc = G.ancestors(stage(up, "up"), 25).select("id", "anc").union(every.select("id", F.col("id").alias("anc"))).distinct()
    roots = every.join(up.select("id"), "id", "left_anti").withColumnRenamed("id", "anc")
    return anc.join(roots, "anc").groupBy("id").agg(F.count("*").alias("roots"))


@query(NATION + ", pk AS (SELECT dst, src, w, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS nth, lag(w) OVER (PARTITION BY src ORDER BY w, dst) AS before FROM edges) SELECT src, sum(w + coalesce(before, 0))::BIGINT AS cost, max(nth) AS n FROM pk GROUP BY src")
def path_costs(spark, sf):
    by = Window.partitionBy("src").orderBy("w", "dst")
    k = nation_edges(spark, sf).withColumns({"nth": F.row_number().over(by).cast("bigint"), "before": F.coalesce(F.lag("w").over(by), F.lit(0))})
    return k.groupBy("src").agg(F.sum(F.col("w") + F.col("before")).alias("cost"), F.max("nth").alias("n"))


@query(D + f""", s AS (SELECT a.t, a.id, b.id AS p, c.id AS r FROM dots a JOIN dots b ON b.t = a.t - 1 AND {D2} <= 9 JOIN dots c ON c.t = a.t + 1 AND (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) <= 9)
SELECT dots.id, CASE WHEN dots.id IN (SELECT id FROM s) THEN 'Seeking' WHEN NOT EXISTS (SELECT 1 FROM dots b WHERE b.t = dots.t - 1 AND (dots.x - b.x) * (dots.x - b.x) + (dots.y - b.y) * (dots.y - b.y) <= 9)
 AND EXISTS (SELECT 1 FROM dots b WHERE b.t = dots.t + 1 AND (dots.x - b.x) * (dots.x - b.x) + (dots.y - b.y) * (dots.y - b.y) <= 9) THEN 'Appeared' ELSE 'Isolated' END AS state FROM dots""")
def light_states(spark, sf):
    d = framed(spark, sf)
    at = stage(J.places(d), "places")
    seen = lambda step, name: J.range_join(at, at.withColumn("frame", F.col("frame") + step), 3.0).groupBy("frame", "a.x", "a.y").agg(F.sum("b.n").alias(name))
    j = d.join(seen(1, "before"), ["frame", "x", "y"], "left").join(seen(-1, "after"), ["frame", "x", "y"], "left").fillna(0, ["before", "after"])
    return j.select("id", R.light_state(F.lit(False), F.col("before") * F.col("after"), F.col("before"), F.col("after")).alias("state"))


@query(CAND + f""", tr AS (SELECT b.p AS q, a.p AS p, b.q AS r, (a.vx + b.vx) / 2 AS vx, (a.vy + b.vy) / 2 AS vy FROM cand a JOIN cand b ON a.q = b.p),
tc AS (SELECT *, 1 / count(*) OVER (PARTITION BY q)::DOUBLE AS prob FROM tr),
s1 AS (SELECT a.q, a.p, a.r, 0.1 + sum(exp(-((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 8) * b.prob) AS s FROM tc a JOIN tc b ON a.p = b.q GROUP BY ALL),
s2 AS (SELECT a.q, a.p, a.r, 0.1 + sum(exp(-((a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy)) / 8) * b.prob) AS s FROM tc a JOIN tc b ON a.r = b.q GROUP BY ALL),
f AS (SELECT tc.q, tc.p, tc.r, sqrt(coalesce(s1.s, 0.1) * coalesce(s2.s, 0.1)) * prob AS f FROM tc LEFT JOIN s1 ON tc.q = s1.q AND tc.p = s1.p AND tc.r = s1.r LEFT JOIN s2 ON tc.q = s2.q AND tc.p = s2.p AND tc.r = s2.r)
SELECT q, p, r, {fixed('f / sum(f) OVER (PARTITION BY q)')} AS prob FROM f""")
def light_support(spark, sf):
    """Dots that are candidates themselves are rows of their own; the others of a place have the same values and go as one row."""
    d, at, c = place_candidates(spark, sf)
    hit = stage(c.select(F.col("q").alias("id")).distinct(), "hit")
    own = d.join(hit, "id", "left_semi").join(at.select("frame", "x", "y", F.col("id").alias("at")), ["frame", "x", "y"]).select("id", "at")
    own = stage(own, "hit-dots")
    steps = c.select(F.col("p").alias("at"), "n", "q", "vx", "vy")
    mine = stage(steps.drop("n").join(own, "at").select(F.col("id").alias("p"), "at", F.lit(1).cast("bigint").alias("n"), "q", "vx", "vy"), "steps")
    left = steps.join(own.groupBy("at").agg(F.count("*").alias("k")), "at", "left").withColumn("n", F.col("n") - F.coalesce("k", F.lit(0))).where("n > 0")
    a = mine.unionByName(left.select(F.lit(None).cast("bigint").alias("p"), "at", "n", "q", "vx", "vy")).select("p", "at", "n", F.col("q").alias("mid"), F.col("vx").alias("ax"), F.col("vy").alias("ay"))
    b = mine.select(F.col("p").alias("mid"), F.col("q").alias("r"), F.col("vx").alias("bx"), F.col("vy").alias("by_"))
    t = a.join(b, "mid").select(F.col("mid").alias("q"), "p", "at", "n", "r", ((F.col("ax") + F.col("bx")) / 2).alias("vx"), ((F.col("ay") + F.col("by_")) / 2).alias("vy"))
    t = stage(t.withColumn("prob", 1 / F.sum("n").over(Window.partitionBy("q"))), "triples")
    s = stage(R.light_support(t, 2.0, 0.1).select("q", "p", "at", "r", fx("prob", "prob")), "supported")
    rest = J.of_places(d.join(hit, "id", "left_anti"), at, s.where("p IS NULL").select(F.col("at").alias("p"), "q", "r", "prob"))
    return s.where("p IS NOT NULL").select("q", "p", "r", "prob").unionByName(rest.select("q", "p", "r", "prob"))


@query(f"WITH {SQL['contours']}" + f", n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM contours WINDOW w AS (PARTITION BY contour_id ORDER BY seq)) SELECT contour_id, seq, {fixed('x + 2.5 * (nx - x)')} AS x, {fixed('y + 2.5 * (ny - y)')} AS y FROM n WHERE nx IS NOT NULL")
def projected_snapshot(spark, sf):
    """Vertices that move at the velocity to their successor, seen at time 2.5."""
    n = Q.with_next(contours(spark, sf)).where("nx IS NOT NULL")
    zero = F.lit(0.0)
    at = lambda p, v: geo.quadratic_at(F.col(p), zero, F.col(v) - F.col(p), F.lit(2.5))
    return n.select("contour_id", "seq", at("x", "nx").alias("x"), at("y", "ny").alias("y")).select("contour_id", "seq", fx("x", "x"), fx("y", "y"))


@query(P + " SELECT frame, x, y, v, CASE WHEN v > 2 THEN 255 ELSE 0 END AS bit FROM pixels")
def binary_threshold(spark, sf):
    return pixels(spark, sf).select("frame", "x", "y", "v", F.when(F.col("v") > 2, 255).otherwise(0).alias("bit"))


@query("WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS rnk FROM s ORDER BY n DESC, l_suppkey LIMIT 10")
def top_regions(spark, sf):
    """The ten suppliers with most parts: a bounded top-k."""
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)
    return s.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("n"), "l_suppkey")).cast("bigint"))


@query(D + """, u AS (SELECT y, t, x, id, lead(x) OVER (PARTITION BY y ORDER BY t, id) AS nx, lead(t) OVER (PARTITION BY y ORDER BY t, id) AS nt FROM dots), s AS (SELECT y, x, nx, t, nt, row_number() OVER (PARTITION BY y ORDER BY t, id) AS i FROM u WHERE nx IS NOT NULL)
SELECT a.y, count(*) AS crossings FROM s a JOIN s b ON a.y = b.y AND a.i + 1 < b.i WHERE greatest(a.x, a.nx) >= least(b.x, b.nx) AND greatest(b.x, b.nx) >= least(a.x, a.nx) GROUP BY a.y""")
def interval_overlaps(spark, sf):
    """Steps of a row of dots whose ranges of x overlap without following each other."""
    by = Window.partitionBy("y").orderBy("t", "id")
    s = dots(spark, sf).withColumns({"nx": F.lead("x").over(by), "i": F.row_number().over(by)}).where("nx IS NOT NULL").select("y", "i", F.least("x", "nx").alias("lo"), F.greatest("x", "nx").alias("hi"))
    return J.overlap_counts(stage(s, "ranges"), "y", "i").select("y", F.col("n").alias("crossings"))


_KINDS = {
    "four": "abs(dx) + abs(dy) = 1", "eight": "(dx, dy) <> (0, 0)", "nine": "true", "causal": "dy < 0 OR (dy = 0 AND dx < 0)",
    "anticausal": "dy > 0 OR (dy = 0 AND dx > 0)", "causal_four": "abs(dx) + abs(dy) = 1 AND (dy < 0 OR (dy = 0 AND dx < 0))",
}


@query(P + """, c AS (SELECT frame, x, y FROM pixels WHERE v >= 1), o AS (SELECT a.dx, b.dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy)),
m AS (SELECT dx, dy, count(*) AS n FROM c a CROSS JOIN o JOIN c b ON b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL),
k AS (""" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, dx, dy FROM o WHERE {cond}" for kind, cond in _KINDS.items()) + """)
SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY dy, dx) - 1)::INT AS k, dx::INT AS dx, dy::INT AS dy, coalesce(n, 0) AS n FROM k LEFT JOIN m USING (dx, dy)""")
def offset_table(spark, sf):
    """Each neighbourhood's offsets in order, and how many cells have a neighbour there."""
    c = stage(pixels(spark, sf).where("v >= 1").select("frame", "x", "y"), "cells")
    out = None
    for kind in _KINDS:
        steps = S.offset_table(spark, 2, kind).select(F.lit(kind).alias("kind"), "k", "dx", "dy")
        hits = S.moved(c, S.offsets(2, kind)).join(c, ["frame", "x", "y"]).groupBy("k").agg(F.count("*").alias("n"))
        rows = steps.join(hits, "k", "left").select("kind", "k", "dx", "dy", F.coalesce("n", F.lit(0)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
