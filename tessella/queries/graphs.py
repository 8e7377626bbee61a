"""Graph and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import hierarchy as H
from tessella.operators import joins as J
from tessella.operators import mesh as M
from tessella.operators import stencil as S
from tessella.operators.components import connected_components
from tessella.plans.storage import stage
from tessella.queries import fixed, query
from tessella.queries.spatial import COMP, framed, with_components
from tessella.queries.stencil import fx
from tessella.sources.bindings import GRID, SQL, pixels, supply_edges, table

CELLS = f"WITH RECURSIVE {SQL['pixels']}, c AS (SELECT frame, x, y, (frame * {GRID} + y) * {GRID} + x AS id FROM pixels WHERE v >= 1)"
CELL_REACH = CELLS + """, e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(u, v) AS (SELECT id, id FROM c UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
comp AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY u)"""
SUPPLY = f"WITH {SQL['supply']}, u AS (SELECT src, dst, w, row_number() OVER (ORDER BY w, src, dst) AS r FROM supply)"
#: least largest rank on a path between suppliers, by squaring
_SQ = ", ".join(
    f"b{k} AS (SELECT a.src, b.dst, min(greatest(a.r, b.r)) AS r FROM b{k - 1} a JOIN b{k - 1} b ON a.dst = b.src GROUP BY ALL)" for k in range(1, 8)
)
BOTTLENECK = SUPPLY + f""", b0 AS (SELECT src, dst, r FROM u UNION ALL SELECT dst, src, r FROM u UNION ALL SELECT DISTINCT src, src, 0 FROM (SELECT src FROM u UNION ALL SELECT dst FROM u)), {_SQ},
mst AS (SELECT u.src, u.dst, u.w FROM u JOIN b7 ON u.src = b7.src AND u.dst = b7.dst AND u.r = b7.r)"""
NATION = """WITH RECURSIVE k AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (SELECT src, dst, floor(1000000 / n)::BIGINT AS w FROM k WHERE n >= (SELECT avg(n) FROM k))"""


def cells(spark, sf):
    c = pixels(spark, sf).where("v >= 1")
    return c.select("frame", "x", "y", ((F.col("frame") * GRID + F.col("y")) * GRID + F.col("x")).cast("bigint").alias("id"))


def cell_edges(c, kind: str = "causal"):
    """Neighbour edges of cells by the causal half of the neighbourhood: each pair once."""
    sent = S.moved(c, S.offsets(2, kind), ("id",)).withColumnRenamed("id", "dst")
    return sent.join(c.withColumnRenamed("id", "src"), ["frame", "x", "y"]).select("src", "dst")


def cell_components(spark, sf):
    c = stage(cells(spark, sf), "cells")
    comp = connected_components(cell_edges(c)).withColumnRenamed("node", "id")
    return c.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def nation_edges(spark, sf):
    """``src, dst, w``: trade from customer to supplier nations that is above average; w falls with its volume."""
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.count("*").alias("n"))
    n = stage(n, "trade")
    return n.join(F.broadcast(n.agg(F.avg("n").alias("mean"))), F.col("n") >= F.col("mean")).select("src", "dst", F.floor(1000000 / F.col("n")).cast("bigint").alias("w"))


@query(CELL_REACH + " SELECT frame, x, y, component::BIGINT AS component FROM c JOIN comp USING (id)")
def connected_cells(spark, sf):
    return cell_components(spark, sf).select("frame", "x", "y", "component")


@query(CELL_REACH + " SELECT frame, x, y, dense_rank() OVER (PARTITION BY frame ORDER BY component)::INT AS label FROM c JOIN comp USING (id)")
def component_labels(spark, sf):
    return G.dense_labels(cell_components(spark, sf), "frame").select("frame", "x", "y", "label")


@query(CELL_REACH + " SELECT frame, component::BIGINT AS component, count(*) AS n FROM c JOIN comp USING (id) GROUP BY ALL")
def component_sizes(spark, sf):
    return cell_components(spark, sf).groupBy("frame", "component").agg(F.count("*").alias("n"))


@query(CELL_REACH + """, s AS (SELECT frame, component, count(*) AS n FROM c JOIN comp USING (id) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40)
SELECT frame, component::BIGINT AS component, n, row_number() OVER (PARTITION BY frame ORDER BY component)::INT AS label FROM s""")
def size_filtered_components(spark, sf):
    s = cell_components(spark, sf).groupBy("frame", "component").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 40")
    return G.dense_labels(s, "frame").select("frame", "component", "n", "label")


@query(CELL_REACH.replace("v >= 1", "v <= 0") + " SELECT frame, component::BIGINT AS component, count(*) AS n FROM c JOIN comp USING (id) GROUP BY ALL HAVING bool_or(x IN (0, 31) OR y IN (0, 31))")
def background_components(spark, sf):
    z = pixels(spark, sf).where("v <= 0").select("frame", "x", "y", ((F.col("frame") * GRID + F.col("y")) * GRID + F.col("x")).cast("bigint").alias("id"))
    z = stage(z, "cells")
    comp = connected_components(cell_edges(z)).withColumnRenamed("node", "id")
    full = z.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return full.groupBy("frame", "component").agg(F.count("*").alias("n"), F.max(S.border(F.col("x"), F.col("y"), GRID, GRID)).alias("b")).where("b").drop("b")


@query(COMP + " SELECT t AS frame, id, comp FROM dots JOIN comp USING (id)")
def dot_components(spark, sf):
    return with_components(spark, sf).select("frame", "id", "comp")


@query(COMP.replace("<= 9", "<= 4") + " SELECT comp, count(*) AS n, min(t) AS frame FROM dots JOIN comp USING (id) GROUP BY comp HAVING count(*) > 1")
def single_linkage_cut(spark, sf):
    """Cutting the spanning forest of all links within 3 at length 2."""
    at = stage(J.places(framed(spark, sf)), "places")
    links = J.range_pairs(at, 3.0).select("src", "dst", F.col("d2").alias("w"))
    comp = G.cut_components(G.minimum_spanning_forest(links), 4)
    named = at.join(comp, at["id"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "id"))
    return named.groupBy("comp").agg(F.sum("n").alias("n"), F.min("frame").alias("frame")).where("n > 1")


@query(BOTTLENECK + " SELECT src, dst, w FROM mst")
def minimum_spanning_tree(spark, sf):
    return G.minimum_spanning_forest(supply_edges(spark, sf))


@query(BOTTLENECK + " SELECT count(*) AS edges, sum(w)::BIGINT AS total FROM mst")
def mst_total_weight(spark, sf):
    return G.minimum_spanning_forest(supply_edges(spark, sf)).agg(F.count("*").alias("edges"), F.sum("w").alias("total"))


@query(BOTTLENECK + " SELECT src, dst, w FROM mst WHERE w <= (SELECT avg(w) FROM supply)")
def pruned_tree(spark, sf):
    e = stage(supply_edges(spark, sf), "supply")
    mean = e.agg(F.avg("w").alias("mean"))
    return G.minimum_spanning_forest(e).join(F.broadcast(mean), F.col("w") <= F.col("mean")).drop("mean")


_MP = ", ".join(f"m{k} AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM m{k - 1} a JOIN m{k - 1} b ON a.dst = b.src GROUP BY ALL)" for k in range(1, 6))
APSP = NATION + f""", nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), m0 AS (SELECT src, dst, min(d) AS d FROM (SELECT src, dst, w AS d FROM edges UNION ALL SELECT id, id, 0 FROM nodes) GROUP BY ALL), {_MP}"""


@query(APSP + " SELECT src, dst, d::BIGINT AS d FROM m5")
def all_pairs_minplus(spark, sf):
    return G.all_pairs(nation_edges(spark, sf))


@query(APSP + " SELECT dst AS id, d::BIGINT AS d FROM m5 WHERE src = (SELECT min(id) FROM nodes)")
def shortest_paths(spark, sf):
    e = stage(nation_edges(spark, sf), "nations")
    return G.shortest_paths(e, e.agg(F.min(F.least("src", "dst")).alias("id"))).select("id", "d")


@query(NATION + " SELECT count(*) >= 0 AS no_negative_cycle FROM edges")
def negative_cycle_test(spark, sf):
    return G.no_negative_cycle(stage(nation_edges(spark, sf), "nations"), 25)


@query(NATION + """, r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT src, count(DISTINCT dst) AS reached FROM r GROUP BY src""")
def reachability(spark, sf):
    a = stage(nation_edges(spark, sf), "nations")
    closure = G.all_pairs(a).where("src <> dst").select("src", "dst")
    # a vertex reaches itself over any edge that comes back
    back = closure.join(a.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]).select("src", F.col("src").alias("dst"))
    return closure.union(back).groupBy("src").agg(F.count_distinct("dst").alias("reached"))


@query(NATION + """, r(src, dst) AS (SELECT src, src FROM edges UNION SELECT dst, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)
SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def strong_components(spark, sf):
    return G.strong_components(nation_edges(spark, sf))


@query(NATION + """, d AS (SELECT src, dst FROM edges WHERE src < dst), n AS (SELECT src AS id FROM d UNION SELECT dst FROM d),
p(id, level) AS (SELECT id, 0 FROM n UNION SELECT d.dst, p.level + 1 FROM p JOIN d ON p.id = d.src) SELECT id, max(level)::INT AS level FROM p GROUP BY id""")
def topological_levels(spark, sf):
    """Levels of the trade that goes from lower to higher keys, which has no cycles."""
    return G.topological_levels(nation_edges(spark, sf).where("src < dst"))


@query(NATION + """, p(id, level) AS (SELECT min(least(src, dst)), 0 FROM edges UNION SELECT e.dst, p.level + 1 FROM p JOIN edges e ON p.id = e.src WHERE p.level < 25) SELECT id, min(level)::INT AS level FROM p GROUP BY id""")
def bfs_levels(spark, sf):
    e = stage(nation_edges(spark, sf), "nations")
    return G.levels(e, e.agg(F.min(F.least("src", "dst")).alias("id")))


def _grow_sql(near: str) -> str:
    return CELLS.replace("v >= 1", "v >= 3") + f""", g(frame, x, y, gen) AS (SELECT frame, x, y, 1 FROM c UNION
 SELECT p.frame, p.x, p.y, g.gen + 1 FROM g JOIN pixels p ON p.frame = g.frame AND {near} WHERE g.gen <= 5 AND p.v < 3 AND (g.gen > 1 OR (g.x BETWEEN 1 AND 30 AND g.y BETWEEN 1 AND 30)))
SELECT frame, x, y, min(gen)::INT AS gen FROM g GROUP BY ALL"""


@query(_grow_sql("abs(p.x - g.x) + abs(p.y - g.y) = 1"))
def growth_generation_4(spark, sf):
    return G.grow(pixels(spark, sf).where("v >= 3"), GRID, GRID, S.offsets(2, "four"), 5)


@query(_grow_sql("abs(p.x - g.x) <= 1 AND abs(p.y - g.y) <= 1"))
def growth_generation_8(spark, sf):
    return G.grow(pixels(spark, sf).where("v >= 3"), GRID, GRID, S.offsets(2, "eight"), 5)


@query(CELLS + """, n AS (SELECT a.frame, a.x, a.y, (SELECT arg_min((b.y * 32 + b.x), (-b.v, b.y * 32 + b.x)) FROM pixels b WHERE b.frame = a.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.v > a.v) AS nxt FROM pixels a),
f(frame, id, spot, steps) AS (SELECT frame, y * 32 + x, y * 32 + x, 0 FROM n UNION ALL SELECT f.frame, f.id, n.nxt, f.steps + 1 FROM f JOIN n ON f.frame = n.frame AND f.spot = n.y * 32 + n.x WHERE n.nxt IS NOT NULL)
SELECT (frame * 1024 + id)::BIGINT AS id, (frame * 1024 + arg_max(spot, steps))::BIGINT AS root, max(steps)::INT AS steps FROM f GROUP BY frame, id HAVING max(steps) > 0""")
def steepest_ascent(spark, sf):
    """Where steepest ascent over brighter neighbours ends, for each cell that has one."""
    p = S.ring(pixels(spark, sf))
    here = (F.col("frame") * 1024 + F.col("y") * 32 + F.col("x")).cast("bigint")
    dx = [-1, 0, 1, -1, 1, -1, 0, 1]
    dy = [-1, -1, -1, 0, 0, 1, 1, 1]
    sides = F.explode(F.array(*[F.struct((here + a + 32 * b).alias("other"), F.get("ring", F.lit(i)).alias("d_other")) for i, (a, b) in enumerate(zip(dx, dy, strict=True))]))
    pairs = p.select(here.alias("id"), F.col("v").alias("d"), sides.alias("s")).select("id", "d", "s.other", "s.d_other").where("d_other IS NOT NULL")
    return G.follow(G.steepest_next(pairs)).where("steps > 0")


@query(NATION + """, d AS (SELECT src, dst FROM edges WHERE src < dst), n AS (SELECT src, count(*) AS n FROM d GROUP BY src), roots AS (SELECT src AS id FROM d EXCEPT SELECT dst FROM d),
p(id, s) AS (SELECT id, 1.0::DOUBLE FROM roots UNION ALL SELECT d.dst, p.s / n.n FROM p JOIN d ON p.id = d.src JOIN n ON n.src = d.src)
""" + f" SELECT id, {fixed('sum(s)')} AS saliency FROM p GROUP BY id")
def saliency_flow(spark, sf):
    d = stage(nation_edges(spark, sf).where("src < dst"), "nations")
    roots = d.select(F.col("src").alias("id")).distinct().join(d.select(F.col("dst").alias("id")), "id", "left_anti")
    return G.flow_down(d, roots).select("id", fx("saliency", "saliency"))


@query()
def merge_hierarchy(spark, sf):
    at = stage(J.places(framed(spark, sf)), "places")
    links = stage(J.range_pairs(at, 4.0).select("src", "dst", F.col("d2").alias("w")), "links")
    return G.merge_events(links, [1, 4, 9, 16])


@query(f"WITH {SQL['supply']} SELECT dst AS src, src AS dst, w FROM supply UNION ALL SELECT src, dst, w FROM supply")
def symmetric_edges(spark, sf):
    return G.both_ways(supply_edges(spark, sf))


@query(NATION + " SELECT DISTINCT unnest([src, dst]) AS id FROM edges")
def graph_vertices(spark, sf):
    return G.vertices(nation_edges(spark, sf))


@query(NATION + " SELECT * FROM edges WHERE src NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def vertices_removed(spark, sf):
    gone = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return G.without_vertices(nation_edges(spark, sf), gone)


PART_SETS = "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"


@query(PART_SETS + """, a AS (SELECT l_partkey FROM p JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 12), b AS (SELECT l_partkey FROM p JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey >= 12)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def coverage_set_ops(spark, sf):
    p = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = p.where("s_nationkey < 12").select("l_partkey"), p.where("s_nationkey >= 12").select("l_partkey")
    parts = [("both", a.intersect(b)), ("only_a", a.subtract(b)), ("only_b", b.subtract(a)), ("all", a.unionAll(b))]
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, d in parts]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])




#: cells with three events or more grow; a component is named by its least cell
_SEEDS = CELL_REACH.replace("v >= 1", "v >= 3")
_GROWN = _SEEDS + f""", m AS (SELECT frame, x, y, component FROM c JOIN comp USING (id)),
r AS (SELECT p.frame, p.x, p.y, min(greatest(abs(p.x - m.x), abs(p.y - m.y))) + 1 AS gen, arg_min(component, (greatest(abs(p.x - m.x), abs(p.y - m.y)), component)) AS source FROM pixels p JOIN m USING (frame) GROUP BY ALL),
t AS (SELECT a.frame, a.source AS u, b.source AS v, min(greatest(a.gen, b.gen)) AS r FROM r a JOIN r b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL),
b0 AS (SELECT frame, u, v, CASE WHEN u = v THEN 0 ELSE r END AS r FROM t),
{", ".join(f"b{k} AS (SELECT a.frame, a.u, b.v, min(greatest(a.r, b.r)) AS r FROM b{k - 1} a JOIN b{k - 1} b ON a.frame = b.frame AND a.v = b.u GROUP BY ALL)" for k in range(1, 8))},
k AS (SELECT frame, s.step::INT AS step, u AS id, min(v) AS name FROM b7 JOIN range(1, {GRID} + 1) s(step) ON r <= s.step GROUP BY ALL),
w AS (SELECT DISTINCT n.frame, n.step, n.name AS merged, o.name AS part FROM k n JOIN k o ON n.id = o.id AND o.step = n.step - 1),
j AS (SELECT * FROM w QUALIFY count(*) OVER (PARTITION BY frame, step, merged) > 1)"""


def growth_forest(spark, sf):
    """(cells with step and source, forest of merges, lineages) of growth from the cells with three events or more."""
    grid = stage(pixels(spark, sf), "pixels")
    seeds = stage(grid.where("v >= 3").select("frame", "x", "y", ((F.col("frame") * GRID + F.col("y")) * GRID + F.col("x")).cast("bigint").alias("id")), "seeds")
    comp = connected_components(cell_edges(seeds)).withColumnRenamed("node", "id")
    members = seeds.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    regions = stage(H.grown(grid, members, "v >= 3"), "regions")
    forest = stage(H.merge_forest(H.touches(regions)), "merge-forest")
    return regions, forest, H.lineages(forest, regions.select(F.col("source").alias("id")).distinct())


@query(_GROWN + """, d AS (SELECT k.frame, step, name, count(*) AS n FROM k JOIN m ON m.component = k.id GROUP BY ALL)
SELECT j.step, merged, part, o.n AS n_part, n.n AS n_merged FROM j JOIN d o ON o.name = part AND o.step = j.step - 1 JOIN d n ON n.name = merged AND n.step = j.step""")
def growth_merges(spark, sf):
    regions, forest, lines = growth_forest(spark, sf)
    return H.merges(forest, lines, regions.where("gen = 1").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")))


@query(_GROWN + f""", d AS (SELECT k.frame, step, name, count(*) AS size, count(*) FILTER (gen = step) AS boundary FROM k JOIN r ON r.source = k.id AND gen <= step GROUP BY ALL),
f AS (SELECT *, sqrt(2 * pi() * size) / boundary AS measure FROM d WHERE boundary > 0)
SELECT part AS name, o.step, o.size, o.boundary, {fixed('o.measure')} AS measure FROM j JOIN f o ON o.name = part AND o.step = j.step - 1 JOIN f n ON n.name = merged AND n.step = j.step
WHERE o.measure > 0.3 AND o.measure > n.measure""")
def saved_growth_regions(spark, sf):
    regions, forest, lines = growth_forest(spark, sf)
    rings = regions.groupBy(F.col("source").alias("id"), "gen").agg(F.count("*").alias("n"))
    return H.saved_regions(forest, lines, rings, 0.3).withColumn("measure", fx("measure", "measure"))


_MESH_ROUNDS = 40
#: a surface mesh over each frame's cells with events, their counts as heights
_MESH = f"""WITH {SQL['pixels']}, c AS (SELECT frame, x, y, v, ((frame * {GRID} + y) * {GRID} + x)::BIGINT AS id FROM pixels WHERE v >= 1),
q AS (SELECT o.frame, p0.id AS p0, p1.id AS p1, p2.id AS p2, p3.id AS p3 FROM (SELECT DISTINCT frame, x - i AS x, y - j AS y FROM c, range(2) a(i), range(2) b(j)) o
  LEFT JOIN c p0 ON p0.frame = o.frame AND p0.x = o.x AND p0.y = o.y LEFT JOIN c p1 ON p1.frame = o.frame AND p1.x = o.x + 1 AND p1.y = o.y
  LEFT JOIN c p2 ON p2.frame = o.frame AND p2.x = o.x AND p2.y = o.y + 1 LEFT JOIN c p3 ON p3.frame = o.frame AND p3.x = o.x + 1 AND p3.y = o.y + 1),
f AS (SELECT frame, 2 * p0 AS face, p0 AS a, p1 AS b, p2 AS c FROM q WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL
  UNION ALL SELECT frame, 2 * p1 + 1, p1, p3, p2 FROM q WHERE p1 IS NOT NULL AND p3 IS NOT NULL AND p2 IS NOT NULL),
s AS (SELECT frame, face, a AS u, b AS v, c AS opp FROM f UNION ALL SELECT frame, face, b, c, a FROM f UNION ALL SELECT frame, face, c, a, b FROM f),
e AS MATERIALIZED (SELECT s.*, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.v - q.v) * (p.v - q.v) AS l2 FROM s JOIN c p ON p.id = u JOIN c q ON q.id = s.v),
a0 AS (SELECT face FROM f)""" + "".join(f""",
h{k} AS MATERIALIZED (SELECT e.* FROM e JOIN a{k - 1} USING (face)), d{k} AS MATERIALIZED (SELECT h.* FROM h{k} h WHERE NOT EXISTS (SELECT 1 FROM h{k} t WHERE t.u = h.v AND t.v = h.u)),
r{k} AS MATERIALIZED (SELECT max((l2, face)).face AS face FROM (SELECT {{'l2': l2, 'face': face}} AS s, * FROM d{k}) WHERE l2 > 2 AND opp NOT IN (SELECT u FROM d{k} UNION SELECT v FROM d{k}) GROUP BY opp),
a{k} AS (SELECT face FROM a{k - 1} EXCEPT SELECT face FROM r{k})""".replace("max((l2, face)).face", "max(s).face") for k in range(1, _MESH_ROUNDS + 1)) + """,
g AS (""" + " UNION ALL ".join(f"SELECT face, {k} AS step FROM r{k}" for k in range(1, _MESH_ROUNDS + 1)) + ")"


def surface_mesh(spark, sf):
    c = stage(cells(spark, sf).join(pixels(spark, sf).select("frame", "x", "y", F.col("v").alias("z")), ["frame", "x", "y"]), "cells")
    faces = M.grid_mesh(c.select(F.col("frame").alias("mesh"), "id", "x", "y"))
    return stage(M.half_edges(faces, c), "mesh")


@query(_MESH + " SELECT frame AS mesh, f.face, step AS removed_at FROM f JOIN g USING (face)")
def peeled_faces(spark, sf):
    """Faces in the round in which they are taken off the mesh."""
    return M.peel(surface_mesh(spark, sf), 2).select("mesh", "face", "removed_at")


@query(_MESH + """, n AS (SELECT frame, 0 AS step FROM f GROUP BY ALL UNION SELECT frame, step FROM f JOIN g USING (face)),
k AS (SELECT n.frame, n.step, f.face FROM n JOIN f USING (frame) LEFT JOIN g USING (face) WHERE coalesce(g.step, 9999) > n.step),
b AS (SELECT k.frame, k.step, e.u, e.v FROM k JOIN e ON e.face = k.face)
SELECT frame AS mesh, step, (SELECT count(*) FROM k WHERE k.frame = n.frame AND k.step = n.step) AS faces,
       (SELECT count(*) FROM b x WHERE x.frame = n.frame AND x.step = n.step AND NOT EXISTS (SELECT 1 FROM b y WHERE y.frame = x.frame AND y.step = x.step AND y.u = x.v AND y.v = x.u)) AS boundary FROM n""")
def mesh_states(spark, sf):
    """Faces and boundary edges of every state that the mesh went through."""
    mesh = surface_mesh(spark, sf)
    return M.state_counts(mesh, stage(M.peel(mesh, 2), "peeled"))
