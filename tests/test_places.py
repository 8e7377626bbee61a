"""Joins of dots over crowded places: the pairs that are formed grow with the places, not with the square of the dots at one."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import joins as J
from tessella.operators import temporal as T
from tessella.plans.storage import stage

COPIES = 400


@pytest.fixture()
def crowd(spark):
    """Two frames with two groups of two places each; ids fall from place to place so that the least isn't the first."""
    place = F.col("id") % 8
    at = F.when(place % 4 < 2, place % 4).otherwise(50 + place % 4)
    return stage(spark.range(8 * COPIES).select((10_000 - F.col("id")).alias("id"), at.cast("int").alias("x"), F.lit(0).alias("y"), (place / 4).cast("int").alias("frame")), "crowd")


@pytest.fixture()
def formed(monkeypatch):
    seen = []
    plain = J.range_join

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        seen.append(out.count())
        return out

    monkeypatch.setattr(J, "range_join", counted)
    return seen


def least(frame, *xs):
    return min(10_000 - i for i in range(8 * COPIES) if i % 8 // 4 == frame and (i % 4 if i % 4 < 2 else 50 + i % 4) in xs)


def test_components(crowd, formed):
    got = {(r["frame"], r["x"] > 10): (r["comp"], r["n"]) for r in J.point_components(crowd, 3.0).groupBy("frame", F.col("x"), "comp").agg(F.count("*").alias("n")).collect()}
    assert got == {(f, far): (least(f, *((52, 53) if far else (0, 1))), COPIES) for f in (0, 1) for far in (False, True)}
    assert sum(formed) < 100


def test_nearest(crowd, formed):
    before = crowd.withColumn("frame", F.col("frame") + 1)
    want = {10_000 - i: least(0, i % 4 if i % 4 < 2 else 50 + i % 4) for i in range(8 * COPIES) if i % 8 >= 4}
    for found in (J.nearest(crowd, before, 3.0), J.nearest_any(crowd, before, 1.0, stage), J.look_back(crowd, 3.0)):
        assert {r["p"]: r["q"] for r in found.where("d2 = 0").collect()} == want
    near = J.knn_in_range(crowd, before, 3, 5.0)
    assert {r["n"] for r in near.groupBy("p").agg(F.count("*").alias("n")).collect()} == {3}
    assert {r["p"]: r["q"] for r in near.where("nth = 1").collect()} == want
    assert sum(formed) < 200


def test_range_joins_broadcast_nothing(spark, crowd, monkeypatch):
    """Scans count as their compressed files and explodes don't count, so a side may be far larger than Catalyst takes it for."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    plans, plain = [], J.range_join

    def kept(*args, **kwargs):
        plans.append(plain(*args, **kwargs))
        return plans[-1]

    monkeypatch.setattr(J, "range_join", kept)
    J.look_back(crowd, 3.0), J.range_pairs(crowd, 3.0).count(), T.frame_pairs(T.branches(crowd, 3.0), 3.0)
    found = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(found) == 4 and not [p for p in found if "Broadcast" in p]


def test_range_pairs_are_sent_to_half_the_cells(spark, monkeypatch):
    """Each pair once, lesser id first, whichever way it lies; a point is sent to 5 of the 9 cells around."""
    rows = [(i, (i * 37) % 23 - 9, (i * 53) % 19 - 9, i % 2) for i in range(240)]
    d = stage(spark.createDataFrame(rows, "id bigint, x int, y int, frame int"), "d")
    halves, plain = [], J.range_join

    def kept(*args, **kwargs):
        halves.append(kwargs.get("half", False))
        return plain(*args, **kwargs)

    monkeypatch.setattr(J, "range_join", kept)
    got = sorted(map(tuple, J.range_pairs(d, 3.0).collect()))
    far = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    assert got == sorted((a[3], a[0], b[0], far(a, b)) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and far(a, b) <= 9)
    assert halves == [True]


def test_look_back_sends_no_side_to_frames_and_cells(spark, crowd, monkeypatch):
    sent, plain = [], J.range_join

    def counted(left, right, *args, **kwargs):
        sent.append((left.count(), right.count()))
        return plain(left, right, *args, **kwargs)

    monkeypatch.setattr(J, "range_join", counted)
    J.look_back(crowd, 3.0)
    assert sent == [(5 * 8, 8)]


def test_matches(crowd, formed):
    b = J.point_components(crowd, 3.0, "branch")
    got = J.directed_match(b, b.withColumn("frame", F.col("frame") - 1), 6.0).collect()
    assert sorted((r["a"], r["b"], r["mean_d"], r["max_d"], r["n"]) for r in got) == sorted((least(0, *x), least(1, *x), 0.0, 0.0, 2 * COPIES) for x in ((0, 1), (52, 53)))
    assert sum(formed) < 100


def test_closest_pairs(crowd, formed):
    b = J.point_components(crowd, 0.5)
    got = sorted(J.closest_component_pairs(b, 3.0).select("frame", "p", "q", "d2").collect())
    want = []
    for f in (0, 1):
        for u, v in ((0, 1), (52, 53)):
            want.append((f, *sorted((least(f, u), least(f, v))), 1))
    assert [tuple(r) for r in got] == sorted(want)
    assert sum(formed) < 100


def test_branch_links_and_velocities(crowd, formed):
    d = T.branches(crowd, 3.0)
    pairs = T.frame_pairs(d, 3.0)
    linked = T.links(d, 3.0, pairs)
    assert sorted(map(tuple, linked.collect())) == sorted((least(0, *x), least(1, *x)) for x in ((0, 1), (52, 53)))
    v = T.velocities(d, linked, 3.0, pairs).where("rooted").collect()
    assert [(r["vx"], r["vy"]) for r in v] == [(0.0, 0.0)] * 2
    assert sum(formed) < 200


def test_points_without_a_place_stand_alone(spark):
    d = stage(spark.createDataFrame([(1, None, 0, 0), (2, None, 0, 0), (3, 1, 0, 0), (4, 1, 0, None), (0, 1, 0, 0)], "id bigint, x int, y int, frame int"), "d")
    assert {r["id"]: r["comp"] for r in J.point_components(d, 3.0).collect()} == {1: 1, 2: 2, 3: 0, 4: 4, 0: 0}


def test_nearest_other(crowd, formed):
    got = {r["p"]: (r["q"], r["d2"]) for r in J.nearest_other(crowd, 3.0).collect()}
    ids = {}
    for i in range(8 * COPIES):
        ids.setdefault(i % 8, []).append(10_000 - i)
    want = {p: ((sorted(own)[1] if p == min(own) else min(own)), 0) for own in ids.values() for p in own}
    assert got == want
    assert sum(formed) < 100


def test_overlap_counts(spark):
    rows = [(k, i, (i * 7 + k) % 11, (i * 7 + k) % 11 + (i * k) % 4) for k in range(3) for i in (1, 2, 3, 5, 6, 9, 12)] + [(9, 1, 0, 1), (9, 2, 1, 2), (None, 1, 0, 1)]
    got = {r["k"]: r["n"] for r in J.overlap_counts(spark.createDataFrame(rows, "k int, i int, lo int, hi int"), "k", "i").collect()}
    want = {}
    for k, i, lo, hi in rows:
        n = sum(k == a and i + 1 < j and hi >= u and v >= lo for a, j, u, v in rows)
        want[k] = want.get(k, 0) + n
    assert got == {k: n for k, n in want.items() if n and k is not None}


def test_overlap_counts_forms_no_pairs(spark):
    n = 200_000
    ranges = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    assert J.overlap_counts(ranges, "k", "id").first()["n"] == n * (n - 1) // 2 - (n - 1)


def test_light_states_of_a_crowd(spark, crowd, formed, monkeypatch):
    from tessella.queries import more

    monkeypatch.setattr(more, "framed", lambda spark, sf: crowd)
    assert {r["state"]: r["n"] for r in more.light_states(spark, None).groupBy("state").agg(F.count("*").alias("n")).collect()} == {"Appeared": 4 * COPIES, "Isolated": 4 * COPIES}
    assert sum(formed) < 100


@pytest.fixture(scope="module")
def copied(tmp_path_factory, sf_dir):
    """The events of sf0.001 six times, at the same places."""
    duckdb = pytest.importorskip("duckdb")
    folder = tmp_path_factory.mktemp("copied")
    e = f"'{sf_dir}/events.parquet'"
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + k * (SELECT max(event_id) + 1 FROM {e}) AS event_id) FROM {e} e, range(6) r(k)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["relaxation_step", "relaxation_probabilities", "light_support", "matched_chains"])
def test_queries_work_on_places(spark, copied, monkeypatch, name):
    """The rows are those of the SQL; what is written on the way has no more rows than three a place, or a few a dot that others are matched to."""
    import duckdb

    import __spark_entry__ as entry
    from tessella.queries import more, temporal

    staged = []

    def counted(df, label):
        out = stage(df, label)
        if label in ("candidates", "near-places"):
            staged.append(out.count())
        return out

    from tessella.queries import extra

    for module in (more, temporal, extra, J):
        monkeypatch.setattr(module, "staged" if module is J else "stage", counted)
    got = entry.queries()[name](spark, copied)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{copied}/events.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    places = db.execute("SELECT count(*) FROM (SELECT DISTINCT ts::DATE, floor(value), user_id % 150 FROM events)").fetchone()[0]
    assert staged and sum(staged) <= 3 * places


def test_grouped_kernels_see_places(spark, copied, sf_dir, monkeypatch):
    """Python gets each place of a group once, however many dots it has; the rows are those without copies."""
    from pyspark.sql import GroupedData

    from tessella.plans import catalog
    from tessella.queries import kernels

    seen, plain = [], GroupedData.applyInPandas

    def counted(self, *args, **kwargs):
        seen.append(self._df.count())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    places = kernels.groups(spark, sf_dir).select("grp", "x", "y").distinct().count()
    for name in ("triangle_clusters", "delaunay", "convex_hull_points", "geometric_circles"):
        got, want = (catalog.queries()[name](spark, sf) for sf in (copied, sf_dir))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name
    assert seen == [places] * 8
    once, six = ({r["grp"]: r for r in catalog.queries()["hull_density"](spark, sf).collect()} for sf in (sf_dir, copied))
    assert {k: (r["n"], r["area"]) for k, r in six.items()} == {k: (6 * r["n"], r["area"]) for k, r in once.items()}


@pytest.mark.parametrize("name", ["similarity_extremes", "agglomerated_branches", "optimal_assignment"])
def test_branches_of_copies_form_no_more_pairs(spark, copied, sf_dir, formed, name):
    from tessella.plans import catalog

    once = sorted(map(tuple, catalog.queries()[name](spark, sf_dir).collect()))
    pairs = sum(formed)
    six = sorted(map(tuple, catalog.queries()[name](spark, copied).collect()))
    assert [pytest.approx(r) for r in once] == six
    assert sum(formed) == 2 * pairs


def test_assignment_of_many_frames_has_many_tasks(spark):
    from tessella.operators import grouped

    costs = spark.range(40).select((F.col("id") % 20).alias("frame"), "id", (F.col("id") + 100).alias("b"), F.lit(1.0).alias("w")).coalesce(1)
    found = grouped.optimal_assignment(costs, "frame", "id", "b", "w")
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 1
