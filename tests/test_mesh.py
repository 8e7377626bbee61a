"""Meshes with versions: against single removals, and states that come back."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.operators import mesh as M


def plain_peel(faces, place, gap2):
    """Rounds of single removals; every edge is looked at anew after each."""
    live, out, step = dict(faces), {}, 0
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(place[a], place[b], strict=True))
    while True:
        sides = Counter(frozenset(e) for t in live.values() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])))
        outer = {e for e, n in sides.items() if n == 1}
        exposed = {v for e in outer for v in e}
        wanted = []
        for f, t in live.items():
            for k in range(3):
                u, v, opp = t[k], t[(k + 1) % 3], t[(k + 2) % 3]
                if frozenset((u, v)) in outer and far(u, v) > gap2 and opp not in exposed:
                    wanted.append((far(u, v), f, opp))
        step += 1
        taken = 0
        for _, f, opp in sorted(wanted, reverse=True):
            if opp not in exposed:  # the round's earlier removals count
                exposed.add(opp)
                del live[f]
                out[f] = step
                taken += 1
        if not taken:
            return out


def grid(seed, n=9):
    rng = random.Random(seed)
    cells = [(0, y * n + x, x, y, rng.randrange(4)) for x in range(n) for y in range(n) if rng.random() < 0.95]
    cells += [(1, 1000 + y * n + x, x, y, rng.randrange(3)) for x in range(6) for y in range(6)] + [(2, 5000, 3, 3, 1)]
    return cells


def plain_faces(cells):
    at = {(m, x, y): i for m, i, x, y, _ in cells}
    out = {}
    for m, x, y in {(m, x - i, y - j) for m, x, y in at for i in (0, 1) for j in (0, 1)}:
        p = [at.get((m, x + i, y + j)) for j in (0, 1) for i in (0, 1)]
        if None not in (p[0], p[1], p[2]):
            out[2 * p[0]] = (p[0], p[1], p[2])
        if None not in (p[1], p[3], p[2]):
            out[2 * p[1] + 1] = (p[1], p[3], p[2])
    return out


def test_mesh(spark):
    cells = grid(4)
    df = spark.createDataFrame(cells, "mesh int, id bigint, x int, y int, z int")
    faces = M.grid_mesh(df)
    want = plain_faces(cells)
    assert {r.face: (r.a, r.b, r.c) for r in faces.collect()} == want
    edges = M.half_edges(faces, df)
    edges = spark.createDataFrame(edges.collect(), edges.schema)
    rows = edges.collect()
    across = {(r.u, r.v): r.face for r in rows}
    assert len(rows) == 3 * len(want) and all(r.twin == across.get((r.v, r.u)) for r in rows)
    removed = M.peel(edges, 2)
    gone = {r.face: r.removed_at for r in removed.collect()}
    assert gone == plain_peel(want, {i: (x, y, z) for _, i, x, y, z in cells}, 2) and gone
    # every earlier state is a filter, and going on from a restored one ends in the same mesh
    last = max(gone.values())
    for at in (0, 1, last // 2, last):
        assert {r.face for r in M.state(edges, removed, at).select("face").distinct().collect()} == {f for f in want if gone.get(f, last + 1) > at}
    again = M.peel(edges, 2, M.restored(removed, last // 2))
    assert {r.face: r.removed_at for r in again.collect()} == gone
    counts = {(r.mesh, r.step): (r.faces, r.boundary) for r in M.state_counts(edges, removed).collect()}
    for (mesh, step), (n, outline) in counts.items():
        state = M.state(edges, removed, step).where(F.col("mesh") == mesh)
        assert (n, outline) == (state.select("face").distinct().count(), M.boundary(state).count())


def test_empty_mesh(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 1), (0, 2, 5, 5, 1)], "mesh int, id bigint, x int, y int, z int")
    edges = M.half_edges(M.grid_mesh(df), df)
    assert edges.count() == 0 and M.peel(edges, 1).count() == 0
