"""Order-dependent kernels in numpy: each works on one small group (a contour, a frame, a cluster) held in memory."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from itertools import combinations

import numpy as np


# -- hulls and polygons ------------------------------------------------------------------------------------------------
def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points) -> list[tuple]:
    """Hull vertices against the clock (y up) from the lowest x; points on an edge aren't vertices."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) <= 2:
        return pts
    halves = []
    for order in (pts, pts[::-1]):
        half: list[tuple] = []
        for p in order:
            while len(half) >= 2 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return halves[0] + halves[1]


def polygon_area(points) -> float:
    p = np.asarray(points, float)
    return 0.0 if len(p) < 3 else float(abs(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) / 2)


def triangle_area(a, b, c) -> float:
    """``polygon_area`` of three points, in the same order of terms."""
    return abs((a[0] * b[1] - b[0] * a[1]) + (b[0] * c[1] - c[0] * b[1]) + (c[0] * a[1] - a[0] * c[1])) / 2


def drop_collinear(points, thres: float) -> list[tuple]:
    """Drops the middle of three neighbours while it is within ``thres`` of the line through the others, the nearest first."""
    pts = list(map(tuple, points))
    while len(pts) > 3:
        gaps = []
        for i, p in enumerate(pts):
            a, b = pts[i - 1], pts[(i + 1) % len(pts)]
            side = np.hypot(b[0] - a[0], b[1] - a[1])
            gaps.append((abs(_turn(a, b, p)) / side if side else 0.0, i))
        gap, i = min(gaps)
        if gap > thres:
            break
        del pts[i]
    return pts


def convex_hull_3d(points) -> list[tuple[int, int, int]]:
    """Faces (index triples, outward, least index first) of the hull, point by point: faces that see a point give way to a cone from their rim.

    Each flat side of the hull is cut into triangles from the least index of its corners, so that the faces don't depend on the order
    of the points. Points within a side or an edge are no corners. Points in one plane have no faces. Exact on whole numbers.
    """
    p = np.asarray(points, float)
    start = _tetrahedron(p)
    if not start:
        return []
    inner = p[start].mean(axis=0)

    def outward(tri):
        tri = np.array(tri)
        n = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
        turned = np.einsum("ij,ij->i", n, inner - p[tri[:, 0]]) > 0
        tri[turned] = tri[turned][:, [0, 2, 1]]
        n[turned] *= -1
        return tri, n

    faces, normals = outward(list(combinations(start, 3)))
    for i in range(len(p)):
        seen = np.einsum("ij,ij->i", normals, p[i] - p[faces[:, 0]]) > 1e-9
        if not seen.any():
            continue
        edges = {(a, b) for t in faces[seen].tolist() for a, b in zip(t, t[1:] + t[:1], strict=True)}
        cone, n = outward([(a, b, i) for a, b in sorted(edges) if (b, a) not in edges])
        faces, normals = np.concatenate([faces[~seen], cone]), np.concatenate([normals[~seen], n])
    return sorted(f for side, n in _flat_sides(p, faces, normals) for f in _fan(p, side, n))


def _tetrahedron(p: np.ndarray) -> list[int]:
    """Four points that aren't in one plane, none if there are no such."""
    if not len(p):
        return []
    b = int(np.argmax(np.sum((p - p[0]) ** 2, axis=1)))
    off_line = np.cross(p - p[0], p[b] - p[0])
    c = int(np.argmax(np.sum(off_line**2, axis=1)))
    off_plane = np.abs((p - p[0]) @ np.cross(p[b] - p[0], p[c] - p[0]))
    d = int(np.argmax(off_plane))
    return [0, b, c, d] if off_plane[d] > 1e-9 else []


def _flat_sides(p: np.ndarray, faces: np.ndarray, normals: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    """(points, outward normal) of each flat side: the faces in one plane."""
    out = []
    left = np.ones(len(faces), bool)
    while left.any():
        f = int(np.argmax(left))
        flat = left & np.all(np.abs((p[faces] - p[faces[f, 0]]) @ normals[f]) <= 1e-9, axis=1)
        left &= ~flat
        out.append((sorted(set(faces[flat].ravel().tolist())), normals[f]))
    return out


def _fan(p: np.ndarray, side: list[int], normal: np.ndarray) -> list[tuple[int, int, int]]:
    axis = int(np.argmax(np.abs(normal)))
    u, v = [((1, 2), (2, 0), (0, 1))[axis], ((2, 1), (0, 2), (1, 0))[axis]][int(normal[axis] < 0)]
    index = {(p[i, u], p[i, v]): i for i in reversed(side)}
    ring = [index[q] for q in convex_hull(index)]
    k = ring.index(min(ring))
    ring = ring[k:] + ring[:k]
    return [(ring[0], a, b) for a, b in zip(ring[1:], ring[2:], strict=False)]


def clip_convex(subject, clip) -> list[tuple]:
    """Intersection of two convex polygons given against the clock."""
    out = list(map(tuple, subject))
    for a, b in zip(clip, list(clip[1:]) + [clip[0]], strict=True):
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            sp, sq = _turn(a, b, p), _turn(a, b, q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return []
    return out


def ear_clip(polygon) -> list[tuple[int, int, int]]:
    """Triangles (indices) of a simple polygon."""
    p = list(map(tuple, polygon))
    ring = list(range(len(p)))
    if len(p) > 2 and sum(_turn((0, 0), p[i - 1], p[i]) for i in ring) < 0:
        ring.reverse()
    out = []
    while len(ring) > 3:
        for n in range(len(ring)):
            a, b, c = ring[n - 1], ring[n], ring[(n + 1) % len(ring)]
            if _turn(p[a], p[b], p[c]) <= 0:
                continue
            inside = lambda q: _turn(p[a], p[b], q) >= 0 and _turn(p[b], p[c], q) >= 0 and _turn(p[c], p[a], q) >= 0  # noqa: B023, E731
            if any(inside(p[q]) for q in ring if q not in (a, b, c) and p[q] not in (p[a], p[b], p[c])):
                continue
            out.append((a, b, c))
            del ring[n]
            break
        else:
            n = min(range(len(ring)), key=lambda i: abs(_turn(p[ring[i - 1]], p[ring[i]], p[ring[(i + 1) % len(ring)]])))
            del ring[n]  # no ear: the flattest vertex goes
    return [*out, tuple(ring)] if len(ring) == 3 else out


def polygon_overlap(a, b) -> float:
    """Common area of two simple polygons: the sum over pairs of their triangles."""
    total = 0.0
    for s in ear_clip(a):
        for t in ear_clip(b):
            sa, tb = [[p[i] for i in tri] for p, tri in ((a, s), (b, t))]
            sa, tb = (x if _turn(*x) > 0 else x[::-1] for x in (sa, tb))
            total += polygon_area(clip_convex(sa, tb))
    return total


# -- triangulation -----------------------------------------------------------------------------------------------------
def delaunay(points) -> list[tuple[int, int, int]]:
    """Triangles by incremental insertion: those whose circle holds the new point go, their outline is joined to it. The circles of
    all triangles are tested at once."""
    p = np.asarray(points, float)
    if len(p) < 3:
        return []
    centre, span = p.mean(axis=0), max(np.ptp(p, axis=0).max(), 1.0) * 1e4
    q = np.vstack([p, centre + [[-span, -span], [span, -span], [0, span]]])
    n = len(p)
    tris = np.array([[n, n + 1, n + 2]])
    for i in range(n):
        m = q[tris] - q[i]
        sq = (m**2).sum(axis=2)
        minor = lambda j, k: m[:, j, 0] * m[:, k, 1] - m[:, j, 1] * m[:, k, 0]  # noqa: B023, E731
        det = sq[:, 0] * minor(1, 2) - sq[:, 1] * minor(0, 2) + sq[:, 2] * minor(0, 1)
        e1, e2 = q[tris[:, 1]] - q[tris[:, 0]], q[tris[:, 2]] - q[tris[:, 0]]
        bad = det * np.sign(e1[:, 0] * e2[:, 1] - e1[:, 1] * e2[:, 0]) > 1e-9
        sides = np.sort(tris[bad][:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), axis=1)
        outline, count = np.unique(sides, axis=0, return_counts=True)
        outline = outline[count == 1]
        wide = np.abs((q[outline[:, 1]] - q[outline[:, 0]])[:, 0] * (q[i] - q[outline[:, 0]])[:, 1] - (q[outline[:, 1]] - q[outline[:, 0]])[:, 1] * (q[i] - q[outline[:, 0]])[:, 0]) > 1e-12
        tris = np.vstack([tris[~bad], np.column_stack([outline[wide], np.full(wide.sum(), i)])])
    return sorted(tuple(sorted(map(int, t))) for t in tris if t.max() < n)


def peel_mesh(points, triangles, max_gap: float) -> tuple[list[tuple], list[tuple]]:
    """(kept, removed) triangles: boundary edges longer than ``max_gap`` are taken off, longest first, if safe: the triangle's
    opposite vertex has no boundary edge, so that the mesh stays one piece."""
    p = np.asarray(points, float)
    kept, removed = set(triangles), []
    while True:
        faces = defaultdict(list)
        for t in kept:
            for e in combinations(t, 2):
                faces[e].append(t)
        edge = {e for e, f in faces.items() if len(f) == 1}
        exposed = {v for e in edge for v in e}
        long = sorted(((float(np.hypot(*(p[a] - p[b]))), (a, b)) for a, b in edge), reverse=True)
        for length, e in long:
            if length <= max_gap:
                return sorted(kept), removed
            (face,) = faces[e]
            opposite = next(v for v in face if v not in e)
            if opposite not in exposed:
                kept.remove(face)
                removed.append(face)
                break
        else:
            return sorted(kept), removed


def convexity(points, max_gap: float) -> float:
    """Area kept / whole area after peeling the triangulation."""
    tri = delaunay(points)
    kept, removed = peel_mesh(points, tri, max_gap)
    area = lambda ts: sum(polygon_area([points[i] for i in t]) for t in ts)
    whole = area(kept) + area(removed)
    return area(kept) / whole if whole else 1.0


# -- matching ----------------------------------------------------------------------------------------------------------
def assignment(cost) -> tuple[list[int], float]:
    """(column of each row or -1, total) of least total cost; a rectangle's longer side stays partly free.

    Rows come in one by one, each over a shortest alternating path to a free column: Dijkstra's search with a heap on
    costs reduced by prices, which the path lengths then update.
    """
    c = np.asarray(cost, float)
    if not c.size:
        return [-1] * len(c), 0.0
    flip = c.shape[0] > c.shape[1]
    table = (c.T if flip else c).tolist()
    columns = range(len(table[0]))
    row_price, column_price = [0.0] * len(table), [0.0] * len(columns)
    owner: dict[int, int] = {}  # column -> row
    for start, costs in enumerate(table):
        row_price[start] = min(x - p for x, p in zip(costs, column_price, strict=True))
        heap = [(costs[j] - row_price[start] - column_price[j], j, start) for j in columns]
        heapq.heapify(heap)
        settled: dict[int, tuple[float, int]] = {}  # column -> (length, row before it)
        while True:
            length, j, row = heapq.heappop(heap)
            if j in settled:
                continue
            settled[j] = length, row
            if j not in owner:
                break
            nxt = owner[j]
            for k in columns:
                if k not in settled:
                    heapq.heappush(heap, (length + table[nxt][k] - row_price[nxt] - column_price[k], k, nxt))
        end, whole = j, length
        for j, (length, _) in settled.items():
            column_price[j] -= whole - length
            if j in owner:
                row_price[owner[j]] += whole - length
        row_price[start] += whole
        held = {r: j for j, r in owner.items()}
        while end is not None:
            row = settled[end][1]
            owner[end], end = row, held.get(row)
    out = [-1] * c.shape[0]
    for j, row in owner.items():
        out[j if flip else row] = row if flip else j
    return out, float(sum(c[i, j] for i, j in enumerate(out) if j >= 0))


def dtw(a, b) -> float:
    """Dynamic time warping with Euclidean cost. Plain numbers row by row: the points of a side are few."""
    d = np.hypot(*(np.asarray(a, float)[:, None, :] - np.asarray(b, float)[None, :, :]).transpose(2, 0, 1))
    row = np.cumsum(d[0]).tolist()
    for costs in d[1:].tolist():
        new, left, before = [], np.inf, np.inf
        for x, w in zip(row, costs, strict=True):
            left = min(x, before, left) + w
            before = x
            new.append(left)
        row = new
    return float(row[-1])


def align(target, source, skip: float, repeat: float, score) -> float:
    """Alignment of symbol sequences: a step along both is free, along the source costs ``repeat``, along the target ``skip``; every cell
    adds its score."""
    row: list[float] = []
    for i, s in enumerate(source):
        new: list[float] = []
        for j, t in enumerate(target):
            options = []
            if i and j:
                options.append(row[j - 1])
            if i:
                options.append(row[j] + repeat)
            if j:
                options.append(new[j - 1] + skip)
            new.append(min(options, default=0.0) + score(s, t))
        row = new
    return row[-1]


# -- images ------------------------------------------------------------------------------------------------------------
# The eight neighbours of thinning in order, from the east against the clock with y down.
_AROUND = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]


def _deletable() -> np.ndarray:
    """2 x 256 booleans: whether a pass of Guo-Hall thinning deletes a cell, by the byte of its set neighbours.

    It does if the neighbours form one arc, the lesser number of set pairs is 2 or 3, and the cell isn't on the side that
    the pass leaves alone; the second pass leaves alone the side opposite to the first one's.
    """
    on = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
    after = lambda k: np.roll(on, -k, axis=1)
    even = slice(0, 8, 2)
    arcs = (~on & (after(1) | after(2)))[:, even].sum(axis=1)
    pairs = np.minimum((on | after(1))[:, even].sum(axis=1), (after(1) | after(2))[:, even].sum(axis=1))
    side = [(after(k + 1) | after(k + 2) | ~after(k + 7))[:, 0] & after(k)[:, 0] for k in (0, 4)]
    return np.stack([(arcs == 1) & (pairs >= 2) & (pairs <= 3) & ~s for s in side])


_DELETABLE = _deletable()


def thin(image) -> np.ndarray:
    """Two in-place passes of Guo-Hall thinning in scan order: a cell sees the deletions before it."""
    r = np.array(image, float)
    inner = np.flatnonzero(np.pad(r[1:-1, 1:-1] > 0, 1))
    set_, reach = (r > 0).ravel(), [dy * r.shape[1] + dx for dx, dy in _AROUND]
    for deletes in _DELETABLE.tolist():
        for at in inner.tolist():
            if set_[at] and deletes[sum(int(set_[at + step]) << k for k, step in enumerate(reach))]:
                set_[at] = False
    return np.where(set_.reshape(r.shape) | (r <= 0), r, 0)


# Steps to the eight neighbours in scan order.
_STEPS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def _preference(ux: float, uy: float) -> list[int]:
    """Steps that turn by less than a right angle from a direction, the straightest first; ties in scan order."""
    along = [x * ux + y * uy for x, y in _STEPS]
    return [k for k in sorted(range(8), key=lambda k: -along[k]) if along[k] > 0]


def edge_tracks(mag, dx, dy, high: float, low: float, min_length: int = 1) -> list[list[tuple[int, int]]]:
    """Hysteresis tracks: from the strongest cell of ``high`` at least, both ways along the edge through cells of ``low`` at least,
    turning by less than a right angle; a cell is in one track only. Ties: later in scan order first.

    Where a track goes on from a cell depends on the step by which it came alone, so the next step is worked out for all
    cells and steps at once; tracks follow these pointers until they leave the edge or meet a track.
    """
    m = np.pad(np.asarray(mag, float), 1)
    live, wide = (m > 0) & (m >= low), m.shape[1]
    reach = [y * wide + x for x, y in _STEPS]
    next_step = np.full((8, m.size), -1)
    for came, direction in enumerate(_STEPS):
        for k in reversed(_preference(*direction)):
            next_step[came][np.roll(live.ravel(), -reach[k])] = k
    live, taken = live.ravel(), np.zeros(m.size, bool)

    def on(at: int, step: int) -> list[int]:
        cells = []
        while step >= 0 and not taken[at + reach[step]]:
            at += reach[step]
            taken[at] = True
            cells.append(at)
            step = next_step[step][at]
        return cells

    seeds = np.flatnonzero(live & (m.ravel() >= high))
    tracks = []
    for seed in seeds[np.lexsort((-seeds, -m.ravel()[seeds]))].tolist():
        if taken[seed]:
            continue
        taken[seed] = True
        y, x = divmod(seed, wide)
        ux, uy = (dy[y - 1, x - 1], -dx[y - 1, x - 1]) if dx[y - 1, x - 1] or dy[y - 1, x - 1] else (1, 0)
        ahead, behind = (on(seed, next((k for k in _preference(s * ux, s * uy) if live[seed + reach[k]]), -1)) for s in (1, -1))
        cells = [*behind[::-1], seed, *ahead]
        if len(cells) >= min_length:
            tracks.append([(at % wide - 1, at // wide - 1) for at in cells])
    return tracks


def follow_contour(cells) -> tuple[list[tuple[int, int]], int]:
    """(ordered cells, error): a closed walk over 4-linked boundary cells from the top left, least visited neighbours first, left before up
    before right before down; 1: it didn't close, 2: a dead end, +10: cells are missing."""
    left = set(map(tuple, cells))
    if not left:
        return [], 2
    start = min(left, key=lambda c: (c[1], c[0]))
    visits = dict.fromkeys(left, 0)
    path, at, before, error = [], start, None, 0
    while True:
        around = [(at[0] + dx, at[1] + dy) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1))]
        nxt = [c for c in around if c in left and c != before]
        to = min(nxt, key=lambda c: visits[c]) if nxt else before
        path.append(at)
        visits[at] += 1
        before, at = at, to
        if at is None:
            error = 2
            break
        if len(path) >= 2 * len(left):
            error = 1
            break
        if at == start and all(visits.values()):
            break
    return path, error + (10 if len(set(path)) < len(left) else 0)


# -- graphs ------------------------------------------------------------------------------------------------------------
def max_flow(edges, source, sink) -> tuple[float, set]:
    """(flow, source side of a least cut) by shortest augmenting paths; ``edges``: (src, dst, capacity)."""
    left: dict = defaultdict(lambda: defaultdict(float))
    for a, b, c in edges:
        left[a][b] += c
        left[b][a] += 0.0
    flow = 0.0
    while True:
        prev, queue = {source: None}, deque([source])
        while queue and sink not in prev:
            a = queue.popleft()
            for b in sorted(left[a]):
                if b not in prev and left[a][b] > 1e-12:
                    prev[b] = a
                    queue.append(b)
        if sink not in prev:
            return flow, set(prev)
        path, b = [], sink
        while prev[b] is not None:
            path.append((prev[b], b))
            b = prev[b]
        push = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= push
            left[b][a] += push
        flow += push


def depth_first(edges) -> dict:
    """vertex -> (discovery, finish, parent), vertices and neighbours by id."""
    near = defaultdict(list)
    nodes = set()
    for a, b in edges:
        near[a].append(b)
        nodes |= {a, b}
    out, clock = {}, 0
    for root in sorted(nodes):
        if root in out:
            continue
        clock += 1
        out[root] = [clock, None, None]
        stack = [(root, iter(sorted(near[root])))]
        while stack:
            a, rest = stack[-1]
            for b in rest:
                if b not in out:
                    clock += 1
                    out[b] = [clock, None, a]
                    stack.append((b, iter(sorted(near[b]))))
                    break
            else:
                clock += 1
                out[a][1] = clock
                stack.pop()
    return {k: tuple(v) for k, v in out.items()}


# -- merging and fitting ----------------------------------------------------------------------------------------------
def agglomerate(centres, velocities, sizes, thres: float, rate: float = 0.8, rounds: int = 5, alpha: float = 1.0) -> list[int]:
    """Group of each item: in each round (threshold * rate^round) the most similar pair above it is merged and its mean taken anew."""
    c, v, n = (np.array(a, float) for a in (centres, velocities, sizes))
    group = np.arange(len(c))

    def similar(i) -> np.ndarray:
        return 1 / (1 + np.sqrt(((c - c[i]) ** 2).sum(axis=1) + alpha * ((v - v[i]) ** 2).sum(axis=1)))

    s = np.array([similar(i) for i in range(len(c))]).reshape(len(c), len(c))
    s[np.tril_indices(len(c))] = -1
    for k in range(rounds):
        while len(c) > 1:
            x, y = np.unravel_index(int(np.argmax(s)), s.shape)
            if s[x, y] <= thres * rate**k:
                break
            total = n[x] + n[y]
            c[x], v[x] = (c[x] * n[x] + c[y] * n[y]) / total, (v[x] * n[x] + v[y] * n[y]) / total
            n[x] = total
            group[group == y] = x
            n[y] = 0
            new = np.where(n > 0, similar(x), -1)
            s[y, :] = s[:, y] = -1
            s[x, x + 1 :] = new[x + 1 :]
            s[:x, x] = new[:x]
    return group.tolist()


def smooth_contour(points, rounds: int, weight: float = 0.5, closed: bool = False) -> np.ndarray:
    """Elastic smoothing in place: each point moves by ``weight`` towards the middle of its neighbours, seeing those moved before it;
    the ends of an open contour stay."""
    axes = np.array(points, float).T.tolist()
    for p in axes:
        n = len(p)
        for _ in range(rounds):
            for i in range(n) if closed else range(1, n - 1):
                p[i] += weight * ((p[i - 1] + p[(i + 1) % n]) / 2 - p[i])
    return np.array(axes).T


def fit_circle(points, rounds: int = 50) -> tuple[float, float, float, float]:
    """(cx, cy, r, residual sum) of least squared distances to the circle, by damped Gauss-Newton from the algebraic fit."""
    p = np.asarray(points, float)
    a = np.column_stack([p, np.ones(len(p))])
    s = np.linalg.lstsq(a, (p**2).sum(axis=1), rcond=None)[0]
    t = np.array([s[0] / 2, s[1] / 2, np.sqrt(max(s[2] + (s[0] ** 2 + s[1] ** 2) / 4, 1e-12))])
    damp = 1e-3

    def residual(t):
        return np.hypot(p[:, 0] - t[0], p[:, 1] - t[1]) - t[2]

    r = residual(t)
    for _ in range(rounds):
        far = np.maximum(r + t[2], 1e-12)
        jac = np.column_stack([(t[0] - p[:, 0]) / far, (t[1] - p[:, 1]) / far, -np.ones(len(p))])
        h = jac.T @ jac
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), -jac.T @ r, rcond=None)[0]
        new = residual(t + step)
        if new @ new < r @ r:
            t, r, damp = t + step, new, damp / 10
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 10
    return float(t[0]), float(t[1]), float(t[2]), float(r @ r)


# -- offset polygons ---------------------------------------------------------------------------------------------------
def offset_polygon(polygon, until: float) -> list[list[tuple[float, float]]]:
    """Rings of a simple polygon whose edges have moved inwards by ``until`` at unit speed.

    The next event of all rings is an edge that shrinks to a point (its ends merge) or a reflex vertex that meets an edge (the ring is
    split). Rings of fewer than three vertices, or without area, are gone.
    """
    first = list(map(tuple, polygon))
    if sum(_turn((0, 0), first[i - 1], first[i]) for i in range(len(first))) < 0:
        first.reverse()
    heap, done, tick = [(0.0, 0, first)], [], 0
    while heap:
        now, _, ring = heapq.heappop(heap)
        ring = _tidy(ring)
        if len(ring) < 3 or polygon_area(ring) < 1e-9:
            continue
        p = np.array(ring, float)
        speed = _speeds(p)
        wait, event = until - now, None
        n = len(p)
        for i in range(n):
            d, dv = p[(i + 1) % n] - p[i], speed[(i + 1) % n] - speed[i]
            rate = d @ dv
            if rate < -1e-12 and (t := -(d @ d) / rate) < wait - 1e-12:
                wait, event = t, None
        for i in range(n):
            if _turn(p[i - 1], p[i], p[(i + 1) % n]) >= -1e-12:
                continue
            for j in range(n):
                if j in (i, (i - 1) % n):
                    continue
                a, b = p[j], p[(j + 1) % n]
                e = (b - a) / np.hypot(*(b - a))
                normal = np.array([-e[1], e[0]])
                gap, closing = (p[i] - a) @ normal, 1 - speed[i] @ normal
                if gap <= 1e-12 or closing <= 1e-12:
                    continue
                t = gap / closing
                if t < wait - 1e-12:
                    at, A, B = p[i] + t * speed[i], a + t * speed[j], b + t * speed[(j + 1) % n]
                    s = (at - A) @ e
                    if -1e-9 <= s <= np.hypot(*(B - A)) + 1e-9:
                        wait, event = t, (i, j)
        moved = [tuple(q) for q in p + max(wait, 0.0) * speed]
        if wait >= until - now - 1e-12:
            if polygon_area(moved) > 1e-9:
                done.append(moved)
            continue
        parts = [moved]
        if event:
            i, j = event
            span = (j - i) % n
            parts = [[moved[(i + k) % n] for k in range(span + 1)], [moved[(j + 1 + k) % n] for k in range((i - j - 1) % n + 1)]]
        for part in parts:
            tick += 1
            heapq.heappush(heap, (now + wait + 1e-12, tick, part))
    return done


def _tidy(ring: list[tuple]) -> list[tuple]:
    """Without repeated points, points on a line and spikes; each can leave others, so until nothing changes."""
    while True:
        out: list[tuple] = []
        for q in ring:
            if not out or np.hypot(q[0] - out[-1][0], q[1] - out[-1][1]) > 1e-7:
                out.append(q)
        while len(out) > 1 and np.hypot(out[0][0] - out[-1][0], out[0][1] - out[-1][1]) <= 1e-7:
            out.pop()
        flat = next((k for k, q in enumerate(out) if len(out) > 2 and abs(_turn(out[k - 1], q, out[(k + 1) % len(out)])) <= 1e-10), None)
        if flat is not None:
            del out[flat]
        elif len(out) == len(ring):
            return out
        ring = out


def _speeds(p: np.ndarray) -> np.ndarray:
    """Velocity of each vertex so that both its edges move inwards at unit speed."""
    e = np.roll(p, -1, axis=0) - p
    e /= np.hypot(e[:, 0], e[:, 1])[:, None]
    n = np.column_stack([-e[:, 1], e[:, 0]])
    m = np.roll(n, 1, axis=0)
    return (n + m) / np.maximum(1 + (n * m).sum(axis=1), 1e-9)[:, None]
