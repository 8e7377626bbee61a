"""Plain versions of the operators, row by row in Python, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def fingerprint(text: str | None, width: int = 4) -> int:
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows: list[tuple], radius: int = 4) -> list[tuple]:
    """(id, fingerprint, component_id) per (id, text)."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[find(i)].append(ident)
    return [(ident, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (ident, _) in enumerate(rows)]


def shingle_set(text: str | None, width: int = 5) -> set[bytes]:
    w = [x.translate(LOWER) for x in words(text)]
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def kept_of_similar(rows: list[tuple], similarity: float = 0.8) -> list[int]:
    """Places of the (id, text) rows that stay: the least id of each group of similar texts, all rows without words."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        groups[find(i)].append((ident is None, ident or 0, i))
    first = {min(g)[2] for g in groups.values()}
    return [i for i in range(len(rows)) if i in first or not sets[i]]


def secrets(text: str | None) -> dict:
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spans.sort()
    base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    counts = {f"n_{k}": sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")}
    return counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "base": base}


def url_verdict(url: str | None) -> tuple:
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches of 24 words or more with three periods or more, by trying all periods."""
    out, number = [], np.unique(np.array(w, dtype=object).astype(bytes), return_inverse=True)[1] if w else np.empty(0, int)
    for q in range(1, len(w) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], number[:-q] == number[q:], [0]])))
        for i, j in edges.reshape(-1, 2).tolist():
            if j + q - i >= max(24, 3 * q) and not any(w[i : j + q - r] == w[i + r : j + q] for r in range(1, q)):
                out.append((i, j + q - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(ident: int, text: str | None) -> list[bytes]:
    w = words(text)
    h = zlib.crc32(str(ident).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)
