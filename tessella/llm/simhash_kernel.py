"""Vectorised SimHash fingerprints of whole texts (numpy + XXH64).

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``; A-Z are lower-cased first.
Shingles are ``width`` consecutive words joined by one space; shorter texts give one shingle.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Distances to references that are held at a time (12 bytes each), whatever the number of texts and references.
DISTANCES = 1 << 21


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets (from 0) of a string array; a null counts as an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, word starts, word ends, words per text); words of a text are parted by one space."""
    low = _LOWER[raw]
    space = _SPACE[raw]
    before = np.empty_like(space)  # is the byte before a space, or outside the text?
    if len(raw):
        before[0] = True
        before[1:] = space[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[firsts] = True
    begins = ~space & before
    keep = ~space | ~before
    after = np.empty_like(space)
    if len(raw):
        after[-1] = True
        after[:-1] = space[1:]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        after[lasts] = True
    low[space] = 0x20
    place = np.cumsum(keep) - 1
    upto = np.concatenate([[0], np.cumsum(begins)])
    return low[keep], place[begins], place[~space & after] + 1, upto[offsets[1:]] - upto[offsets[:-1]]


def shingle_hashes(texts: pa.Array, width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, text after text; shingles per text)."""
    norm, starts, ends, counts = words_of(*string_buffers(texts))
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    total = int(shingles.sum())
    first_word = np.cumsum(counts) - counts
    first_shingle = np.cumsum(shingles) - shingles
    at = np.arange(total) - np.repeat(first_shingle - first_word, shingles)
    last = at + np.repeat(np.minimum(width, np.maximum(counts, 1)) - 1, shingles)
    data, digest = norm.tobytes(), xxhash.xxh64_intdigest
    step = 1 << 18  # spans at a time: lists of numbers of a very long text stay small
    hashes = np.empty(total, np.uint64)
    for lo in range(0, total, step):
        spans = zip(starts[at[lo : lo + step]].tolist(), ends[last[lo : lo + step]].tolist(), strict=True)
        hashes[lo : lo + step] = np.fromiter((digest(data[a:b], seed) for a, b in spans), np.uint64, min(step, total - lo))
    return hashes, shingles


def bit_counts(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """texts x 64: how many shingle hashes have each bit."""
    out = np.zeros((len(shingles), 64), np.int64)
    if not len(hashes):
        return out
    first_shingle = np.cumsum(shingles) - shingles
    # bytes of 0/1 are summed eight at a time, over runs of 255 shingles at most
    full = np.flatnonzero(shingles)
    runs = -(-shingles[full] // 255)
    run_first = np.repeat(first_shingle[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    sums = []
    step = 1024  # runs at a time: 16 MB of bits at most
    for lo in range(0, len(run_first), step):
        part = run_first[lo : lo + step]
        stop = run_first[lo + step] if lo + step < len(run_first) else len(hashes)
        bits = np.unpackbits(hashes[part[0] : stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums.append(np.add.reduceat(bits.view(np.uint64), part - part[0], axis=0).view(np.uint8))
    out[full] = np.add.reduceat(np.concatenate(sums).astype(np.int64), np.cumsum(runs) - runs, axis=0)
    return out


def majority(ones: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    return np.packbits((2 * ones > shingles[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts: pa.Array, width: int = 4, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit SimHash per text: a bit is 1 if over half the shingles' hashes have it; no words: 0."""
    hashes, shingles = shingle_hashes(texts, width, seed)
    return majority(bit_counts(hashes, shingles), shingles)


def distinct_hashes(hashes: np.ndarray, shingles: np.ndarray) -> list[np.ndarray]:
    return [np.unique(part) for part in np.split(hashes, np.cumsum(shingles)[:-1])] if len(shingles) else []


def shingle_sets(texts: pa.Array, width: int = 5, seed: int = 42) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    return distinct_hashes(*shingle_hashes(texts, width, seed))


def parities(members: np.ndarray, sizes: np.ndarray, longs: int) -> np.ndarray:
    """sets x longs: parities of the numbers of members by their last bits; ``members`` of all sets, set after set."""
    bits = 64 * longs
    place = members.view(np.uint64).astype(np.int64) & (bits - 1)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * bits + place, minlength=len(sizes) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


@lru_cache(maxsize=4)
def reference_fingerprints(count: int, seed: int) -> np.ndarray:
    """Drawn once a worker. ``count`` scattered 64-bit fingerprints as a 64 x count matrix of -1 and 1."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (64, count)).astype(np.float32) * 2 - 1


def margins(ones: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """How clear each bit's majority is, as a vector of length 1 per text."""
    found = (2 * ones - shingles[:, None]).astype(np.float64)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def nearest_references(clear: np.ndarray, references: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the ``nearest`` references of each text, ascending.

    The distance is Hamming distance in which a bit weighs as much as its majority is clear, so that bits that a few
    changed words could turn hardly count. Weights are rounded to whole numbers: their sums stay under 2**24, exact in any
    order, so that a text's references don't depend on the texts that share its batch.
    """
    whole = np.rint(clear * -(1 << 14)).astype(np.float32)
    count = references.shape[1]
    step = max(1, DISTANCES // count)
    found = np.empty((len(whole), nearest), np.int64)
    for lo in range(0, len(whole), step):
        far = whole[lo : lo + step] @ references
        found[lo : lo + step] = np.argpartition(far, nearest - 1, axis=1)[:, :nearest]
    return np.sort(found, axis=1)


def sliced(texts: pa.Array, most: int = 1 << 20):
    """Slices of a string array with about ``most`` bytes at most; a longer text is a slice of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi
    give_back()


_libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
