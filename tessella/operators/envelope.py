"""Least costs along a line in linear time: the lower envelope of one cost curve per place, kept as a stack.

A place ``p`` of a line offers ``cost(a[p], |q - p|)`` to every place ``q``. For the costs here two such curves cross once: of two places the
earlier one is better up to some q, the later one from there on. So the places that are best somewhere form a stack as the line is
read, a new place removes those that it beats on all of their stretch, and one look-up from the other end reads off the result. All lines of
a batch take each step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OCTILE = 2**0.5 - 1
COSTS = {
    "l2": lambda a, d: a * a + d * d,
    "l1": lambda a, d: a + d,
    "linf": np.maximum,
    "octile": lambda a, d: np.maximum(a, d) + _OCTILE * np.minimum(a, d),
    "added": lambda a, d: a + d * d,
}


def lower_envelope(a: np.ndarray, places: np.ndarray, cost: str, spacing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(least cost, index of the place that offers it) per line and place; ``a`` is lines x places, nan: no offer, ``places`` ascend.

    Without any offer the cost is nan and the index -1.
    """
    lines, n = a.shape
    f = COSTS[cost]
    where = places.astype(float) * spacing
    every = np.arange(lines)
    known = ~np.isnan(a)

    def at(rows: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return f(a[rows, p], np.abs(where[q] - where[p]))

    owner, begin, top = np.zeros((lines, n), np.int64), np.zeros((lines, n), np.int64), np.full(lines, -1)
    for q in range(n):
        rows = every[known[:, q]]
        new = np.full(len(rows), q)
        beaten = rows
        while len(beaten):
            beaten = beaten[top[beaten] >= 0]
            first = begin[beaten, top[beaten]]
            beaten = beaten[at(beaten, owner[beaten, top[beaten]], first) > at(beaten, np.full(len(beaten), q), first)]
            top[beaten] -= 1
        # the last place where the top of the stack is as good, by halving
        low = np.where(top[rows] >= 0, begin[rows, np.maximum(top[rows], 0)], -1)
        high = np.where(top[rows] >= 0, n, 0)
        held = owner[rows, np.maximum(top[rows], 0)]
        while (open_ := np.flatnonzero(high - low > 1)).size:
            mid = (low[open_] + high[open_]) // 2
            good = at(rows[open_], held[open_], mid) <= at(rows[open_], new[open_], mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good]
        wins = high < n
        rows, high = rows[wins], high[wins]
        top[rows] += 1
        owner[rows, top[rows]], begin[rows, top[rows]] = q, high
    best, which = np.full((lines, n), np.nan), np.full((lines, n), -1)
    rows = every[top >= 0]
    for q in range(n - 1, -1, -1):
        held = owner[rows, top[rows]]
        best[rows, q], which[rows, q] = at(rows, held, np.full(len(rows), q)), held
        top[rows[(begin[rows, top[rows]] == q) & (top[rows] > 0)]] -= 1
    return best, which


def _envelopes(batches: Iterator[pa.RecordBatch], axis: str, value: str, cost: str, spacing: float) -> Iterator[pa.RecordBatch]:
    """Adds ``best`` to batches of lines; lines with the same places go together."""
    kind = pa.list_(pa.struct([("d", pa.float64()), ("k", pa.int32())]))
    for batch in batches:
        line = batch["line"]
        flat, cuts = line.flatten(), np.append(0, np.cumsum(line.value_lengths().to_numpy(zero_copy_only=False)))
        places = flat.field(axis).to_numpy(zero_copy_only=False)
        values = flat.field(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        alike: dict[bytes, list[int]] = {}
        for k in range(batch.num_rows):
            alike.setdefault(places[cuts[k] : cuts[k + 1]].tobytes(), []).append(k)
        best, which = np.empty(len(flat)), np.empty(len(flat), np.int32)
        for lines in alike.values():
            n = cuts[lines[0] + 1] - cuts[lines[0]]
            at = cuts[lines][:, None] + np.arange(n)
            best[at], which[at] = lower_envelope(values[at], places[at[0]], cost, spacing)
        pairs = pa.StructArray.from_arrays([pa.array(best, mask=np.isnan(best)), pa.array(which)], ["d", "k"])
        made = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs).cast(kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "best"])


def along(df: DataFrame, keys: list[str], axis: str, value: str, cost: str, spacing: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keys, axis, d``, and the ``keep`` columns of the row that offers d: the least ``cost(value, distance)`` along each line ``keys``.

    Null values offer nothing; lines without any offer get nulls. A line's rows are packed once; a task holds the lines of one batch.
    """
    fields = F.struct(axis, value, *[c for c in keep if c != axis])
    lines = df.groupBy(*keys).agg(F.sort_array(F.collect_list(fields)).alias("line"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    found = lines.mapInArrow(lambda it: _envelopes(it, axis, value, cost, spacing), f"{schema}, best array<struct<d:double,k:int>>")
    offer = lambda b, c: F.when(b["k"] >= 0, F.get("line", b["k"])[c])
    rows = F.zip_with("line", "best", lambda p, b: F.struct(p[axis].alias(axis), b["d"].alias("d"), *[offer(b, c).alias(f"of_{c}" if c == axis else c) for c in keep]))
    return found.select(*keys, F.inline(rows))
