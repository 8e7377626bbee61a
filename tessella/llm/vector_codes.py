"""Vector code compression: product quantisation with an exponion search for the nearest entry (operator 11).

Vectors become whole numbers and are cut into equal consecutive parts; each part position has a codebook of its own.
A round assigns every part to its nearest entry and moves the entries to the floored means of their parts.

The search starts at the entry ``a`` of the round before. Every entry that is as near as ``a`` lies, by the triangle
inequality, within twice the distance to ``a`` around ``a``. In squares that is ``D(a, e) <= 4 * D(x, a)``, exact in whole
numbers. Each entry has a list of all entries sorted by their distance to it, which is scanned up to that radius.

The state of the rounds is one staged table (vector, codes). A round is a single pass that reads it, writes the next one,
and adds one row per task with the sums and counts of its parts: ``parts * entries`` vectors, which Spark adds up. A lost
executor repeats its tasks of one round. Only codebooks (``parts * entries`` vectors) pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table
from tessella.plans.storage import release, stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
STEP = 4096  # vectors per step of a task


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, distance): per entry all entries by their squared distance to it, ties by index, and these distances."""
    apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def nearest_entries(x: np.ndarray, book: np.ndarray, start: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, distances taken) for each row of ``x``: the exact nearest entry, ties to the lower index.

    ``start`` is any entry per row; the nearer it is, the fewer entries are looked at.
    """
    order, apart = neighbour_lists(book) if lists is None else lists
    best, least = start.astype(np.int64), ((x - book[start]) ** 2).sum(axis=1)
    within = np.empty(len(x), np.int64)
    for a in np.unique(start):
        of = start == a
        within[of] = np.searchsorted(apart[a], 4 * least[of], side="right")
    taken, left = len(x), np.arange(len(x))
    for k in range(len(book)):
        left = left[within[left] > k]
        if not len(left):
            break
        entry = order[start[left], k]
        other = entry != start[left]
        rows, entry = left[other], entry[other]
        far = ((x[rows] - book[entry]) ** 2).sum(axis=1)
        taken += len(rows)
        better = (far < least[rows]) | ((far == least[rows]) & (entry < best[rows]))
        best[rows[better]], least[rows[better]] = entry[better], far[better]
    return best, least, taken


def moved(book: list[list[int]], sums: dict[int, tuple[list[int], int]]) -> list[list[int]]:
    """Entries at the floored means of their parts; an entry without parts stays."""
    return [[s // sums[e][1] for s in sums[e][0]] if e in sums else entry for e, entry in enumerate(book)]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    """One pass over a task's vectors: new codes, errors at the end; else one more row with the task's sums and counts."""
    parts, entries, width = books.shape
    lists = [neighbour_lists(b) for b in books]
    sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    schema = None
    for whole in batches:
        own = [pa.field("error", pa.int64()), pa.field("sums", pa.list_(pa.int64())), pa.field("counts", pa.list_(pa.int64()))]
        schema = pa.schema([*[whole.schema.field(n) for n in ("id", "kept", "ints", "codes")], *own])
        for begin in range(0, whole.num_rows, STEP):
            batch = whole.slice(begin, STEP)
            x = _vectors(batch["ints"], parts * width).reshape(-1, parts, width)
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, parts)
            new, error = np.empty_like(codes), np.zeros(len(x), np.int64)
            for p in range(parts):
                best, least, _ = nearest_entries(x[:, p], books[p], codes[:, p], lists[p])
                new[:, p] = best
                error += least
                if not last:
                    counts[p] += np.bincount(best, minlength=entries)
                    np.add.at(sums[p], best, x[:, p])
            none = pa.nulls(len(x), pa.list_(pa.int64()))
            made = pa.array([r.tobytes() for r in new], schema.field("codes").type)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["kept"], batch["ints"], made, pa.array(error), none, none], schema=schema)
    if not last and schema is not None:
        blank = [pa.nulls(1, schema.field(n).type) for n in ("id", "kept", "ints", "codes", "error")]
        both = [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (sums, counts)]
        yield pa.RecordBatch.from_arrays([*blank, *both], schema=schema)


def _added_up(state: DataFrame, shape: tuple[int, int, int]) -> list[dict[int, tuple[list[int], int]]]:
    """Per part the exact sums and counts of each entry that has parts; ``parts * entries`` rows."""
    parts, entries, width = shape
    rows = state.where("sums IS NOT NULL").select("sums", F.posexplode("counts").alias("cell", "n")).where("n > 0")
    own = [F.sum(F.get("sums", F.col("cell") * width + k).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]
    out: list[dict] = [{} for _ in range(parts)]
    for r in rows.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), *own).collect():
        out[r["cell"] // entries][r["cell"] % entries] = ([int(r[f"s{k}"]) for k in range(width)], int(r["n"]))
    return out


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components; null vectors aren't usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows ``id, codes (a byte a part), error``, and the columns of ``keep`` as the struct ``kept``; the codebooks by part and entry).

    Components become ``floor(scale * x)``. Vectors that are null or hold null or non-finite components are dropped. The codebooks
    start as the parts of the ``entries`` smallest ids, ascending, null ids last; ids that repeat count row by row, in the order of
    their vectors. With fewer vectors the codebooks are shorter. An empty table, or one without a usable vector, gives no rows
    and empty codebooks; rows that repeat get equal codes; other columns are ignored, whatever their names. The length of
    vectors is that of the smallest id and must be a positive multiple of ``parts``; vectors of another length can't be cut into the same parts
    and raise, as do components too large for an error that fits a long. ``entries`` is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code is a byte")
    wide = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("boolean")
    near = F.exists(vector_col, lambda x: F.abs(x.cast("double") * scale) >= 2.0**62)
    ints = F.when(near, F.raise_error("components are too large for a long")).otherwise(wide)
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), kept.alias("kept"), ints.alias("ints"), F.unhex(F.lit("00" * parts)).alias("codes"))
    extra = "error bigint", "sums array<bigint>", "counts array<bigint>"
    state = stage(rows.select("*", *[F.lit(None).cast(e.split()[1]).alias(e.split()[0]) for e in extra]), "vectors")
    first = state.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    if not first:
        return state.select("id", "codes", "error", "kept"), [[] for _ in range(parts)]
    dims = len(first[0]["ints"])
    seen = state.agg(F.min(F.size("ints")).alias("least"), F.max(F.size("ints")).alias("most"), F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints")))).alias("far")).first()
    if not dims or dims % parts or seen["least"] != seen["most"]:
        raise ValueError(f"vectors have {seen['least']} to {seen['most']} components, need one length, a positive multiple of {parts}")
    if seen["far"] > math.isqrt((2**63 - 1) // dims) // 4:
        raise ValueError(f"a component of {seen['far']} is too large for squared distances of {dims} components")
    width = dims // parts
    books = [[list(r["ints"][p * width : (p + 1) * width]) for r in first] for p in range(parts)]
    out = state.schema
    for k in range(rounds + 1):
        table_of, last = np.array(books, np.int64), k == rounds
        vectors = state.where("ints IS NOT NULL").select("id", "kept", "ints", "codes")
        done = stage(vectors.mapInArrow(lambda it, b=table_of, end=last: _round(it, b, end), out), "vectors")
        release(state)
        state = done
        if not last:
            added = _added_up(state, table_of.shape)
            books = [moved(book, sums) for book, sums in zip(books, added, strict=True)]
    return state.select("id", "codes", "error", "kept"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors of ``embeddings``. Errors of a label are added up in an aggregate and joined back, so a hot label
    is never in one task; vectors with a null label are one group."""
    found, books = compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = found.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", F.col("kept.label").alias("label"))
    sums = stage(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").cast("bigint").alias("label_error")), "label-errors")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op11_sql() -> str:
    square = "list_sum(list_transform(range(1, {n} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
    far = square.format(n="len(v.x)", a="v.x", b="b.c")
    near = "SELECT v.row, v.part, arg_min(b.entry, [" + far + "::HUGEINT, b.entry]) AS entry, min(" + far + ") AS far FROM v JOIN b{k} b ON b.part = v.part GROUP BY v.row, v.part"
    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(
            f"s{k} AS (SELECT part, entry, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{k} USING (row, part), range(1, (SELECT max(len(x)) FROM v) + 1) t(i) GROUP BY part, entry, i),"
            f"m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY part, entry),"
            f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c::HUGEINT[]) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"
        )
    return f"""
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS row FROM r),
v AS MATERIALIZED (SELECT row, p AS part, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS x FROM k, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c FROM v WHERE row <= {ENTRIES}),
{",".join(steps)},
f AS MATERIALIZED ({near.format(k=ROUNDS)}),
e AS (SELECT row, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM f GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN e USING (row), h
"""


OP11_SQL = _op11_sql()
