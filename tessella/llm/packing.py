"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing (operator 9).

A document's ids and one closing id are one item; longer ones are cut into full pieces, the first takes the rest.

1. Each task packs its own items best-fit decreasing, ``LOCAL`` at a time, and emits the nearly full bins.
2. Underfull bins go up a tree of fan ``FAN`` as the items they hold (a bin of two items fits fewer partners than its
   items do). Only their number by length goes up, at most ``capacity`` numbers a node, however many items there are.
   A node packs its children's items best-fit on these numbers, emits nearly full bins and hands up the rest; the
   root emits all.
3. A node's plan says which bin and offset the q-th of its items of a length gets. Every item knows its place among
   the items of its length in its task; the plans of the levels above turn that into bin and offset by one join a
   level on (group, length). Items themselves are never gathered or moved up the tree.

Each level is written before the next reads it, so that sequence ids don't change if an executor is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.simhash_kernel import sliced
from tessella.llm.tables import table
from tessella.plans.storage import stage

CAPACITY = 2048
NEARLY_FULL = 2000
CLOSING_ID = 0
LOCAL = 200_000
FAN = 16
_COLUMNS = [("id", None), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _ranks(path: str, pattern: str, special: dict[str, int]):
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def encoder(tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """texts -> id arrays as of the tokenizer file at ``tokenizer_path``, without added special tokens.

    ``ranks_path``: the same vocabulary as ranks, if there is one. It gives the same ids several times faster and is
    used for texts of Latin-1 letters with ordinary word lengths and no special token's string; others take the file.
    """

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        if ranks_path:
            for i, text in enumerate(texts):
                if "<|" not in text and (text.isascii() or _latin(text)) and _ordinary(text):
                    plain.append(i)
            fast = _ranks(ranks_path, pattern, {})
            for i in plain:
                out[i] = np.array(fast.encode_ordinary(texts[i]), dtype="<u4")
        slow = [i for i, x in enumerate(out) if x is None]
        if slow:
            for i in slow:
                out[i] = np.array(_tokenizer(tokenizer_path).encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out

    return encode


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def _ordinary(text: str) -> bool:
    """No run of a thousand characters without white space."""
    return len(text) < 1000 or max(map(len, text.split()), default=0) < 1000 and "    " * 200 not in text


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the little-endian ids)."""
    n = len(ids)
    first = n if n <= capacity else n % capacity or capacity
    ends = [first, *range(first + capacity, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


def _tokenise(batches: Iterator[pa.RecordBatch], encode, closing: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in sliced(batch["text"]):
            rows, cut = [], []
            for i, ids in enumerate(encode(part.to_pylist())):
                found = pieces_of(np.append(ids, np.array([closing], dtype="<u4")), capacity)
                cut += found
                rows += [at + i] * len(found)
            at += len(part)
            cols = list(zip(*cut, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, _COLUMNS[1:], strict=True)]], [n for n, _ in _COLUMNS]
            )


def token_pieces(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 closing: int = CLOSING_ID, capacity: int = CAPACITY) -> DataFrame:
    """``id, piece, start, length, ids_crc32``. A null or empty text is one piece: the closing id."""
    kind = df.schema[id_col].dataType.simpleString()
    encode = encoder(tokenizer_path, ranks_path, pattern)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _tokenise(it, encode, closing, capacity), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit decreasing: (bin, offset) of each item and the number of bins. Free space is looked up in a bit set."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free, made = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            held = open_bins[space]
            b = held.pop()
            if not held:
                free &= ~(1 << space)
        else:
            space, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - space
        left = space - size
        if left:
            open_bins[left].append(b)
            free |= 1 << left
    return bins, offsets, made


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]], int]]:
    """Best fit decreasing on numbers of items by size: (number of equal bins, their (size, items) in order, free space)."""
    made: list[list] = []  # [bins, contents, free]
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # places in ``made`` by free space
    free = 0

    def put(group: list) -> None:
        nonlocal free
        made.append(group)
        if group[2]:
            at[group[2]].append(len(made) - 1)
            free |= 1 << group[2]

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = free >> size
            if not fits:
                per = capacity // size
                for bins, each in ((left // per, per), (1, left % per)):
                    if bins and each:
                        put([bins, [(size, each)], capacity - size * each])
                break
            space = size + (fits & -fits).bit_length() - 1
            held = at[space]
            place = held.pop()
            group = made[place]
            if not held:
                free &= ~(1 << space)
            each = min(space // size, -(-left // group[0]))
            bins = min(group[0], left // each)
            left -= bins * each
            if bins < group[0]:
                put([group[0] - bins, list(group[1]), space])
            group[0], group[2] = bins, space - size * each
            group[1].append((size, each))
            if group[2]:
                at[group[2]].append(place)
                free |= 1 << group[2]
    return [tuple(g) for g in made]


#: Sequence ids: leaves count from 0 (partition, chunk, bin), nodes of the tree from 2^62 (level, node, bin).
_CHUNK_BITS, _BIN_BITS, _NODE_BITS, _NODE_BIN_BITS = 20, 18, 20, 36
_PLAN = "node bigint, length bigint, first bigint, bin bigint, offset bigint, each bigint"


def node_plan(level: int, node: int, counts: dict[int, int], capacity: int, least_fill: int) -> list[tuple[int, int, int, int, int, int]]:
    """(node, length, first, bin, offset, each): from the ``first``-th item of a length on, ``each`` items go to each bin from
    ``bin`` on, at ``offset`` and behind. Bins filled to less than ``least_fill`` are left out: their items go up."""
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    out, bin_ = [], 0
    for bins, contents, free in best_fit_counts(counts, capacity):
        if capacity - free < least_fill:
            continue
        place = 0
        for size, each in contents:
            out.append((node, size, taken[size], (1 << 62) + (level << 56) + (node << _NODE_BIN_BITS) + bin_, place, each))
            taken[size] += bins * each
            place += size * each
        bin_ += bins
    if node >> _NODE_BITS or bin_ >> _NODE_BIN_BITS:
        raise ValueError("more bins or groups than sequence ids are made for")
    # a last entry a length: from here on items go up
    return out + [(node, size, n, -1, 0, 1) for size, n in taken.items()]


def _planner(level: int, capacity: int, least_fill: int):
    names = [x.split()[0] for x in _PLAN.split(", ")]

    def plan(key: tuple, rows: pa.Table) -> pa.Table:
        counts = dict(zip(rows["length"].to_pylist(), rows["n"].to_pylist(), strict=True))
        cols = zip(*node_plan(level, key[0].as_py(), counts, capacity, least_fill), strict=True)
        return pa.table([pa.array(c, pa.int64()) for c in cols], names)

    return plan


def _leaf(capacity: int, nearly_full: int, local: int):
    names = [*(n for n, _ in _COLUMNS), "bin", "offset", "grp", "idx"]

    def packed(held: list[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        length = rows["length"].to_numpy()
        bins, starts, made = best_fit(length, capacity)
        full = np.bincount(bins, weights=length, minlength=made)[bins] >= nearly_full
        left = np.flatnonzero(~full)
        left = left[np.argsort(length[left], kind="stable")]
        sizes = length[left]
        idx = np.full(len(length), -1, np.int64)  # of an item of an underfull bin: its place among those of its length
        idx[left] = np.arange(len(left)) - np.searchsorted(sizes, sizes)
        cols = [*(rows[n] for n, _ in _COLUMNS), pa.array((group << _BIN_BITS) + bins), pa.array(starts), pa.array(np.full(len(length), group, np.int64)), pa.array(idx)]
        yield from pa.table(cols, names).to_batches(20_000)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = 0, [], 0
        for batch in batches:
            for at in range(0, len(batch), local):
                part = batch.slice(at, local)
                if n + len(part) > local:
                    yield from packed(held, (TaskContext.get().partitionId() << _CHUNK_BITS) + chunk)
                    chunk, held, n = chunk + 1, [], 0
                held.append(part)
                n += len(part)
        if n:
            yield from packed(held, (TaskContext.get().partitionId() << _CHUNK_BITS) + chunk)

    return leaf


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, local: int = LOCAL, fan: int = FAN) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``, one row per piece.

    Lengths are 1 to ``capacity``. Equal and repeated pieces and null ids are packed one by one; an empty table gives an
    empty result; other columns of ``pieces`` are ignored. A task holds at most ``local`` pieces, a node of the tree
    ``fan * capacity`` numbers.
    """
    if local > 1 << _BIN_BITS:
        raise ValueError(f"local is {1 << _BIN_BITS} at most")
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, grp bigint, idx bigint"
    # dealt by a hash, so that each task packs a mixture of all lengths, however the table is sorted
    dealt = pieces.select(*(n for n, _ in _COLUMNS)).repartition(F.xxhash64("id", "piece", "start", "ids_crc32"))
    leaves = stage(dealt.mapInArrow(_leaf(capacity, nearly_full, local), schema), "packed")
    own = ["id", "piece", "start", "length", "ids_crc32"]
    out = leaves.where("idx < 0").select(*own, F.col("bin").alias("sequence_id"), "offset")
    under = leaves.where("idx >= 0").select(*own, "grp", F.col("idx").alias("q"))
    counts = stage(under.groupBy("grp", "length").agg(F.count("*").alias("n")), "left-by-length")
    # groups with items left, numbered from 0: a row a group, far fewer than items
    numbered = counts.select("grp").distinct().withColumn("child", F.row_number().over(Window.orderBy("grp")).cast("bigint") - 1)
    counts = stage(counts.join(numbered, "grp"), "left-by-length")
    groups = counts.agg(F.max("child")).first()[0]
    if groups is None:
        return out
    under = under.join(counts.select("grp", "length", "child"), ["grp", "length"]).drop("grp")
    counts, level = counts.drop("grp"), 0
    while True:
        level, root = level + 1, groups < fan
        parted = counts.withColumn("node", F.floor(F.col("child") / fan).cast("bigint"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("node", "length").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parted = stage(parted.withColumn("ahead", ahead).select("child", "length", "node", "ahead", "n"), "children")
        totals = parted.groupBy("node", "length").agg(F.sum("n").alias("n"))
        plan = stage(totals.groupBy("node").applyInArrow(_planner(level, capacity, 0 if root else nearly_full), _PLAN), "node-plans")
        ranges = plan.groupBy("node", "length").agg(F.array_sort(F.collect_list(F.struct("first", "bin", "offset", "each"))).alias("ranges"))
        here = parted.join(ranges, ["node", "length"]).select("child", "length", "node", "ahead", "ranges")
        q = F.col("q") + F.col("ahead")
        found = under.join(stage(here, "places"), ["child", "length"]).withColumn("q", q)
        found = found.withColumn("at", F.element_at(F.filter("ranges", lambda r: r["first"] <= F.col("q")), -1)).drop("ranges", "ahead", "child")
        found = found.withColumn("q", F.col("q") - F.col("at.first"))
        found = stage(found, "placed")
        places = found.where("at.bin >= 0")
        step = F.col("q") % F.col("at.each")
        out = out.unionByName(places.select(*own, (F.col("at.bin") + F.expr("q div at.each")).alias("sequence_id"), (F.col("at.offset") + step * F.col("length")).alias("offset")))
        if root:
            return out
        under = found.where("at.bin < 0").select(*own, "q", F.col("node").alias("child"))
        counts = stage(totals.join(plan.where("bin < 0"), ["node", "length"]).select(F.col("node").alias("child"), "length", (F.col("n") - F.col("first")).alias("n")).where("n > 0"), "left-by-length")
        groups = groups // fan


def default_tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer_path": str(public_tokenizers.path("byte_bpe_50k.json")), "ranks_path": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


def pack_documents(df: DataFrame) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every row of ``df`` (doc_id, text).

    A null or empty text is one piece, the closing id; very long texts are cut into full pieces; repeated rows and null
    ids are packed one by one; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    pieces = stage(token_pieces(df, **default_tokenizer()), "pieces")
    return pack(pieces).withColumnRenamed("id", "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
