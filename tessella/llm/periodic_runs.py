"""Periodic runs: stretches of words that repeat with a period (operator 12), by branching tandem repeats in a suffix tree.

All texts of a step share one suffix tree in array form: sorted suffixes and the common prefixes of neighbours. A word
sequence ``w w`` that the next word doesn't continue is a branching tandem repeat; it shows at one node of the tree as two
leaves, ``len(w)`` words apart, below different children of the node of depth ``len(w)``. Per node the leaves of the smaller half
are listed and both partners of each, that many words before and behind, are looked up among the leaves of the other half:
n log n lookups in all. A repeat is then rotated to the left as long as words agree, which gives the whole run, and repeats
of one stretch are merged: its period is their shortest.

A run of ``LEAST`` words or more with three periods or more consists of word sequences of length ``LEAST / 3`` that occur
twice in the text, so only words in such sequences become leaves. That filter drops no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
SEED = LEAST // TIMES  # must be a power of two: a round of doubling ends at it
STEP_BYTES = 1 << 20
LEAVES = 1 << 20  # leaves looked up at a time
WORD_GAP = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind, text, id) of each word; ``raw`` holds the texts' bytes, one behind the other."""
    space = _SPACE[raw]
    opens, shuts = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    opens[offsets], shuts[offsets] = True, True
    opens[1:] |= np.append(space[:-1], True) if len(raw) else False
    shuts[:-1] |= space
    starts = np.flatnonzero(~space & opens[:-1])
    ends = np.flatnonzero(~space & shuts[1:]) + 1
    if not len(starts):
        return starts, ends, starts, starts
    edges = np.stack([starts, ends], axis=1).ravel()
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, pieces.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``sizes[k]`` of them, for all k in turn."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def sorted_prefixes(ids: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(rank of each suffix within all, names by length 1, 2, 4, ..., places whose ``SEED`` words occur twice in their text).

    Two places have the same name of length ``2 ** k`` if the next that many words are equal and in the same text. Suffixes end with
    their text. Only names that several places share are sorted again.
    """
    n = len(ids)
    order = np.lexsort((ids, text))
    fresh = np.ones(n, bool)
    fresh[1:] = (ids[order[1:]] != ids[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    rank, group = np.empty(n, np.int64), np.flatnonzero(fresh)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    shared, names, length = order, [], 1
    seeds = order[:0]
    while True:
        names.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        sizes = np.bincount(rank[shared], minlength=n) if len(shared) else np.zeros(n, np.int64)
        shared = shared[sizes[rank[shared]] > 1]
        if length == SEED:
            seeds = shared
        if not len(shared):
            return rank, names, seeds
        behind = shared + length
        inside = behind < end[shared]
        follow = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[shared] * (n + 1) + follow
        by = np.argsort(key)
        shared, key = shared[by], key[by]
        old = rank[shared]
        starts_new = np.append(True, key[1:] != key[:-1])
        starts_old = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(shared))
        new = np.maximum.accumulate(np.where(starts_new, at, 0)) - np.maximum.accumulate(np.where(starts_old, at, 0))
        rank[shared] = old + new
        length *= 2


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Least of the next 1, 2, 4, ... values at each place."""
    out = [values]
    while 2 ** len(out) <= len(values):
        half = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def halves(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, last leaf) below each split: leaf k - 1 and leaf k share ``common[k]`` words, ``common[0]`` is not used.

    A node of several children is split from the left, one child at a time.
    """
    m = len(common)
    levels = _minima(common)
    first, last = np.arange(m) - 1, np.arange(m)
    for k in range(len(levels) - 1, -1, -1):
        # to the left over larger values, to the right over larger and equal ones
        at = first + 1 - 2**k
        fits = at >= 1
        fits[fits] = levels[k][at[fits]] > common[fits]
        first[fits] -= 2**k
        at = last + 1
        fits = at + 2**k <= m
        fits[fits] = levels[k][at[fits]] >= common[fits]
        last[fits] += 2**k
    return first, last


def branching_repeats(leaves: np.ndarray, place: np.ndarray, common: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats with a period of ``most[start]`` at most.

    ``leaves`` are the sorted suffixes, ``place`` the number of a suffix among them or -1.
    """
    first, last = halves(common)
    splits = np.flatnonzero((common > 0) & (common <= most[leaves]))
    splits = splits[splits > 0]
    left = splits - first[splits]
    smaller_left = left <= last[splits] - splits + 1
    begin = np.where(smaller_left, first[splits], splits)
    sizes = np.where(smaller_left, left, last[splits] - splits + 1)
    other_first = np.where(smaller_left, splits, first[splits])
    other_last = np.where(smaller_left, last[splits], splits - 1)
    out = []
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(LEAVES, sizes.sum() + LEAVES, LEAVES), side="left") + 1 if len(sizes) else []
    low = 0
    for high in bounds:
        of = slice(low, min(high, len(sizes)))
        low = min(high, len(sizes))
        leaf = leaves[_ranges(begin[of], sizes[of])]
        depth, a, b = (np.repeat(v[of], sizes[of]) for v in (common[splits], other_first, other_last))
        for sign in (1, -1):
            partner = leaf + sign * depth
            ok = (partner >= 0) & (partner < len(place))
            at = place[np.where(ok, partner, 0)]
            ok &= (at >= a) & (at <= b)
            out.append((np.minimum(leaf, partner)[ok], depth[ok]))
    if not out:
        return leaves[:0], leaves[:0]
    return np.concatenate([s for s, _ in out]), np.concatenate([p for _, p in out])


def maximal_runs(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind, period) of all runs, by first word and then period; ``text`` ascends."""
    n, none = len(ids), np.empty(0, np.int64)
    if not n:
        return none, none, none
    begin = np.searchsorted(text, text, side="left")
    end = np.searchsorted(text, text, side="right")
    rank, names, seeds = sorted_prefixes(ids, text, end)
    if not len(seeds):
        return none, none, none
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, seeds, 1)
    np.add.at(edge, seeds + SEED, -1)
    covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    leaves = covered[np.argsort(rank[covered])]
    place = np.full(n, -1, np.int64)
    place[leaves] = np.arange(len(leaves))
    common, one, two = np.zeros(len(leaves), np.int64), leaves[:-1], leaves[1:]
    for k in range(len(names) - 1, -1, -1):
        a, b = one + common[1:], two + common[1:]
        same = (a + 2**k <= end[one]) & (b + 2**k <= end[two]) & (text[one] == text[two])
        same[same] = names[k][a[same]] == names[k][b[same]]
        common[1:][same] += 2**k
    start, period = branching_repeats(leaves, place, common, (end - begin) // TIMES)
    stop = start + 2 * period
    for k in range(len(names) - 1, -1, -1):
        a = start - 2**k
        same = a >= begin[start]
        same[same] = names[k][a[same]] == names[k][a[same] + period[same]]
        start = np.where(same, a, start)
    long = stop - start >= np.maximum(LEAST, TIMES * period)
    start, stop, period = start[long], stop[long], period[long]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    shortest = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(start)]
    start, stop, period = start[shortest], stop[shortest], period[shortest]
    by = np.lexsort((period, start))
    return start[by], stop[by], period[by]


def _collapsed(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts' kept words, joined by one space."""
    first, last, of = starts[kept], ends[kept], text[kept]
    # the byte behind a word that has a successor is white space
    more = np.append(of[1:] == of[:-1], False)[: len(of)]
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[first] += 1
    np.subtract.at(edge, last + more, 1)
    mask = np.cumsum(edge[: len(raw)], dtype=np.int8) > 0
    return np.where(_SPACE[raw], np.uint8(0x20), raw)[mask], np.append(0, np.cumsum(mask))[offsets]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def runs_of_texts(texts: pa.Array) -> pa.Array:
    """Struct(n_words, runs, collapsed) per text, all texts in one suffix tree; a null text has no words."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends, text, ids = split_words(raw, offsets)
    words = np.searchsorted(text, np.arange(len(texts) + 1))
    start, stop, period = maximal_runs(ids, text)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, stop, -1)
    kept = np.cumsum(edge[:-1]) == 0
    data, cuts = _collapsed(raw, offsets, starts, ends, text, kept)
    of = text[start]
    runs = pa.StructArray.from_arrays([pa.array(start - words[of]), pa.array(stop - start), pa.array(period)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), runs)
    joined = pa.StringArray.from_buffers(len(texts), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
    return pa.StructArray.from_arrays([pa.array(np.diff(words)), lists, joined], fields=list(FOUND))


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of about ``STEP_BYTES`` of whole texts, each with a suffix tree of its own."""
    for batch in batches:
        texts = batch["text"].cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)[1:]
        cuts = [0, *(np.flatnonzero(np.diff((ends - ends[:1]) // STEP_BYTES)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield pa.RecordBatch.from_arrays([batch["id"][a:b], *runs_of_texts(texts[a:b]).flatten()], ["id", "n_words", "runs", "collapsed"])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed``, one row per input row.

    ``runs`` are all maximal stretches of ``LEAST`` words or more whose smallest period occurs ``TIMES`` times or more, by start and then
    period; ``collapsed`` is the text without the words behind a run's first period, joined by one space. Null and empty texts have no
    words, no runs and an empty ``collapsed``; repeated rows and null ids are treated alike; an empty table gives an empty
    result; other columns are ignored, whatever their names. A text is treated whole in one step, which takes some
    100 + 4 log2(longest repeat) bytes a word.
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = next(f.dataType.simpleString() for f in texts.schema if f.name == "id")
    return texts.mapInArrow(_with_runs, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, or for one id in ten its words with a periodic end: the contract of ``op12_periodic_runs``. A null id has none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_GAP}|{WORD_GAP}$", "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        tail = F.transform(F.sequence(a, (n - 1).cast("bigint")), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    # the words are bound by a lambda, so that they are made once a text
    planted = F.get(F.transform(F.array(F.split(inner, WORD_GAP)), repeated), F.lit(0))
    return F.when((h % 10 == 0) & (inner != ""), planted).otherwise(F.coalesce(text, F.lit("")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one id in ten with a planted periodic end; the digests are made from the operator's runs and texts.

    A null id has no planted end; texts that are null or without words have no run and the digests of empty strings.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs)
    # runs are sorted, so that of equal exponents the first one stays
    most = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), most.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    milli = F.floor(F.expr("best.length * 1000 div best.period")).cast("bigint")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
