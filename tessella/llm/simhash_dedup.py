"""SimHash near-duplicates by pivot distance tables (operator 10).

``similar_groups`` links texts whose 5-word shingles have a similarity of 0.8 or more (the pipeline's stage):

1. A text's distances to ``M`` scattered reference fingerprints make a row of a distance table; there are ``TABLES`` of
   them. Distances weigh each bit by how clear its majority is (see ``nearest_references``). The ``NEAREST`` references
   of each table are kept, and every two of them are a join key: similar texts have nearly the same distances, so that
   they share two of their nearest references in some table.
2. Texts of keys with over ``STARRED`` texts are first compared with a few drawn ones; of what that has joined no two are paired up again, so that a
   group of similar texts costs a few pairs a text.
   Pairs of a key are discarded if a coordinate of their rows of distances to the first references of ``PIVOTS`` differs by over ``NEAR_BITS`` (then
   the fingerprints do, too), if the fingerprints differ in over ``NEAR_BITS`` bits, then if their numbers of shingles (``sizes_allow``) or the
   parities of these (``marks_allow``) rule the similarity out, which loses no similar pair. Keys with over ``STARRED`` texts, where groups of
   half-similar texts would make most pairs, have the parities at hand when they pair up; others look at them afterwards.
3. The survivors are verified by the exact similarity of their shingles.
4. Keys with over ``CROWDED`` texts aren't paired up. Their texts are compared with a few drawn ones, which joins large groups of
   similar texts in linear work; what that leaves apart is joined exactly by shingles (``unlike_parts``), so that no link within such
   a key is lost.

``near_groups`` links fingerprints within ``radius`` bits, all of them. Plain distances to scattered references gather
around 32 (sigma 4), so one reference's test ``|d(x,p) - d(y,p)| <= 4`` passes over half of all pairs: a complete join
can't use them as keys. Its candidates therefore agree in enough bit blocks (pigeonhole: of ``blocks`` blocks,
``blocks - radius`` agree; every choice of so many blocks is a key). Candidates whose table of ``PIVOTS`` distances shows a
coordinate difference over the radius are discarded, survivors are verified by the exact Hamming distance. Blocks are
chosen so that a key has at least log2(distinct fingerprints) bits; more fingerprints take more, finer keys. A bucket with
over ``DENSE`` distinct fingerprints isn't paired up: its members go through ``ball_links``, linear in their number and exact.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.simhash_kernel import bit_counts, distinct_hashes, fingerprints, majority, margins, nearest_references, parities, reference_fingerprints, shingle_hashes, shingle_sets, sliced
from tessella.llm.tables import fresh, table
from tessella.operators.components import connected_components
from tessella.plans.storage import anchored, release, row_id, stage

RADIUS = 4
WIDTH = 4
DENSE = 1024
#: Reference fingerprints of the distance tables, scattered by an odd multiplier; seven distances fill one long.
PIVOTS = [(k * 0x9E3779B97F4A7C15 ^ k * k * 0xC2B2AE3D27D4EB4F) % 2**64 for k in range(1, 71)]
SIMILARITY = 0.8
SIMILAR_WIDTH = 5
TABLES = 4
NEAREST = 5
NEAR_BITS = 20
CROWDED = 64
STARRED = 8
HUBS = 2
HUB_KEYS = 3
EARLIER = 32
MARKS = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_udf(width: int = WIDTH):
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        parts = [pa.array(fingerprints(part, width).view("int64")) for part in sliced(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())

    return simhash


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """Fewest blocks whose keys have log2(distinct) bits at least (radius + 2 to radius + 5 blocks)."""
    for blocks in range(radius + 2, radius + 5):
        if 64 * (blocks - radius) // blocks >= log2(max(distinct, 2)):
            return blocks
    return radius + 5


def block_masks(blocks: int) -> list[int]:
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]


def pivot_distances(fp: Column, seven: list[int]) -> Column:
    """Distances to seven references, a byte each, in a long."""
    parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("bigint"), 8 * i) for i, p in enumerate(seven)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def pivot_table(fp: Column) -> Column:
    """Distances to the references, a byte each, in an array of longs."""
    return F.array(*[pivot_distances(fp, PIVOTS[i : i + 7]) for i in range(0, len(PIVOTS), 7)])


def seven_within(a: Column, b: Column, radius: int) -> Column:
    """Whether no coordinate of two ``pivot_distances`` differs by more than ``radius``: true for all pairs within it.

    Seven bytes at a time: with the high bit set, a byte of a - b + radius keeps it if the difference is -radius or more.
    """
    high, add = sum(0x80 << 8 * i for i in range(7)), sum(radius << 8 * i for i in range(7))
    return ((a + high - b + add).bitwiseAND(b + high - a + add).bitwiseAND(F.lit(high))) == high


def within(a: Column, b: Column, radius: int) -> Column:
    """``seven_within`` for all of two distance tables."""
    return reduce(lambda x, y: x & y, [seven_within(a[i], b[i], radius) for i in range(-(-len(PIVOTS) // 7))])


def links(distinct: DataFrame, count: int, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints (column ``fp``): all pairs within the radius are connected by them."""
    blocks = blocks_for(count, radius)
    masks = block_masks(blocks)
    keys = list(combinations(range(blocks), blocks - radius))
    assert len(keys) == comb(blocks, radius)
    mask_of = [_signed(sum(masks[b] for b in key)) for key in keys]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in mask_of])).alias("k", "mask"))
    keyed = keyed.select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    crowded = keyed.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
    crowded = stage(crowded.select("k", "key", "n"), "buckets")
    keyed = stage(keyed.join(crowded, ["k", "key"]), "keyed")
    sparse = keyed.where(F.col("n") <= dense).drop("n").withColumn("far", pivot_table(F.col("fp")))
    a, b = sparse.alias("a"), sparse.alias("b")
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    near &= within(F.col("a.far"), F.col("b.far"), radius)
    near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = a.join(b, near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct()
    heavy = keyed.where(F.col("n") > dense).select("fp").distinct()
    return pairs.union(ball_links(heavy, radius))


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links for crowded buckets, complete for connectivity and only between fingerprints within the radius.

    Two fingerprints within r bits have a common neighbour within r // 2 bits of one and r - r // 2 of the other. Of all
    fingerprints around a neighbour, those within r // 2 are its inner ones; any other is within r of an inner one, so that
    all link to the least inner one. Rows: C(64, <= r - r // 2) per fingerprint.
    """
    inner, outer = radius // 2, radius - radius // 2
    around = fps.select("fp", F.col("fp").alias("mid"), F.lit(64).alias("last"), F.lit(0).alias("n"))
    for _ in range(outer):  # one more bit below the last one, or none (-1) from here on
        around = around.withColumn("bit", F.explode(F.sequence(F.lit(-1), F.col("last") - 1)))
        turned = F.expr("CASE WHEN bit < 0 THEN mid ELSE mid ^ shiftleft(1L, bit) END")
        around = around.select("fp", turned.alias("mid"), F.greatest("bit", F.lit(0)).alias("last"), (F.col("n") + F.when(F.col("bit") < 0, 0).otherwise(1)).alias("n"))
    around = around.select("fp", "mid", (F.col("n") <= inner).alias("inner"))
    least = around.groupBy("mid").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("low"), F.count("*").alias("n")).where("n > 1 AND low IS NOT NULL")
    return around.join(least, "mid").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst")).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """One row per input row: ``rid, id, fp, component_id``; component_id is the smallest id reachable over links.

    A null or wordless text has fingerprint zero and links like any other. A null id never names a component unless
    all ids of the component are null (then null). Repeated rows share fingerprint and component. Equal fingerprints
    are collapsed first, so exact copies cost one row however many there are. An empty table gives an empty result.
    """
    rows = df.select(row_id(df).alias("rid"), F.col(id_col).alias("id"), fingerprint_udf(width)(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))
    rows = stage(rows, "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    found = connected_components(links(distinct, distinct.count(), radius, dense)).withColumnRenamed("node", "fp")
    joined = stage(distinct.join(found, "fp"), "linked")
    named = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = joined.join(named, "component").select("fp", "component_id")
    of_fp = distinct.join(linked, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(of_fp, "fp").select("rid", "id", "fp", "component_id")


def signature_udf(width: int, references: int, tables: int, nearest: int, longs: int = MARKS):
    """text -> struct(fp, n, marks, keys): n distinct shingles and their ``parities``; two of the nearest references of a table are a key; a text
    without words has none."""

    @F.arrow_udf("fp bigint, n int, marks array<bigint>, keys array<bigint>")
    def signature(texts: pa.Array) -> pa.Array:
        fps, counts, marks, keys, sizes = [], [], [], [], []
        for part in sliced(texts):
            hashes, shingles = shingle_hashes(part, width)
            ones = bit_counts(hashes, shingles)
            clear = margins(ones, shingles)
            fps.append(majority(ones, shingles).view("int64"))
            sets = distinct_hashes(hashes, shingles)
            counts.append(np.array([len(x) for x in sets], np.int32))
            marks.append(parities(np.concatenate(sets), counts[-1], longs))
            own = []
            for t in range(tables):
                near = nearest_references(clear, reference_fingerprints(references, t), nearest).astype(np.int64)
                own += [(t * references + near[:, i]) * references + near[:, j] for i, j in combinations(range(nearest), 2)]
            keys.append(np.stack(own, axis=1)[shingles > 0].ravel())
            sizes.append((shingles > 0) * len(own))
        joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0, kind))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)), joined(keys, np.int64))
        fixed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * longs), joined([m.ravel() for m in marks], np.int64))
        return pa.StructArray.from_arrays([joined(fps, np.int64), joined(counts, np.int32), fixed, lists], ["fp", "n", "marks", "keys"])

    return signature


def shingles_udf(width: int):
    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        sets = [x.view("int64") for part in sliced(texts) for x in shingle_sets(part, width)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))

    return shingles


def marks_udf(longs: int = MARKS):
    """Parities of a set's hashes by their last bits: two sets differ in at least as many members as their parities in bits."""

    @F.arrow_udf("array<bigint>")
    def marks(sets: pa.Array) -> pa.Array:
        found = parities(sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy()), longs)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * longs), pa.array(found.ravel()))

    return marks


def sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of so many members can have the similarity: the smaller one has that share of the larger one."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def marks_allow(a: str, b: str, similarity: float) -> Column:
    """Whether sets with these columns ``n`` and ``marks`` can have the similarity: then so many of their members are in one of them only."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.marks")[i].bitwiseXOR(F.col(f"{b}.marks")[i])) for i in range(MARKS)])
    return differ <= (1 - similarity) / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-6


def references_for(rows: int) -> int:
    """In proportion to the square root of the rows, without steps, so that the number of texts that share a key by chance is the same at any size."""
    return max(64, ceil(sqrt(16 * max(rows, 1))))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst`` of the pairs with at least this shingle similarity; ``sets``: doc, own (distinct shingle hashes)."""
    joined = pairs.join(sets.select(F.col("doc").alias("src"), F.col("own").alias("a")), "src").join(sets.select(F.col("doc").alias("dst"), F.col("own").alias("b")), "dst")
    joined = joined.select("src", "dst", (F.size("a") + F.size("b")).alias("all"), F.size(F.array_intersect("a", "b")).alias("both"))
    return stage(joined.where(F.col("both") >= similarity * (F.col("all") - F.col("both"))).select("src", "dst"), "links")


def _verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``src, dst`` of the pairs that pass the marks and the exact similarity; ``docs``: doc, rid, n, marks; ``texts``: rid, text."""
    pairs, marks = stage(pairs.distinct(), "candidates"), docs.select("doc", "n", "marks")
    pairs = pairs.join(marks.alias("a"), F.col("src") == F.col("a.doc")).join(marks.alias("b"), (F.col("dst") == F.col("b.doc")) & marks_allow("a", "b", similarity))
    pairs = stage(pairs.select("src", "dst"), "candidates")
    needed = docs.join(pairs.select(F.col("src").alias("doc")).union(pairs.select("dst")).distinct(), "doc").select("doc", "rid")
    sets = stage(texts.join(stage(needed, "needed"), "rid").select("doc", shingles_udf(width)("text").alias("own")), "shingles")
    return _similar(pairs, sets, similarity)


def unlike_parts(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidates ``src, dst`` from different parts, with every pair of that similarity among them; ``sets``: doc, part, own.

    A prefix join. Only shingles that two parts have can join them. Of a text of n shingles a similar one has 0.8 n, so that a text with
    fewer of those joins nothing, and two similar texts meet in one of their first 0.2 n + 1 shingles, in any order that is the same
    for all texts: here those that no other part has come first, then the rarest. Behind the first shingle in which two texts meet
    each must have enough left to come to the similarity.
    """
    each = sets.select("doc", "part", F.size("own").alias("n"), F.explode("own").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("rows"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("s", "rows")
    own = each.join(stage(shared, "shared"), "s").groupBy("doc", "part", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "s"))).alias("shared"))
    need = F.ceil(similarity * F.col("n") - 1e-6)
    own = own.where(F.size("shared") >= need).select("doc", "part", "n", F.size("shared").alias("left"), F.slice("shared", F.lit(1), F.greatest(F.size("shared") - need + 1, F.lit(0)).cast("int")).alias("prefix"))
    own = own.select("doc", "part", "n", "left", "prefix", F.posexplode(F.col("prefix")["s"]).alias("at", "s"))
    earlier = F.slice(F.col("prefix")["s"], F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least("at", F.lit(EARLIER))).alias("earlier")
    own = own.select("doc", "part", "n", (F.col("left") - F.col("at")).alias("left"), "s", earlier)
    own = stage(own.join(sets.select("doc", marks_udf()("own").alias("marks")), "doc"), "prefixes")
    both = similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6
    enough = (F.least("a.left", "b.left") >= both) & marks_allow("a", "b", similarity)
    found = own.alias("a").join(own.alias("b"), (F.col("a.s") == F.col("b.s")) & F.expr("a.doc < b.doc AND a.part <> b.part") & enough & ~F.arrays_overlap("a.earlier", "b.earlier"))
    return found.select(F.col("a.doc").alias("src"), F.col("b.doc").alias("dst")).distinct()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, tables: int = TABLES,
                   nearest: int = NEAREST, near_bits: int = NEAR_BITS, crowded: int = CROWDED) -> DataFrame:
    """One row per row of an ``anchored`` table: ``rid, id, doc, component``; doc is one per distinct text, component the
    least doc reachable over links, null for texts without links.

    Links are verified exactly; which texts share a key is a matter of chance (README has the recall). Each text is compared with ``HUBS``
    drawn ones of its ``HUB_KEYS`` largest keys; keys with up to ``crowded`` texts then pair up what that leaves apart. Within a key with
    more all similar ones end in one group, as ``unlike_parts`` finds what is apart. Groups are the same whatever the rows' order,
    their partitions and the hubs. Null and
    wordless texts link to none but their equals. Repeated rows share doc and component; null ids are rows like any
    other; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sign = signature_udf(width, references_for(df.count()), tables, nearest)
    rows = df.select(row_id(df).alias("rid"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), sign(text).alias("s"))
    signed = stage(rows.select("rid", "id", "digest", "s.*"), "signatures")
    # one text of each sort of equal ones; its number is fixed by being written
    firsts = signed.groupBy("digest").agg(F.min("rid").alias("rid")).select("rid")
    docs = stage(signed.join(firsts, "rid").select("digest", "rid", F.monotonically_increasing_id().alias("doc"), "fp", "n", "marks", "keys"), "distinct-texts")
    rows = stage(signed.select("rid", "id", "digest"), "rows")
    release(signed)
    keyed = docs.select("doc", "fp", F.col("n").alias("size"), F.explode("keys").alias("key"))
    large = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > min(STARRED, crowded)), "large-keys")
    few = keyed.join(large, "key", "left_anti")
    # one row per text with large keys, those with most texts first
    held = keyed.join(large, "key").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("large"))
    some, full = F.filter("large", lambda k: k["n"] <= crowded)["key"], F.filter("large", lambda k: k["n"] > crowded)["key"]
    held = held.select("doc", F.col("large")["key"].alias("large"), some.alias("some"), full.alias("full"))
    held = stage(held.join(docs.select("doc", "fp", "n", "marks", F.xxhash64("digest").alias("draw")), "doc"), "held")
    many = held.where(F.size("full") > 0)
    texts = df.select(row_id(df).alias("rid"), text.alias("text"))

    def pairs(a: DataFrame, b: DataFrame, which: Column) -> DataFrame:
        """Pairs of rows (key, doc, fp, n) of ``a`` and ``b`` within ``near_bits`` whose sizes allow the similarity, the smaller doc first."""
        near = seven_within(pivot_distances(F.col("a.fp"), PIVOTS[:7]), pivot_distances(F.col("b.fp"), PIVOTS[:7]), near_bits)
        near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= near_bits
        near &= sizes_allow(F.col("a.n"), F.col("b.n"), similarity)
        found = a.alias("a").join(b.alias("b"), (F.col("a.key") == F.col("b.key")) & near & which)
        return found.select(F.least("a.doc", "b.doc").alias("src"), F.greatest("a.doc", "b.doc").alias("dst"))

    def parted(rows: DataFrame, *columns: str | Column) -> DataFrame:
        return rows.join(starred, rows["doc"] == starred["node"], "left").select(*columns, F.coalesce("component", "doc").alias("part"))

    in_largest = held.select("doc", "fp", "n", "draw", F.explode(F.slice("large", 1, HUB_KEYS)).alias("key"))
    hubs = in_largest.groupBy("key").agg(F.array(*[F.min_by(F.struct("doc", "fp", "n"), F.xxhash64("draw", F.lit(i))) for i in range(HUBS)]).alias("hubs"))
    hubs = hubs.select("key", F.explode(F.array_distinct("hubs")).alias("h")).select("key", "h.*")
    links = _verified(pairs(in_largest, hubs, F.expr("a.doc <> b.doc")), docs, texts, width, similarity)
    starred = stage(connected_components(links), "linked")
    few = parted(few, "doc", "fp", F.col("size").alias("n"), "key")
    some = parted(held.select("doc", "fp", "n", "marks", F.explode("some").alias("key")), "doc", "fp", "n", "marks", "key")
    apart = F.expr("a.doc < b.doc AND a.part <> b.part")
    links = links.union(_verified(pairs(few, few, apart).union(pairs(some, some, apart & marks_allow("a", "b", similarity))), docs, texts, width, similarity))
    found = stage(connected_components(links), "linked")

    # keys whose texts aren't all connected; pairs of other keys are left out, so that the groups don't depend on which keys these are
    parts = many.join(found, many["doc"] == found["node"], "left").select("doc", "full", F.coalesce("component", "doc").alias("part"))
    in_keys = parts.select("doc", "part", F.explode("full").alias("key"))
    open_keys = in_keys.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    opened = stage(in_keys.join(open_keys, "key", "left_semi").select("doc", "part").distinct().join(docs.select("doc", "rid"), "doc"), "open")
    sets = stage(texts.join(opened, "rid").select("doc", "part", shingles_udf(width)("text").alias("own")), "shingles")
    left = stage(unlike_parts(sets, similarity), "candidates")
    left = left.join(many.select(F.col("doc").alias("src"), F.col("full").alias("a")), "src").join(many.select(F.col("doc").alias("dst"), F.col("full").alias("b")), "dst")
    links = links.union(_similar(left.where(F.arrays_overlap("a", "b")).select("src", "dst"), sets, similarity))
    found = connected_components(links)
    of_text = docs.join(found, F.col("doc") == F.col("node"), "left").select("digest", "doc", "component")
    return rows.select("rid", "id", "digest").join(of_text, "digest").select("rid", "id", "doc", "component")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts stays: that with the smallest id (null ids last; of repeated ids, one).

    Rows without words are kept: they say nothing about being copies of each other. All columns; an empty table gives an
    empty result; very long texts are compared whole; names of other columns don't matter. Only ids of dropped rows are joined.
    """
    df, rid = anchored(df), fresh(df, "_rid")
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = similar_groups(df.where(has_words), id_col, text_col, width, similarity).withColumn("own", F.coalesce("component", "doc"))
    found = stage(found.select("rid", "id", "own"), "groups")
    first = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    kept = found.groupBy("own").agg(F.min(first).alias("best")).select(F.col("best.rid").alias("rid"))
    dropped = stage(found.join(kept, "rid", "left_anti").select(F.col("rid").alias(rid)), "dropped")
    return df.withColumn(rid, row_id(df)).join(dropped, rid, "left_anti").select(*df.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint and the smallest id among those that links within 4 bits reach."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
