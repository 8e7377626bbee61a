import gzip
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import brute

from tessella.llm import exact_dedup, language_id, licenses, mixing, packing, secrets, simhash_dedup, simhash_kernel, tiff, url_rules, warc
from tessella.plans.storage import anchored

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "a word " * 60_000 + "end"


def clash(df, **more):
    """``df`` with further columns, named like those that operators use inside."""
    names = dict.fromkeys(("rid", "digest", "kept", "fp", "key", "id", "size", "spans", "media", "bin", "w", "hits", "row", "file"), 1)
    return df.withColumns({c: F.lit(v) for c, v in (names | more).items()})


def docs(spark, rows):
    """Rows (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


EDGE = [(1, None), (2, ""), (None, "same text"), (3, "same text"), (3, "same text"), (None, None), (4, LONG), (5, LONG), (6, " \t\n"), (7, "\x00 odd \ufffe \U0001f600")]


# -- 6 ---------------------------------------------------------------------------------------------------------------
def plain_exact(rows):
    groups = defaultdict(list)
    for i, (ident, text) in enumerate(rows):
        groups[text or ""].append((ident is not None, ident or 0, i))
    out = []
    for text, members in groups.items():
        best = max(members)
        for known, ident, i in members:
            out.append((ident if known else None, best[1] if best[0] else None, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_groups(spark, counters):
    rows = EDGE + [(100 + i, "hot") for i in range(40)]
    got = exact_dedup.exact_groups(docs(spark, rows).transform(clash), counters=counters).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got], key=repr) == plain_exact(rows)
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    left = exact_dedup.drop_exact_copies(docs(spark, rows).transform(clash))
    assert left.count() == len(kept) and left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_misra_gries_bound(values, counters):
    digests = [bytes([v]) for v in values]
    batches = [pa.RecordBatch.from_arrays([pa.array(digests[i : i + 17], pa.binary())], ["digest"]) for i in range(0, len(digests), 17)]
    (out,) = exact_dedup.misra_gries(iter(batches), counters)
    found = dict(zip(out["digest"].to_pylist(), out["n"].to_pylist(), strict=True))
    true = Counter(digests)
    assert len(found) <= counters and all(n <= true[d] for d, n in found.items())
    assert all(found.get(d, 0) >= n - len(values) / (counters + 1) for d, n in true.items())


# -- 10 --------------------------------------------------------------------------------------------------------------
TEXT = st.text(alphabet=st.sampled_from("abAB \t\n\x0b\x0c\r\xe9\U0001f600\x1c"), max_size=60)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=150, deadline=None)
def test_fingerprints(texts):
    got = simhash_kernel.fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [brute.fingerprint(t) for t in texts]


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 977}" for i in range(5000))
    assert simhash_kernel.fingerprints(pa.array(["x", text, None, text]))[1:].tolist() == [brute.fingerprint(text), 0, brute.fingerprint(text)]


def near_rows():
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 150)) for _ in range(12)]
    rows = list(EDGE)
    for i in range(160):
        w = base[i % 12].split()
        for at in rng.integers(0, len(w), i % 4):
            w[at] = f"n{i}"
        rows.append((1000 - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("dense", [1024, 2])
def test_near_groups(spark, dense):
    rows = near_rows()
    got = simhash_dedup.near_groups(docs(spark, rows).transform(clash), dense=dense)
    got = [(r.id, f"{r.fp % 2**64:016x}", r.component_id) for r in got.collect()]
    want = brute.near_components(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({c for *_, c in want}) < len(rows) / 2
    assert simhash_dedup.near_groups(docs(spark, [])).count() == 0


def changed(rng, text, share):
    """``text`` with about ``share`` of its words replaced."""
    return " ".join(f"new{rng.integers(10**9)}" if rng.random() < share else w for w in text.split())


def similar_rows():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{rng.integers(10**6)}" for _ in range(n)) for n in (3, 30, 80, 200, 700)]
    rows = [(10 * k + 1000, changed(rng, t, 0.02)) for t in texts for k in range(3)]
    rows = [(i + 7 * n, t) for n, (i, t) in enumerate(rows)] + [(n + 1, t) for n, t in enumerate(texts)]
    # many copies of one text that differ from it in a word or more, and from each other in twice as many
    rows += [(5000 + n, changed(rng, texts[3], 0.006)) for n in range(90)] + EDGE
    return rows + [(None, texts[2].upper()), (9000, texts[2].replace(" ", " \n"))]


def test_a_group_of_similar_texts_costs_a_few_pairs_a_text(spark, monkeypatch):
    """Sixty texts with keys below the crowded ones: compared with drawn ones, not all with each other."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for k in range(60)]
    counts, verified = [], simhash_dedup._verified

    def counted(pairs, *rest):
        counts.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash_dedup, "_verified", counted)
    got = simhash_dedup.similar_groups(anchored(docs(spark, rows)))
    assert got.count() == 60 and got.select("component").distinct().count() == 1
    assert sum(counts) <= 60 * simhash_dedup.HUBS * simhash_dedup.HUB_KEYS


def test_a_group_of_half_similar_texts_costs_few_pairs(spark, monkeypatch):
    """Sixty texts of one, each with other words replaced: they share keys, but hardly two have a similarity of 0.8, and most of the 1,770 pairs go in the join."""
    rng = np.random.default_rng(21)
    base = " ".join(f"w{n}" for n in range(300))
    rows = [(n, changed(rng, base, 0.03)) for n in range(60)]
    counts, verified = [], simhash_dedup._verified

    def counted(pairs, *rest):
        counts.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash_dedup, "_verified", counted)
    got = simhash_dedup.similar_groups(anchored(docs(spark, rows)))
    assert got.count() == 60 and got.select(F.coalesce("component", "doc")).distinct().count() > 30
    assert sum(counts) < 60 * 59 / 4


def test_references_keep_the_texts_a_key_the_same_at_any_size():
    """Rows over squared references, by the tables' sizes: no size has more texts a key than another."""
    crowd = [n / simhash_dedup.references_for(n) ** 2 for n in (10_000, 47_257, 65_536, 236_076, 10**6, 14 * 10**6)]
    assert max(crowd) < 1.05 * min(crowd)


def test_sizes_and_marks_discard_no_similar_pair(spark):
    """Sets of 1 to 3,000 members and changed copies, some at exactly 0.8: against the similarity itself."""
    rng, sim = np.random.default_rng(22), 0.8
    pairs = [(list(range(9, 9 + n)), list(range(9 + k, 9 + n + k))) for n, k in ((9, 1), (18, 2), (900, 100), (9, 2), (4, 1))]
    for size in (1, 2, 5, 10, 50, 300, 3000):
        for share in (0, 0.04, 0.09, 0.11, 0.13, 0.3, 1):
            a = rng.integers(-(2**63), 2**63, size)
            b = np.where(rng.random(size) < share, rng.integers(-(2**63), 2**63, size), a)
            pairs += [(a.tolist(), b.tolist()), (a.tolist(), a[: max(1, int(size * (1 - share)))].tolist())]
    side = lambda k: spark.createDataFrame([(n, p[k]) for n, p in enumerate(pairs)], "i bigint, own array<bigint>").select("i", F.size("own").alias("n"), simhash_dedup.marks_udf()("own").alias("marks"))
    found = side(0).alias("a").join(side(1).alias("b"), F.col("a.i") == F.col("b.i"))
    found = found.where(simhash_dedup.sizes_allow(F.col("a.n"), F.col("b.n"), sim) & simhash_dedup.marks_allow("a", "b", sim))
    kept = {r.i for r in found.select(F.col("a.i").alias("i")).collect()}
    like = [len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in pairs]
    assert {i for i, x in enumerate(like) if x >= sim} <= kept and like[:3] == [0.8] * 3
    assert not [i for i in kept if like[i] < 0.5]


def test_similar_texts_with_unlike_repeated_lines_are_linked(spark):
    """Repeated lines weigh in the fingerprints, not in the similarity: no bound on the fingerprints' margins may part such texts."""
    rows = []
    for n in range(12):
        base = " ".join(f"w{n}x{i}" for i in range(200))
        rows += [(10 * n + j, base + (" " + " ".join(f"{k}{n}y{i}" for i in range(5))) * 4) for j, k in enumerate("ab")]
    got = simhash_dedup.similar_groups(anchored(docs(spark, rows))).where("component IS NOT NULL").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert brute.kept_of_similar(rows) == list(range(0, 24, 2))
    assert sorted(r.ids for r in got.collect()) == [[10 * n, 10 * n + 1] for n in range(12)]

def test_pivot_distances_discard_no_pair_within_the_bits(spark):
    near = simhash_dedup.NEAR_BITS
    r = random.Random(5)
    rows = [(a, a ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 63)))) for a in (r.getrandbits(63) for _ in range(500))]
    a, b = (simhash_dedup.pivot_distances(F.col(c), simhash_dedup.PIVOTS[:7]) for c in "ab")
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", simhash_dedup.seven_within(a, b, near).alias("kept")).collect()
    far = [max(abs((x.a ^ p).bit_count() - (x.b ^ p).bit_count()) for p in [(p - (1 << 64) if p >> 63 else p) & (2**64 - 1) for p in simhash_dedup.PIVOTS[:7]]) for x in got]
    assert [x.kept for x in got] == [f <= near for f in far] and not all(x.kept for x in got)
    assert all(x.kept for x in got if (x.a ^ x.b).bit_count() <= near)


@pytest.mark.parametrize("crowded", [64, 12])
def test_drop_near_copies(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash_dedup.similar_groups, "__defaults__", (*simhash_dedup.similar_groups.__defaults__[:-1], crowded))
    rows = similar_rows()
    left = simhash_dedup.drop_near_copies(docs(spark, rows).transform(clash))
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [rows[i] for i in brute.kept_of_similar(rows)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr) and len(want) < len(rows) / 3
    assert simhash_dedup.drop_near_copies(docs(spark, [])).count() == 0


def test_similar_groups_of_crowded_keys_do_not_depend_on_the_partitions(spark):
    """Copies of 200 words, about three of them replaced: some are similar and some are not, so that it matters which are drawn as hubs."""
    rng = np.random.default_rng(12)
    text = " ".join(f"w{rng.integers(10**6)}" for _ in range(200))
    rows = [(n, changed(rng, text, 0.015)) for n in range(150)]
    found = []
    for order in range(2):
        df = docs(spark, [rows[i] for i in rng.permutation(len(rows))]).repartition(2 + 3 * order)
        got = simhash_dedup.similar_groups(anchored(df), crowded=4).where("component IS NOT NULL")
        found.append(sorted(tuple(sorted(r.ids)) for r in got.groupBy("component").agg(F.collect_list("id").alias("ids")).collect()))
    assert found[0] and found[1] == found[0]


def test_unlike_parts_has_every_similar_pair(spark):
    """Sets around a few centres, of 1 to 900 members, in parts of one or many: against all pairs by brute force."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 5, 9, 40, 41, 150, 900):
        centre = rng.integers(-(2**63), 2**63, size)
        for _ in range(30):
            own = np.where(rng.random(size) < rng.choice([0, 0.03, 0.06, 0.12, 0.2]), rng.integers(-(2**63), 2**63, size), centre)
            sets.append(set(own[rng.random(size) > 0.02].tolist()) or {1})
    part = [int(p) for p in rng.integers(0, 100, len(sets))]
    df = spark.createDataFrame(list(zip(range(len(sets)), part, map(sorted, sets), strict=True)), "doc bigint, part bigint, own array<bigint>")
    got = {(r.src, r.dst) for r in simhash_dedup.unlike_parts(df, 0.8).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    alike = {(i, j): like(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if part[i] != part[j]}
    assert {p for p, s in alike.items() if s >= 0.8} <= got and len([p for p, s in alike.items() if s >= 0.8]) > 300
    assert len([p for p in got if alike[p] < 0.6]) < 100
    assert simhash_dedup.unlike_parts(df.limit(0), 0.8).count() == 0


def test_similar_texts_of_crowded_keys_lose_no_link(spark):
    """Two loose groups and texts like neither: with all keys crowded the groups are those of all pairs of keys."""
    rng = np.random.default_rng(13)
    bases = [" ".join(f"w{rng.integers(10**6)}" for _ in range(120)) for _ in range(2)]
    rows = [(n, changed(rng, bases[n % 2], 0.005 + 0.015 * (n % 5))) for n in range(160)]
    want, got = ({tuple(sorted(r.ids)) for r in simhash_dedup.similar_groups(anchored(docs(spark, rows)), crowded=c).where("component IS NOT NULL").groupBy("component").agg(F.collect_list("id").alias("ids")).collect()} for c in (10**6, 1))
    assert got == want and max(map(len, got)) > 20 and sum(map(len, got)) < 150


def test_distance_tables_discard_no_pair_within_the_radius(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(a) ^ sum(1 << int(b) for b in rng.choice(63, n % 12, replace=False))) for n, a in enumerate(rng.integers(-(2**63), 2**63, 400))]
    df = spark.createDataFrame(pairs + rng.integers(-(2**63), 2**63, (400, 2)).tolist(), "a bigint, b bigint")
    df = df.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"), *[F.array(*(simhash_dedup.pivot_table(F.col(c))[i] for i in range(10))).alias(c) for c in "ab"])
    for radius in (0, 4, 9):
        ok = df.withColumn("ok", simhash_dedup.within(F.col("a"), F.col("b"), radius)).groupBy((F.col("d") <= radius).alias("near")).agg(F.avg(F.col("ok").cast("int")))
        got = dict(ok.collect())
        assert got[True] == 1 and (radius > 4 or got[False] < 0.3)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_links_of_crowded_buckets(spark, radius):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 3)]
    fps = list(dict.fromkeys(x ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)) for x in base for n in (0, 1, 2, 3, 4) for _ in range(3)))
    got = {frozenset((r.src, r.dst)) for r in simhash_dedup.ball_links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), radius).collect()}
    every = {frozenset((a, b)) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= radius}
    assert got <= every

    def parts(edges):
        root = {x: x for x in fps}
        for _ in fps:
            for e in edges:
                a, b = e
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(got) == parts(every)


@pytest.mark.parametrize("count", [10, 1 << 24, 1 << 30])
def test_links_are_complete_for_any_number_of_blocks(spark, count):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 4, 5, 6, 8) for _ in range(6)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {frozenset((r.src, r.dst)) for r in simhash_dedup.links(df, count).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4}


# -- 4 ---------------------------------------------------------------------------------------------------------------
def plain_targets(sizes, weights, epochs=3):
    """Clamp and share anew until no source is above its cap."""
    capped, total = set(), sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(epochs * sizes[i] for i in capped)) / max(sum(weights[i] for i in open_), 1)
        over = {i for i in open_ if level * weights[i] > epochs * sizes[i] + 1e-9}
        if not over:
            return [epochs * sizes[i] if i in capped else level * weights[i] for i in range(len(sizes))]
        capped |= over


def plain_mix(rows):
    """How often each (id, text, source) row is taken: each source's tickets one after the other."""
    size = [len(brute.words(t)) for _, t, _ in rows]
    ticket = [hashlib.md5(f"{'' if i is None else i}:20240".encode()).hexdigest() for i, _, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    targets = dict(zip(names, plain_targets([total[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    times = [0] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        items, long = Counter(), set()
        for i in own:
            items[ticket[i]] += size[i]
            if size[i] * 256 > total[s]:
                long.add(ticket[i])
        whole = int(targets[s] // total[s]) if total[s] else 0
        extra = targets[s] - whole * total[s]
        mass = sum(items[t] for t in long)
        need, taken, took = max(extra * mass / total[s], extra - (total[s] - mass)) if total[s] else 0, 0, set()
        for t in sorted(long):
            if items[t] <= 2 * (need - taken) and taken + items[t] <= extra:
                taken += items[t]
                took.add(t)
        left = extra - taken
        for t in sorted(set(items) - long):
            if items[t] > left:
                break
            left -= items[t]
            took.add(t)
        over = [(abs(size[i] - left), ticket[i]) for i in own if ticket[i] not in took]
        if left > 0 and over and abs(items[min(over)[1]] - left) < left:
            took.add(min(over)[1])
        for i in own:
            times[i] = whole + (ticket[i] in took and size[i] > 0)
    return times


@pytest.mark.parametrize("planted", [0, 5_000])
def test_mixing_equals_the_plain_version(spark, planted):
    rows = [(i, "w " * (1 + i * 31 % 40), f"s{i % 2}") for i in range(5000)] + [(10_000 + s, "w " * planted * (s + 5), f"s{s % 3}") for s in range(9)]
    rows += [(i, "again " * 3, "s0") for i in range(0, 200, 3)]
    df = docs(spark, [(i, t, None, s) for i, t, s in rows])
    got = Counter(tuple(r) for r in mixing.mix(df).select("doc_id", "text", "source").collect())
    want = Counter()
    for r, n in zip(rows, plain_mix(rows), strict=True):
        want[r] += n
    assert got == +want
    taken = Counter()
    for r, n in got.items():
        taken[r[2]] += n * len(r[1].split())
    for r in mixing.plan_mix(df)[1].where("source < 's2'").collect():
        assert abs(taken[r.source] - r.target) < 0.001 * r.target


def test_mixing(spark):
    rows = [(i, "word " * (1 + i * 7 % 50), None, f"s{i % 5}" if i % 9 else None) for i in range(400)] + [(None, None), (1, "twice"), (1, "twice"), (900, "w " * 40_000, None, "big")]
    df = docs(spark, rows).transform(clash)
    got_rows, plan = mixing.plan_mix(df)
    plan = sorted(plan.collect(), key=lambda r: (r.source is None, r.source or ""))
    size = Counter()
    for r in rows:
        size[r[3] if len(r) > 3 else None] += len(brute.words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [r.source for r in plan] == names and [r.source_size for r in plan] == [size[s] for s in names]
    want = plain_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [r.target for r in plan] == pytest.approx(want)
    assert sum(want) == pytest.approx(sum(size.values()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken, most = Counter(), Counter()
    for r in mixed.select("doc_id", "text", "source").collect():
        taken[r.source] += len(brute.words(r.text))
        most[(r.doc_id, r.source, r.text)] += 1
    for s, target in zip(names, want, strict=True):
        largest = max(len(brute.words(r[1])) for r in rows if (r[3] if len(r) > 3 else None) == s)
        assert abs(taken[s] - target) <= max(1, largest / 2 + 1)
    given_ = Counter((r[0], r[3] if len(r) > 3 else None, r[1]) for r in rows)
    assert all(n <= 3 * given_[k] for k, n in most.items())
    assert mixing.mix(docs(spark, [])).count() == 0


def test_texts_without_words_stay_within_the_epochs(spark):
    """A source at its cap: three whole repetitions, and nothing of the extra share for texts without words."""
    rows = [(i, "w " * 10, "capped") for i in range(5)] + [(100 + i, None if i % 2 else " \n", "capped") for i in range(8)] + [(1000 + i, "w " * 50, "other") for i in range(40)]
    got = Counter(r.doc_id for r in mixing.mix(docs(spark, [(i, t, None, s) for i, t, s in rows])).collect())
    assert got == Counter({r[0]: n for r, n in zip(rows, plain_mix(rows), strict=True) if n}) and max(got.values()) == 3
    assert {got[100 + i] for i in range(8)} == {3}


def test_word_count(spark):
    texts = [None, "", " ", "a", " a b ", "a\x0bb\x0cc\r\nd", "\xa0 x\u2003y", "a\x1cb c", LONG]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [len(brute.words(t)) for t in texts]


# -- 8 ---------------------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://", "https://ORG/", "http://a.org", "http://a.org/", "http://example.org/es/1", "http://x.Example.org/en/12?q#f", "http://notexample.org/es/", "http://a.com/fr/x",
        "http://com/de/", "ftp://a.b.com?x=/de/", "a://b://c.org/x", "http://example.org.evil.net/es/", "http://\x00.org/", "http://é.example.org/es/é", "x\n://a.org/\n"]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_url_rules(spark, ranges):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://hot.example.org/es/")] * 60 + [(1000 + i, f"http://h{i % 7}.example.org/en/{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").transform(clash, host=1, part=2)
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    got = url_rules.judge_urls(df, rules, ranges=ranges).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(i, *brute.url_verdict(u)) for i, u in rows], key=repr)
    assert {r.verdict for r in url_rules.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


def test_longest_path_of_many_rules():
    level = url_rules._Level(0, "k", "h")
    paths = [f"/{'x' * (i % 7)}{i}" for i in range(20_000)] + ["/", "/x"]
    for p in paths:
        level.add(p, "block" if len(p) % 2 else "allow")
    level.add("/x", "block")
    for path in ("/xx2", "/xx23456789", "/y", "", "/x", "no"):
        assert level.longest(path) == max((p for p in paths if path.startswith(p)), key=len, default=None)
    assert len(level.lengths) < 20 and level.verdict_of["/x"] == "block"


# -- 2 ---------------------------------------------------------------------------------------------------------------
def plain_bits(train, text, order):
    """Code length of ``text`` by the definition, from dictionaries of counts."""
    counts = defaultdict(Counter)
    for t in train:
        for i, b in enumerate(t):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i]][b] += 1
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if seen[b]:
                bits -= np.log2(seen[b] / (total + kinds))
                break
            bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@given(st.lists(st.binary(max_size=30), min_size=1, max_size=4), st.lists(st.binary(max_size=30), min_size=1, max_size=4), st.lists(st.text("abc\xe9", max_size=30), max_size=4))
@settings(max_examples=100, deadline=None)
def test_code_lengths(a, b, texts):
    a, b = [bytes(x % 5 + 97 for x in t) for t in a], [bytes(x % 7 + 95 for x in t) for t in b]
    got = language_id.code_lengths(language_id.fit({"a": a, "b": b}), pa.array(texts, pa.string()))
    for text, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx([plain_bits(t, text.encode(), 3) for t in (a, b)])


def test_language_id(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(df).select("lang", "_language.*", language_id.held_out(F.col("doc_id")).alias("out")).collect()
    out = [r for r in got if r.out]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    odd = docs(spark, [*EDGE, (50, "123 !!"), (51, "the tree", "en"), (52, "the leaf", "en"), (53, "la rue", "fr")]).transform(clash)
    found = {(r.doc_id, r.text): r._language for r in language_id.identify(odd).collect()}
    assert found[(1, None)].lang_pred == found[(50, "123 !!")].lang_pred == "und" and found[(50, "123 !!")].score == 0
    assert {r.lang_pred for r in language_id.identify(docs(spark, EDGE)).select("_language.*").collect()} == {"und"}
    assert language_id.identify(docs(spark, [])).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------
PIECES = ["password", "Secret", "api_key", "APIKEY", "token", "pass", "AKIA", "akia", "=", ": ", '"', " ", "é", "\u017f", "K", "0123456789abcdef", "deadbeef", "f", "ABCDEFGH12345678", "x-y_z.", "\n", "ghp_"]


@given(st.lists(st.sampled_from(PIECES), max_size=25))
@settings(max_examples=400, deadline=None)
def test_secret_scan(parts):
    text = "".join(parts)
    data = text.encode()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in secrets._in_code_points(data, secrets.scan(data)) if k in secrets.KINDS)
    assert base == brute.secrets(text)["base"]


def test_secret_checksum(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123"
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = secrets.BASE62[r] + digits
    good = f"é ghp_{body}{digits.rjust(6, '0')} ghp_{body}000000"
    rows = [*EDGE, (70, good)]
    got = {(r.id, len(r.spans)): r.spans for r in secrets.scan_secrets(docs(spark, rows).transform(clash)).collect()}
    (span,) = got[(70, 1)]
    assert (span.kind, span.start, span.end) == ("checked", 2, 42)
    assert secrets.scan_secrets(docs(spark, [])).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------
@given(st.lists(st.integers(1, 2048), max_size=300))
def test_best_fit(sizes):
    bins, offsets, made = packing.best_fit(np.array(sizes, dtype=np.int64))
    fill = Counter()
    for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes, strict=True)):
        assert o == fill[b]
        fill[b] += s
    assert len(fill) == made and all(f <= 2048 for f in fill.values())
    assert made <= 11 / 9 * -(-sum(sizes) // 1025) + 4 if sizes else made == 0


def check_packed(rows):
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r.sequence_id].append((r.offset, r.length))
    for members in by_bin.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_bin)


def test_packing_of_texts(spark):
    files = packing.default_tokenizer()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(files["tokenizer_path"])
    texts = [*EDGE, (20, "x" * 20_000), (21, "<|endoftext|> is plain or special"), (22, "日本 été I'm  \t\n end "), (23, "one two. " * 3000)]
    got = packing.pack_documents(docs(spark, texts).transform(clash)).collect()
    want = Counter()
    for ident, text in texts:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n = len(ids)
        first = n if n <= 2048 else n % 2048 or 2048
        starts = [0, *range(first, n, 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
            want[(ident, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packed(got)
    assert packing.pack_documents(docs(spark, [])).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=30))
def test_best_fit_on_counts(counts):
    made = packing.best_fit_counts(counts, 60)
    assert all(sum(n * k for n, k in items) + free == 60 for _, items, free in made)
    assert {s: sum(bins * k for bins, items, _ in made for n, k in items if n == s) for s in counts} == counts
    whole = packing.best_fit(np.repeat([*counts], [*counts.values()]).astype(np.int64), 60)[2] if counts else 0
    assert sum(bins for bins, *_ in made) <= 1.05 * whole + 1


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=30), st.sampled_from([0, 55]))
def test_node_plan_places_each_item_once(counts, least):
    plan = packing.node_plan(1, 0, counts, 60, least)
    fill = Counter()
    for length, n in counts.items():
        own = sorted(r for r in plan if r[1] == length)
        for (_, _, first, bin_, offset, each), (_, _, stop, *_) in zip(own, own[1:], strict=False):
            for q in range(stop - first):
                fill[bin_ + q // each, offset + q % each * length] += length
        assert own[-1][3] == -1 and own[-1][2] <= n and (least or own[-1][2] == n)
    by_bin = defaultdict(list)
    for (bin_, offset), length in fill.items():
        by_bin[bin_].append((offset, length))
    for members in by_bin.values():
        ends = [o + n for o, n in sorted(members)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(members)] and least <= ends[-1] <= 60


PIECES_TYPE = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@pytest.mark.parametrize("nearly_full", [2000, 2048])
def test_packing_levels(spark, nearly_full):
    rng = np.random.default_rng(3)
    sizes = np.where(rng.random(3000) < 0.1, 2048, rng.integers(1, 2048, 3000))
    rows = [(i if i % 50 else None, 0, 0, int(s), 0) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, PIECES_TYPE).repartition(20).withColumns({"grp": F.lit(1), "q": F.lit("x"), "idx": F.lit(2), "bin": F.lit(0)})
    got = packing.pack(df, local=100, fan=3, nearly_full=nearly_full).collect()
    assert sorted(r.length for r in got) == sorted(sizes.tolist()) and sorted(r.id for r in got if r.id) == [i for i in range(3000) if i % 50]
    whole = packing.best_fit(sizes)[2]  # with all pieces in one task
    assert check_packed(got) <= 1.02 * whole
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_does_not_depend_on_the_order_of_the_table(spark):
    rng = np.random.default_rng(11)
    sizes = np.concatenate([rng.integers(100, 400, 20_000), rng.integers(1100, 1700, 12_000)]).tolist()
    made = []
    for lengths in (sorted(sizes), rng.permutation(sizes).tolist()):
        rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
        df = spark.createDataFrame(rows, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartitionByRange(16, "id")
        made.append(packing.pack(df).select("sequence_id").distinct().count())
    assert abs(made[0] - made[1]) <= 0.005 * made[1]


def test_packing_pairs_large_with_small_of_other_tasks(spark):
    large = spark.range(0, 3000, 1, 2).select("id", (1025 + F.col("id") % 75).alias("length"))
    small = spark.range(3000, 6000, 1, 2).select("id", (900 + F.col("id") % 40).alias("length"))
    df = large.union(small).selectExpr("id", "0 piece", "0L start", "length", "0L ids_crc32")
    assert check_packed(packing.pack(df, local=700, fan=2).collect()) == 3000


# -- 3 ---------------------------------------------------------------------------------------------------------------
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"0" + b"%x;ext=1\r\n" % 3 + b"abc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


@pytest.mark.parametrize("broken", [b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\n"])
def test_broken_framing(broken):
    with pytest.raises(ValueError):
        warc.unchunked(broken)


def test_warc_round_trip(spark, tmp_path):
    big = "".join(chr(0x100 + i % 700) for i in range(30_000))
    rows = [(5, "http://a/\n b", "p" * 100), (2, None, "p" * 100), (None, "u", "p" * 100), (3, "u", "p" * 99), (4, "u", "p" * 99), (6, "u", None), (7, "u", ""), (8, "é", big), (9, "u", big), (10, "u", big + "x"),
            (11, "u", "WARC/1.1\r\n\r\n" * 30), (2, "u", "p" * 100)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").transform(clash, payload=1)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, segment=1000)
    got = warc.read_archives(spark, path).collect()
    assert all(r.error is None for r in got) and len(got) == len(rows)
    responses = Counter((r.page_id, bytes(r.payload)) for r in got if r.type == "response")
    assert responses == Counter({("2", b"p" * 100): 1, ("3", b"p" * 99): 1, ("4", b"p" * 99): 1, ("6", b""): 1, ("7", b""): 1, ("8", big.encode()): 1, ("10", (big + "x").encode()): 1, ("11", b"WARC/1.1\r\n\r\n" * 30): 1})
    assert Counter((r.page_id, r.refers_to) for r in got if r.type == "revisit") == Counter({("5", "2"): 1, (None, "2"): 1, ("9", "8"): 1, ("2", "2"): 1})
    assert all(hashlib.sha256(r.payload).hexdigest() == r.digest for r in got if r.type == "response")


def test_segments():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abcdefgh", 3)
    parts = [(1, None, block[:10]), (2, None, block[10:30]), (3, len(block), block[30:])]
    assert warc.assemble(parts[::-1]) == (b"abcdefgh", None)
    assert warc.assemble([*parts, parts[1]]) == (b"abcdefgh", None)
    assert warc.assemble([parts[0], parts[2]])[1] == "segments missing"
    assert "total length" in warc.assemble([parts[0], parts[1], (3, 7, block[30:])])[1]
    assert warc.assemble(parts[:2])[1] == "no total length"


def record(block, more="", length=None):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_and_broken_archives(spark, tmp_path):
    http = "Content-Type: application/http; msgtype=response\r\n"
    files = {
        "CC-MAIN-1.warc.gz": gzip.compress(record(b"info: x\r\n", "Content-Type: application/warc-fields\r\n")) + gzip.compress(record(b"HTTP/1.1 200 OK\r\n\r\nbody", http)),
        "plain.warc": record(b"HTTP/1.1 200 OK\r\n\r\none", http) + record(b"HTTP/1.1 200 OK\r\n\r\ntwo", http + "WARC-Payload-Digest: sha256:00\r\n"),
        "cut.warc": record(b"a") + record(b"hello", length=100),
        "cut.warc.gz": gzip.compress(record(b"b") * 3)[:-9],
        "noise.warc": b"\x00" * 50,
        "chunks.warc": record(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\n3\r\n-07\r\n", http),
        "empty.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert Counter(bytes(r.payload) for r in got if not r.error) == Counter([b"info: x\r\n", b"body", b"one", b"a"])
    errors = sorted(r.error.rpartition(": ")[2] for r in got if r.error)
    assert errors == sorted(["the payload differs from its digest", "the last record is cut off", "a gzip member is cut off", "no record where one should start", "chunk size isn't a hexadecimal number"])


def test_orphan_continuations_are_errors(spark, tmp_path):
    part = lambda more: record(b"fragment", more).replace(b"WARC-Type: response", b"WARC-Type: continuation")
    origin = "WARC-Segment-Origin-ID: <gone>\r\n"
    good = record(b"HTTP/1.1 200 OK\r\n\r\nfine", "Content-Type: application/http\r\n")
    parts = [part(origin), part(origin + "WARC-Segment-Number: 1\r\n"), part(origin + "WARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 8\r\n"), part("WARC-Segment-Number: 2\r\n")]
    (tmp_path / "a.warc").write_bytes(good + b"".join(parts))
    (tmp_path / "padded.warc.gz").write_bytes(gzip.compress(good) + b"\0" * 700)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [bytes(r.payload) for r in got if not r.error] == [b"fine", b"fine"]
    assert Counter(r.error for r in got if r.error) == Counter({"a continuation without its number or origin": 3, "segments missing": 1})
    assert all(r.payload is None for r in got if r.error)


def test_sha1_digests(spark, tmp_path):
    import base64

    body = b"HTTP/1.1 200 OK\r\n\r\nbody"
    right = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    http = "Content-Type: application/http\r\nWARC-Payload-Digest: sha1:"
    (tmp_path / "a.warc").write_bytes(record(body, f"{http}{right}\r\n") + record(body, f"{http}{right[::-1]}\r\n"))
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.payload and bytes(r.payload), r.error) for r in got if not r.error) == [(b"body", None)]
    assert [r.error for r in got if r.error] == ["the payload differs from its digest"]


@given(st.binary(max_size=200), st.integers(0, 400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_damaged_archives_end(noise, cut, flips):
    made = bytearray(record(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(noise, 7)) * 2)
    for at, value in flips:
        made[at % len(made)] = value
    try:
        for _, block in warc.walk(bytes(made[: len(made) - cut])):
            warc.assemble([(None, None, block)])
    except ValueError:
        pass


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, payload int, rid int")
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


# -- 5 ---------------------------------------------------------------------------------------------------------------
@given(st.one_of(st.binary(max_size=600), st.lists(st.tuples(st.sampled_from(b"ab"), st.integers(1, 300)), max_size=12).map(lambda r: b"".join(bytes([c]) * n for c, n in r))))
@settings(deadline=None)
def test_codecs(data):
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_over_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 30_000, dtype=np.uint8).tobytes() + b"abcabc" * 5000
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(b"\x07\x07\x07\x08"), 4) == b"\x07\x07\x07\x08"


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_round_trip(compression, predictor, tiled):
    payload = np.random.default_rng(1).integers(0, 9, 576 * 300, dtype=np.uint8).tobytes()
    pages = list(tiff.pages_of(tiff.encode_tiff(payload, compression, predictor, tiled)))
    assert [(p.width, p.height) for p in pages] == [(576, 256), (576, 44)] and b"".join(p.data for p in pages) == payload


# The published PackBits example, and the LZW example of the format's specification as 9-bit codes.
PACKBITS_EXAMPLE = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
PACKBITS_PLAIN = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
LZW_CODES, LZW_PLAIN = [256, 7, 258, 8, 8, 258, 6, 6, 257], bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_published_examples():
    assert tiff.unpackbits(PACKBITS_EXAMPLE, len(PACKBITS_PLAIN)) == PACKBITS_PLAIN
    bits = "".join(f"{c:09b}" for c in LZW_CODES)
    coded = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.unlzw(coded, 9) == LZW_PLAIN and tiff.lzw(LZW_PLAIN) == coded


def tiny_tiff(fields, blocks, order="<"):
    """A file of one directory; strip or tile places and sizes are filled in for the tags 273/279 or 324/325."""
    at, body = 8, b"".join(blocks)
    places, sizes = [], [len(b) for b in blocks]
    for n in sizes:
        places.append(at)
        at += n
    fields = {t: places if v == "places" else sizes if v == "sizes" else v for t, v in fields.items()}
    extra, entries, start = b"", b"", 8 + len(body)
    for tag, values in sorted(fields.items()):
        raw = struct.pack(f"{order}{len(values)}I", *values)
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + (raw if len(raw) == 4 else struct.pack(f"{order}I", start + len(extra)))
        extra += b"" if len(raw) == 4 else raw
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", start + len(extra))
    return head + body + extra + struct.pack(f"{order}H", len(fields)) + entries + b"\0\0\0\0"


STRIPS = {256: [10], 257: [3], 262: [1], 273: "places", 277: [1], 278: [2], 279: "sizes"}


def test_bits_and_planes():
    one = tiny_tiff(STRIPS | {258: [1]}, [bytes([0b10100000, 0b01000000, 0, 0]), bytes([255, 255])])
    (page,) = tiff.pages_of(one)
    assert (page.bits, page.data) == (1, bytes([1, 0, 1, 0, 0, 0, 0, 0, 0, 1]) + bytes(10) + b"\1" * 10)
    turned = tiny_tiff(STRIPS | {258: [1], 266: [2]}, [bytes([0b00000101, 0b00000010, 0, 0]), bytes([255, 255])], ">")
    assert next(tiff.pages_of(turned)).data == page.data
    four = tiny_tiff(STRIPS | {256: [3], 257: [1], 278: [1], 258: [4]}, [bytes([0x1F, 0x20])])
    assert next(tiff.pages_of(four)).data == bytes([1, 15, 2])
    planar = tiny_tiff(STRIPS | {256: [2], 257: [2], 278: [2], 258: [8, 8], 277: [2], 284: [2]}, [b"abcd", b"ABCD"])
    assert next(tiff.pages_of(planar)).data == b"aAbBcCdD"


@pytest.mark.parametrize("fields", [{256: [400_000], 257: [400_000]}, {278: [0]}, {278: [1]}, {256: [0]}, {258: [8, 16]}, {259: [3]}, {259: [5]}, {317: [9]}, {273: [8], 279: [1]}, {279: [5, 99]}])
def test_broken_tiff(fields):
    made = tiny_tiff(STRIPS | {258: [8]} | fields, [b"\xff" * 20, b"\xff" * 10])
    with pytest.raises(ValueError):
        list(tiff.pages_of(made))


@given(st.binary(max_size=80), st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 255)), max_size=6), st.integers(0, 2000), st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]))
@settings(max_examples=150, deadline=None)
def test_damaged_tiff_gives_an_error_row(noise, flips, cut, compression):
    made = bytearray(tiff.encode_tiff(b"payload " * 144, compression, 2, cut % 2 == 0))
    for at, value in flips:
        made[at % len(made)] = value
    media = pa.RecordBatch.from_arrays([pa.array([bytes(made[: len(made) - cut]) if cut % 3 else bytes(made), b"II*\0" + noise, noise, None], pa.binary())], ["media"])
    rows = [r for b in tiff.read_pages(iter([media])) for r in b.to_pylist()]
    assert {r["item"] for r in rows} >= {2, 3} and all(r["error"] or r["data"] is not None for r in rows)


def test_long_text_as_tiff():
    text = np.random.default_rng(0).integers(32, 127, 48_000_000, dtype=np.uint8).tobytes().decode()
    (row,) = [r for b in tiff._digest(tiff._store(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])]))) for r in b.to_pylist()]
    payload = text.encode() + b"\xff" * (-len(text) % 576)
    assert (row["payload_bytes"], row["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_big_endian_16_bit_tiff():
    import struct

    strip = struct.pack(">6H", 1, 1, 1, 65535, 2, 0)
    fields = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 12), (317, 3, 2)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0\0\0\0"
    (page,) = tiff.pages_of(b"MM\0*" + struct.pack(">I", 20) + strip + ifd)
    assert np.frombuffer(page.data, np.uint16).tolist() == [1, 2, 3, 65535, 1, 1]


def test_false_header_of_a_large_file():
    """A page of 80 GiB in a file of 40 MB is a fault of the file, for every coding."""
    for coding in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE):
        made = tiny_tiff(STRIPS | {256: [1 << 18], 257: [1 << 18], 278: [1 << 18], 258: [8], 259: [coding], 273: [8], 279: [30]}, [b"\xff" * 30]) + b"\0" * 40_000_000
        media = pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["media"])
        (row,) = [r for b in tiff.read_pages(iter([media])) for r in b.to_pylist()]
        assert row["error"] and row["data"] is None


def test_tiff_pages(spark):
    good = tiff.encode_tiff(b"q" * 576 * 257)
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:-40]), (None, good), (1, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "k bigint, media binary").withColumns({"page": F.lit(1), "id": F.lit(2)}), "k").collect()
    assert Counter((r.id, r.page, r.height) for r in got if not r.error) >= Counter({(1, 0, 256): 2, (1, 1, 1): 2, (None, 0, 256): 1, (None, 1, 1): 1})
    assert {r.id for r in got if r.error} == {2, 3, 4}
    assert tiff.tiff_pages(spark.createDataFrame([], "k bigint, media binary"), "k").count() == 0


def test_stored_texts(spark):
    rows = [*EDGE, (30, "z" * 576), (31, "é" * 288 * 300)]
    df = tiff.store_texts(docs(spark, rows).transform(clash))
    for r in df.collect():
        payload = b"".join(p.data for p in tiff.pages_of(r.media))
        assert len(payload) % 576 == 0 and payload[r.n_bytes :] == b"\xff" * (len(payload) - r.n_bytes) and len(payload) - r.n_bytes <= 576
        assert payload[: r.n_bytes] in {(t or "").encode() for _, t in rows}


# -- 1 ---------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    changed = mit.replace("sublicense", "SUBLICENSE!").replace("merge", "fold")
    rows = [*EDGE, (80, f"Some text here. {mit} More."), (81, changed), (82, "x Released under the MIT License. y"), (83, mit[: len(mit) // 2]), (84, "Released under the MIT"), (80, f"Some text here. {mit} More."), (85, "pad " * 999 + mit)]
    got = licenses.scan_licenses(docs(spark, rows).transform(clash, P=1, license="x")).collect()
    found = {(r.id, r.license): r for r in got}
    assert set(found) == {(80, "mit"), (81, "mit"), (82, "mit-line"), (85, "mit")}
    assert found[(80, "mit")].containment == 1 and 0.8 <= found[(81, "mit")].containment < 1
    assert sum(r.id == 80 for r in got) == 2
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs(spark, EDGE), {"short": "three words only"})
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
