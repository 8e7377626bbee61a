"""Operators 11 to 13 against plain versions, and their edge cases."""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_operators import EDGE, LONG, clash, docs

from tessella.llm import periodic_runs, quality_rules, queries, simhash_kernel, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int"


# -- 11 --------------------------------------------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds):
    """(id, codes, error) by comparing every part with every entry, and the codebooks; rows in the order of ids."""
    rows = [(i, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts if rows else 0
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, c[p])[1] for c in cut]
            for k in set(of):
                own = [c[p] for c, o in zip(cut, of, strict=True) if o == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, bytes(near(p, c[p])[1] for p in range(parts)), sum(near(p, c[p])[0] for p in range(parts))) for (i, _), c in zip(rows, cut, strict=True)], books


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_nearest_entries_from_any_start(points, entries, start):
    x = np.array(points, np.int64)
    book = x[:entries]
    best, least, taken = vector_codes.nearest_entries(x, book, np.full(len(x), min(start, len(book) - 1)))
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all() and taken <= every.size + len(x)


def test_search_skips_far_entries():
    book = np.arange(0, 160_000, 10_000)[:, None]
    x = np.repeat(book, 50, axis=0) + 3
    best, _, taken = vector_codes.nearest_entries(x, book, np.repeat(np.arange(16), 50))
    assert (best == np.repeat(np.arange(16), 50)).all() and taken == len(x)


def test_compress(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 4], int(i) % 3) for i in rng.permutation(70)]
    rows += [(3, [0.5] * 8, 1), (3, [0.25] * 8, 1), (None, [-0.75] * 8, None), (None, [-0.75] * 8, None)]  # ids that repeat, null ids
    rows += [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] + [0.0] * 7, 1), (904, [-math.inf] + [0.0] * 7, 2)]
    found, books = vector_codes.compress(clash(spark.createDataFrame(rows, VECTORS)), keep=("label",), parts=4, entries=5, rounds=3)
    want, want_books = plain_codes([r[:2] for r in rows], 4, 5, 3)
    assert sorted([(r.id, bytes(r.codes), r.error) for r in found.collect()], key=repr) == sorted(want, key=repr) and books == want_books
    few, books = vector_codes.compress(spark.createDataFrame(rows[:3], VECTORS), entries=16, parts=8)
    assert few.count() == 3 and {len(b) for b in books} == {3}
    for none in ([], [(1, None, 1)], [(1, [math.nan] * 8, 1)]):
        found, books = vector_codes.compress(spark.createDataFrame(none, VECTORS))
        assert found.count() == 0 and books == [[] for _ in range(8)]


@pytest.mark.parametrize("rows", [[(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)], [(1, [0.0] * 7, 0)], [(1, [], 0)], [(1, [1e30] * 8, 0)], [(1, [1e9] * 8, 0)]])
def test_vectors_that_cannot_be_cut_raise(spark, rows):
    with pytest.raises(Exception, match="components|too large"):
        vector_codes.compress(spark.createDataFrame(rows, VECTORS))[0].count()


def test_codes_do_not_depend_on_the_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = [vector_codes.compress(df.repartition(n, F.xxhash64("vec_id", F.lit(n))), rounds=2) for n in (1, 7)]
    assert made[0][1] == made[1][1]
    one, two = ({r.id: (bytes(r.codes), r.error) for r in found.collect()} for found, _ in made)
    assert one == two


def test_op11_with_hot_and_null_labels(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 7 if i % 3 else None) for i in range(60)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    want, books = plain_codes([r[:2] for r in rows], 8, 16, 6)
    label = {i: n for i, _, n in rows}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {n: sum(e for i, _, e in want if label[i] == n) for n in (7, None)}
    assert sorted(map(tuple, got)) == sorted((i, c.hex(), e, total[label[i]], digest) for i, c, e in want)


# -- 10: the signature step at any number of references ------------------------------------------------------------------
def test_nearest_references_in_bounded_steps():
    rng = np.random.default_rng(2)
    clear = simhash_kernel.margins(rng.integers(0, 20, (3000, 64)), np.full(3000, 20))
    references = simhash_kernel.reference_fingerprints(256, 1)
    got = simhash_kernel.nearest_references(clear, references, 4)
    far = np.rint(clear * (1 << 14)) @ references.astype(np.float64)
    assert (np.sort(np.take_along_axis(far, got, axis=1), axis=1) == np.sort(far, axis=1)[:, -4:]).all()


def test_memory_of_signatures_does_not_grow_with_the_references():
    """10,000 short texts against 2 ** 17 references: all distances at once were over 5 GB."""
    import tracemalloc

    clear = simhash_kernel.margins(np.random.default_rng(3).integers(0, 20, (40, 64)), np.full(40, 20))
    references = simhash_kernel.reference_fingerprints(1 << 17, 0)
    tracemalloc.start()
    simhash_kernel.nearest_references(np.tile(clear, (10, 1)), references, 4)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    simhash_kernel.reference_fingerprints.cache_clear()
    assert peak < 100 << 20


# -- 12 --------------------------------------------------------------------------------------------------------------
def plain_found(text):
    w = brute.words(text)
    runs = brute.runs(w)
    return {"n_words": len(w), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": brute.collapsed(w, runs).decode()}


@st.composite
def periodic_texts(draw):
    w = draw(st.lists(st.sampled_from("abcdeé"), max_size=90))
    for _ in range(draw(st.integers(0, 3))):
        if len(w) > 3:
            a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 12))
            for i in range(a, draw(st.integers(a, len(w)))):
                w[i] = w[a + (i - a) % p]
    return draw(st.sampled_from(["", " ", "\n\t"])) + draw(st.sampled_from([" ", "  ", "\r\n"])).join(w) + draw(st.sampled_from(["", " "]))


@settings(max_examples=200)
@given(st.lists(st.one_of(st.none(), periodic_texts()), min_size=1, max_size=5))
def test_runs_of_texts(texts):
    assert periodic_runs.runs_of_texts(pa.array(texts, pa.string())).to_pylist() == [plain_found(t) for t in texts]
    if len(texts) > 1:  # a slice of an Arrow array starts within its buffers
        assert periodic_runs.runs_of_texts(pa.array(texts, pa.string())[1:]).to_pylist() == [plain_found(t) for t in texts[1:]]


def test_runs_of_few_kinds_of_words():
    fibonacci, thue = ["a", "ab"], "".join("ab"[i.bit_count() % 2] for i in range(300))
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [" ".join(fibonacci[-1]), " ".join(thue), " ".join("a" * 500), " ".join("ab" * 12), " ".join("ab" * 11 + "a"), " ".join("abcdefgh" * 3), " ".join("abcdefgh" * 3)[:-2]]
    got = periodic_runs.runs_of_texts(pa.array(texts)).to_pylist()
    assert got == [plain_found(t) for t in texts]
    assert [len(g["runs"]) for g in got[1:]] == [0, 1, 1, 0, 1, 0] and got[0]["runs"]


def test_find_runs(spark):
    rows = [*EDGE, (20, "x y z " * 9000), (20, "x y z " * 9000), (None, "q " * 30)]
    got = periodic_runs.find_runs(docs(spark, rows).transform(clash)).collect()
    key = lambda r: repr(r)
    want = [(i, f["n_words"], [tuple(r.values()) for r in f["runs"]], f["collapsed"]) for i, f in ((i, plain_found(t)) for i, t in rows if t != LONG)]
    want += [(i, 120_001, [(0, 120_000, 2)], "a word end") for i, t in rows if t == LONG]
    assert sorted([(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0


def plain_op12(ident, text):
    w = brute.planted_words(ident, text)
    runs = brute.runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute.collapsed(w, runs)).hexdigest())
    return (ident, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *digests)


def test_op12(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got == {plain_op12(i, t) for i, t in zip(table.doc_id.tolist(), table.text, strict=True)}


def test_op12_on_edge_rows(spark, tmp_path):
    rows = [(i, t) for i, t in EDGE if i is not None and t != LONG] + [(100 + i, "one two three " * (i % 40)) for i in range(200)] + [(None, "u v " * 20)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    no_id = (None, 1, 0, 40, 2, 20_000, hashlib.sha256(b"0,40,2\n").hexdigest(), hashlib.sha256(b"u v").hexdigest())
    assert got == sorted([*(plain_op12(i, t) for i, t in rows[:-1]), no_id], key=repr)


# -- 13 --------------------------------------------------------------------------------------------------------------
def plain_counts(text):
    text = text or ""
    w = [x.decode() for x in brute.words(text)]
    lines = [x for x in text.split("\n") if brute.words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    letters = [c for c in text if c.isalpha()]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_lines": len(lines), "n_letters": len(letters), "n_upper": sum(c.isupper() for c in letters),
        "n_calls": text.count("!"), "n_lettered": sum(any(c.isalpha() for c in x) for x in w), "n_distinct": len(set(w)),
    }


COUNTED = ["a b c d e f g h " * 3, "a b c d e f g h x " * 2 + "a b c d e f g h", "a " * 20, "ÉA ßb # $! \U0001f600\n\n É\nÉ\n x|y", "w " * 7, "w " * 8, "w " * 9, "one two\none two\n \none"]


def test_text_counts(spark):
    rows = [(i, t) for i, t in EDGE if t != LONG] + [(50 + i, t) for i, t in enumerate(COUNTED)]
    got, _ = quality_rules.judge(docs(spark, rows).transform(clash))
    key = lambda r: repr(sorted(r.items(), key=repr))
    got = [{k: r[k] for k in ("id", *quality_rules.COUNTS)} for r in got.collect()]
    assert sorted(got, key=key) == sorted([{"id": i, **plain_counts(t)} for i, t in rows], key=key)
    assert quality_rules.judge(docs(spark, []))[0].count() == 0


def test_counts_of_a_long_text(spark):
    got, _ = quality_rules.judge(docs(spark, [(1, LONG)]))
    r = got.first()
    assert (r.n_words, r.n_repeat_words, r.n_distinct, r.n_dup_lines) == (120_001, 120_000, 3, 0)


def plain_fit(codes, rules, rounds):
    """The same model in floating point, text by text."""
    start, least, most = quality_rules.START, quality_rules.LEAST, quality_rules.MOST
    votes = np.array([[c // 3**k % 3 for k in range(rules)] for c in codes])
    a, b, share = np.full(rules, start["good"]), np.full(rules, start["bad"]), start["share"]
    for _ in range(rounds):
        good = share * np.where(votes == 1, a, np.where(votes == 2, 1 - a, 1)).prod(axis=1)
        bad = (1 - share) * np.where(votes == 1, 1 - b, np.where(votes == 2, b, 1)).prod(axis=1)
        p = (good / (good + bad))[:, None]
        of = lambda right, weight, kind, before: np.where((votes > 0).any(axis=0), np.clip(((votes == right) * weight).sum(axis=0) / np.maximum(1e-300, ((votes > 0) * weight).sum(axis=0)), least[kind], most[kind]), before)
        a, b, share = of(1, p, "good", a), of(2, 1 - p, "bad", b), float(np.clip(p.mean(), least["share"], most["share"]))
    return a, b, share


def test_fit(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.8
    votes = np.where(rng.random((3000, 4)) < 0.15, 0, np.where(truth[:, None], np.where(rng.random((3000, 4)) < 0.03, 2, 1), np.where(rng.random((3000, 4)) < 0.6, 2, 1)))
    codes = (votes * 3 ** np.arange(4)).sum(axis=1).tolist()
    counted = pd.Series(codes).value_counts()
    table = spark.createDataFrame([(int(c), int(n)) for c, n in counted.items()], "code bigint, n bigint").withColumn("votes", quality_rules.votes_of(F.col("code"), 5))
    model = quality_rules.fit(table, 5, 8)
    a, b, share = plain_fit(codes, 5, 8)
    assert np.allclose(model["good"], a, atol=1e-6) and np.allclose(model["bad"], b, atol=1e-6) and abs(model["share"] - share) < 1e-6
    assert abs(model["share"] - truth.mean()) < 0.03 and all(abs(x - 0.6) < 0.1 for x in model["bad"][:4])
    assert model["good"][4] == quality_rules.START["good"]  # a rule that never votes
    assert quality_rules.fit(table.where("false"), 5)["share"] == quality_rules.START["share"]


def test_votes_drop_junk_and_keep_clean_texts(spark, sf_dir):
    """Against labels like those with which start and bounds of the model were chosen: no held-out figure."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op13_quality_rules"](spark, sf_dir).toPandas().merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert len(got) > 300 and not (got.base_failed & got.kept).any()
    voted = got[~got.base_failed]
    assert voted.kept[voted.quality == 1].mean() > 0.99 and voted.kept[voted.quality == 0].mean() < 0.1
