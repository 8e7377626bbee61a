"""The registered queries and the pipeline on the smallest tables, against SQL or plain versions."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tests.llm import brute
from tests.llm.test_operators import check_packed, plain_mix

import corpus_pipeline
from tessella.llm import language_id, packing, queries, tiff


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    keep = lambda v: None if v is None or v is pd.NA or v != v else (round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else v)
    return sorted((tuple(map(keep, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetch_df()
    assert plain(got) == plain(want)


def test_op2(spark, sf_dir, docs):
    got = queries.QUERIES["op2_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.doc_id)
    lang = docs.set_index("doc_id").lang
    out = got[got.held_out]
    assert set(out.index) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (out.lang_pred == lang[out.index]).mean() > 0.95
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*lang.dropna(), "und"}


def test_op5(spark, sf_dir, docs):
    text = docs.set_index("doc_id").text
    for r in queries.QUERIES["op5_tiff"](spark, sf_dir).collect():
        data = text[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = tiff.encode_tiff(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.startswith("pages=")


def test_op7(spark, sf_dir, docs):
    text = docs.set_index("doc_id").text
    rows = queries.QUERIES["op7_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.secrets(text[r.doc_id])
        assert {k: r[k] for k in ("n_assign", "n_access", "n_hex", "base_sha256")} == {k: want[k] for k in ("n_assign", "n_access", "n_hex", "base_sha256")}
        assert set(filter(None, want["base"].split(","))) <= set(r.spans.split(","))


def pieces(rows):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_tokenizer()["tokenizer_path"])
    out = Counter()
    for ident, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a, n, crc in packing.pieces_of(ids):
            assert crc == zlib.crc32(ids[a : a + n].tobytes())
            out[(ident, k, a, n, crc)] += 1
    return out


def check_pieces(rows, want):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    least = -(-sum(n * k for (*_, n, _), k in want.items()) // 2048)
    assert least <= check_packed(rows) <= 1.05 * least + 1


def test_op9(spark, sf_dir, docs):
    check_pieces(queries.QUERIES["op9_packing"](spark, sf_dir).collect(), pieces(zip(docs.doc_id.tolist(), docs.text, strict=True)))


def test_op10(spark, sf_dir, docs):
    got = [tuple(r) for r in queries.QUERIES["op10_simhash_dedup"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute.near_components(list(zip(docs.doc_id.tolist(), docs.text, strict=True))))


def test_pipeline(spark, sf_dir, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = language_id.fit(language_id.labelled_sample(df))
    bits = language_id.code_lengths(trees, pa.array(docs.text))
    score = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
    letters = docs.text.str.contains(r"[^\W\d_]", regex=True).to_numpy()
    rows = [(int(i), t, s) for i, t, s, ok in zip(docs.doc_id, docs.text, docs.source, letters & (score >= 0.5), strict=True) if ok]
    last = {t: max(i for i, u, _ in rows if u == t) for _, t, _ in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    rows = [rows[i] for i in brute.kept_of_similar([r[:2] for r in rows])]
    times = plain_mix(rows)
    want = pieces([r[:2] for r, k in zip(rows, times, strict=True) for _ in range(k)])
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), want)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.schema == df.schema
        empty = stage(spark, df.limit(0), sf_dir)
        assert empty.count() == 0
