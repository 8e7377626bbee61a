"""Language identification by prediction by partial matching (operator 2).

Per language, a context tree of byte strings up to ``ORDER`` holds frozen counts. A byte costs
-log2(count / (total + kinds)) in the longest context that has seen it; each longer context that was seen but not
with this byte adds its escape, -log2(kinds / (total + kinds)); a byte never seen costs 8 more bits. The language
with the shortest exact code length wins. All languages share one trie of the union of their contexts, so that a
text is walked once, vectorised over all its bytes.

The trees are fitted on whole labelled texts: per language, distinct texts in the order of a text hash, up to
``SAMPLE_BYTES`` in all. That bound is what is gathered on the driver and broadcast; it doesn't grow with the input.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.simhash_kernel import sliced, string_buffers
from tessella.llm.tables import fresh, table
from tessella.plans.storage import stage

ORDER = 3
SAMPLE_BYTES = 400_000
SAMPLE_TEXTS = 1000
UNDETERMINED = "und"
MIN_SCORE = 0.5


@dataclass
class ContextTrees:
    """A trie of byte strings up to ``order + 1``: node 0 is dead, node 1 the root."""

    languages: list[str]
    order: int
    symbol: np.ndarray  # 256 -> symbol, 0: never seen
    child: np.ndarray  # inner node x symbol -> node
    cost: np.ndarray  # node x language: bits of the node's last byte in the context before it, escapes included
    escape: np.ndarray  # node x language: bits of an escape from this context, 0 where the language hasn't seen it


def fit(texts: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
    languages = sorted(texts)
    symbol = np.zeros(256, dtype=np.int64)
    seen = np.unique(np.frombuffer(b"".join(b"".join(v) for v in texts.values()), dtype=np.uint8))
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by length - 1, by language: codes and counts
    for size in range(1, order + 2):
        own = []
        for lang in languages:
            codes = []
            for text in texts[lang]:
                s = symbol[np.frombuffer(text, dtype=np.uint8)]
                if len(s) >= size:
                    code = np.zeros(len(s) - size + 1, dtype=np.int64)
                    for k in range(size):
                        code = code * width + s[k : len(s) - size + 1 + k]
                    codes.append(code)
            own.append(np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_counts=True))
        counts.append(own)
    grams = [np.unique(np.concatenate([c for c, _ in own])) if own else np.empty(0, np.int64) for own in counts]
    first = np.cumsum([2, *map(len, grams)])  # node of the first gram of each length
    inner = int(first[order])
    child = np.zeros((inner, width), dtype=np.int32)
    for k, codes in enumerate(grams):
        above = np.ones(len(codes), dtype=np.int64) if k == 0 else first[k - 1] + np.searchsorted(grams[k - 1], codes // width)
        child[above, codes % width] = first[k] + np.arange(len(codes))
    cost = np.zeros((int(first[-1]), len(languages)))
    escape = np.zeros((inner, len(languages)))
    for j in range(len(languages)):
        total, kinds = np.zeros(int(first[-1])), np.zeros(int(first[-1]))
        of = np.zeros(int(first[-1]))
        for k, codes in enumerate(grams):
            c, n = counts[k][j]
            nodes = first[k] + np.searchsorted(codes, c)
            of[nodes] = n
            above = np.ones(len(c), dtype=np.int64) if k == 0 else first[k - 1] + np.searchsorted(grams[k - 1], c // width)
            np.add.at(total, above, n)
            np.add.at(kinds, above, 1)
        used = total[:inner] > 0
        escape[used, j] = -np.log2(kinds[:inner][used] / (total[:inner] + kinds[:inner])[used])
        for k, codes in enumerate(grams):
            nodes = first[k] + np.arange(len(codes))
            if k == 0:
                above, shorter = np.ones(len(codes), dtype=np.int64), np.full(len(codes), 8.0)
            else:
                above = first[k - 1] + np.searchsorted(grams[k - 1], codes // width)
                shorter = cost[first[k - 1] + np.searchsorted(grams[k - 1], codes % width**k), j]
            here = of[nodes] > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = -np.log2(of[nodes] / (total[above] + kinds[above]))
            cost[nodes, j] = np.where(here, direct, escape[above, j] + shorter)
    cost[0] = 8.0 + escape[1]  # a byte that no language has seen
    return ContextTrees(languages, order, symbol.astype(np.int32), child, cost, np.where(np.arange(inner)[:, None] == 1, 0.0, escape))


def code_lengths(trees: ContextTrees, texts: pa.Array) -> np.ndarray:
    """Bits of each text under each language (texts x languages); a null text counts as empty."""
    raw, offsets = string_buffers(texts)
    out = np.zeros((len(texts), len(trees.languages)))
    if not len(raw):
        return out
    sym = trees.symbol[raw]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = offsets[:-1][full]
    fresh = np.zeros(len(raw), dtype=bool)
    fresh[starts] = True
    node = trees.child[1, sym]  # the gram of length 1 that ends here
    best, missed = node, []
    for _ in range(trees.order):
        context = np.empty_like(node)
        context[0] = 0
        context[1:] = node[:-1]
        context[fresh] = 0  # contexts don't reach over a text's start
        node = trees.child[context, sym]
        best = np.where(node > 0, node, best)
        gone = np.flatnonzero((node == 0) & (context > 0))
        missed.append((gone, context[gone]))
    text_of = np.repeat(np.arange(len(full)), np.diff(offsets)[full])
    for j in range(len(trees.languages)):
        bits = np.add.reduceat(trees.cost[:, j][best], starts)
        for gone, context in missed:
            bits += np.bincount(text_of[gone], weights=trees.escape[:, j][context], minlength=len(full))
        out[full, j] = bits
    return out


def labelled_sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    sample_bytes: int = SAMPLE_BYTES, sample_texts: int = SAMPLE_TEXTS) -> dict[str, list[bytes]]:
    """Whole distinct texts per language outside the held-out fold, at most ``sample_bytes`` a language.

    A text hash decides, so copies count once and reruns agree. The share of hashes that is gathered follows
    from the number of rows per language; a language's texts that fit are kept, longer ones are passed over.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("out"))
    rows = rows.where("NOT out AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    narrow = stage(rows.select("lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")), "label-hashes")
    distinct = narrow.groupBy("lang", "h").agg(F.max("n").alias("n"))
    sizes = distinct.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("bytes")).collect()
    # thresholds on the upper 32 bits of the hash: about twice the wanted bytes, or all
    share = {r["lang"]: min(1.0, max(2.0 * sample_bytes / max(r["bytes"], 1), 40 / r["texts"]), sample_texts / r["texts"]) for r in sizes}
    cut = spark_map(share)
    place = F.pmod(F.shiftright("h", 32), F.lit(1 << 32)).cast("double") / float(1 << 32)
    chosen = rows.withColumn("h", F.xxhash64("text")).where(F.octet_length("text") <= sample_bytes).where(place <= cut[F.col("lang")])
    found: dict[str, dict[int, str]] = defaultdict(dict)
    for r in chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).toLocalIterator():
        found[r["lang"]][r["h"]] = r["text"]
    out: dict[str, list[bytes]] = {}
    for lang, texts in found.items():
        left, own = sample_bytes, []
        for h in sorted(texts, key=lambda h: (h >> 32) % (1 << 32)):
            data = texts[h].encode()
            if len(data) <= left:
                own.append(data)
                left -= len(data)
        out[lang] = own
    return out


def spark_map(values: dict[str, float]) -> Column:
    pairs = [x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictor(spark: SparkSession, trees: ContextTrees):
    """A column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores = [], []
        for part in sliced(texts):
            bits = code_lengths(model, part)
            best = bits.argmin(axis=1)
            gain = np.clip(bits.min(axis=1)[:, None] - bits, -60, 0)
            langs.append(pa.array(np.array(model.languages, dtype=object)[best], pa.string()))
            scores.append(1.0 / np.exp2(gain).sum(axis=1))
        fields = [pa.chunked_array(langs, pa.string()).combine_chunks(), pa.array(np.concatenate(scores) if scores else np.empty(0))]
        return pa.StructArray.from_arrays(fields, ["lang_pred", "score"])

    def column(text: Column) -> Column:
        undetermined = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        return F.when(has_letter, predict(text)).otherwise(undetermined) if trees.languages else undetermined

    return column


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", name: str = "_language") -> DataFrame:
    """``df`` with a column ``name``: struct(lang_pred, score), fitted on its own labelled rows.

    The score is the winner's posterior under equal priors. Null texts and texts without a letter are ``und``
    with score 0; so is every text if no row has a label. Of equal code lengths the first language by name wins.
    Repeated rows are predicted alike; other columns stay as they are.
    """
    trees = fit(labelled_sample(df, id_col, text_col, lang_col))
    return df.withColumn(name, predictor(df.sparkSession, trees)(F.col(text_col)))


def keep_identified(df: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is determined with a posterior of ``min_score`` at least."""
    name = fresh(df, "_language")
    found = identify(df, name=name)
    return found.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score)).select(*df.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score")
