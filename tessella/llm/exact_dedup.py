"""Exact deduplication with a heavy-hitter split (operator 6).

1. Each row becomes (row id, doc id, SHA-256 of its text); this narrow table is written once.
2. Misra-Gries summaries (``counters`` per task) are added up and cut to the ``counters`` largest.
   A digest with more than ``2 * rows / counters`` rows is always among them.
3. The candidates' exact counts and winners are aggregated (a partial aggregate per task); at most
   ``counters`` rows, which is the proven bound of what is broadcast for the map-side removal.
4. The other digests, each a small share of the rows, go through one ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.tables import fresh, table
from tessella.plans.storage import anchored, row_id, stage

COUNTERS = 1024


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over one task's digests, a batch at a time: at most ``counters`` lower bounds of counts."""
    held: Counter = Counter()
    for batch in batches:
        for found in pc.value_counts(batch["digest"]).to_pylist():
            held[found["values"]] += found["counts"]
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: n - cut for k, n in held.items() if n > cut})
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` candidate digests; all with over ``2 / counters`` of the rows are among them."""
    parts = rows.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, n bigint")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def _order(id_col: str = "id") -> Column:
    """Largest id wins, nulls lose, the row id settles repeated rows."""
    return F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("rid").alias("rid"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``rid, id, digest, keep_id, group_size, kept``.

    A null text counts as empty. Of equal texts the row with the largest id stays; a null id loses against
    any other; of repeated rows with the same id exactly one stays. An empty table gives an empty result;
    other columns of ``df`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(row_id(df).alias("rid"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = stage(rows, "digests")
    heavy = frequent_digests(rows, counters)
    winners = stage(
        rows.join(F.broadcast(heavy), "digest").groupBy("digest").agg(F.max(_order()).alias("best"), F.count("*").alias("group_size")), "winners"
    )
    marked = rows.join(F.broadcast(winners), "digest", "left")
    out = ["rid", "id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept")]
    by = Window.partitionBy("digest")
    rest = marked.where("best IS NULL").select("rid", "id", "digest")
    rest = rest.withColumns({"best": F.max(_order()).over(by), "group_size": F.count("*").over(by)})
    return marked.where("best IS NOT NULL").select(*out).unionByName(rest.select(*out))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns. Only the ids of dropped rows are joined, never texts with texts."""
    df, rid = anchored(df), fresh(df, "_rid")
    dropped = stage(exact_groups(df, id_col, text_col).where(~F.col("kept")).select(F.col("rid").alias(rid)), "dropped")
    return df.withColumn(rid, row_id(df)).join(dropped, rid, "left_anti").select(*df.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
w AS (SELECT doc_id, text_sha256,
             max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS nth
      FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM w
"""
