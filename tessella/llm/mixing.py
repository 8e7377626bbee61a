"""Mixing sources to target weights by capped water-filling (operator 4), DataFrame functions only.

Targets: with weights w and caps c = ``max_epochs`` * size, the fixed point of "clamp at the cap, share the
excess by weight" is target = min(c, level * w). Sources ordered by c / w are clamped from the left; prefix
sums give the level behind each prefix, and the first prefix whose level fits the next source is the one.

Sampling: a document is taken floor(target / size) times. The fractional repetition is an extra share of the source, for
which documents queue in the order of a seeded hash:

* Long documents hold over 1 / ``LONG`` of their source each, so a source has fewer than ``LONG``. They are folded in
  order: one is taken while that brings the long documents nearer to their share and stays within the extra.
* The others fill what is left of the extra, up to the first that doesn't fit. That cut is found from sums per hash
  bucket (two digits, then four) and from the rows of the one bucket that holds it: a hot source is never in one task.
* Of all documents that were passed over, the one whose size comes nearest to what is still left is taken too, if that
  narrows the gap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.tables import fresh, table
from tessella.plans.storage import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240
LONG = 256
END = "g"  # after all tickets
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, null: 0; counted without an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ticket(id_col: Column, seed: int = SEED) -> Column:
    """32 hex digits by which documents queue for the fractional repetition; the same on every engine."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: source, source_size, weight. Adds ``target`` (double); one row per source.

    The total of all sizes is shared. Sums are whole numbers in doubles, exact to 2^53.
    """
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    t = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "weights": F.sum("weight").over(Window.partitionBy())})
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"caps_before": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "weights_before": F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    level = (F.col("total") - F.col("caps_before")).cast("double") / (F.col("weights") - F.col("weights_before")).cast("double")
    t = t.withColumn("level_if_first", level)
    fits = F.col("level_if_first") * F.col("weight") <= F.col("cap")
    # the least level among sources that fit is that of the first of them; later ones give the same or less only by rounding
    t = t.withColumn("nth", F.row_number().over(by)).withColumn("first_fit", F.min(F.when(fits, F.struct("nth", "level_if_first"))).over(Window.partitionBy()))
    target = F.when(F.col("nth") < F.col("first_fit.nth"), F.col("cap").cast("double")).otherwise(F.col("first_fit.level_if_first") * F.col("weight"))
    return t.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))


def _long_taken(items: Column, need: Column, extra: Column) -> Column:
    """Fold of (ticket, size) in order: struct(taken, tickets). Fewer than ``LONG`` items."""
    start = F.struct(F.lit(0).cast("bigint").alias("taken"), F.array().cast("array<string>").alias("tickets"))

    def step(state: Column, item: Column) -> Column:
        taken = state["taken"] + item["size"]
        fits = (item["size"] <= 2 * (need - state["taken"])) & (taken <= extra)
        return F.when(fits, F.struct(taken.alias("taken"), F.concat(state["tickets"], F.array(item["ticket"])).alias("tickets"))).otherwise(state)

    return F.aggregate(items, start, step)


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents: id, source, size, ticket; sources: source, source_size, target, whole, boundary, skipped, chosen).

    A document is taken ``whole`` times, and, if it has words, once more if its ticket is in ``chosen``, or before ``boundary`` and not in
    ``skipped``. Null text: size 0. Null source: a source of its own, last in order. A source of size 0 has target 0.
    Null ids share one ticket; documents of equal ticket (repeated ids) are taken together. Very long texts are counted
    whole. An empty table gives two empty ones; other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), ticket(F.col(id_col), seed).alias("ticket"))
    rows = stage(rows, "sizes")
    same = lambda other: F.col("source").eqNullSafe(F.col(other))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    nth = reduce(lambda c, x: F.when(F.col("rank") % len(weights) == x[0], F.lit(x[1])).otherwise(c), enumerate(weights), F.lit(0))
    sources = water_fill(sizes.withColumn("rank", rank).withColumn("weight", nth), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.select("source", "source_size", "target", whole.alias("whole"))
    sources = stage(sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    # long documents, fewer than LONG a source; a ticket with one is long as a whole
    of = sources.select(F.col("source").alias("s"), "source_size")
    long_tickets = rows.join(of, same("s")).where(F.col("size") * LONG > F.col("source_size")).select("s", F.col("ticket").alias("t")).distinct()
    long_tickets = stage(long_tickets, "long")
    rows_of = rows.join(long_tickets, same("s") & (F.col("ticket") == F.col("t")), "left").select("source", "size", "ticket", F.col("t").isNotNull().alias("long"))
    rows_of = stage(rows_of, "queued")
    items = rows_of.where("long").groupBy("source", "ticket").agg(F.sum("size").alias("size"))
    items = items.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("ticket", "size"))).alias("items"), F.sum("size").alias("mass"))
    t = sources.join(items, same("s"), "left").drop("s").withColumn("mass", F.coalesce("mass", F.lit(0)))
    need = F.greatest(F.col("extra") * F.col("mass") / F.col("source_size"), F.col("extra") - (F.col("source_size") - F.col("mass")))
    t = t.withColumn("fold", F.when(F.col("items").isNotNull(), _long_taken(F.col("items"), need, F.col("extra"))))
    t = t.withColumns({"chosen": F.coalesce("fold.tickets", F.array().cast("array<string>")), "extra": F.col("extra") - F.coalesce("fold.taken", F.lit(0)), "short": F.col("source_size") - F.col("mass")})
    t = t.withColumn("passed", F.coalesce(F.array_except("items.ticket", "chosen"), F.array().cast("array<string>")))
    sources = stage(t.select("source", "source_size", "target", "whole", "extra", "short", "chosen", "passed"), "sources")
    # the bucket in which the running size of the others passes ``extra``, two digits at a time: no window has more than 256 rows a source
    bucket = F.substring("ticket", 1, 4)
    buckets = stage(rows_of.where("NOT long").groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "size-buckets")
    cut = sources.select(F.col("source").alias("s"), "extra", F.lit("").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for digits in (2, 4):
        part = F.substring("bucket", 1, digits)
        inner = buckets.join(cut, same("s") & F.col("bucket").startswith(F.col("prefix")))
        inner = inner.groupBy("s", "extra", "before", part.alias("prefix")).agg(F.sum("size").alias("size"))
        inner = inner.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("prefix")))
        cut = stage(inner.where("upto > extra AND upto - size <= extra").select("s", "extra", "prefix", (F.col("upto") - F.col("size")).alias("before")), "cuts")
    cut = cut.withColumnRenamed("prefix", "bucket")
    inside = rows_of.where("NOT long").withColumn("b4", bucket).join(cut, same("s") & (F.col("b4") == F.col("bucket")))
    tickets = inside.groupBy("source", "bucket", "extra", "before", "ticket").agg(F.sum("size").alias("size"))
    tickets = tickets.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("ticket")))
    edge = tickets.where("upto > extra").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("ticket", (F.col("upto") - F.col("size")).alias("taken"))).alias("at"))
    # without a cut all others are taken
    ends = sources.join(edge, same("s"), "left").select(
        F.col("source").alias("s"), "source_size", "target", "whole", "chosen", "passed", F.coalesce("at.ticket", F.lit(END)).alias("boundary"),
        (F.col("extra") - F.coalesce("at.taken", "short")).alias("left"),
    )
    ends = stage(ends, "ends")
    over = F.when(F.col("long"), F.array_contains("passed", F.col("ticket"))).otherwise(F.col("ticket") >= F.col("boundary"))
    near = rows_of.join(ends.select("s", "passed", "boundary", "left"), same("s")).where(over & (F.col("left") > 0))
    near = near.select("s", "ticket", "left", F.abs(F.col("size") - F.col("left")).alias("gap"))
    gaps = stage(near.groupBy("s").agg(F.min("gap").alias("least")).withColumnRenamed("s", "g"), "gaps")
    picks = near.join(gaps, F.col("s").eqNullSafe(F.col("g")) & (F.col("gap") == F.col("least"))).groupBy("s", "left").agg(F.min("ticket").alias("pick"))
    picks = stage(picks, "picks")
    whole_pick = rows_of.join(picks, same("s") & (F.col("ticket") == F.col("pick"))).groupBy(F.col("s").alias("p"), "left", "pick").agg(F.sum("size").alias("size"))
    whole_pick = whole_pick.where(F.abs(F.col("size") - F.col("left")) < F.col("left")).select("p", "pick")
    plan = ends.join(whole_pick, F.col("s").eqNullSafe(F.col("p")), "left")
    chosen = F.when(F.col("pick").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("pick")))
    skipped = F.filter("passed", lambda x: x < F.col("boundary"))
    # written, so that its size is known: a small plan is broadcast to the documents, a large one is not
    return rows, stage(plan.select(F.col("s").alias("source"), "source_size", "target", "whole", "boundary", skipped.alias("skipped"), chosen.alias("chosen")), "plan")


def repeats(ticket_col: Column, worded: Column, plan: str = "") -> Column:
    """How often a document is taken; ``worded``: it has words, ``plan`` is the prefix of the plan's columns.

    A document without words takes nothing of the extra share, so it is taken ``whole`` times.
    """
    queued = (ticket_col < F.col(f"{plan}boundary")) & ~F.array_contains(f"{plan}skipped", ticket_col)
    return F.col(f"{plan}whole") + F.when(worded & (queued | F.array_contains(f"{plan}chosen", ticket_col)), 1).otherwise(0)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it: 0 to ``MAX_EPOCHS`` times.

    Null sources are a source of their own, null ids share one ticket, repeated rows are taken together, texts without words
    have size 0 and get whole repetitions only (none in a source without words); an empty table gives an empty result; names of other columns don't matter.
    """
    _, plan = plan_mix(df, id_col, text_col, source_col, seed=seed)
    name = fresh(df, "_mix")
    plan = plan.select(F.struct("source", "whole", "boundary", "skipped", "chosen").alias(name))
    joined = df.join(plan, F.col(source_col).eqNullSafe(F.col(f"{name}.source")))
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    times = repeats(ticket(F.col(id_col), seed), worded, f"{name}.")
    return joined.withColumn(name, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*df.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes from it."""
    rows, plan = plan_mix(table(spark, sf_dir, "documents"))
    joined = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * repeats(F.col("ticket"), F.col("size") > 0)).cast("bigint").alias("taken"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':20240') AS ticket,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER q AS nth,
             ((sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE) AS level
      FROM w WINDOW q AS (ORDER BY cap::DOUBLE / weight, rank)),
f AS (SELECT min(nth) AS n0, arg_min(level, nth) AS l0 FROM o WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN n0 IS NULL OR nth < n0 THEN cap::DOUBLE ELSE l0 * weight END AS target FROM o LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (SELECT d.source, ticket, sum(size)::BIGINT AS size, max(size) * 256 > source_size AS long, max(target - whole * source_size) AS extra, max(source_size) AS source_size
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source GROUP BY d.source, ticket, source_size),
m AS (SELECT source, any_value(extra) AS extra, any_value(source_size) AS source_size, coalesce(sum(size) FILTER (long), 0)::BIGINT AS mass FROM k GROUP BY source),
n AS (SELECT *, greatest(extra * mass::DOUBLE / source_size, extra - (source_size - mass)) AS need FROM m),
l AS (SELECT k.source, ticket, size, n.extra, need, row_number() OVER (PARTITION BY k.source ORDER BY ticket) AS nth FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source WHERE long),
v(source, nth, taken, ticket, took) AS (
  SELECT source, 0::BIGINT, 0::BIGINT, '', false FROM n
  UNION ALL
  SELECT l.source, l.nth, v.taken + CASE WHEN size <= 2 * (need - v.taken) AND v.taken + size <= extra THEN size ELSE 0 END, l.ticket,
         size <= 2 * (need - v.taken) AND v.taken + size <= extra
  FROM v JOIN l ON l.source IS NOT DISTINCT FROM v.source AND l.nth = v.nth + 1),
x AS (SELECT n.source, extra - max(taken) AS extra, any_value(source_size - mass) AS short FROM n JOIN v ON n.source IS NOT DISTINCT FROM v.source GROUP BY n.source, extra),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ticket) AS upto FROM k WHERE NOT long),
c AS (SELECT u.source, min(ticket) AS boundary, arg_min(upto - size, ticket) AS taken
      FROM u JOIN x ON u.source IS NOT DISTINCT FROM x.source WHERE upto > x.extra GROUP BY u.source),
b AS (SELECT x.source, coalesce(boundary, 'g') AS boundary, extra - coalesce(taken, short) AS rest FROM x LEFT JOIN c ON x.source IS NOT DISTINCT FROM c.source),
o2 AS (SELECT k.source, k.ticket, k.long, k.size, CASE WHEN k.long THEN v.took ELSE k.ticket < boundary END AS took, boundary, rest
       FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source LEFT JOIN v ON v.source IS NOT DISTINCT FROM k.source AND v.ticket = k.ticket),
p AS (SELECT o2.source, min({'gap': abs(d.size - rest), 'ticket': d.ticket}).ticket AS pick, any_value(rest) AS rest
      FROM o2 JOIN d ON d.source IS NOT DISTINCT FROM o2.source AND d.ticket = o2.ticket WHERE NOT took AND rest > 0 GROUP BY o2.source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (d.size * (e.whole + CASE WHEN o2.took OR (d.ticket = p.pick AND abs(o2.size - p.rest) < p.rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
JOIN o2 ON d.source IS NOT DISTINCT FROM o2.source AND d.ticket = o2.ticket LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
