"""Streaming queries, run over the table as it stands; each has the batch relation as its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.queries import fixed, query
from tessella.queries.stencil import fx
from tessella.streaming import forest, frames


@query(f"SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, {fixed('sum(value)')} AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    out = frames.run_once(frames.windowed_counts(frames.event_stream(spark, sf), "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", fx("total", "total"))


@query("""WITH s AS (SELECT ts, event_type, value, unnest([0, 1]) AS k FROM events)
SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * ((hour(ts) // 12) - k) AS start, event_type, count(*) AS n FROM s GROUP BY ALL""")
def stream_sliding_counts(spark, sf):
    out = frames.run_once(frames.windowed_counts(frames.event_stream(spark, sf), "1 day", "12 hours"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    out = frames.run_once(frames.session_counts(frames.event_stream(spark, sf), "6 hours"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH c AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame, floor(value)::INT AS x, (user_id % 150)::INT AS y FROM events)
SELECT frame, x, y FROM c WHERE frame > 0 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.frame = c.frame - 1 AND b.x = c.x AND b.y = c.y)""")
def stream_moving_cells(spark, sf):
    e = frames.event_stream(spark, sf)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    cells = e.select(day.alias("frame"), F.floor("value").cast("int").alias("x"), (F.col("user_id") % 150).cast("int").alias("y"))
    return frames.run_once(frames.moving_cells(cells), "append")


#: least largest rank on a path between two dots, by squaring; an edge is in the forest if no path is better
_SQUARED = ", ".join(
    f"b{k} AS (SELECT stream, frame, a.src, b.dst, min(greatest(a.r, b.r)) AS r FROM b{k - 1} a JOIN b{k - 1} b USING (stream, frame) WHERE a.dst = b.src GROUP BY ALL)" for k in range(1, 8)
)


@query("""WITH d AS (SELECT event_type AS stream, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame, event_id AS id, floor(value)::INT AS x, (user_id % 150)::INT AS y FROM events),
n AS (SELECT a.stream, a.id, a.x - b.x AS dx, a.y - b.y AS dy, row_number() OVER (PARTITION BY a.id ORDER BY a.frame - b.frame, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS nth
      FROM d a JOIN d b ON a.stream = b.stream AND b.frame BETWEEN a.frame - 5 AND a.frame - 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 361),
p AS (SELECT d.*, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy FROM d LEFT JOIN n ON n.id = d.id AND nth = 1),
e AS (SELECT a.stream, greatest(a.frame, b.frame) AS newest, least(a.frame, b.frame) AS oldest, a.id AS src, b.id AS dst,
             (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) + (a.frame - b.frame) * (a.frame - b.frame) AS w
      FROM p a JOIN p b ON a.stream = b.stream AND a.id < b.id AND abs(a.frame - b.frame) < 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25),
f AS (SELECT DISTINCT stream, frame FROM d),
g AS (SELECT e.stream, f.frame, src, dst, w, row_number() OVER (PARTITION BY e.stream, f.frame ORDER BY w, src, dst) AS r
      FROM e JOIN f ON e.stream = f.stream AND newest <= f.frame AND oldest > f.frame - 3),
b0 AS (SELECT stream, frame, src, dst, r FROM g UNION ALL SELECT stream, frame, dst, src, r FROM g
       UNION ALL SELECT stream, frame, id, id, 0 FROM (SELECT DISTINCT stream, frame, unnest([src, dst]) AS id FROM g)), """ + _SQUARED + """
SELECT stream, frame, src AS p, dst AS q, w::BIGINT AS w FROM g JOIN b7 USING (stream, frame, src, dst, r)""")
def stream_spanning_forests(spark, sf):
    """Events of a type are a stream, days are its frames."""
    e = frames.event_stream(spark, sf)
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    dots = e.select(F.col("event_type").alias("stream"), day.alias("frame"), F.col("event_id").alias("id"), F.floor("value").cast("int").alias("x"), (F.col("user_id") % 150).cast("int").alias("y"))
    return frames.run_once(forest.spanning_forests(dots), "append", forest.ROCKS)
