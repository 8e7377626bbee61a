"""How the driver's tables are seen as dots, pixels, contours, features and graphs.

Each function is a projection or one aggregate over a Parquet scan, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = 32
FRAMES = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, t``: one dot per event; t is the day, x the whole part of the value, y the user modulo 150."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.floor("value").cast("int").alias("x"), (F.col("user_id") % 150).cast("int").alias("y"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("t"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, x, y, v``: a dense GRID x GRID image per day from the table's first to its last; v counts the events of a cell.

    Events are counted first, so that what is completed to the full grid has frames * GRID * GRID rows at most.
    """
    d = dots(spark, sf_dir).where("t IS NOT NULL")
    x, y = F.least((F.col("x") / 16).cast("int"), F.lit(GRID - 1)), (F.col("y") % GRID)
    counted = d.groupBy(F.col("t").alias("frame"), x.alias("x"), y.alias("y")).agg(F.count("*").cast("int").alias("v"))
    days = d.agg(F.min("t").alias("first"), F.max("t").alias("last")).where("first IS NOT NULL")
    cells = days.select(F.explode(F.sequence("first", "last")).alias("frame")).select("frame", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))).alias("cell"))
    empty = cells.select("frame", (F.col("cell") % GRID).alias("x"), F.floor(F.col("cell") / GRID).cast("int").alias("y"), F.lit(0).alias("v"))
    return counted.unionByName(empty).groupBy("frame", "x", "y").agg(F.sum("v").cast("int").alias("v"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contour_id, seq, x, y``: a customer's orders in time; x is the day number, y the price in thousands."""
    o = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(F.col("o_custkey").alias("contour_id"), (F.row_number().over(by) - 1).cast("bigint").alias("seq"), day.cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vec, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, w``: suppliers that sell the same part within an order; w is how rarely (1000 / count)."""
    orders = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    pairs = orders.select("s", F.explode("s").alias("src")).select("src", F.explode(F.filter("s", lambda x: x > F.col("src"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.floor(1000 / F.count("*")).cast("bigint").alias("w"))


#: DuckDB text of the same relations, for oracle queries.
SQL = {
    "dots": "dots AS (SELECT event_id AS id, floor(value)::INT AS x, (user_id % 150)::INT AS y, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t FROM events)",
    "pixels": f"""cells AS (SELECT event_id, least(floor(value)::INT // 16, {GRID - 1}) AS x, ((user_id % 150) % {GRID})::INT AS y,
        date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS frame FROM events),
    pixels AS (SELECT f.frame::INT AS frame, gx.x::INT AS x, gy.y::INT AS y, count(c.event_id)::INT AS v
        FROM (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM cells) f CROSS JOIN range({GRID}) gx(x) CROSS JOIN range({GRID}) gy(y)
        LEFT JOIN cells c ON c.frame = f.frame AND c.x = gx.x AND c.y = gy.y GROUP BY ALL)""",
    "contours": """contours AS (SELECT o_custkey AS contour_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
        date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders)""",
    "features": "features AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)",
    "supply": """li AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
    supply AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, floor(1000 / count(*))::BIGINT AS w FROM li a JOIN li b
        ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)""",
}
