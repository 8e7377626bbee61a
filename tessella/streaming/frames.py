"""Structured Streaming over events: windowed counts, sessions, and the frame-to-frame detector with keyed state.

A frame is a tumbling window of event time; the watermark says when it is closed. State per key is the cells of the last
frame only, so it is as large as one frame and is replaced as frames go by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.plans.storage import new_path


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The events table as a stream of files, with ``ts`` as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def run_once(df: DataFrame, mode: str, store: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result: the last whole table (complete), or all rows emitted (append).

    ``store`` names the state store of this stream; the session's own is set again afterwards.
    """
    spark = df.sparkSession
    out = new_path(spark, "stream")

    def sink(batch: DataFrame, number: int) -> None:
        # overwriting a batch's own folder makes a retry harmless
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    before = spark.conf.get(STORE_KEY, None)
    if store:
        spark.conf.set(STORE_KEY, store)
    try:
        query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if store:
            spark.conf.unset(STORE_KEY) if before is None else spark.conf.set(STORE_KEY, before)
    table = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if mode == "complete":
        last = table.agg(F.max("batch").alias("batch"))
        table = table.join(F.broadcast(last), "batch", "left_semi")
    return table.drop("batch")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("s.start").alias("start"), "n")


def moving_cells(cells: DataFrame, late: bool = False) -> DataFrame:
    """Of a stream of ``frame, x, y`` the cells with nothing at their place in the frame before, per row y.

    State: the number and cells of the row's last frame. Frames of a batch are taken in order; a frame older than the state is late and is
    dropped (``late``: given out as moving). The first frame of a row has no predecessor and gives nothing unless a later one refers to it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, held = state.get if state.exists else (-1, "")
        before = {int(v) for v in held.split(",") if v}
        rows = pd.concat(list(batches)).drop_duplicates(["frame", "x"])
        out = []
        for k, g in rows.sort_values("frame").groupby("frame"):
            now = set(g["x"].astype(int))
            if k < frame or (k == frame and now <= before):
                if late:
                    out += [(k, x, key[0]) for x in sorted(now)]
                continue
            gone = before if k == frame + 1 else set()
            if k > 0:
                out += [(k, x, key[0]) for x in sorted(now - gone)]
            frame, before = int(k), now
        state.update((frame, ",".join(map(str, sorted(before)))))
        yield pd.DataFrame(out, columns=["frame", "x", "y"])

    return cells.groupBy("y").applyInPandasWithState(step, "frame int, x int, y int", "frame int, cells string", "append", GroupStateTimeout.NoTimeout)
