"""Aggregations over points, images and groups: one grouped aggregate each, combined map-side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], v: str, most: int = 4, central: bool = True) -> DataFrame:
    """Mean and population moments 2 ... ``most`` per key, about the mean or about zero."""
    by = Window.partitionBy(*keys)
    base = df.withColumn("_m", F.avg(v).over(by) if central else F.lit(0.0))
    powers = [F.avg(F.pow(F.col(v) - F.col("_m"), F.lit(float(k)))).alias(f"m{k}") for k in range(2, most + 1)]
    return base.groupBy(*keys).agg(F.avg(v).alias("mean"), *powers)


def scatter(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates n, cx, cy, sxx, syy, sxy (population)."""
    return [
        F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"),
    ]


def principal_axes(df: DataFrame) -> DataFrame:
    """Adds ``laxis, saxis`` (variances along the axes) and ``theta`` (long axis, in (-pi/2, pi/2]) from scatter columns, in closed form."""
    root = F.sqrt((F.col("sxx") - F.col("syy")) * (F.col("sxx") - F.col("syy")) + 4 * F.col("sxy") * F.col("sxy"))
    total = F.col("sxx") + F.col("syy")
    level = lambda c: F.when(F.abs(c) < 1e-9, 0.0).otherwise(c)  # noqa: E731  a rounding error mustn't turn the axis around
    theta = F.atan2(level(2 * F.col("sxy")), level(F.col("sxx") - F.col("syy"))) / 2
    return df.withColumns({"laxis": (total + root) / 2, "saxis": (total - root) / 2, "theta": theta})


def covariance_inverse(df: DataFrame) -> DataFrame:
    """Adds ``det, ixx, ixy, iyy`` of the 2 x 2 scatter matrix; null if singular."""
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    safe = F.when(F.abs(det) > 1e-12, det)
    return df.withColumns({"det": det, "ixx": F.col("syy") / safe, "ixy": -F.col("sxy") / safe, "iyy": F.col("sxx") / safe})


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's vectors as (key, dims, n, sums, products of columns i <= j); ``SCATTERS`` keys are held at a time."""
    held: dict = {}

    def made() -> pa.RecordBatch:
        rows = [{"key": k, "dims": d, "n": n, "sums": s.tolist(), "products": m[np.triu_indices(d)].tolist()} for (k, d), (n, s, m) in held.items()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("key", key), ("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))]))

    for batch in batches:
        key = batch["key"].type
        keys, sizes = np.array(batch["key"].to_pylist(), dtype=object), batch["vec"].value_lengths().to_numpy(zero_copy_only=False)
        flat, cuts = batch["vec"].flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes)).astype(np.int64)
        for k, d in {*zip(keys.tolist(), sizes.tolist(), strict=True)}:
            at = np.flatnonzero((sizes == d) & (np.array([x == k for x in keys], bool)))
            x = flat[cuts[at][:, None] + np.arange(int(d))].astype(float)
            n, s, m = held.get((k, int(d)), (0, 0.0, 0.0))
            held[k, int(d)] = (n + len(x), s + x.sum(axis=0), m + x.T @ x)
        if len(held) > SCATTERS:
            yield made()
            held.clear()
    if held:
        yield made()


SCATTERS = 256


def covariance_matrix(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key, i, j, cov`` for i <= j: covariances of all dimensions of the vectors of a key, from scatter matrices that each task makes of its own
    vectors. Null vectors and vectors with null components are left out; vectors of another length are a group of their own by ``dims``."""
    rows = df.where(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull())).select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = rows.mapInArrow(_scatter, f"key {kind}, dims int, n bigint, sums array<double>, products array<double>")
    total = parts.groupBy("key", "dims").agg(F.sum("n").alias("n"))
    sums = parts.select("key", "dims", F.posexplode("sums").alias("i", "s")).groupBy("key", "dims", "i").agg(F.sum("s").alias("s"))
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.col("dims") - 1), lambda i: F.transform(F.sequence(i, F.col("dims") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    products = parts.select("key", "dims", F.explode(F.arrays_zip(places.alias("p"), F.col("products").alias("v"))).alias("e")).groupBy("key", "dims", "e.p.i", "e.p.j").agg(F.sum("e.v").alias("v"))
    a, b = sums.select("key", "dims", "i", F.col("s").alias("si")), sums.select("key", "dims", F.col("i").alias("j"), F.col("s").alias("sj"))
    joined = products.join(a, ["key", "dims", "i"]).join(b, ["key", "dims", "j"]).join(total, ["key", "dims"])
    return joined.select(F.col("key").alias(key), "i", "j", (F.col("v") / F.col("n") - F.col("si") / F.col("n") * (F.col("sj") / F.col("n"))).alias("cov"))


def percentile_threshold(df: DataFrame, keys: list[str], v: str, percent: float, bins: int = 256) -> DataFrame:
    """``threshold`` per key by a histogram: the first bin whose running count passes round(n * percent). If that is bin 0, the
    percentile moves half-way to 1 until it isn't. A constant image gives its value."""
    by = Window.partitionBy(*keys)
    r = df.withColumns({"_lo": F.min(v).over(by), "_hi": F.max(v).over(by)})
    flat = r.where("_hi = _lo").groupBy(*keys).agg(F.first("_lo").alias("threshold"))
    r = r.where("_hi > _lo").withColumn("bin", F.floor((bins - 1) * (F.col(v) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).cast("int"))
    hist = r.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    upto = F.sum("n").over(by.orderBy("bin"))
    hist = hist.withColumns({"upto": upto, "total": F.sum("n").over(by)})
    first = F.max(F.when(F.col("bin") == 0, F.col("n"))).over(by)
    # the first percentile of the series p, 1 - (1 - p) / 2, ... whose target isn't within bin 0
    targets = F.array(*[F.round(F.col("total") * (1 - (1 - percent) / 2**k)) for k in range(40)])
    hist = hist.withColumn("_first", F.coalesce(first, F.lit(0)))
    hist = hist.withColumn("target", F.get(F.filter(targets, lambda t: t >= F.col("_first")), F.lit(0)))
    picked = hist.where(F.col("upto") > F.col("target")).groupBy(*keys).agg(F.min("bin").alias("bin"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    # no bin passes the target (it is the whole count): one past the last
    every = hist.groupBy(*keys).agg(F.first("_lo").alias("lo"), F.first("_hi").alias("hi")).join(picked.select(*keys, "bin"), keys, "left")
    value = F.coalesce("bin", F.lit(bins)) * (F.col("hi") - F.col("lo")) / bins + F.col("lo")
    return every.select(*keys, value.alias("threshold")).unionByName(flat.select(*keys, F.col("threshold").cast("double")))


def kth_smallest(df: DataFrame, keys: list[str], v: str, k: int, tie: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(v, tie))
    return df.withColumn("_n", nth).where(F.col("_n") == k + 1).select(*keys, v)


def bounding_box(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def sum_in_order(value: str, *order: str) -> Column:
    """An aggregate: the sum of doubles taken in the given order, whatever tasks their rows are in, so that sums that tie are the same from run to run.
    Nulls are left out; null without any value. For groups of few rows."""
    held = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))))
    return F.when(F.size(held) > 0, F.aggregate(F.sort_array(held), F.lit(0.0), lambda s, x: s + x["v"]))


def dominant(df: DataFrame, key: str, cand: str, prob: str) -> DataFrame:
    """``key, winner, prob``: the most probable candidate (ties by least candidate), null if the rest mass 1 - sum is larger."""
    g = df.groupBy(key).agg(F.max_by(cand, F.struct(prob, -F.col(cand))).alias("w"), F.max(prob).alias("prob"), (1 - F.sum(prob)).alias("rest"))
    return g.select(key, F.when(F.col("prob") >= F.col("rest"), F.col("w")).alias("winner"), "prob")


def coverage(parts: DataFrame, covered: DataFrame, key: str, on: list[str]) -> DataFrame:
    """``key, coverage``: share of each part's cells that are not covered."""
    n = parts.groupBy(key).agg(F.count("*").alias("n"))
    hit = parts.join(covered.select(*on).distinct(), on, "left_semi").groupBy(key).agg(F.count("*").alias("h"))
    return n.join(hit, key, "left").select(key, (1 - F.coalesce("h", F.lit(0)) / F.col("n")).alias("coverage"))
