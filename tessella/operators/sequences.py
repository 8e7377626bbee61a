"""Ordered-sequence operators over ``contour_id, seq, x, y``: windows keyed by the contour, one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by():
    return Window.partitionBy("contour_id").orderBy("seq")


def _all():
    return _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def following(c: str, closed: bool = False) -> Column:
    """The next point's value; of the last point null, or the first point's if the contour is closed."""
    return F.coalesce(F.lead(c).over(_by()), F.first(c).over(_all())) if closed else F.lead(c).over(_by())


def preceding(c: str, closed: bool = False) -> Column:
    return F.coalesce(F.lag(c).over(_by()), F.last(c).over(_all())) if closed else F.lag(c).over(_by())


def with_next(c: DataFrame, closed: bool = False) -> DataFrame:
    return c.withColumns({"nx": following("x", closed), "ny": following("y", closed)})


def polygon_measures(c: DataFrame) -> DataFrame:
    """``contour_id, n, area, perimeter, measure, orientation``: shoelace area (0 below three points), closed perimeter,
    area / perimeter (0 below eight points), and the sign of the turn (+1 against the clock with y up, 0 within 1e-6)."""
    n = with_next(c, True)
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    agg = n.groupBy("contour_id").agg(F.count("*").alias("n"), F.sum(cross).alias("s"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"))
    area = F.when(F.col("n") < 3, 0.0).otherwise(F.abs(F.col("s")) / 2)
    turn = F.when(F.abs(F.col("s")) < 1e-6, 0).otherwise(F.signum("s")).cast("int")
    measure = F.when((F.col("n") < 8) | (F.col("perimeter") == 0), 0.0).otherwise(F.try_divide(area, F.col("perimeter")))
    return agg.select("contour_id", "n", area.alias("area"), "perimeter", measure.alias("measure"), turn.alias("orientation"))


def arc_length(c: DataFrame) -> DataFrame:
    n = with_next(c).where("nx IS NOT NULL")
    return n.groupBy("contour_id").agg(F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("length"))


def turning_angles(c: DataFrame) -> DataFrame:
    """Adds ``angle``: direction by central differences, one-sided at the ends."""
    ax, ay = F.coalesce(F.lag("x").over(_by()), F.col("x")), F.coalesce(F.lag("y").over(_by()), F.col("y"))
    bx, by = F.coalesce(F.lead("x").over(_by()), F.col("x")), F.coalesce(F.lead("y").over(_by()), F.col("y"))
    return c.withColumn("angle", F.atan2(by - ay, bx - ax))


def step_bin(dx: Column, dy: Column) -> Column:
    """One of nine bins: -1, 0, 1 in x and y by half-unit thresholds."""
    sign = lambda d: F.when(d > 0.5, 1).when(d < -0.5, -1).otherwise(0)
    return (sign(dy) + 1) * 3 + sign(dx) + 1


def step_histogram(c: DataFrame) -> DataFrame:
    """``contour_id, bin, n``: counts of steps between following points."""
    n = with_next(c).where("nx IS NOT NULL")
    return n.groupBy("contour_id", step_bin(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("bin")).agg(F.count("*").alias("n"))


def smoothed_distribution(hist: DataFrame, bins: int = 9, eps: float = 1e-3) -> DataFrame:
    """``contour_id, pdf``: (n + eps) / (total + eps * bins) for every bin, as an array."""
    packed = hist.groupBy("contour_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    pdf = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: (F.coalesce(F.try_element_at("m", b), F.lit(0)) + eps) / (F.col("total") + eps * bins))
    return packed.select("contour_id", pdf.alias("pdf"))


def kl_divergence(p: Column, q: Column) -> Column:
    terms = F.zip_with(p, q, lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / b)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def sample_every(c: DataFrame, k: int) -> DataFrame:
    return c.where(F.col("seq") % k == 0)


def sample_count(c: DataFrame, n: int) -> DataFrame:
    """At most n points, evenly by index: those where seq * n passes a multiple of the length."""
    size = F.count("*").over(Window.partitionBy("contour_id"))
    s = c.withColumn("_n", size)
    pick = F.floor(F.col("seq") * n / F.col("_n")) != F.floor((F.col("seq") - 1) * n / F.col("_n"))
    return s.where((F.col("_n") <= n) | pick).drop("_n")


def split_even(c: DataFrame, pieces: int) -> DataFrame:
    """Adds ``piece``: contours cut into runs of equal length (the last may be shorter)."""
    size = F.count("*").over(Window.partitionBy("contour_id"))
    return c.withColumn("piece", F.floor(F.col("seq") / F.ceil(size / pieces)).cast("int"))


def split_at(c: DataFrame, cut: Column) -> DataFrame:
    """Adds ``piece``: a new piece starts at each point where ``cut`` holds (gaps and islands)."""
    return c.withColumn("piece", F.sum(F.when(cut, 1).otherwise(0)).over(_by()).cast("int"))


def drop_repeated_cells(c: DataFrame, size: float) -> DataFrame:
    """Consecutive points of one grid cell become one: ``contour_id, seq, gx, gy``."""
    g = c.withColumns({"gx": F.floor(F.col("x") / size).cast("int"), "gy": F.floor(F.col("y") / size).cast("int")})
    fresh = F.lag("gx").over(_by()).isNull() | (F.lag("gx").over(_by()) != F.col("gx")) | (F.lag("gy").over(_by()) != F.col("gy"))
    return g.withColumn("_f", fresh).where("_f").select("contour_id", "seq", "gx", "gy")


def centred(c: DataFrame) -> DataFrame:
    by = Window.partitionBy("contour_id")
    return c.withColumns({"x": F.col("x") - F.avg("x").over(by), "y": F.col("y") - F.avg("y").over(by)})


def densify(c: DataFrame, step: float) -> DataFrame:
    """``contour_id, seq, k, x, y``: points no further apart than ``step`` along each segment, both ends kept."""
    n = with_next(c)
    gap = F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    parts = F.when(F.col("nx").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(gap / step))).cast("int")
    n = n.withColumn("_n", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b: F.col(a) + F.coalesce((F.col(b) - F.col(a)) * F.col("k") / F.col("_n"), F.lit(0.0))
    return n.select("contour_id", "seq", "k", at("x", "nx").alias("x"), at("y", "ny").alias("y"))


def reversed_sequence(c: DataFrame) -> DataFrame:
    return c.withColumn("seq", F.max("seq").over(Window.partitionBy("contour_id")) - F.col("seq"))


def extract(c: DataFrame, first: int, last: int) -> DataFrame:
    return c.where(F.col("seq").between(first, last)).withColumn("seq", F.col("seq") - first)


def nearest_active(b: DataFrame, key: str, index: str, active: Column) -> DataFrame:
    """Adds ``left, right``: the nearest active index before and after each, round the end of the ring if need be."""
    by = Window.partitionBy(key).orderBy(index)
    at = F.when(active, F.col(index))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.coalesce(F.last(at, True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.last(at, True).over(whole))
    right = F.coalesce(F.first(at, True).over(by.rowsBetween(1, Window.unboundedFollowing)), F.first(at, True).over(whole))
    return b.withColumns({"left": left, "right": right})


def nested(c: DataFrame) -> DataFrame:
    """``contour_id, points``: a ragged list of ordered points per contour."""
    pts = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return c.groupBy("contour_id").agg(F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def unnested(n: DataFrame) -> DataFrame:
    return n.select("contour_id", F.posexplode("points").alias("seq", "p")).select("contour_id", "seq", "p.x", "p.y")
