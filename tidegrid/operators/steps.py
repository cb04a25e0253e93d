"""Operators that keep series apart: windows, transforms, differences, histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.registry import Function
from ..plans.errors import BadArgument
from .frame import Frame, Histograms
from .scan import FILL_BLOCK


def window(f: Frame, function: Function, consts: tuple, ms: int) -> Frame:
    """One point of each run of ``ms`` // resolution points, counted from the start of the query.

    A last window with fewer points is emitted. Where no point qualifies the value
    is null and the confidence 0, else the confidence is the mean.
    """
    count = max(1, ms // f.rms)
    value = function.build(*consts)
    out = f.points.groupBy("sid", F.expr(f"off div {count}L").alias("win")).agg(value.alias("value"), F.avg("confidence").alias("confidence"))
    out = out.select("sid", F.col("win").alias("off"), "value", F.when(F.col("value").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"))
    return f.with_points(out, rms=f.rms * count, n=-(-f.n // count))


def transform(f: Frame, function: Function, consts: tuple) -> Frame:
    return f.with_points(f.points.select("sid", "off", function.build(*consts).alias("value"), "confidence"))


def derivate(f: Frame) -> Frame:
    """value - value before; the first point takes the second's. One point alone: null.

    Long series are joined with themselves one offset on, so that no task needs a
    whole series.
    """
    if f.n <= FILL_BLOCK:
        w = Window.partitionBy("sid").orderBy("off")
        change = F.coalesce(F.col("value") - F.lag("value").over(w), F.lead("value").over(w) - F.col("value"))
        return f.with_points(f.points.select("sid", "off", change.alias("value"), "confidence"))
    earlier = f.points.select("sid", (F.col("off") + 1).alias("off"), F.col("value").alias("was"))
    later = f.points.where("off = 1").select("sid", F.lit(0).cast("long").alias("off"), F.col("value").alias("next"))
    both = f.points.join(earlier, ["sid", "off"], "left").join(later, ["sid", "off"], "left")
    return f.with_points(both.select("sid", "off", F.coalesce(F.col("value") - F.col("was"), F.col("next") - F.col("value")).alias("value"), "confidence"))


def histogram(f: Frame, top: int, digits: int, ms: int) -> Histograms:
    """Bucket counts of each full window; a last window with fewer points is not emitted.

    Values are rounded. Buckets hold as many units as keep ``digits`` significant
    digits. Values below 0 or above ``top`` are not recorded.
    """
    if not 1 <= digits <= 5:
        raise BadArgument("significant digits must be 1 to 5")
    if top < 2:
        raise BadArgument("highest trackable value must be 2 at least")
    half = (2 * 10**digits - 1).bit_length() - 1
    count = max(1, ms // f.rms)
    many = f.n // count
    v = F.round("value").cast("long")
    rows = f.points.where(F.col("off") < many * count).select("sid", F.expr(f"off div {count}L").alias("off"), v.alias("v"))
    rows = rows.withColumn("v", F.when((F.col("v") >= 0) & (F.col("v") <= top), F.col("v")))
    width = F.greatest(F.lit(0), F.length(F.bin("v")) - 1 - half)
    rows = rows.withColumn("unit", F.pow(F.lit(2.0), width).cast("long"))
    out = rows.groupBy("sid", "off", (F.expr("v div unit") * F.col("unit")).alias("lo"), "unit").agg(F.count("v").alias("cnt"))
    return Histograms(out, f.series, f.rms * count, f.start_ms, many)


def statistic(h: Histograms, which: str, p: float | None) -> Frame:
    """One point of each histogram, 0 where nothing was recorded; confidence 1."""
    middle = F.col("lo") + F.expr("unit div 2")
    n = F.sum("cnt")
    if which in ("median", "percentile"):
        p = 50.0 if which == "median" else float(p)
        if not 0 <= p <= 100:
            raise BadArgument("percentile must be 0 to 100")
        whole = Window.partitionBy("sid", "off")
        ranked = h.points.select("sid", "off", "lo", "unit", F.sum("cnt").over(whole.orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run"), F.sum("cnt").over(whole).alias("all"))
        wanted = F.greatest(F.lit(1).cast("long"), F.floor(F.col("all") * F.lit(p / 100) + F.lit(0.5)))
        value = F.min(F.when(F.col("run") >= wanted, F.col("lo") + F.col("unit") - 1))
        out = ranked.groupBy("sid", "off").agg(value.alias("value"))
    else:
        mean = F.try_divide(F.sum(F.col("cnt") * middle), n)
        square = F.try_divide(F.sum(F.col("cnt") * middle * middle), n)
        value = {"min": F.min("lo"), "max": F.max(F.col("lo") + F.col("unit") - 1), "mean": mean, "stddev": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))}[which]
        out = h.points.groupBy("sid", "off").agg(value.alias("value"))
    out = out.select("sid", "off", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.lit(1.0).alias("confidence"))
    return Frame(out, h.series, h.rms, h.start_ms, h.n)
