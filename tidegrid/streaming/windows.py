"""Window aggregates over unbounded input: an extension, with the engine's own functions.

Windows are tumbling, ``window`` long and aligned to ``start_ms``, and hold the
points that arrived, without gap filling; late points are dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Registry, builtin
from ..plans.errors import BadArgument
from ..plans.nodes import Duration


def aggregate(stream: DataFrame, name: str, window: Duration, *consts: float, start_ms: int = 0, late: str = "10 minutes", functions: Registry | None = None) -> DataFrame:
    """(sid, start, value, confidence) of a stream with columns sid, ts TIMESTAMP and value.

    ``confidence`` is 1 for windows with points, and windows without points are not
    emitted. Works on static frames too.
    """
    kind = {int: "integer", float: "float"}
    f = (functions or builtin()).find(name, ("metric", *(kind[type(c)] for c in consts), "time"))
    if f.kind != "agg":
        raise BadArgument(f"{name} is no window aggregate")
    offset = f"{start_ms % window.ms} milliseconds"
    points = stream.select("sid", "ts", F.col("value").cast("double").alias("value"), F.lit(1.0).alias("confidence"), F.unix_micros("ts").alias("off"))
    slots = points.withWatermark("ts", late).groupBy("sid", F.window("ts", f"{window.ms} milliseconds", f"{window.ms} milliseconds", offset))
    out = slots.agg(f.build(*consts).alias("value"), F.avg("confidence").alias("confidence"))
    return out.select("sid", F.col("window.start").alias("start"), "value", "confidence")
