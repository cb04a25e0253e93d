"""Combiners: all series of the inputs, or of each group, become one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import Function
from ..plans import nodes as n
from ..plans.errors import NoResults, ResolutionConflict
from ..sources.catalog import MARK, tag_key
from .frame import Frame
from .scan import tag


def _aligned(function: Function, frames: list[Frame]) -> int:
    if not frames:
        raise NoResults()
    found = sorted({f.rms for f in frames})
    if len(found) > 1:
        raise ResolutionConflict(function.name, found)
    return min(f.n for f in frames)


def _united(frames: list[Frame], many: int) -> DataFrame:
    """Points of all inputs; ``ord`` orders them by input, then by series."""
    parts = [(f.points.where(F.col("off") < many) if f.n > many else f.points).select("sid", "off", "value", "confidence", F.struct(F.lit(i).alias("input"), F.col("sid").alias("sid")).alias("ord")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, parts)


def combine(function: Function, frames: list[Frame]) -> Frame:
    """Points meet by offset, not by time, so shifted inputs line up; the shortest input ends the result."""
    many = _aligned(function, frames)
    out = _united(frames, many).groupBy("off").agg(function.build().alias("value"), F.avg("confidence").alias("confidence"))
    series = frames[0].series.agg(F.min("path").alias("path"), F.min_by("tags", "path").alias("tags")).select(F.lit("").alias("sid"), "path", "tags")
    first = frames[0]
    return Frame(out.select(F.lit("").alias("sid"), "off", "value", "confidence"), series, first.rms, first.start_ms, many)


def grouped(function: Function, frames: list[Frame], tags: tuple[n.Tag, ...]) -> Frame:
    """One series for each combination of tag values."""
    many = _aligned(function, frames)
    key = F.array_join(F.array(F.lit(""), *map(tag, tags)), MARK)
    series = reduce(DataFrame.unionByName, [f.series for f in frames])
    groups = series.select("sid", key.alias("gid"))
    out = _united(frames, many).join(groups, "sid").groupBy("gid", "off").agg(function.build().alias("value"), F.avg("confidence").alias("confidence"))
    kept = F.create_map(*(x for t in tags for x in (F.lit(tag_key(t.ns, t.key)), tag(t))))
    named = series.select(key.alias("sid"), "path", kept.alias("tags")).groupBy("sid").agg(F.min("path").alias("path"), F.min_by("tags", "path").alias("tags"))
    first = frames[0]
    return Frame(out.select(F.col("gid").alias("sid"), "off", "value", "confidence"), named, first.rms, first.start_ms, many)
