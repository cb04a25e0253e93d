"""Selectors: series by path, glob or tags, read as gap-filled points."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import nodes as n
from ..plans.unparse import expression
from ..plans.errors import NoSeries
from ..sources.catalog import MARK, Bucket, Catalog, tag_key
from .frame import Frame

#: Points of a series that one task fills by itself; longer ranges are filled in blocks.
FILL_BLOCK = 1 << 15


def identity(bucket: str) -> Column:
    """A series by bucket and path, as text."""
    return F.array_join(F.concat(F.array(F.lit(bucket)), F.col("path")), MARK)


def label() -> Column:
    """The path (or group) part of an identity, dotted."""
    return F.replace(F.regexp_replace("sid", f"^[^{MARK}]*{MARK}?", ""), F.lit(MARK), F.lit("."))


def path_test(path: tuple[str | None, ...]) -> Column:
    """Equal length, and equal parts where the pattern has no star. Reaches the scan where parts are stored columns."""
    test = F.size("path") == len(path)
    for i, p in enumerate(path):
        if p is not n.STAR:
            test = (F.get("path", F.lit(i)) == p) & test
    return test


def tag(t: n.Tag) -> Column:
    return F.col("tags")[tag_key(t.ns, t.key)]


def tag_test(w) -> Column:
    """A tag predicate. A series without the tag meets neither = nor !=."""
    if isinstance(w, n.Both):
        left, right = tag_test(w.left), tag_test(w.right)
        return left & right if w.op == "and" else left | right
    value = tag(w.tag)
    if w.op == "exists":
        return value.isNotNull()
    return value == w.value if w.op == "=" else value != w.value  # a missing tag makes it null, which doesn't pass


def tag_test_of_path(w, parts: dict[str, int]) -> Column | None:
    """What a tag predicate asks of a path whose parts hold tags: a necessary condition, or none."""
    if isinstance(w, n.Both):
        both = [tag_test_of_path(x, parts) for x in (w.left, w.right)]
        known = [t for t in both if t is not None]
        if w.op == "and":
            return known[0] & known[1] if len(known) == 2 else known[0] if known else None
        return both[0] | both[1] if len(known) == 2 else None
    part = parts.get(tag_key(w.tag.ns, w.tag.key))
    if part is None or w.op == "exists":
        return None
    value = F.get("path", F.lit(part))
    return value == w.value if w.op == "=" else value != w.value


def select(catalog: Catalog, of: n.Get | n.Lookup, tags: Iterable[n.Tag], need_tags: bool) -> list[tuple[Bucket, DataFrame, Column | None]]:
    """(bucket, series, test on paths) of a selector. ``tags`` have to exist."""
    if isinstance(of, n.Get):
        bucket = catalog.bucket(of.bucket)
        test = path_test(of.path)
        if of.glob or need_tags:
            series = catalog.series.where((F.col("bucket") == of.bucket) & test)
        else:  # an exact series is known without the catalog; where it has no points it is all gap
            series = catalog.spark.range(1).select(F.array(*map(F.lit, of.path)).alias("path"), F.lit(None).cast("map<string,string>").alias("tags"))
        return [(bucket, series, test)]
    out = []
    for bucket in catalog.collection(of.collection):
        series = catalog.series.where((F.col("collection") == of.collection) & (F.col("bucket") == bucket.name))
        test = None
        if of.path is not None:
            test = path_test(of.path)
            series = series.where(test)
        if of.where is not None:
            series = series.where(tag_test(of.where))
            known = tag_test_of_path(of.where, bucket.parts)
            if known is not None:
                test = known if test is None else test & known
        for t in tags:
            series = series.where(tag(t).isNotNull())
        out.append((bucket, series, test))
    return out


def read(catalog: Catalog, of: n.Get | n.Lookup, start_ms: int, end_ms: int, shift: int = 0, tags: Iterable[n.Tag] = (), need_tags: bool = False, check: bool = True, block: int | None = None) -> list[Frame]:
    """Frames of a selector, one for each bucket it reaches."""
    out = []
    found = select(catalog, of, tags, need_tags)
    for bucket, series, test in found:
        rms = bucket.resolution_ms
        lo, hi = (start_ms - shift) // rms, (end_ms - shift) // rms
        many = max(0, hi - lo)
        series = series.select(identity(bucket.name).alias("sid"), "path", "tags")
        points = bucket.read(lo * rms, hi * rms).where((F.col("idx") >= lo) & (F.col("idx") < hi))
        if test is not None:
            points = points.where(test)
        points = points.select(identity(bucket.name).alias("sid"), (F.col("idx") - lo).alias("off"), F.col("value").cast("double").alias("value"))
        if isinstance(of, n.Lookup) and (of.where is not None or tags):
            points = points.join(series.select("sid"), "sid", "left_semi")
        out.append(Frame(filled(series.select("sid"), points, many, block or FILL_BLOCK), series, rms, start_ms // rms * rms, many))
    if check and (isinstance(of, n.Lookup) or of.glob):
        if all(f.series.isEmpty() for f in out):
            raise NoSeries(expression(of))
        if len(out) > 1:
            out = [f for f in out if not f.series.isEmpty()]
    return out


def filled(series: DataFrame, points: DataFrame, many: int, block: int) -> DataFrame:
    """Every offset of every series; gaps take the last value (0.0 before the first) with confidence 0.

    The grid and the points meet in one exchange by series. A range of more than
    ``block`` offsets is dealt by (series, block) instead, and each block gets the
    last value before it from a table with one row a block; so a single long series
    is spread over tasks.
    """
    if not many:
        grid = series.select("sid", F.lit(0).cast("long").alias("off")).where(F.lit(False))
    else:
        grid = series.select("sid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("off"))
    both = grid.select("sid", "off", F.lit(None).cast("double").alias("value")).unionByName(points)
    if many <= block:
        slots = both.repartition("sid").groupBy("sid", "off").agg(F.max("value").alias("value"))
        before = Window.partitionBy("sid").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return slots.select("sid", "off", F.coalesce(F.last("value", ignorenulls=True).over(before), F.lit(0.0)).alias("value"), F.when(F.col("value").isNull(), 0.0).otherwise(1.0).alias("confidence"))
    cut = both.withColumn("blk", F.expr(f"off div {block}L"))
    slots = cut.repartition("sid", "blk").groupBy("sid", "blk", "off").agg(F.max("value").alias("value"))
    ends = slots.groupBy("sid", "blk").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("off"))).alias("last"))
    earlier = Window.partitionBy("sid").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("sid", "blk", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    before = Window.partitionBy("sid", "blk").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slots.join(carry, ["sid", "blk"]).select("sid", "off", F.coalesce(F.last("value", ignorenulls=True).over(before), F.col("carry"), F.lit(0.0)).alias("value"), F.when(F.col("value").isNull(), 0.0).otherwise(1.0).alias("confidence"))
