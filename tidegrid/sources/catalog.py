"""Where series and events come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import UnknownBucket

#: Between a namespace and a key in the tag map, and between parts of a series' identity.
MARK = "\x01"


def tag_key(ns: str, key: str) -> str:
    return f"{ns}{MARK}{key}"


def _millis(ts: str) -> str:
    """Of fields of the timestamp: a difference of timestamps would go by the session's zone."""
    return f"(unix_date(cast({ts} as date)) * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + cast(extract(SECOND FROM {ts}) * 1000 as bigint))"


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(_millis(ts))


def slot(ts: str, resolution_ms: int) -> Column:
    """Index of a timestamp's point in a series of the given resolution."""
    step = int(resolution_ms)
    return F.expr(f"({_millis(ts)} - pmod({_millis(ts)}, {step}L)) div {step}L")


@dataclass(frozen=True)
class Bucket:
    """Points of one resolution.

    ``read(start_ms, end_ms)`` gives (path ARRAY<STRING>, idx BIGINT, value DOUBLE),
    unique by (path, idx), for a range of time; it should filter on stored columns,
    so that the range reaches the scan. Filters on ``path`` are added by the engine,
    also those of tags that are parts of the path: ``parts`` says which part a tag is.
    """

    name: str
    resolution_ms: int
    read: Callable[[int, int], DataFrame]
    parts: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class EventSource:
    """Events with a timestamp column, a JSON column, and typed columns for top-level keys."""

    name: str
    frame: DataFrame
    ts: str
    payload: str
    columns: dict[str, str] = field(default_factory=dict)


@dataclass
class Catalog:
    """``series``: (collection, bucket, path, tags MAP<STRING,STRING>), one row a series."""

    spark: SparkSession
    series: DataFrame | None = None
    buckets: dict[str, Bucket] = field(default_factory=dict)
    events: dict[str, EventSource] = field(default_factory=dict)
    collections: dict[str, list[str]] = field(default_factory=dict)

    def collection(self, name: str) -> list[Bucket]:
        """Buckets that a collection has series in."""
        if name not in self.collections:
            raise UnknownBucket(name)
        return [self.bucket(b) for b in self.collections[name]]

    def bucket(self, name: str) -> Bucket:
        if name not in self.buckets:
            raise UnknownBucket(name)
        return self.buckets[name]

    def event_source(self, name: str) -> EventSource:
        if name not in self.events:
            raise UnknownBucket(name)
        return self.events[name]

    def add_bucket(self, bucket: Bucket, series: DataFrame, collection: str | None = None) -> None:
        """``series``: (path, tags) of the bucket's series."""
        rows = series.select(F.lit(collection or bucket.name).alias("collection"), F.lit(bucket.name).alias("bucket"), "path", "tags")
        self.buckets[bucket.name] = bucket
        self.collections.setdefault(collection or bucket.name, []).append(bucket.name)
        self.series = rows if self.series is None else self.series.unionByName(rows)


def tags(**pairs: Column) -> Column:
    """Tag map of the default namespace."""
    return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(tag_key("", k)), v)))


def write_store(root: str, bucket: str, resolution_ms: int, collection: str, points: DataFrame, series: DataFrame) -> None:
    """Keep a bucket as Parquet: points by bucket, sorted by series and time within files, so row groups prune."""
    key = F.array_join("path", MARK)
    points.select("path", "idx", "value").repartition(key).sortWithinPartitions("path", "idx").write.mode("overwrite").parquet(f"{root}/points/bucket={bucket}")
    series.select(F.lit(collection).alias("collection"), "path", "tags", F.lit(resolution_ms).cast("long").alias("resolution_ms")).write.mode("overwrite").parquet(f"{root}/series/bucket={bucket}")


def open_store(spark: SparkSession, root: str) -> Catalog:
    """A catalog over what write_store kept."""
    out = Catalog(spark)
    listed = spark.read.parquet(f"{root}/series")
    out.series = listed.select("collection", "bucket", "path", "tags")
    for r in listed.select("collection", F.col("bucket").cast("string"), "resolution_ms").distinct().collect():
        name, step = r.bucket, r.resolution_ms
        out.collections.setdefault(r.collection, []).append(name)

        def read(start: int, end: int, name=name, step=step) -> DataFrame:
            points = spark.read.parquet(f"{root}/points").where(F.col("bucket") == name)
            return points.where((F.col("idx") >= start // step) & (F.col("idx") < -(-end // step))).select("path", "idx", "value")

        out.buckets[name] = Bucket(name, step, read)
    return out
