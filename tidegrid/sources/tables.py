"""Series over the benchmark tables: three buckets and one event source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Bucket, Catalog, EventSource, slot, tag_key, tags

HOUR, DAY = 3_600_000, 86_400_000


def _between(ts: str, start: int, end: int) -> F.Column:
    """Range of stored timestamps, so that it is pushed down to the scan."""
    stamp = lambda ms: F.expr(f"timestampadd(MILLISECOND, {ms}L, timestamp_ntz'1970-01-01 00:00:00')")
    return (F.col(ts) >= stamp(start)) & (F.col(ts) < stamp(end))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """``events`` and ``shards`` keep the last write of an hour, ``sales`` the sum of a day."""
    out = Catalog(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shard = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))

    def last(path: F.Column):
        def read(start: int, end: int) -> DataFrame:
            rows = events.where(_between("ts", start // HOUR * HOUR, -(-end // HOUR) * HOUR)).select(path.alias("path"), slot("ts", HOUR).alias("idx"), "value", "event_id")
            return rows.groupBy("path", "idx").agg(F.max_by("value", "event_id").alias("value"))

        return read

    one, two = F.array("event_type"), F.array(F.col("event_type"), shard)
    out.add_bucket(Bucket("events", HOUR, last(one), {tag_key("", "type"): 0}), events.select("event_type").distinct().select(one.alias("path"), tags(type=F.col("event_type")).alias("tags")))
    out.add_bucket(Bucket("shards", HOUR, last(two), {tag_key("", "type"): 0, tag_key("", "shard"): 1}), events.select("event_type", shard.alias("shard")).distinct().select(F.array("event_type", "shard").alias("path"), tags(type=F.col("event_type"), shard=F.col("shard")).alias("tags")))
    sold = F.array(F.lit("sales"), F.col("l_returnflag"), F.col("l_linestatus"))

    def sales(start: int, end: int) -> DataFrame:
        rows = items.where(_between("l_shipdate", start // DAY * DAY, -(-end // DAY) * DAY)).select(sold.alias("path"), slot("l_shipdate", DAY).alias("idx"), "l_quantity")
        return rows.groupBy("path", "idx").agg(F.sum("l_quantity").alias("value"))

    out.add_bucket(Bucket("sales", DAY, sales, {tag_key("", "flag"): 1, tag_key("", "status"): 2}), items.select("l_returnflag", "l_linestatus").distinct().select(sold.alias("path"), tags(flag=F.col("l_returnflag"), status=F.col("l_linestatus")).alias("tags")))
    out.events["events"] = EventSource("events", events, "ts", "props", {"event_type": "event_type", "user_id": "user_id", "value": "value"})
    return out
