"""The streaming form of window aggregates gives what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from tidegrid.plans.errors import BadArgument
from tidegrid.plans.nodes import Duration
from tidegrid.streaming.windows import aggregate


def test_stream_and_batch_agree(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    shape = lambda df: df.select(F.col("event_type").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), "value")
    day = Duration(1, "d")
    for name, consts in (("avg", ()), ("count_above", (50.0,)), ("percentile", (0.9,)), ("last_below", (20.0,))):
        batch = aggregate(shape(spark.read.parquet(path)), name, day, *consts)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.rsplit("/", 1)[0] + "/events.parq*")
        query = aggregate(shape(stream), name, day, *consts).writeStream.outputMode("complete").format("memory").queryName(f"s_{name}").start()
        query.processAllAvailable()
        query.stop()
        key = lambda df: sorted((r.sid, r.start, round(r.value, 9) if r.value is not None else None) for r in df.collect())
        assert key(spark.table(f"s_{name}")) == key(batch) and batch.count() > 100


def test_only_window_aggregates(spark):
    with pytest.raises(Exception):
        aggregate(spark.range(1).selectExpr("'a' AS sid", "now() AS ts", "1.0 AS value"), "abs", Duration(1, "d"))
    with pytest.raises((BadArgument, LookupError, Exception)):
        aggregate(spark.range(1).selectExpr("'a' AS sid", "now() AS ts", "1.0 AS value"), "histogram", Duration(1, "d"), 5, 2)
