"""A table of metric steps that a stream appends to as time buckets close.

Counters are summed, gauges keep their last value, per series and bucket of ``every``; the watermark closes a bucket and
only then is it written, once.  Cumulative counters and their rates are read from the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.operators.series import HOUR
from flowscope.operators.sliced import sliced_running_sum
from flowscope.streaming import sinks

SERIES = ("metric", "label")
EVERY = "5 seconds"


def _steps(rows: DataFrame, series, ts: str, late: str, every: str, value) -> DataFrame:
    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(*series, F.window("_at", every).alias("_w")).agg(value).select(*series, F.col("_w.end").alias("ts"), "value")


def counter_steps(increments: DataFrame, late: str, series=SERIES, ts: str = "ts", value: str = "bytes", every: str = EVERY) -> DataFrame:
    """Increase of each counter in every closed bucket, stamped with the bucket's end (append mode)."""
    return _steps(increments, series, ts, late, every, F.sum(value).cast("bigint").alias("value"))


def gauge_steps(samples: DataFrame, late: str, series=SERIES, ts: str = "ts", value: str = "value", every: str = EVERY) -> DataFrame:
    """Last value of each gauge in every closed bucket (append mode)."""
    return _steps(samples, series, ts, late, every, F.max_by(value, ts).alias("value"))


def append_steps(steps: DataFrame, folder: str, series=SERIES, every: str | None = None):
    """Starts the sink; a retried micro-batch writes its steps over, and old epochs are merged into one table."""
    return sinks.start(steps, folder, "append", keys=[*series, "ts"], every=every)


def read_steps(spark: SparkSession, folder: str, series=SERIES) -> DataFrame:
    return sinks.read_latest(spark, folder, [*series, "ts"])


def read_counters(spark: SparkSession, folder: str, series=SERIES, epoch=()) -> DataFrame:
    """Cumulative counters at the end of every bucket in which they grew; ``epoch`` names columns at whose change they
    restart (not called ``epoch``: the sink has a column of that name)."""
    steps = read_steps(spark, folder, (*series, *epoch))
    total = sliced_running_sum(steps, [*series, *epoch], "ts", "value", "total", seconds=24 * HOUR)
    return total.select(*series, "ts", F.col("total").cast("bigint").alias("value"))
