"""Re-anchored export windows of a stream: the windows open at the end of a micro-batch are its state.

The state is one row per stream: where its open window starts.  Rows of a micro-batch that come less than a window's
length after that start belong to the open window, earlier ones too, as they arrive while it is open.  The first row
after them starts a new window, so the rest is the batch operator's work.  Sums of a window that spans micro-batches are
added up when the result is read; ends become known when a later window starts, and are null for what is open at stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.operators.anchors import (
    EXPORT_SECONDS,
    SLICE_SECONDS,
    packet_second,
    same_keys,
    window_sums,
    with_anchors,
    with_times,
)
from flowscope.operators.rollup import FIVE_TUPLE
from flowscope.session import written
from flowscope.streaming import sinks


def anchored_batch(folder: str, by=("agent_id",), ts: str = "ts", every: int = EXPORT_SECONDS, slice_seconds: int = SLICE_SECONDS):
    """Micro-batch function for ``sinks.start``; ``folder`` is the query's own shared folder."""
    by = list(by)

    def apply(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        open_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema if f.name in by) + ", opened bigint"
        if epoch:
            before = spark.read.schema(open_schema).parquet(f"{folder}/state/epoch={epoch - 1}")
        else:
            before = spark.createDataFrame([], open_schema)
        renamed = before.select(*[F.col(k).alias(f"_at_{k}") for k in by], "opened")
        second = packet_second(ts)
        timed = batch.where(F.col(ts).isNotNull())
        known = timed.join(renamed, same_keys(timed, renamed, by), "left").select(*batch.columns, "opened")
        in_open = F.coalesce(second < F.col("opened") + every, F.lit(False))
        held = known.where(in_open).select(*batch.columns, F.col("opened").alias("window_start"), F.lit(None).cast("bigint").alias("window_end"))
        new = with_anchors(known.where(~in_open).drop("opened"), by, ts, every, slice_seconds)
        rows = written(held.unionByName(new), "anchored-rows")
        started = rows.groupBy(*by, "window_start").agg(F.max("window_end").alias("window_end"))
        opened = started.groupBy(*by).agg(F.min("window_start").alias("first"), F.max("window_start").alias("opened"))
        opened.select(*by, "opened").unionByName(before).groupBy(*by).agg(F.max("opened").alias("opened")).write.mode(
            "overwrite").parquet(f"{folder}/state/epoch={epoch}")
        newest = new_starts(rows, renamed, by)
        ends = started.where("window_end is not null").unionByName(newest)
        ends.write.mode("overwrite").parquet(f"{folder}/ends/epoch={epoch}")
        sinks.remove_epochs(spark, f"{folder}/state", epoch - 2)
        return window_sums(rows, by, ts)

    return apply


def new_starts(rows: DataFrame, opened: DataFrame, by) -> DataFrame:
    """(by, window_start, window_end) of windows that were open before and end with the first start of this batch."""
    joined = rows.join(opened, same_keys(rows, opened, by)).where("window_start > opened")
    return joined.groupBy(*by, F.col("opened").alias("start")).agg(F.min("window_start").alias("window_end")).select(
        *by, F.col("start").alias("window_start"), "window_end")


def read_anchored(spark: SparkSession, folder: str, by=("agent_id",)) -> DataFrame:
    """The windows so far; those that are open have a null end."""
    data = spark.read.parquet(f"{folder}/data")
    sums = data.groupBy(*by, "window_start", *FIVE_TUPLE).agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.sum("packets").cast("bigint").alias("packets"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    keys = [*by, "window_start"]
    ends = spark.read.parquet(f"{folder}/ends").select(*[F.col(k).alias(f"_at_{k}") for k in keys], "window_end").distinct()
    return with_times(sums.join(ends, same_keys(sums, ends, keys), "left").select(*sums.columns, "window_end"))
