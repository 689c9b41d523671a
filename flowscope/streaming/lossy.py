"""Heavy prefixes of a stream in bounded memory: counters that may be too low by a known amount, one set per level.

A level keeps at most ``counters`` prefixes.  The sums of a micro-batch are added to them; if there are more, the largest
sum that has no place is taken off all of them and what falls to zero is forgotten.  The amounts taken off add up to the
level's error: a kept sum is at most that much too low and never too high, a forgotten prefix has at most that much.
As every unit taken off is taken off more than ``counters`` prefixes at once, the error is at most the level's total
divided by ``counters`` + 1, whatever the number of addresses and however the stream is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.operators.prefixes import LEVELS
from flowscope.streaming import sinks
from flowscope.streaming.operators import prefix_sums

COUNTERS = 10_000
MERGE_WIDTH = 16
STATE = "mask_len int, network bigint, low bigint, error bigint"


def merge_counters(sums: DataFrame, state: DataFrame | None, counters: int) -> DataFrame:
    """(mask_len, network, low, error) after adding ``sums`` (mask_len, network, bytes); network null holds the error."""
    rows = sums.select(F.col("mask_len").cast("int").alias("mask_len"), F.col("network").cast("bigint").alias("network"), F.col("bytes").alias("low"))
    before = rows.select("mask_len", F.lit(0).cast("bigint").alias("error")).limit(0)
    if state is not None:
        rows = rows.unionByName(state.where("network is not null").select("mask_len", "network", "low"))
        before = state.where("network is null").select("mask_len", "error")
    whole = rows.groupBy("mask_len", "network").agg(F.sum("low").alias("low"))
    # the largest of each level, in two steps: no task sees a whole level
    order = [F.desc("low"), F.asc("network")]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    part = F.pmod(F.xxhash64("network"), F.lit(MERGE_WIDTH))
    first = whole.withColumn("part", part).withColumn("rank", rank("mask_len", "part")).where(F.col("rank") <= counters + 1)
    top = first.withColumn("rank", rank("mask_len")).where(F.col("rank") <= counters + 1)
    level = W.partitionBy("mask_len")  # counters + 1 rows
    cut = F.coalesce(F.max(F.when(F.col("rank") == counters + 1, F.col("low"))).over(level), F.lit(0))
    lowered = top.withColumn("cut", cut)
    kept = lowered.where((F.col("rank") <= counters) & (F.col("low") > F.col("cut"))).select(
        "mask_len", "network", (F.col("low") - F.col("cut")).alias("low"), F.lit(None).cast("bigint").alias("error"))
    errors = lowered.select("mask_len", F.col("cut").alias("error")).distinct().unionByName(before)
    errors = errors.groupBy("mask_len").agg(F.sum("error").alias("error"))
    none = F.lit(None).cast("bigint")
    return kept.unionByName(errors.select("mask_len", none.alias("network"), none.alias("low"), "error"))


def lossy_batch(folder: str, counters: int = COUNTERS, levels=LEVELS):
    """Micro-batch function for ``sinks.start``; the counters after each epoch are its result and the next one's state."""

    def apply(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        state = spark.read.schema(STATE).parquet(f"{folder}/data/epoch={epoch - 1}") if epoch else None
        sinks.remove_epochs(spark, f"{folder}/data", epoch - 3)
        return merge_counters(prefix_sums(batch, levels), state, counters)

    return apply


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """(mask_len, network, low, high) of every prefix with a counter; its bytes lie from ``low`` to ``high``."""
    last = sinks.epochs(spark, f"{folder}/data")[-1]
    state = spark.read.schema(STATE).parquet(f"{folder}/data/epoch={last}")
    errors = state.where("network is null").select("mask_len", F.col("error").alias("level_error"))
    return state.where("network is not null").join(errors, "mask_len").select(
        "mask_len", "network", "low", (F.col("low") + F.col("level_error")).alias("high"))


def maybe_heavy(counters: DataFrame, threshold: int) -> DataFrame:
    """Prefixes that may have ``threshold`` bytes.  None with more than the threshold and its level's error is missing."""
    return counters.where(F.col("high") >= threshold)
