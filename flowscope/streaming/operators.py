"""Streaming forms of the cumulative and windowed operators.

Each function takes a streaming DataFrame and returns the streaming result; ``sinks`` runs it.  Keyed sums and maxima
are partially aggregated before the shuffle, so one dominant key reaches its state task as one row per input task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions.hashing import CmsSpec, HllSpec
from flowscope.functions.net import ipv4_to_long, is_ipv4, network_of
from flowscope.operators.countmin import cms_build, cms_build_metrics
from flowscope.operators.loglog import dimension_registers, hll_build
from flowscope.operators.policy import MAX_TTL, policy_apply
from flowscope.operators.prefixes import LEVELS
from flowscope.operators.rollup import FIVE_TUPLE, counter_rows
from flowscope.operators.sliced import time_slice
from flowscope.streaming import sinks


def flow_windows(flows: DataFrame, every: str = "30 seconds", late: str = "10 minutes", by=("agent_id",)) -> DataFrame:
    """Per-agent flow rollup of every time window, aligned to the epoch.

    In append mode a window is emitted once, when the watermark closes it.  In update mode its newest state is emitted
    with every micro-batch, so the windows that are still open when the stream stops are there too; the watermark
    still drops their state in time.
    """
    timed = flows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rolled = timed.groupBy(F.window("ts", every).alias("w"), *by, *FIVE_TUPLE).agg(
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("packets").cast("bigint").alias("packets"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    return rolled.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *FIVE_TUPLE,
        "bytes", "packets", "first_seen", "last_seen",
    )


def prefix_sums(flows: DataFrame, levels=LEVELS, ip_col="dst_ip") -> DataFrame:
    """Cumulative bytes per prefix over everything seen so far (update mode)."""
    v = ipv4_to_long(F.col(ip_col)).alias("v")
    rungs = F.array(
        *[F.struct(F.lit(k).alias("mask_len"), network_of(F.col("v"), k).alias("network")) for k in sorted(levels)]
    )
    rows = flows.where(is_ipv4(F.col(ip_col)) & (F.col("bytes") > 0)).select(v, "bytes").select("bytes", F.inline(rungs))
    return rows.groupBy("mask_len", "network").agg(F.sum("bytes").cast("bigint").alias("bytes"))


def heavy_prefix_sums(flows: DataFrame, threshold: int, levels=LEVELS) -> DataFrame:
    """Prefixes at or above the threshold; sums only grow, so a prefix never leaves once emitted."""
    return prefix_sums(flows, levels).where(F.col("bytes") >= threshold)


def sketch_cells(flows: DataFrame, key, value, spec: CmsSpec = CmsSpec()) -> DataFrame:
    """Running Count-Min cells; the state is bounded by depth x width."""
    return cms_build(flows, key, value, spec).cells


def sketch_registers(flows: DataFrame, value, spec: HllSpec = HllSpec()) -> DataFrame:
    """Running HyperLogLog registers; the state is bounded by 2^precision."""
    return hll_build(flows, value, spec).table


def sketch_metric_cells(flows: DataFrame, spec: CmsSpec = CmsSpec()) -> DataFrame:
    """Running cells of the bytes, packets and flows sketches; the state is three times depth x width at most."""
    return cms_build_metrics(flows, spec).cells


def sketch_dimension_registers(flows: DataFrame, spec: HllSpec = HllSpec()) -> DataFrame:
    """Running registers of the five cardinality sketches."""
    return dimension_registers(flows, spec).table


def sliding_rate(messages: DataFrame, span: str = "2 seconds", step: str = "1 second", seconds: float = 2.0,
                 late: str = "10 seconds") -> DataFrame:
    """Bytes per second and Mbps of sliding windows."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    summed = timed.groupBy(F.window("ts", span, step).alias("w")).agg(F.sum("bytes").alias("_b"))
    rate = F.col("_b") / F.lit(seconds)
    return summed.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), rate.alias("rate"),
        (rate * 8 / 1e6).alias("mbps"),
    )


def agent_state(messages: DataFrame, agent="agent_id", ts="ts", values=("cpu",)) -> DataFrame:
    """Last value of each gauge per agent."""
    return messages.groupBy(agent).agg(*[F.max_by(v, ts).alias(v) for v in values], F.max(ts).alias("last_ts"))


def counters(flows: DataFrame) -> DataFrame:
    """Running byte counters: total, per protocol, per port and per destination."""
    usable = flows.where((F.col("dst_ip") != "") & (F.col("bytes") > 0))
    return counter_rows(usable).groupBy("metric", "label").agg(F.sum("bytes").cast("bigint").alias("value"))


def new_batches(docs: DataFrame, ts: str, keys=("agent", "timestamp"), late: str = "10 minutes") -> DataFrame:
    """Drop documents already seen within the watermark, before their flows are exploded."""
    return docs.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


RULE_DAY = 24 * 3600


def sliced_rules(rules: DataFrame, max_ttl: int = MAX_TTL) -> DataFrame:
    """Rules with their time slice, and the day that their table is partitioned by."""
    return rules.withColumn("rule_slice", time_slice("ts", max_ttl)).withColumn("rule_day", time_slice("ts", RULE_DAY))


def policy_batch(folder: str, rule_schema, max_ttl: int = MAX_TTL):
    """Per-micro-batch blocklist application against the rules that ``sliced_rules`` wrote to ``folder``.

    A rule is in force for at most ``max_ttl``, one slice: only the slices of the batch and the one before are read, by
    the partition of their day and by row group.  Before the first rule nothing is dropped.  Traffic meets the rules that
    are written when its batch starts; what it must not miss has to be written before, by running the rule stream ahead
    of it.  The rule state lives in that shared table, and the traffic is matched by the same sliced equality join as in
    batch, so a hot source is not one state key.
    """

    def apply(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        added = [T.StructField("rule_slice", T.LongType()), T.StructField("rule_day", T.LongType())]
        if not sinks.exists(spark, f"{folder}/data"):
            return batch.withColumn("dropped", F.lit(False))
        at, day = time_slice("ts", max_ttl), lambda c: time_slice(F.timestamp_seconds(c * max_ttl), RULE_DAY)
        span = batch.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).select(
            "lo", "hi", day(F.col("lo") - 1).alias("first_day"), day(F.col("hi") + 1).alias("last_day")).first()
        if span.lo is None:
            return batch.withColumn("dropped", F.lit(False))
        rules = spark.read.schema(T.StructType([*rule_schema.fields, *added])).parquet(f"{folder}/data")
        live = rules.where(F.col("rule_day").between(span.first_day, span.last_day) & F.col("rule_slice").between(span.lo - 1, span.hi))
        return policy_apply(batch, live.drop("rule_slice", "rule_day", "epoch"), max_ttl=max_ttl)

    return apply
