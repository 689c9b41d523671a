"""Flow rollups, totals and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.functions.net import flow_key

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]


def packet_rollup(packets: DataFrame, length_col: str = "wire_len", by=()) -> DataFrame:
    """Packets -> flows: bytes, packet count, first and last seen per 5-tuple."""
    return packets.groupBy(*by, *FIVE_TUPLE).agg(
        F.sum(length_col).cast("bigint").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def flow_rollup(flows: DataFrame, by=()) -> DataFrame:
    """Flow observations -> one row per 5-tuple; partial aggregation happens before the shuffle."""
    return flows.groupBy(*by, *FIVE_TUPLE).agg(
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("packets").cast("bigint").alias("packets"),
        F.count(F.lit(1)).alias("observations"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def traffic_totals(flows: DataFrame, batch_col: str = "batch_ts", by=()) -> DataFrame:
    """Running totals: flows, bytes, packets and non-empty batches."""
    return flows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flows_processed"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum("packets"), F.lit(0)).cast("bigint").alias("total_packets"),
        F.countDistinct(batch_col).alias("batches_processed"),
    )


def traffic_counters(flows: DataFrame, by=()) -> DataFrame:
    """Byte counters: total, per protocol, per destination port and per destination address, in one pass.

    Every row is expanded into its four series before the partial aggregate, so one shuffle of distinct series
    carries all four counters.  Result: ``metric, label, value``.
    """
    usable = flows.where((F.col("dst_ip") != "") & (F.col("bytes") > 0))
    return counter_rows(usable, *by).groupBy(*by, "metric", "label").agg(F.sum("bytes").cast("bigint").alias("value"))


def counter_rows(flows: DataFrame, *keep: str) -> DataFrame:
    """Each flow as one row per counter series it increments."""
    series = F.array(
        F.struct(F.lit("throughput_bytes").alias("metric"), F.lit("").alias("label")),
        F.struct(F.lit("protocol_bytes").alias("metric"), F.col("proto").alias("label")),
        F.struct(F.lit("port_bytes").alias("metric"), F.col("dst_port").cast("string").alias("label")),
        F.struct(F.lit("dest_bytes").alias("metric"), F.col("dst_ip").alias("label")),
    )
    return flows.select(*keep, "bytes", F.inline(series))


def batch_cardinalities(flows: DataFrame, by=("agent_id", "poll_id")) -> DataFrame:
    """Exact distinct sources, source ports and destination ports of every agent batch."""
    return flows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.countDistinct("src_ip").alias("unique_src_ips"),
        F.countDistinct("src_port").alias("unique_src_ports"),
        F.countDistinct("dst_port").alias("unique_dst_ports"),
    )


def agent_health(samples: DataFrame, agent="agent_id", value="cpu", ts="ts") -> DataFrame:
    """Last CPU value of every agent ever seen, with the fleet maximum and the number of agents."""
    last = agent_last(samples, agent, value, ts)
    fleet = last.agg(F.struct(F.coalesce(F.max("last_cpu"), F.lit(0.0)).alias("max"), F.count(F.lit(1)).alias("n")))
    whole = last.withColumn("_fleet", fleet.scalar())
    return whole.select(
        agent, "last_cpu", F.col("_fleet.max").alias("max_agent_cpu"), F.col("_fleet.n").alias("active_agents")
    )


def agent_last(samples: DataFrame, agent="agent_id", value="cpu", ts="ts") -> DataFrame:
    return samples.groupBy(agent).agg(F.max_by(value, ts).alias("last_cpu"))


def top_flows_per_batch(flows: DataFrame, k: int = 20, by=("agent_id", "poll_id")) -> DataFrame:
    """The ``k`` largest flows of each agent batch.

    Flows are summed first; the rank filter becomes a group limit before the shuffle, so a hot batch sends at most
    ``k`` rows per task to the task that ranks it.
    """
    per_flow = flows.groupBy(*by, *FIVE_TUPLE).agg(F.sum("bytes").cast("bigint").alias("bytes"))
    order = W.partitionBy(*by).orderBy(F.desc("bytes"), *FIVE_TUPLE)
    return per_flow.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_flow_keys(*flow_sets: DataFrame) -> DataFrame:
    """Set union of the flow keys observed in any of the inputs."""
    keys = [f.select(flow_key().alias("flow")) for f in flow_sets]
    merged = keys[0]
    for other in keys[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def flow_listing(rollup: DataFrame, asof, first_seen: str = "first_seen") -> DataFrame:
    """Flows with their age in microseconds at the given instant."""
    age = F.unix_micros(F.lit(asof).cast("timestamp")) - F.unix_micros(F.col(first_seen).cast("timestamp"))
    return rollup.select(*FIVE_TUPLE, "bytes", "packets", age.alias("duration_us"))
