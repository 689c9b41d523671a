"""JSON documents built from the analytics.

A document holds totals and bounded lists only.  Lists that grow with the data (scanners, prefixes) are written as
further documents of the same shape, one entry each, so no group is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.hashing import CmsSpec, HllSpec
from flowscope.operators.countmin import cms_build_metrics, cms_heavy_hitters, cms_mass, metric_sketch
from flowscope.operators.detect import port_scanners_hll
from flowscope.functions.net import flow_key
from flowscope.operators.loglog import (
    cardinalities,
    dimension_registers,
    diversity_score,
    hll_build,
    hll_count,
    sketch_memory,
)
from flowscope.operators.rollup import top_flows_per_batch


def summary_document(flows: DataFrame, asof: str, top: int = 20, scanner_threshold: int = 20, private: bool = True,
                     cms: CmsSpec = CmsSpec(), hll: HllSpec = HllSpec()) -> DataFrame:
    """Summary as JSON lines ``part, document``: one head, then one document per port scanner."""
    sketch = cms_build_metrics(flows, cms)
    hitters = cms_heavy_hitters(flows, sketch, top, "bytes").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("estimate")).alias("o"), "flow"))).alias("l")
    ).select(
        F.transform("l", lambda x: F.struct(x["flow"].alias("flow"), (-x["o"]).alias("bytes"))).alias("v")
    )
    totals = flows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("packets"), F.lit(0)).alias("p")).alias("v"))
    mass = cms_mass(metric_sketch(sketch, "bytes"))
    head = cardinalities(dimension_registers(flows, hll)).select(F.struct("*").alias("cards"))
    head = head.select(
        "cards", totals.scalar().alias("t"), mass.scalar().alias("mass"), hitters.scalar().alias("hh")
    )
    document = F.to_json(
        F.struct(
            F.lit(asof).alias("timestamp"),
            F.col("t.n").alias("flows_processed"),
            F.lit(private).alias("privacy_enabled"),
            F.struct(
                F.col("mass").alias("total_bytes"), F.col("t.p").alias("total_packets"),
                F.col("hh").alias("heavy_hitters_bytes"),
            ).alias("cms"),
            F.struct(F.col("cards").alias("cardinalities")).alias("hll"),
        )
    )
    scanner = F.struct(F.col("src_ip").alias("ip"), "unique_ports")
    listed = port_scanners_hll(flows, scanner_threshold).select(
        F.lit("scanner").alias("part"),
        F.to_json(
            F.struct(F.lit(asof).alias("timestamp"), F.struct(F.array(scanner).alias("port_scanners")).alias("hll"))
        ).alias("document"),
    )
    return head.select(F.lit("head").alias("part"), document.alias("document")).unionByName(listed)


def summary_record(flows: DataFrame, asof: str, started: str, batch: str = "batch_ts", private: bool = True,
                   cms: CmsSpec = CmsSpec(), hll: HllSpec = HllSpec()) -> DataFrame:
    """The full summary of both sketches and of the run, as one row.

    A sketch's total is its mass: the bytes sketch takes three keys per flow.  Unique flows are exact on the Count-Min
    side and estimated on the other.
    """
    memory = sketch_memory(flows, cms, hll).select(F.struct("cms_bytes", "hll_bytes", "tracked_src_ips", "tracked_services").alias("v"))
    totals = flows.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("b"),
        F.coalesce(F.sum("packets"), F.lit(0)).cast("bigint").alias("p"), F.countDistinct(flow_key()).alias("flows"),
        F.countDistinct(batch).alias("batches"),
    ).alias("v"))
    cards = diversity_score(cardinalities(dimension_registers(flows, hll)))
    row = cards.select("*", totals.scalar().alias("t"), memory.scalar().alias("m"))
    seconds = (F.unix_micros(F.lit(asof).cast("timestamp")) - F.unix_micros(F.lit(started).cast("timestamp"))) / F.lit(1e6)
    return row.select(
        F.lit(asof).alias("timestamp"), seconds.alias("runtime_seconds"), F.col("t.n").alias("flows_processed"),
        F.col("t.batches").alias("batches_processed"), F.lit(private).alias("privacy_enabled"),
        F.lit("count_min_sketch").alias("cms_type"), (F.col("t.b") * 3).alias("cms_total_bytes"), F.col("t.p").alias("cms_total_packets"),
        F.col("t.flows").alias("cms_unique_flows"), F.col("m.cms_bytes").alias("cms_memory_bytes"), F.lit(cms.width).alias("width"),
        F.lit(cms.depth).alias("depth"), F.lit("hyperloglog").alias("hll_type"), *cards.columns,
        F.col("t.n").alias("hll_total_flows"), F.col("t.b").alias("hll_total_bytes"), F.col("t.p").alias("hll_total_packets"),
        F.col("m.hll_bytes").alias("hll_memory_bytes"), F.col("m.tracked_src_ips").alias("tracked_src_ips"),
        F.col("m.tracked_services").alias("tracked_services"),
    )


GAUGES = {"agent_cpu": "agent_cpu", "hll_unique_flows": "unique_flows", "hll_unique_src_ips": "unique_src_ips"}


def gauge_rows(payloads: DataFrame, agent: str = "agent_id", ts: str = "poll_id") -> DataFrame:
    """Gauges of every payload as ``metric, label, ts, value`` rows, ready to be scraped or stored."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in GAUGES.items()]))
    return payloads.select(F.col(agent).alias("label"), F.col(ts).alias("ts"), each).select("metric", "label", "ts", "value")


def agent_gauges(payloads: DataFrame, agent: str = "agent_id", ts: str = "poll_id") -> DataFrame:
    """The newest value of every gauge and agent."""
    return gauge_rows(payloads, agent, ts).groupBy("metric", "label").agg(F.max_by("value", "ts").alias("value"))


def save_metrics(rows: DataFrame, path: str) -> None:
    """Appends ``metric, label, ts, value`` rows to a Parquet table partitioned by metric."""
    rows.select("metric", "label", "ts", "value").write.mode("append").partitionBy("metric").parquet(path)


def agent_payload(flows: DataFrame, cpu: DataFrame, k: int = 20, by=("agent_id", "poll_id"),
                  spec: CmsSpec = CmsSpec()) -> DataFrame:
    """One telemetry payload row per agent poll: totals, top flows, cardinalities, diversity.

    ``cpu`` has one row per agent poll, so an idle poll still yields a payload (a heartbeat with an empty list).
    """
    by = list(by)
    totals = flows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flows_processed"),
        F.sum("bytes").cast("bigint").alias("total_bytes"),
        F.sum("packets").cast("bigint").alias("total_packets"),
        F.countDistinct("src_ip").alias("unique_src_ips"),
        F.countDistinct("src_port").alias("unique_src_ports"),
        F.countDistinct("dst_port").alias("unique_dst_ports"),
    )
    unique = hll_count(hll_build(flows, "flow_id", HllSpec(12, "B"), by), "unique_flows")
    fields = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "bytes"]
    listed = top_flows_per_batch(flows, k, by).groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])
        ).alias("heavy_flows")
    )
    joined = cpu.join(totals, by, "left").join(unique, by, "left").join(listed, by, "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    counted = ["flows_processed", "total_bytes", "total_packets", "unique_src_ips", "unique_src_ports",
               "unique_dst_ports", "unique_flows"]
    rows = joined.select(*by, "agent_cpu", *[zero(c) for c in counted], F.coalesce("heavy_flows", F.array()).alias("heavy_flows"))
    return rows.withColumn(
        "diversity_score", F.col("unique_flows") / F.greatest(F.lit(1), F.col("flows_processed"))
    ).withColumn("width", F.lit(spec.width)).withColumn("depth", F.lit(spec.depth))


def payload_json(payloads: DataFrame, agent="agent_id", stamp="timestamp") -> DataFrame:
    """Payload rows as telemetry JSON text in column ``value``."""
    return payloads.select(F.to_json(_payload_struct(agent, F.col(stamp))).alias("value"))


def _cms_struct():
    return F.struct(
        F.struct(
            F.lit("count_min_sketch").alias("type"), "total_bytes", "total_packets",
            F.struct("width", "depth").alias("dimensions"),
        ).alias("summary"),
        F.col("heavy_flows").alias("heavy_hitters_bytes"),
    ).alias("cms")


def _hll_struct():
    cards = F.struct("unique_src_ips", "unique_src_ports", "unique_dst_ports", "unique_flows")
    return F.struct(
        F.struct(F.lit("hyperloglog").alias("type"), cards.alias("cardinalities"), "diversity_score").alias("summary")
    ).alias("hll")


def _payload_struct(agent, stamp):
    return F.struct(
        F.col(agent).alias("agent_ip"), stamp.alias("timestamp"), "flows_processed",
        F.lit(1).alias("batches_processed"), "agent_cpu", _cms_struct(), _hll_struct(),
    )


def payload_documents(payloads: DataFrame, agent="agent_id") -> DataFrame:
    """One push document per payload."""
    delta = F.aggregate(
        "heavy_flows", F.lit(0).cast("bigint"), lambda acc, f: acc + F.coalesce(f["bytes"], F.lit(0))
    )
    whole = F.struct(F.col(agent).alias("agent_ip"), "agent_cpu", delta.alias("total_bytes_delta"), _cms_struct(), _hll_struct())
    return payloads.select(F.to_json(whole).alias("document"))


def push_document(payloads: DataFrame, prefixes: DataFrame, agent="agent_id") -> DataFrame:
    """Push documents as JSON lines ``part, document``: one per payload, one per heavy prefix."""
    pushed = payload_documents(payloads, agent).select(F.lit("payload").alias("part"), "document")
    hitters = prefixes.select(
        F.lit("prefix").alias("part"),
        F.to_json(F.struct(F.array(F.struct("prefix", "parent", "bytes")).alias("heavy_hitters"))).alias("document"),
    )
    return pushed.unionByName(hitters)
