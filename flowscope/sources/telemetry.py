"""Agent telemetry payloads (nested JSON) -> payload rows and heavy-flow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.schema import TELEMETRY


def parse_telemetry(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Typed payloads; unparsable lines are dropped, missing fields take the documented defaults.

    The agent is the payload's own ``agent_ip`` unless the input already carries an ``agent_ip`` column
    (the sender's address).
    """
    others = [c for c in lines.columns if c != text_col]
    schema = T.StructType([*TELEMETRY.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn(
        "_p", F.from_json(F.col(text_col), schema, {"columnNameOfCorruptRecord": "_bad"})
    )
    return _with_defaults(parsed.where(F.col("_p").isNotNull() & F.col("_p._bad").isNull()), others)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return parse_telemetry(spark.read.text(path))


def _with_defaults(parsed: DataFrame, others: list[str]) -> DataFrame:
    agent = [] if "agent_ip" in others else [F.col("_p.agent_ip").alias("agent_ip")]
    zero = lambda path: F.coalesce(F.col(path), F.lit(0)).cast("bigint")
    cards = "_p.hll.summary.cardinalities"
    return parsed.select(
        *others,
        *agent,
        F.col("_p.timestamp").alias("timestamp"),
        F.coalesce("_p.runtime_seconds", F.lit(0.0)).alias("runtime_seconds"),
        zero("_p.flows_processed").alias("flows_processed"),
        F.coalesce("_p.agent_cpu", F.lit(0.0)).alias("agent_cpu"),
        zero("_p.cms.summary.total_bytes").alias("total_bytes"),
        zero("_p.cms.summary.total_packets").alias("total_packets"),
        zero(f"{cards}.unique_src_ips").alias("unique_src_ips"),
        zero(f"{cards}.unique_src_ports").alias("unique_src_ports"),
        zero(f"{cards}.unique_dst_ports").alias("unique_dst_ports"),
        zero(f"{cards}.unique_flows").alias("unique_flows"),
        F.coalesce("_p.hll.summary.diversity_score", F.lit(0.0)).alias("diversity_score"),
        F.col("_p.cms.heavy_hitters_bytes").alias("heavy_flows"),
    )


def heavy_flow_rows(payloads: DataFrame, keep_idle: bool = False) -> DataFrame:
    """Explode the heavy-flow list; ``keep_idle`` keeps a heartbeat as one row with NULL flow fields."""
    others = [c for c in payloads.columns if c != "heavy_flows"]
    burst = F.explode_outer if keep_idle else F.explode
    rows = payloads.select(*others, burst("heavy_flows").alias("_f"))
    return rows.select(
        *others,
        F.col("_f.src_ip").alias("src_ip"),
        F.col("_f.dst_ip").alias("dst_ip"),
        F.coalesce("_f.src_port", F.lit(0)).alias("src_port"),
        F.coalesce("_f.dst_port", F.lit(0)).alias("dst_port"),
        F.coalesce("_f.proto", F.lit("UNKNOWN")).alias("proto"),
        F.coalesce("_f.bytes", F.lit(0)).cast("bigint").alias("bytes"),
    )


def usable_destinations(flows: DataFrame) -> DataFrame:
    """Rows that count towards prefixes and metrics: a destination and a positive volume."""
    return flows.where((F.col("dst_ip") != "") & (F.col("bytes") > 0))
