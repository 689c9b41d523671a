"""Explicit schemas of the JSON inputs; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_RECORD = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("byte_count", T.LongType()),
    T.StructField("first_seen", T.LongType()),
    T.StructField("last_seen", T.LongType()),
])

FLOW_BATCH = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("flow_count", T.LongType()),
    T.StructField("flows", T.ArrayType(FLOW_RECORD)),
])

COUNTER_ENTRY = T.StructType([
    T.StructField("key", T.ArrayType(T.StringType())),
    T.StructField("value", T.ArrayType(T.StringType())),
])

HEAVY_FLOW = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.StringType()),
    T.StructField("bytes", T.LongType()),
])

TELEMETRY = T.StructType([
    T.StructField("agent_ip", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("runtime_seconds", T.DoubleType()),
    T.StructField("flows_processed", T.LongType()),
    T.StructField("batches_processed", T.LongType()),
    T.StructField("agent_cpu", T.DoubleType()),
    T.StructField("cms", T.StructType([
        T.StructField("summary", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("total_bytes", T.LongType()),
            T.StructField("total_packets", T.LongType()),
            T.StructField("dimensions", T.StructType([
                T.StructField("width", T.IntegerType()),
                T.StructField("depth", T.IntegerType()),
            ])),
        ])),
        T.StructField("heavy_hitters_bytes", T.ArrayType(HEAVY_FLOW)),
    ])),
    T.StructField("hll", T.StructType([
        T.StructField("summary", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("cardinalities", T.StructType([
                T.StructField("unique_src_ips", T.LongType()),
                T.StructField("unique_src_ports", T.LongType()),
                T.StructField("unique_dst_ports", T.LongType()),
                T.StructField("unique_flows", T.LongType()),
            ])),
            T.StructField("diversity_score", T.DoubleType()),
        ])),
    ])),
])

PEER_SUMMARY = T.StructType([
    T.StructField("peer", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("runtime_seconds", T.DoubleType()),
    T.StructField("flows_processed", T.LongType()),
    T.StructField("privacy_enabled", T.BooleanType()),
    T.StructField("cms", T.StructType([
        T.StructField("total_bytes", T.LongType()),
        T.StructField("total_packets", T.LongType()),
        T.StructField("heavy_hitters_bytes", T.ArrayType(T.StructType([
            T.StructField("flow", T.StringType()),
            T.StructField("bytes", T.LongType()),
        ]))),
    ])),
    T.StructField("hll", T.StructType([
        T.StructField("cardinalities", T.StructType([
            T.StructField("unique_src_ips", T.LongType()),
            T.StructField("unique_dst_ips", T.LongType()),
            T.StructField("unique_src_ports", T.LongType()),
            T.StructField("unique_dst_ports", T.LongType()),
            T.StructField("unique_flows", T.LongType()),
        ])),
        T.StructField("port_scanners", T.ArrayType(T.StructType([
            T.StructField("ip", T.StringType()),
            T.StructField("unique_ports", T.LongType()),
        ]))),
    ])),
])

POLICY_EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("ttl_s", T.LongType()),
])
