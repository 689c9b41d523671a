"""Frame table -> packet rows with a 5-tuple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import frames as fr
from flowscope.functions.net import protocol_name

MODES = ("v4_any", "v4v6_tcpudp")


def decode_frames(frames: DataFrame, mode: str = "v4_any", frame_col: str = "frame") -> DataFrame:
    """Decode captured frames; inadmissible ones are filtered out.

    ``v4_any`` keeps IPv4 of any protocol; ``v4v6_tcpudp`` keeps IPv4 and IPv6 but only TCP and UDP.
    All other input columns pass through; ``wire_len`` is usually the byte count downstream.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    frame = F.col(frame_col)
    ethertype = fr.uint(frame, fr.ETHERTYPE_AT, 2)
    is_v4 = (ethertype == fr.ETHERTYPE_IPV4) & (F.length(frame) >= 34)
    keep = is_v4
    if mode == "v4v6_tcpudp":
        keep = is_v4 | ((ethertype == fr.ETHERTYPE_IPV6) & (F.length(frame) >= 54))

    header = frames.where(keep).withColumn("_v4", is_v4)
    if mode == "v4_any":
        number = fr.uint(frame, 24, 1)
        l4_at = F.lit(fr.IP_AT) + (fr.uint(frame, fr.IP_AT, 1).bitwiseAND(F.lit(15).cast("bigint")) * 4)
        src, dst = fr.ipv4_text(frame, 27), fr.ipv4_text(frame, 31)
    else:
        ihl = fr.uint(frame, fr.IP_AT, 1).bitwiseAND(F.lit(15).cast("bigint")) * 4
        number = F.when(F.col("_v4"), fr.uint(frame, 24, 1)).otherwise(fr.uint(frame, 21, 1))
        l4_at = F.lit(fr.IP_AT) + F.when(F.col("_v4"), ihl).otherwise(F.lit(40))
        header = header.withColumn("_src6", F.when(~F.col("_v4"), fr.ipv6_digits(frame, 23)))
        header = header.withColumn("_dst6", F.when(~F.col("_v4"), fr.ipv6_digits(frame, 39)))
        src = F.when(F.col("_v4"), fr.ipv4_text(frame, 27)).otherwise(fr.ipv6_text(F.col("_src6")))
        dst = F.when(F.col("_v4"), fr.ipv4_text(frame, 31)).otherwise(fr.ipv6_text(F.col("_dst6")))
    header = header.withColumn("_proto", number.cast("int")).withColumn("_l4", l4_at.cast("int"))
    header = header.where(F.col("_l4") >= fr.IP_AT + 20)
    if mode == "v4v6_tcpudp":
        header = header.where(F.col("_proto").isin(fr.TCP, fr.UDP))
    src_port, dst_port = fr.l4_ports(frame, F.col("_proto"), F.col("_l4"))
    passed = [c for c in frames.columns if c != frame_col]
    return header.select(
        *passed,
        src.alias("src_ip"), dst.alias("dst_ip"),
        src_port.alias("src_port"), dst_port.alias("dst_port"),
        protocol_name(F.col("_proto")).alias("proto"),
    )
