"""Detectors over flows: port scanners and service popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.loglog import KEYED, hll_build, hll_count


def port_scanners(flows: DataFrame, threshold: int = 50) -> DataFrame:
    """Sources with at least ``threshold`` distinct destination ports, exact.

    The distinct aggregate shuffles (source, port) pairs after a map-side distinct, so a hot source is spread by port.
    """
    counts = flows.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("unique_ports"))
    return counts.where(F.col("unique_ports") >= threshold).orderBy(F.desc("unique_ports"), "src_ip")


def port_scanners_hll(flows: DataFrame, threshold: int = 50, spec=KEYED) -> DataFrame:
    """The same from one small HyperLogLog per source."""
    counts = hll_count(hll_build(flows, "dst_port", spec, ("src_ip",)), "unique_ports")
    return counts.where(F.col("unique_ports") >= threshold).orderBy(F.desc("unique_ports"), "src_ip")


def popular_services(flows: DataFrame, top_n: int = 10) -> DataFrame:
    """Destination ports with the most distinct clients, exact."""
    counts = flows.groupBy("dst_port").agg(F.countDistinct("src_ip").alias("unique_clients"))
    return counts.orderBy(F.desc("unique_clients"), "dst_port").limit(top_n)


def popular_services_hll(flows: DataFrame, top_n: int = 10, spec=KEYED) -> DataFrame:
    counts = hll_count(hll_build(flows, "src_ip", spec, ("dst_port",)), "unique_clients")
    return counts.orderBy(F.desc("unique_clients"), "dst_port").limit(top_n)
