"""Consolidation of several peers' summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.hashing import HllSpec
from flowscope.functions.net import flow_key, flow_key_endpoints
from flowscope.operators.loglog import Registers, hll_build, hll_count
from flowscope.sources.summaries import scanner_rows


def peer_consolidation(docs: DataFrame) -> DataFrame:
    """Totals over peers; unique flows are the sum of the peers' own estimates."""
    total = lambda path, name: F.coalesce(F.sum(F.coalesce(F.col(path), F.lit(0))), F.lit(0)).cast("bigint").alias(name)  # noqa: E731,E501
    return docs.agg(
        F.countDistinct("peer").alias("active_peers"),
        total("cms.total_bytes", "total_bytes"),
        total("cms.total_packets", "total_packets"),
        total("hll.cardinalities.unique_flows", "flow_count"),
    )


def peer_union(flows: DataFrame, spec: HllSpec = HllSpec(), peer: str = "peer") -> DataFrame:
    """Unique flows over all peers: the sum of the peers' estimates, and the estimate of their union.

    A flow that several peers see counts once in the union: registers are merged by their maximum.
    """
    each = hll_build(flows, flow_key(), spec, (peer,))
    united = Registers(spec, each.table.groupBy("register").agg(F.max("rho").alias("rho")))
    total = hll_count(each).agg(F.coalesce(F.sum("estimate"), F.lit(0)).cast("bigint").alias("summed"))
    return total.select("summed", hll_count(united, "united").scalar().alias("united"))


def top_flows_across_peers(hitters: DataFrame, n: int = 10) -> DataFrame:
    """Largest heavy hitters over all peers; a flow seen by two peers is listed twice."""
    return hitters.select("flow", "bytes", "detected_by").orderBy(F.desc("bytes"), "flow", "detected_by").limit(n)


def ddos_victims(hitters: DataFrame, min_sources: int = 3) -> DataFrame:
    """Destinations that heavy flows reach from at least ``min_sources`` distinct sources.

    One row per victim and attacker, so an attack from any number of sources never becomes a single row.
    """
    src, dst = flow_key_endpoints(F.col("flow"))
    pairs = hitters.select(src.alias("attacker"), dst.alias("victim")).where("attacker <> '' AND victim <> ''")
    pairs = pairs.distinct()
    counts = pairs.groupBy("victim").agg(F.count(F.lit(1)).alias("attackers_count"))
    return pairs.join(counts.where(F.col("attackers_count") >= min_sources), "victim").select(
        "victim", "attackers_count", "attacker"
    )


def scanner_rollcall(docs: DataFrame) -> DataFrame:
    """Every peer's scanners with their origin and the number of distinct scanner addresses."""
    rows = scanner_rows(docs)
    total = rows.agg(F.countDistinct("ip")).scalar()
    return rows.select("origin_peer", "ip", "unique_ports", total.alias("distinct_scanners"))
