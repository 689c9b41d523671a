"""Hierarchical prefix heavy hitters and the reports on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import cidr, ipv4_to_long, is_ipv4, mask_length, network_of

LEVELS = (0, 8, 16, 24, 32)


def prefix_sums(flows: DataFrame, levels=LEVELS, ip_col="dst_ip", bytes_col="bytes") -> DataFrame:
    """Bytes of every prefix at every level: ``mask_len, network, bytes`` (network as BIGINT).

    Addresses are summed first (one shuffle of distinct addresses).  The deepest level is that table itself; the upper
    levels are expanded from it and summed with a map-side partial, so the root and other hot prefixes arrive as one
    row per task.  Both branches share the per-address shuffle.
    """
    levels = sorted(set(levels))
    per_ip = (
        flows.where(F.col(bytes_col) > 0)
        .groupBy(F.col(ip_col).alias("ip"))
        .agg(F.sum(bytes_col).cast("bigint").alias("sum"))
        # Tied to the sum so that addresses are validated once each and not per input row below the aggregate.
        .select(ipv4_to_long(F.col("ip")).alias("v"), F.when(is_ipv4(F.col("ip")), F.col("sum")).alias("bytes"))
        .where(F.col("bytes") > 0)
    )
    upper = [k for k in levels if k < 32]
    parts = []
    if upper:
        rungs = F.array(
            *[
                F.struct(F.lit(k).alias("mask_len"), network_of(F.col("v"), k).alias("network"))
                for k in upper
            ]
        )
        parts.append(
            per_ip.select(F.inline(rungs), "bytes")
            .groupBy("mask_len", "network")
            .agg(F.sum("bytes").cast("bigint").alias("bytes"))
        )
    if 32 in levels:
        parts.append(per_ip.select(F.lit(32).alias("mask_len"), F.col("v").alias("network"), "bytes"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def name_prefixes(sums: DataFrame, levels=LEVELS) -> DataFrame:
    """Attach prefix and parent text; only called on rows that survived the threshold."""
    levels = sorted(set(levels))
    name, parent = F.lit(None).cast("string"), F.lit(None).cast("string")
    for above, k in zip([None, *levels], levels):
        at = F.col("mask_len") == k
        name = F.when(at, cidr(F.col("network"), k)).otherwise(name)
        parent = F.when(at, F.lit("") if above is None else cidr(F.col("network"), above)).otherwise(parent)
    return sums.select(name.alias("prefix"), parent.alias("parent"), "mask_len", "bytes")


def hhh_prefixes(flows: DataFrame, threshold: int, levels=LEVELS, ip_col="dst_ip", bytes_col="bytes") -> DataFrame:
    """Prefixes whose traffic reaches the threshold, each with its nearest emitted ancestor.

    Sums never grow downwards, so a prefix at the threshold has all its ancestors at the threshold too, and a plain
    filter equals a pruned top-down search.  Addresses that are not strict IPv4 take no part.
    """
    sums = prefix_sums(flows, levels, ip_col, bytes_col)
    return name_prefixes(sums.where(F.col("bytes") >= threshold), levels)


def parent_check(prefixes: DataFrame) -> DataFrame:
    """Each emitted prefix with its parent's bytes and whether the parent was emitted and is at least as large."""
    above = prefixes.select(F.col("prefix").alias("parent"), F.col("bytes").alias("parent_bytes"))
    joined = prefixes.join(above, "parent", "left")
    ok = (F.col("parent") == "") | F.coalesce(F.col("parent_bytes") >= F.col("bytes"), F.lit(False))
    return joined.select("prefix", "parent", "bytes", "parent_bytes", ok.alias("parent_ok"))


def top_prefixes(prefixes: DataFrame, n: int = 10) -> DataFrame:
    return prefixes.select("prefix", "bytes").orderBy(F.desc("bytes"), "prefix").limit(n)


def top_subnets(prefixes: DataFrame, mask: int = 24, n: int = 15) -> DataFrame:
    """Largest subnets of one mask length."""
    return top_prefixes(prefixes.where(mask_length(F.col("prefix")) == mask), n)


def spray_index(prefixes: DataFrame, topn: int = 20, mask_len: int | None = None) -> DataFrame:
    """One minus the share of the largest among the ``topn`` largest positive prefixes; NULL without any.

    By default nested prefixes take part, so the root is usually the largest; ``mask_len`` keeps a single level.
    """
    pool = prefixes.where(F.col("bytes") > 0)
    if mask_len is not None:
        pool = pool.where(F.col("mask_len") == mask_len)
    largest = pool.orderBy(F.desc("bytes"), "prefix").limit(topn)
    return largest.agg((F.lit(1.0) - F.max("bytes") / F.sum("bytes")).alias("spray_index"))
