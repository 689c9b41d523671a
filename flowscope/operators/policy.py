"""Time-limited blocklist: rule normalisation, application to traffic, active rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.functions.net import is_ipv4
from flowscope.operators.sliced import micros, time_slice

DEFAULT_TTL, MIN_TTL, MAX_TTL = 60, 1, 3600


def normalize_policy_events(events: DataFrame) -> DataFrame:
    """Accepted rule events with their clamped TTL and expiry.

    Input: ``ts, seq, action, match, ip, ttl_s``.  A block needs match ``src_ip`` (the default) and a valid IPv4; an
    unblock only the address.  Unblocks have no TTL and no expiry.
    """
    block = F.col("action") == "block"
    ttl = F.least(F.greatest(F.coalesce("ttl_s", F.lit(DEFAULT_TTL)), F.lit(MIN_TTL)), F.lit(MAX_TTL)).cast("bigint")
    accepted = (block & (F.coalesce("match", F.lit("src_ip")) == "src_ip")) | (F.col("action") == "unblock")
    rules = events.where(accepted & is_ipv4(F.col("ip"))).select(
        "ts", "seq", "action", "ip", F.when(block, ttl).alias("ttl_s")
    )
    expiry = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_s"))
    return rules.withColumn("expiry", expiry)


def rule_intervals(rules: DataFrame, max_ttl: int = MAX_TTL) -> DataFrame:
    """Disjoint spans in which each block rule is in force: ``ip, from_us, until_us, next_us``.

    In force from its own instant, up to and including its expiry, and before the next event of the same address
    (the last write wins).  A TTL is at most ``max_ttl``, so only events within that time matter: events are cut into
    slices of that length and also copied one slice back, which keeps an address with many rules out of one task.
    """
    own = time_slice("ts", max_ttl)
    placed = rules.select(
        "ip", "seq", micros("ts").alias("from_us"), micros("expiry").alias("until_us"), own.alias("_own"),
        F.explode(F.array(own, own - 1)).alias("_slice"),
    )
    w = W.partitionBy("ip", "_slice").orderBy("from_us", "seq")
    spans = placed.withColumn("next_us", F.lead("from_us").over(w))
    return spans.where((F.col("_slice") == F.col("_own")) & F.col("until_us").isNotNull()).select(
        "ip", "from_us", "until_us", "next_us"
    ).where(F.col("next_us").isNull() | (F.col("next_us") > F.col("from_us")))


def policy_apply(traffic: DataFrame, rules: DataFrame, ip_col="src_ip", ts="ts", max_ttl: int = MAX_TTL) -> DataFrame:
    """Traffic with ``dropped``: true when a rule for its source is in force at its instant.

    Spans of one address are disjoint and short, so the as-of lookup is an equality join on (address, time slice) with
    a range condition: at most one match per row, no window over an address's whole traffic, and a hot address is
    spread over its slices, where the adaptive skew join can split it further.
    """
    unit = max_ttl * 1_000_000
    spans = rule_intervals(rules, max_ttl)
    last = F.least(F.col("until_us"), F.coalesce(F.col("next_us"), F.col("until_us")))
    cut = lambda c: F.floor(c / F.lit(unit)).cast("bigint")
    spans = spans.select(
        F.col("ip").alias("_ip"), "from_us", "until_us", "next_us",
        F.explode(F.sequence(cut(F.col("from_us")), cut(last))).alias("_rslice"),
    )
    placed = traffic.withColumn("_us", micros(ts)).withColumn("_tslice", time_slice(ts, max_ttl))
    match = (
        (F.col(ip_col) == F.col("_ip"))
        & (F.col("_tslice") == F.col("_rslice"))
        & (F.col("_us") >= F.col("from_us"))
        & (F.col("_us") <= F.col("until_us"))
        & (F.col("next_us").isNull() | (F.col("_us") < F.col("next_us")))
    )
    return placed.join(spans, match, "left").select(*traffic.columns, F.col("_ip").isNotNull().alias("dropped"))


def policy_dropped(applied: DataFrame) -> DataFrame:
    return applied.where("dropped").drop("dropped")


def policy_passed(applied: DataFrame) -> DataFrame:
    return applied.where("NOT dropped").drop("dropped")


def policy_drops_total(applied: DataFrame, by=()) -> DataFrame:
    return applied.groupBy(*by).agg(F.count_if("dropped").alias("drops_total"))


def active_rules(rules: DataFrame, asof) -> DataFrame:
    """Block rules still in force at an instant, longest remaining time first."""
    now = F.lit(asof).cast("timestamp")
    known = rules.where(micros("ts") <= F.unix_micros(now))
    newest = known.groupBy("ip").agg(F.max_by("expiry", F.struct("ts", "seq")).alias("expiry"))
    left = (micros("expiry") - F.unix_micros(now)) / F.lit(1e6)
    alive = newest.select("ip", left.alias("_left")).where(F.col("_left") > 0)
    return alive.select(
        F.lit("src_ip").alias("match"), "ip", F.bround("_left", 1).alias("expires_in_s")
    ).orderBy(F.desc("expires_in_s"), "ip")
