"""Blocklist rules as keyed state with event-time timers: upsert, delete, and one event when a rule ends.

A rule is in force from its own instant up to and including its expiry, and before the next event of its address.  The
state of a key holds the events whose effect is not over yet; a timer at the earliest end wakes the key when the
watermark has passed it, the rules that are over leave the state and are emitted with the reason.  So the state holds
live rules only (and what the lateness still keeps open), however many addresses have been blocked before.

Keys are (address, time slice of the longest TTL).  As in the batch operator an event is also copied one slice back,
where it can end a rule but is never emitted: an address with very many rules is spread over its slices.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowscope.operators.policy import MAX_TTL, rule_intervals
from flowscope.operators.sliced import micros, time_slice
from flowscope.session import ship_code

STATE = "from_us array<bigint>, seq array<bigint>, until_us array<bigint>, block array<boolean>, own array<boolean>, timer_ms bigint"
OUTPUT = "ip string, from_us bigint, end_us bigint, reason string"
EXPIRED, REPLACED, DELETED = "expired", "replaced", "deleted"


def settle(events: list[tuple], upto_us: int) -> tuple[list[tuple], list[tuple]]:
    """(rules that are over at ``upto_us``, events that stay) of one key.

    An event is (from, seq, until, block, own); a block's end is its expiry or the next event, whichever is first.
    Deletions and copies only end earlier rules: they stay until the watermark has reached them.
    """
    ended, kept = [], []
    for i, event in enumerate(events):
        start, _, until, block, own = event
        following = events[i + 1] if i + 1 < len(events) else None
        if not (block and own):
            if start > upto_us:
                kept.append(event)
            continue
        cut = following is not None and following[0] <= until
        end = following[0] if cut else until
        if end > upto_us:
            kept.append(event)
        elif end > start:
            ended.append((start, end, (REPLACED if following[3] else DELETED) if cut else EXPIRED))
    return ended, kept


def next_end(events: list[tuple]) -> int | None:
    """When the first of the key's events is over."""
    starts = [e[0] for e in events] + [None]
    ends = [start if not (block and own) else until if following is None else min(until, following)
            for (start, _, until, block, own), following in zip(events, starts[1:], strict=True)]
    return min(ends, default=None)


class RuleEnds(StatefulProcessor):
    """Keyed by (address, slice): remembers events, emits rules as they end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", STATE)

    def _load(self) -> tuple[list[tuple], int]:
        got = self.live.get() if self.live.exists() else None
        return (list(zip(*got[:5], strict=True)), got[5]) if got else ([], 0)

    def _store(self, events: list[tuple], timer: int) -> None:
        if not events:
            self.live.clear()
            return
        wanted = -(-next_end(events) // 1000)  # the watermark counts milliseconds: not before the end
        if not timer or wanted < timer:
            self.handle.registerTimer(wanted)
            timer = wanted
        self.live.update((*map(list, zip(*events, strict=True)), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, timer = self._load()
        known = {e[:2]: e for e in events}
        for r in rows:  # an event that comes again changes nothing
            known[r.from_us, r.seq] = (r.from_us, r.seq, r.until_us, r.block, r.own)
        self._store(sorted(known.values()), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        events, _ = self._load()
        ended, kept = settle(events, timerValues.getCurrentWatermarkInMs() * 1000)
        self._store(kept, 0)
        return iter([Row(ip=key[0], from_us=a, end_us=b, reason=why) for a, b, why in ended])

    def close(self) -> None:
        pass


def rule_ends(rules: DataFrame, late: str = "10 seconds", max_ttl: int = MAX_TTL) -> DataFrame:
    """(ip, from_ts, end_ts, reason) for every rule of a stream of normalised rule events, once, when it has ended.

    ``reason``: ``expired``, ``replaced`` (by another rule of the address, at that instant) or ``deleted``.  Events more
    than ``late`` behind the newest are dropped; within that time the order of arrival does not matter.  A rule replaced
    in its own instant was never in force.  Of events equal in (ip, ts, seq) the last one counts.  Append mode, RocksDB.
    """
    ship_code(rules.sparkSession)
    own = time_slice("ts", max_ttl)
    placed = rules.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).select(
        "ip", "at", micros("ts").alias("from_us"), F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(micros("expiry"), micros("ts")).alias("until_us"), (F.col("action") == "block").alias("block"),
        own.alias("_own"), F.explode(F.array(own, own - 1)).alias("rule_slice"),
    ).withColumn("own", F.col("_own") == F.col("rule_slice")).drop("_own")
    ended = placed.groupBy("ip", "rule_slice").transformWithState(
        statefulProcessor=RuleEnds(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )
    return ended.select("ip", *_times(), "reason")


def ended_rules(rules: DataFrame, upto, max_ttl: int = MAX_TTL) -> DataFrame:
    """The same rows from a table: the rules that have ended at ``upto``."""
    spans = rule_intervals(rules, max_ttl)
    cut = F.col("next_us").isNotNull() & (F.col("next_us") <= F.col("until_us"))
    by = rules.groupBy(F.col("ip").alias("by_ip"), micros("ts").alias("by_us")).agg(F.min_by("action", "seq").alias("by"))
    ended = spans.withColumn("end_us", F.when(cut, F.col("next_us")).otherwise(F.col("until_us")))
    ended = ended.where(F.col("end_us") <= F.unix_micros(F.lit(upto).cast("timestamp")))
    named = ended.withColumn("cut_us", F.when(cut, F.col("next_us"))).join(by, (F.col("ip") == F.col("by_ip")) & (F.col("cut_us") == F.col("by_us")), "left")
    reason = F.when(F.col("by").isNull(), EXPIRED).when(F.col("by") == "block", REPLACED).otherwise(DELETED)
    return named.select("ip", *_times(), reason.alias("reason"))


def _times():
    return [F.timestamp_micros(f"{side}_us").cast("timestamp_ntz").alias(f"{side}_ts") for side in ("from", "end")]
