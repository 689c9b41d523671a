"""Counter deltas from a stream of snapshots, with the newest polls of each key as keyed state.

A key is an agent's flow; its state is the totals of its newest polls, found by key.  A micro-batch reads and writes the
state of its own keys only, whatever else is stored, and an event-time timer removes keys that are not seen any more.
A row emits its own delta and that of the next poll if it is known already, so a poll that spans micro-batches or comes
late corrects what was emitted before; results are read as the newest row of each key and poll.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowscope.session import ship_code
from flowscope.streaming import sinks

KEYS = ("agent_id", "src_ip", "dst_ip", "proto", "src_port", "dst_port")
POLLS = 8

STATE = "polls array<bigint>, total_bytes array<bigint>, total_packets array<bigint>, newest_ms bigint"


def increase(total: int, before: int) -> int:
    """A counter that went down has restarted."""
    return total - before if total >= before else total


class CounterState(StatefulProcessor):
    """Totals of a key's newest polls, until ``keep_ms`` after the last of them."""

    def __init__(self, polls: int, keep_ms: int):
        self.polls, self.keep_ms = polls, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.totals.get()
        known = {p: (b, n) for p, b, n in zip(*stored[:3], strict=True)} if stored else {}
        newest_ms = stored[3] if stored else 0
        batch: dict[int, tuple[int, int]] = {}
        for r in rows:  # of rows for one poll in a micro-batch the largest counts
            batch[r.poll_id] = max(batch.get(r.poll_id, (-1, -1)), (r.total_bytes, r.total_packets))
            newest_ms = max(newest_ms, r.at_ms)
        newest = max((*known, *batch))
        fresh = {p: t for p, t in batch.items() if p > newest - self.polls and known.get(p) != t}
        known.update(fresh)
        out = []
        for p in sorted({*fresh, *(p + 1 for p in fresh)} & known.keys()):
            before = known.get(p - 1, (0, 0))
            b, n = (increase(total, old) for total, old in zip(known[p], before, strict=True))
            out.append(Row(**dict(zip(KEYS, key, strict=True)), poll_id=p, bytes=b, packets=n))
        if not stored:
            self.handle.registerTimer(newest_ms + self.keep_ms)
        if fresh or newest_ms != stored[3]:
            kept = sorted(p for p in known if p >= newest - self.polls)  # one more, for the delta of the oldest
            self.totals.update((kept, [known[p][0] for p in kept], [known[p][1] for p in kept], newest_ms))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stored = self.totals.get()
        if stored:  # a key has one timer; it is set anew if the key was seen since
            if stored[3] + self.keep_ms > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(stored[3] + self.keep_ms)
            else:
                self.totals.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_deltas(snapshots: DataFrame, at: str, late: str, keep_ms: int, polls: int = POLLS) -> DataFrame:
    """(key, poll_id, bytes, packets) of a stream of snapshots, corrections included.

    ``at``: the time of a row's poll; rows more than ``late`` behind the newest are dropped, as are those ``polls`` or
    more behind their key's newest poll.  ``keep_ms``: how long after its last poll a key is remembered; it has to be at
    least the time between two polls.  A key that was forgotten or missed a poll starts from zero.  Rows without a poll,
    time or totals are ignored.  Update mode, RocksDB.
    """
    ship_code(snapshots.sparkSession)
    timed = snapshots.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    whole = timed.select(*KEYS, "at", F.unix_millis("at").alias("at_ms"),
                         *[F.col(c).cast("bigint").alias(c) for c in ("poll_id", "total_bytes", "total_packets")])
    whole = whole.where("at is not null and poll_id is not null and total_bytes is not null and total_packets is not null")
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    fields = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    return whole.groupBy(*KEYS).transformWithState(
        statefulProcessor=CounterState(polls, keep_ms), outputStructType=f"{fields}, poll_id bigint, bytes bigint, packets bigint",
        outputMode="update", timeMode="eventTime",
    )


def read_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Deltas with new bytes, as corrected last."""
    return sinks.read_latest(spark, folder, [*KEYS, "poll_id"]).where("bytes > 0")
