"""Export windows that are anchored at packets: a window starts with the first packet at least ``every`` seconds after
the start of the one before.

A packet's second is all that counts, so each stream's seconds are cut into slices and a slice is a sorted array of
bounded length.  What a slice does to the chain is a function from the earliest second that may start a window to the
same in the next slice; there are only ``every`` values, so the function is a short array.  Functions of neighbouring
slices are composed by pointer doubling: after k rounds a slice's function reaches 2^k slices back, and one that has
become constant is finished.  No stream is walked through in one task, however long or busy it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.operators.rollup import FIVE_TUPLE
from flowscope.operators.sliced import micros
from flowscope.session import written

EXPORT_SECONDS = 30
SLICE_SECONDS = 600


def packet_second(ts) -> Column:
    return F.floor(micros(ts) / F.lit(1_000_000)).cast("bigint")


def same_keys(left: DataFrame, right: DataFrame, keys) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[f"_at_{k}"])
    return match


def _start(second: Column, allowed: Column, every: int) -> Column:
    """The earliest second that may start the next window, after a packet in ``second``."""
    return F.when(second >= allowed, second + every).otherwise(allowed)


def _composed(slices: DataFrame, by) -> DataFrame:
    """Composes each slice's function with those of all slices before it; ``fn[0]`` is the result for a new stream."""
    width = 1
    while True:
        open_ends = (F.col("n") > width) & (F.array_min("fn") != F.array_max("fn"))
        if not slices.where(open_ends).limit(1).count():
            return slices
        earlier = slices.select(*[F.col(k).alias(f"_at_{k}") for k in by], (F.col("n") + width).alias("_n"), F.col("fn").alias("_fn"))
        match = same_keys(slices, earlier, by) & (slices["n"] == earlier["_n"]) & open_ends
        joined = slices.join(earlier, match, "left")
        through = F.transform("_fn", lambda x: F.get("fn", x))
        slices = written(joined.select(*by, "slice", "n", "gap", "seconds", F.coalesce(through, F.col("fn")).alias("fn")), "anchor-slices")
        width *= 2


def anchors(packets: DataFrame, by=("agent_id",), every: int = EXPORT_SECONDS, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(by, slice, starts, carried, following): the window starts of each slice of ``packets`` (by, second), sorted; the
    last one before the slice and the first one after it.
    """
    if slice_seconds < every:
        raise ValueError("a slice has to be at least as long as a window")
    at = F.floor(F.col("second") / slice_seconds).cast("bigint")
    placed = packets.where("second is not null").select(*by, at.alias("slice"), (F.col("second") - at * slice_seconds).cast("int").alias("at"))
    slices = placed.groupBy(*by, "slice").agg(F.sort_array(F.collect_set("at")).alias("seconds"))  # slice_seconds at most
    order = W.partitionBy(*by).orderBy("slice")  # one row a slice
    slices = slices.withColumn("n", F.row_number().over(order))
    gap = F.coalesce(F.lag("slice").over(order) < F.col("slice") - 1, F.lit(True))
    leave = lambda o: F.greatest(F.aggregate("seconds", o, lambda allowed, s: _start(s, allowed, every)) - slice_seconds, F.lit(0))
    own = F.transform(F.sequence(F.lit(0), F.lit(every - 1)), lambda o: leave(F.when(F.col("gap"), F.lit(0)).otherwise(o)))
    slices = written(slices.withColumn("gap", gap).withColumn("fn", own), "anchor-slices")
    done = _composed(slices, by)
    enter = F.when(F.col("gap"), F.lit(0)).otherwise(F.lag(F.get("fn", F.lit(0))).over(order))
    empty = F.array().cast("array<bigint>")
    first = F.struct(F.col("enter").alias("allowed"), empty.alias("starts"))

    def step(state: Column, second: Column) -> Column:
        starts = F.when(second >= state["allowed"], F.concat(state["starts"], F.array(F.col("slice") * slice_seconds + second)))
        return F.struct(_start(second, state["allowed"], every).alias("allowed"), starts.otherwise(state["starts"]).alias("starts"))

    walked = done.withColumn("enter", enter).select(*by, "slice", F.aggregate("seconds", first, step, lambda s: s["starts"]).alias("starts"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    return walked.select(
        *by, "slice", "starts",
        F.last(F.array_max("starts"), ignorenulls=True).over(before).alias("carried"),
        F.first(F.array_min("starts"), ignorenulls=True).over(after).alias("following"),
    )


def with_anchors(flows: DataFrame, by=("agent_id",), ts: str = "ts", every: int = EXPORT_SECONDS,
                 slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``flows`` with ``window_start`` and ``window_end`` in epoch seconds; the end is null in a stream's last window.

    Rows without a time have no window and are left out.
    """
    timed = flows.withColumn("_second", packet_second(ts)).where("_second is not null")
    timed = timed.withColumn("_slice", F.floor(F.col("_second") / slice_seconds).cast("bigint"))
    found = anchors(timed.select(*by, F.col("_second").alias("second")).distinct(), by, every, slice_seconds)
    found = found.select(*[F.col(k).alias(f"_at_{k}") for k in by], F.col("slice").alias("_of"), "starts", "carried", "following")
    met = timed.join(found, same_keys(timed, found, by) & (timed["_slice"] == found["_of"]))
    started = F.filter("starts", lambda s: s <= F.col("_second"))
    later = F.filter("starts", lambda s: s > F.col("_second"))
    return met.select(
        *flows.columns, F.coalesce(F.array_max(started), F.col("carried")).alias("window_start"),
        F.coalesce(F.array_min(later), F.col("following")).alias("window_end"),
    )


def window_sums(windowed: DataFrame, by=("agent_id",), ts: str = "ts", extra=()) -> DataFrame:
    return windowed.groupBy(*by, "window_start", *extra, *FIVE_TUPLE).agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.sum("packets").cast("bigint").alias("packets"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )


def with_times(rows: DataFrame) -> DataFrame:
    times = {c: F.timestamp_seconds(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rows.withColumns(times)


def anchored_windows(flows: DataFrame, by=("agent_id",), ts: str = "ts", every: int = EXPORT_SECONDS,
                     slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Flow rollup of every re-anchored export window, the last ones (with a null end) included."""
    return with_times(window_sums(with_anchors(flows, by, ts, every, slice_seconds), by, ts, ["window_end"]))
