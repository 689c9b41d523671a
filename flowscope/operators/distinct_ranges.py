"""Distinct counts of any time interval from stored sketches.

Values are sketched once per time slot.  Slots are merged in pairs, pairs in pairs again, and so on: level ``k`` holds a
sketch for every aligned run of 2^k slots.  An interval of n slots is the union of at most 2 log2(n) of these runs, so it
is answered from a few stored sketches instead of from its rows.  Tables of later data are added by merging.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.operators.sliced import time_slice

LG_K = 12
LEVELS = 16
BLOCK = 8  # log2 of the slots whose intervals are answered together
STEP = 3  # exact counts are summed over runs of every third level


class RangeSketches(NamedTuple):
    """(by, level, slot, sketch) with the shape that tables must share to be merged."""

    table: DataFrame
    lg_k: int
    levels: int
    by: tuple = ()


def build_ranges(rows: DataFrame, value, ts="ts", seconds: int = 3600, by=(), lg_k: int = LG_K, levels: int = LEVELS) -> RangeSketches:
    """Sketches of ``value`` for every slot of ``seconds`` and every aligned run of 2^1 to 2^``levels`` slots.

    Rows are sketched per slot before anything is merged, partially in the task that reads them; the runs are made of
    those small sketches.  Rows without a time or value count for nothing.
    """
    value = F.col(value) if isinstance(value, str) else value
    placed = rows.select(*by, time_slice(ts, seconds).alias("slot"), value.alias("_value")).where("slot is not null and _value is not null")
    slots = placed.groupBy(*by, "slot").agg(F.hll_sketch_agg("_value", F.lit(lg_k)).alias("sketch"))
    # neighbours in one task: their runs are merged there, and leave it as one sketch each
    slots = slots.repartition(*by, F.call_function("shiftright", "slot", F.lit(BLOCK)))
    runs = slots.select(*by, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "slot", "sketch")
    runs = runs.withColumn("slot", F.call_function("shiftright", "slot", "level"))
    return RangeSketches(_merged(runs, by), lg_k, levels, tuple(by))


def _merged(runs: DataFrame, by) -> DataFrame:
    return runs.groupBy(*by, "level", "slot").agg(F.hll_union_agg("sketch").alias("sketch"))


def merge_ranges(*tables: RangeSketches) -> RangeSketches:
    """The sketches of all rows of several tables; other shapes are refused."""
    first = tables[0]
    if any(t[1:] != first[1:] for t in tables):
        raise ValueError("range sketches of different shapes cannot be merged")
    runs = first.table
    for t in tables[1:]:
        runs = runs.unionByName(t.table)
    return first._replace(table=_merged(runs, first.by))


def runs_of(lo: Column, hi: Column, levels: int) -> Column:
    """The aligned runs (level, slot) whose union is the slots ``lo`` to ``hi`` - 1."""
    kind = "array<struct<level:int,slot:bigint>>"
    start = F.struct(lo.cast("bigint").alias("l"), hi.cast("bigint").alias("r"), F.array().cast(kind).alias("runs"))

    def step(state: Column, level: Column) -> Column:
        # an end inside a pair takes its half run; what is left are whole pairs
        left = (state["l"] < state["r"]) & (F.pmod(state["l"], F.lit(2)) == 1)
        after = F.when(left, state["l"] + 1).otherwise(state["l"])
        right = (after < state["r"]) & (F.pmod(state["r"], F.lit(2)) == 1)
        before = F.when(right, state["r"] - 1).otherwise(state["r"])
        one = lambda slot: F.array(F.struct(level.alias("level"), slot.alias("slot")))
        none = F.array().cast(kind)
        runs = F.concat(state["runs"], F.when(left, one(state["l"])).otherwise(none), F.when(right, one(before)).otherwise(none))
        half = lambda c: F.call_function("shiftright", c, F.lit(1))
        return F.struct(half(after).alias("l"), half(before).alias("r"), runs.alias("runs"))

    def finish(state: Column) -> Column:
        whole = F.when(state["l"] < state["r"], F.sequence(state["l"], state["r"] - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.concat(state["runs"], F.transform(whole, lambda s: F.struct(F.lit(levels).alias("level"), s.alias("slot"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, finish)


def relative_error(lg_k: int, deviations: float = 3.0) -> float:
    """What the estimate's relative error exceeds only at so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def _spans(intervals: DataFrame, key: str, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
    """(key, _lo, _hi) of every key with one interval, null if that is empty; the rows of keys with several different ones."""
    whole = F.coalesce(F.col(lo) < F.col(hi), F.lit(False))
    ends = intervals.select(F.col(key).alias("_key"), *[F.when(whole, F.col(c)).cast("bigint").alias(n) for c, n in ((lo, "_lo"), (hi, "_hi"))])
    of_key = ends.groupBy("_key").agg(*[f(c).alias(f"{c}{n}") for c in ("_lo", "_hi") for f, n in ((F.min, ""), (F.max, "_most"))])
    several = F.coalesce((F.col("_lo") != F.col("_lo_most")) | (F.col("_hi") != F.col("_hi_most")), F.lit(False))
    one = of_key.where(~several).select(F.col("_key").alias(key), "_lo", "_hi")
    return one, intervals.join(of_key.where(several).select("_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def distinct_in(ranges: RangeSketches, intervals: DataFrame, key: str = "id", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(by, key, runs, estimate) for every interval of ``intervals``: slots ``lo`` up to but not including ``hi``.

    ``runs`` is the number of stored runs an interval is made of.  Intervals in which nothing was seen have estimate 0
    without groups, and no row with groups; ones that are empty, reversed or have a null end are empty.  Several
    intervals of one key count as their union, with the most runs of one of them.
    """
    one, several = _spans(intervals, key, lo, hi)
    found = _estimates(ranges, one.where("_lo is not null").select("_lo", "_hi").distinct())
    runs = F.when(F.col("_lo").isNull(), F.lit(0)).otherwise(F.size(runs_of(F.col("_lo"), F.col("_hi"), ranges.levels)))
    alone = one.join(found, ["_lo", "_hi"], "inner" if ranges.by else "left").select(
        *ranges.by, key, runs.cast("bigint").alias("runs"), F.coalesce("_estimate", F.lit(0)).cast("bigint").alias("estimate"))

    whole = F.coalesce(F.col(lo) < F.col(hi), F.lit(False))
    parts = F.when(whole, runs_of(F.col(lo), F.col(hi), ranges.levels)).otherwise(F.array().cast("array<struct<level:int,slot:bigint>>"))
    asked = several.select(F.col(key), parts.alias("_runs"))
    each = asked.select(key, F.size("_runs").cast("bigint").alias("runs"), F.inline_outer("_runs"))
    met = each.join(ranges.table, ["level", "slot"], "inner" if ranges.by else "left")
    estimate = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint")
    return alone.unionByName(met.groupBy(*ranges.by, key).agg(F.max("runs").alias("runs"), estimate.alias("estimate")))


def _estimates(ranges: RangeSketches, pairs: DataFrame) -> DataFrame:
    """(by, _lo, _hi, _estimate) for distinct intervals in which something was seen.

    Intervals whose first and last slots are in the same blocks of 2^``BLOCK`` slots are made of the same few runs: those
    are sent once to each pair of blocks, at most 2^(BLOCK + 1) and the longer ones between, and no sketch to an interval.
    """
    at = ["_from", "_to"]
    block = lambda c: F.call_function("shiftright", c, F.lit(BLOCK))
    placed = pairs.select(block(F.col("_lo")).alias("_from"), block(F.col("_hi") - 1).alias("_to"), "_lo", "_hi")
    needed = placed.select(*at, F.inline(runs_of(F.col("_lo"), F.col("_hi"), ranges.levels))).distinct()
    shift = lambda c, n: F.call_function("shiftleft", c, n)
    pair = F.call_function("shiftright", "slot", F.lit(1))
    whole_pair = F.col("level") < ranges.levels
    run = F.struct(
        shift(F.col("slot"), F.col("level")).alias("lo"), shift(F.col("slot") + 1, F.col("level")).alias("hi"),
        F.when(whole_pair, shift(pair, F.col("level") + 1)).alias("pair_lo"),
        F.when(whole_pair, shift(pair + 1, F.col("level") + 1)).alias("pair_hi"), "sketch")
    stored = needed.join(ranges.table, ["level", "slot"]).select(*ranges.by, *at, run.alias("_run")).repartition(*at)
    sketches = stored.groupBy(*ranges.by, *at).agg(F.collect_list("_run").alias("_stored"))
    asked = placed.groupBy(*at).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_asked"))

    def estimate(ask: Column) -> Column:
        inside = lambda a, b: (ask["_lo"] <= a) & (b <= ask["_hi"])
        # the largest runs inside, as runs_of takes them
        taken = lambda r: inside(r["lo"], r["hi"]) & ~F.coalesce(inside(r["pair_lo"], r["pair_hi"]), F.lit(False))
        merged = F.aggregate(F.filter("_stored", taken), F.lit(None).cast("binary"),
                             lambda all_, r: F.coalesce(F.hll_union(all_, r["sketch"]), r["sketch"]))
        return F.struct(ask["_lo"].alias("_lo"), ask["_hi"].alias("_hi"), F.hll_sketch_estimate(merged).alias("_estimate"))

    return sketches.join(asked, at).select(*ranges.by, F.inline(F.transform("_asked", estimate))).where("_estimate is not null")


def exact_in(rows: DataFrame, value, intervals: DataFrame, ts="ts", seconds: int = 3600, levels: int = LEVELS, key: str = "id",
             lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, exact): the same from the rows; for checks of the estimate.

    A value counts once in an interval: at its first slot there, which is the one whose slot before lies before the
    interval.  So values are counted by (slot, slot before), and no interval meets its values one by one.  In the union
    of several different intervals of one key that does not hold; only these are joined with the values.
    """
    value = F.col(value) if isinstance(value, str) else value
    one, several = _spans(intervals, key, lo, hi)
    seen = rows.select(time_slice(ts, seconds).alias("_slot"), value.alias("_value")).where("_slot is not null and _value is not null")
    slots = seen.groupBy("_value").agg(F.sort_array(F.collect_set("_slot")).alias("_slots"))
    found = _first_seen(slots, one.where("_lo is not null").select("_lo", "_hi").distinct(), levels)
    alone = one.join(found, ["_lo", "_hi"]).select(key, "exact")

    some = several.where(F.col(lo) < F.col(hi))
    # one row, null without such intervals: then nothing below is dealt out
    span = F.broadcast(some.agg(F.min(lo).alias("_first"), F.max(hi).alias("_end")))
    near = slots.select("_value", F.explode("_slots").alias("_slot")).join(span, (F.col("_slot") >= F.col("_first")) & (F.col("_slot") < F.col("_end")))
    runs = near.select("_value", "_slot", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    runs = runs.select("_value", "level", F.call_function("shiftright", "_slot", "level").alias("slot")).distinct()
    asked = some.select(key, F.inline(runs_of(F.col(lo), F.col(hi), levels)))
    joined = asked.join(runs, ["level", "slot"]).groupBy(key).agg(F.countDistinct("_value").alias("exact"))
    met = alone.unionByName(joined)
    return intervals.select(key).join(met, key, "left").select(key, F.coalesce("exact", F.lit(0)).alias("exact"))


def _first_seen(slots: DataFrame, pairs: DataFrame, levels: int) -> DataFrame:
    """(_lo, _hi, exact): for distinct intervals, how many values have one of their ``_slots`` (sorted) inside.

    Counts by (slot, slot before) are summed over runs of 8^k slots, and within a run over the slots before.  An interval
    needs the sums of its runs at its own start; a run has at most one row for each slot before and for each start.
    """
    down = lambda c, n: F.call_function("shiftright", c, n)
    seen = slots.select(F.inline(F.transform("_slots", lambda s, i: F.struct(s.alias("_slot"), (F.get("_slots", i - 1) + 1).alias("_after")))))
    counts = seen.groupBy("_slot", "_after").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_slot", "_after", "_n", F.explode(F.sequence(F.lit(0), F.lit(levels), F.lit(STEP))).alias("level"))
    counts = counts.groupBy("level", down("_slot", "level").alias("slot"), "_after").agg(F.sum("_n").alias("_n"))
    counts = counts.withColumn("_ends", F.lit(None).cast("array<bigint>"))

    asked = pairs.select("_lo", "_hi", F.inline(runs_of(F.col("_lo"), F.col("_hi"), levels)))
    rest = F.col("level") % STEP
    first, end = [F.call_function("shiftleft", F.col("slot") + n, rest) for n in (0, 1)]
    asked = asked.select("_lo", "_hi", (F.col("level") - rest).alias("level"), F.explode(F.sequence(first, end - 1)).alias("slot"))
    asked = asked.groupBy("level", "slot", F.col("_lo").alias("_after")).agg(F.lit(0).cast("bigint").alias("_n"), F.collect_list("_hi").alias("_ends"))
    # values never seen before (null) come first; those last seen just before the start are its peers in the order
    until = W.partitionBy("level", "slot").orderBy("_after")
    summed = counts.unionByName(asked).withColumn("_n", F.sum("_n").over(until)).where("_ends is not null")
    ends = summed.select(F.col("_after").alias("_lo"), F.explode("_ends").alias("_hi"), "_n")
    return ends.groupBy("_lo", "_hi").agg(F.sum("_n").alias("exact"))


def save_ranges(ranges: RangeSketches, path: str) -> None:
    """Writes a new table, one folder per level; an existing one is never written over."""
    shape = {"lg_k": F.lit(ranges.lg_k), "levels": F.lit(ranges.levels)}
    ranges.table.withColumns(shape).write.mode("error").partitionBy("level").parquet(path)


def load_ranges(spark, path: str, lg_k: int = LG_K, levels: int = LEVELS, by=()) -> RangeSketches:
    """Reads a stored table; one of another shape makes the query fail."""
    stored = spark.read.parquet(path)
    same = (F.col("lg_k") == lg_k) & (F.col("levels") == levels)
    sketch = F.when(same, F.col("sketch")).otherwise(F.raise_error(F.lit("stored range sketches have another shape")))
    return RangeSketches(stored.select(*by, "level", "slot", sketch.alias("sketch")), lg_k, levels, tuple(by))
