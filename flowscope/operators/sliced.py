"""Ordered computations that do not put a whole key into one task.

A window partitioned by key alone sends a hot key (or, without keys, the whole table) through one task.  These helpers
cut every key into time slices, compute inside the slice, and hand the state across slice borders in one of two ways:

* bounded look-back (``with_lookback``): rows near the end of a slice are copied into the next one;
* unbounded look-back (``sliced_*``): one summary row per key and slice is chained by a window over the summaries,
  whose number depends on the time span and not on the number of rows, and joined back on (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3600
RANK_BLOCK = 4096


def micros(ts) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def time_slice(ts, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def with_lookback(df: DataFrame, position: Column, width: int, lookback: int) -> DataFrame:
    """Assign rows to slices of ``width`` positions and copy the last ``lookback`` positions into the next slice.

    Adds ``_slice`` and ``_copied``; frames reaching back at most ``lookback`` positions are then exact within
    (key, ``_slice``) for the rows that are not copies.
    """
    if lookback > width:
        raise ValueError("the look-back must fit into one slice")
    own = F.floor(position / F.lit(width)).cast("bigint")
    near_end = position >= (own + 1) * width - lookback
    slices = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_slice", F.explode(slices)).withColumn(
        "_copied", F.col("_slice") != F.col("_own")
    ).drop("_own")


def _carried(df: DataFrame, keys, summary: dict[str, Column], chained) -> DataFrame:
    """Adds ``_carry_<name>``: per (key, slice) summaries chained over the slices of a key by ``chained(column, window)``.

    The chain is a window over one small row per slice; without keys all slices are one partition, whose size is the
    covered time over the slice width and not the number of rows.

    The join back is null-safe: no not-null filter is inferred for one side only, so both sides keep sharing the
    exchanges below them, and rows with NULL keys stay.
    """
    at = [*keys, "_slice"]
    per_slice = df.groupBy(*at).agg(*[c.alias(f"_carry_{n}") for n, c in summary.items()])
    w = W.partitionBy(*keys).orderBy("_slice")
    before = per_slice.select(
        *[F.col(k).alias(f"_at_{k}") for k in at],
        *[chained(F.col(f"_carry_{n}"), w).alias(f"_carry_{n}") for n in summary],
    )
    same = F.lit(True)
    for k in at:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return df.join(before, same, "left").drop(*[f"_at_{k}" for k in at])


def _position(ts: str, order) -> Column:
    """Ordering key of an aggregate: plain microseconds keep it in hash aggregation, a struct only when ties matter."""
    return F.struct(ts, *order) if order else micros(ts)


def sliced_lag(df: DataFrame, keys, ts: str, cols, order=(), seconds: int = HOUR) -> DataFrame:
    """Adds ``prev_<col>``: the value on the preceding row of the key by (ts, order)."""
    sliced = df.withColumn("_slice", time_slice(ts, seconds))
    newest = {c: F.max_by(c, _position(ts, order)) for c in cols}
    joined = _carried(sliced, keys, newest, lambda c, w: F.lag(c).over(w))
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, *order)
    first = F.row_number().over(inside) == 1
    prev = [F.when(first, F.col(f"_carry_{c}")).otherwise(F.lag(c).over(inside)).alias(f"prev_{c}") for c in cols]
    return joined.select(*df.columns, *prev)


def sliced_running_sum(df: DataFrame, keys, ts: str, col: str, name: str, order=(), seconds: int = HOUR) -> DataFrame:
    """Adds the running total of ``col`` within the key, by (ts, order)."""
    sliced = df.withColumn("_slice", time_slice(ts, seconds))
    joined = _carried(
        sliced, keys, {"sum": F.sum(col)}, lambda c, w: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, *order).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce(F.col("_carry_sum"), F.lit(0)) + F.sum(col).over(inside)
    return joined.select(*df.columns, total.alias(name))


def sliced_rank(df: DataFrame, keys, ts: str, order=(), seconds: int = HOUR, name: str = "rank") -> DataFrame:
    """Adds the 1-based row number of each row within its key, by (ts, order)."""
    sliced = df.withColumn("_slice", time_slice(ts, seconds))
    joined = _carried(
        sliced, keys, {"n": F.count(F.lit(1))}, lambda c, w: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, *order)
    rank = F.coalesce(F.col("_carry_n"), F.lit(0)) + F.row_number().over(inside)
    return joined.select(*df.columns, rank.cast("bigint").alias(name))


def sliced_last_value(df: DataFrame, keys, ts: str, values: dict[str, Column], order=(), seconds: int = HOUR) -> DataFrame:
    """Adds, per entry of ``values``, its last non-NULL value up to and including the row."""
    sliced = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_slice", time_slice(ts, seconds))
    newest = {
        n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), _position(ts, order))) for n in values
    }
    joined = _carried(
        sliced, keys, newest,
        lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, *order).rowsBetween(W.unboundedPreceding, 0)
    filled = [
        F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_carry_{n}")).alias(n) for n in values
    ]
    return joined.select(*[c for c in df.columns if c not in values], *filled)


def rolling_blocks(df: DataFrame, keys, ts: str, rows: int, order=(), seconds: int = HOUR, block: int = RANK_BLOCK):
    """Rows laid out for a frame of the last ``rows`` rows: returns (frame-ready DataFrame, window).

    Rows are ranked, cut into blocks of equal length and the last ``rows - 1`` of each block copied into the next.
    Filter out ``_copied`` after evaluating the window.
    """
    ranked = sliced_rank(df, keys, ts, order, seconds, "_rank")
    laid = with_lookback(ranked, F.col("_rank") - 1, max(block, rows), rows - 1)
    window = W.partitionBy(*keys, "_slice").orderBy("_rank").rowsBetween(-(rows - 1), 0)
    return laid, window
