"""Time-series operators: counter deltas, rates, rolling baselines, scores, histories, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.functions.labels import clamp, score_label
from flowscope.operators.sliced import (
    HOUR,
    micros,
    rolling_blocks,
    sliced_lag,
    sliced_last_value,
    sliced_running_sum,
    with_lookback,
)

POLL_SLICE = 512

# Fixed values of the score.
SCORE_WEIGHTS = {"flow_density": 40.0, "src_density": 25.0, "spray": 20.0, "diversity": 15.0}
BUSY_MBPS, BUSY_FACTOR, MIN_MBPS = 200.0, 0.6, 0.1
BASELINE_TICKS, BASELINE_MIN, BASELINE_Q = 120, 10, 0.95


def counter_deltas(snapshots: DataFrame, keys=("agent_id", "src_ip", "dst_ip", "proto", "src_port", "dst_port"),
                   poll="poll_id", keep=(), positive: bool = True) -> DataFrame:
    """Traffic since the previous poll from cumulative counters.

    A key missing from poll n-1 starts from zero again, a decrease means a restart, and only keys with new bytes are
    emitted (all of them unless ``positive``).  Because only the adjacent poll matters, each key is cut into runs of polls whose last poll is copied
    into the next run, so a long-lived key is not one window partition.
    """
    laid = with_lookback(snapshots, F.col(poll), POLL_SLICE, 1)
    w = W.partitionBy(*keys, "_slice").orderBy(poll)
    adjacent = F.lag(poll).over(w) == F.col(poll) - 1

    def delta(total: str) -> Column:
        change = F.col(total) - F.when(adjacent, F.lag(total).over(w)).otherwise(F.lit(0))
        return F.when(change < 0, F.col(total)).otherwise(change).cast("bigint")

    out = laid.select(
        *keys, poll, *keep, "_copied", delta("total_bytes").alias("bytes"), delta("total_packets").alias("packets")
    )
    shown = ~F.col("_copied") & (F.col("bytes") > 0) if positive else ~F.col("_copied")
    return out.where(shown).drop("_copied")


def _trailing_sum(col: str, ordered, span: int) -> Column:
    """Sum over the half-open range (now - span, now], as the difference of two growing sums.

    Growing frames cost one addition per row; a sliding frame would add up its whole content again for every row.
    """
    upto = lambda end: F.coalesce(F.sum(col).over(ordered.rangeBetween(W.unboundedPreceding, end)), F.lit(0))
    return upto(0) - upto(-span)


def live_rate(messages: DataFrame, seconds: float = 2.0, ts="ts", bytes_col="bytes", by=(), slice_seconds: int = 60):
    """Bytes per second and Mbps over the last ``seconds`` at every message; the far end is exclusive.

    Messages of one instant are summed before the window, which sees each instant of a slice once.
    """
    span = int(seconds * 1_000_000)
    placed = messages.withColumn("_us", micros(ts))
    instants = placed.groupBy(*by, "_us").agg(F.sum(bytes_col).alias("_sum"))
    laid = with_lookback(instants, F.col("_us"), max(slice_seconds * 1_000_000, span), span)
    rate = _trailing_sum("_sum", W.partitionBy(*by, "_slice").orderBy("_us"), span) / F.lit(seconds)
    rates = laid.withColumn("rate", rate).where(~F.col("_copied")).select(
        *[F.col(b).alias(f"_at_{b}") for b in by], F.col("_us").alias("_at_us"), "rate"
    )
    same = F.col("_us").eqNullSafe(F.col("_at_us"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_at_{b}"))
    out = placed.join(rates, same, "left")
    return out.select(*messages.columns, "rate", (F.col("rate") * 8 / 1e6).alias("mbps"))


def live_rate_ticks(messages: DataFrame, seconds: int = 2, step: int = 1, ts="ts", bytes_col="bytes") -> DataFrame:
    """The same rate on a grid of ``step`` seconds from the first message on, also where nothing arrives and it is 0.

    Every message feeds the ticks whose look-back covers it; the grid has one row per tick of the covered time and ends
    when the last message has left the window.
    """
    if seconds % step:
        raise ValueError("the rate span must be a multiple of the step")
    unit, span = step * 1_000_000, seconds * 1_000_000
    first = F.ceil(micros(ts) / F.lit(unit)).cast("bigint") * unit
    fed = messages.where(F.col(ts).isNotNull()).select(
        F.col(bytes_col).alias("_b"), F.explode(F.sequence(first, first + F.lit(span - unit), F.lit(unit))).alias("_us")
    )
    sums = fed.groupBy("_us").agg(F.sum("_b").alias("_sum"))
    ends = sums.agg(F.min("_us").alias("lo"), (F.max("_us") + unit).alias("hi")).where("lo IS NOT NULL")
    coarse = ends.select("hi", F.explode(F.sequence("lo", "hi", F.lit(unit * 3600))).alias("from"))
    grid = coarse.repartition("from").select(
        F.explode(F.sequence("from", F.least(F.col("hi"), F.col("from") + F.lit(unit * 3599)), F.lit(unit))).alias("_us")
    )
    rate = F.coalesce(F.col("_sum"), F.lit(0)) / F.lit(float(seconds))
    out = grid.join(sums, "_us", "left").select(F.timestamp_micros("_us").alias("tick"), rate.alias("rate"))
    return out.withColumn("mbps", F.col("rate") * 8 / 1e6)


def finite(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def rolling_baseline(ticks: DataFrame, cols, by=("tenant",), ts="ts", rows: int = BASELINE_TICKS,
                     min_count: int = BASELINE_MIN, q: float = BASELINE_Q) -> DataFrame:
    """Adds ``<col>_p95``: linear-interpolated quantile of the last ``rows`` finite values including the current.

    NULL while fewer than ``min_count`` values are known.
    """
    laid, w = rolling_blocks(ticks, by, ts, rows)
    for c in cols:
        laid = laid.withColumn(f"_x_{c}", finite(F.col(c)))
    base = [
        F.when(F.count(f"_x_{c}").over(w) >= min_count, F.percentile(f"_x_{c}", F.lit(q)).over(w)).alias(f"{c}_p95")
        for c in cols
    ]
    out = laid.select(*ticks.columns, "_copied", *base)
    return out.where(~F.col("_copied")).drop("_copied")


def densities(ticks: DataFrame) -> DataFrame:
    """Flows and sources per Mbps, with a floor under the rate."""
    rate = F.greatest(F.col("mbps"), F.lit(MIN_MBPS))
    return ticks.withColumns(
        {"flow_density": F.col("unique_flows") / rate, "src_density": F.col("unique_src") / rate}
    )


def lowslow_score(ticks: DataFrame, by=("tenant",), ts="ts") -> DataFrame:
    """Low-and-slow score 0..100 of every tick against its own rolling baselines."""
    signals = list(SCORE_WEIGHTS)
    based = rolling_baseline(densities(ticks), signals, by, ts)
    score = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        x, p95 = F.col(name), F.col(f"{name}_p95")
        excess = F.lit(weight) * clamp(x / (p95 + 1e-9) - 1.0, 0.0, 1.0)
        score = score + F.when(x > p95, excess).otherwise(0.0)
    score = clamp(F.when(F.col("mbps") > BUSY_MBPS, score * BUSY_FACTOR).otherwise(score), 0.0, 100.0)
    scored = based.withColumn("score", score)
    return scored.withColumn("label", score_label(F.col("score")))


def carry_forward(messages: DataFrame, values: dict[str, Column], by=(), ts="ts", order=(), seconds: int = 60) -> DataFrame:
    """Last meaningful value so far of each entry; NULL marks a value as not meaningful.

    Raw messages meet in slices of ``seconds``; a busier source takes narrower ones.
    """
    return sliced_last_value(messages, by, ts, values, order, seconds)


def drops_rate(polls: DataFrame, ts="ts", total="drops_total", by=()) -> DataFrame:
    """Change of a drop counter since the previous poll; 0 on the first poll, shown only when positive."""
    lagged = sliced_lag(polls, by, ts, [total], seconds=24 * HOUR)
    delta = F.col(total) - F.coalesce(F.col(f"prev_{total}"), F.col(total))
    return lagged.select(*polls.columns, delta.cast("bigint").alias("delta")).withColumn(
        "shown_delta", F.when(F.col("delta") > 0, F.col("delta"))
    )


def bounded_history(points: DataFrame, n: int, by=(), ts="ts", order=()) -> DataFrame:
    """The newest ``n`` points, per key when keys are given."""
    newest = [F.desc(ts), *[F.desc(o) for o in order]]
    if not by:
        return points.orderBy(*newest).limit(n)
    ranked = points.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*newest)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def metric_scrape(samples: DataFrame, series=("metric", "label"), ts="ts", value="value", every: str = "5 seconds"):
    """Last value of each series in every scrape interval, stamped with the interval's end."""
    picked = samples.groupBy(*series, F.window(ts, every).alias("_w")).agg(F.max_by(value, ts).alias(value))
    return picked.select(*series, F.col("_w.end").alias("ts"), value)


def counter_series(increments: DataFrame, series=("metric", "label"), ts="ts", value="bytes", every: str = "5 seconds",
                   epoch=()) -> DataFrame:
    """Scraped cumulative counters from increments: sum per scrape interval, then running total per series.

    ``epoch`` names columns at whose change the counter restarts from zero.
    """
    binned = increments.groupBy(*series, *epoch, F.window(ts, every).alias("_w")).agg(F.sum(value).alias("_inc"))
    stamped = binned.select(*series, *epoch, F.col("_w.end").alias("ts"), "_inc")
    total = sliced_running_sum(stamped, [*series, *epoch], "ts", "_inc", "value", seconds=24 * HOUR)
    return total.select(*series, "ts", F.col("value").cast("bigint").alias("value"))


def counter_increments(samples: DataFrame, series=("metric", "label"), ts="ts", value="value") -> DataFrame:
    """Reset-aware increase of each counter sample over the previous one; 0 on a series' first sample."""
    lagged = sliced_lag(samples, series, ts, [value], seconds=24 * HOUR)
    prev = F.col(f"prev_{value}")
    inc = F.when(prev.isNull(), F.lit(0)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return lagged.select(*samples.columns, inc.alias("inc"))


def metric_rate(samples: DataFrame, seconds: int = 60, series=("metric", "label"), ts="ts", value="value") -> DataFrame:
    """Per-second rate of every counter over the last ``seconds``, at each sample; no edge extrapolation."""
    span = seconds * 1_000_000
    placed = counter_increments(samples, series, ts, value).withColumn("_us", micros(ts))
    laid = with_lookback(placed, F.col("_us"), max(HOUR * 1_000_000, span), span)
    summed = _trailing_sum("inc", W.partitionBy(*series, "_slice").orderBy("_us"), span)
    out = laid.withColumn("rate", summed / F.lit(float(seconds)))
    return out.where(~F.col("_copied")).select(*samples.columns, "rate")


def step_rates(samples: DataFrame, seconds: int = 60, step: int = 15, series=("metric", "label"), ts="ts",
               value="value") -> DataFrame:
    """Rates on an evaluation grid: each increment feeds the steps whose look-back covers it.

    The expansion is constant (seconds / step rows per increment) and partially summed before the shuffle.  Increments
    of zero count too: a series that rests has the rate 0, not a gap.
    Result: series, ``step_ts``, ``rate``.
    """
    if seconds % step:
        raise ValueError("the rate span must be a multiple of the step")
    unit = step * 1_000_000
    inc = counter_increments(samples, series, ts, value)
    first = F.ceil(micros(ts) / F.lit(unit)) * unit
    steps = F.explode(F.sequence(first, first + F.lit((seconds - step) * 1_000_000), F.lit(unit)))
    placed = inc.select(*series, "inc", steps.alias("_us"))
    rate = (F.sum("inc") / F.lit(float(seconds))).alias("rate")
    return placed.groupBy(*series, F.timestamp_micros("_us").alias("step_ts")).agg(rate)


def topk_rate(rates: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The ``k`` highest rates of every evaluation step."""
    order = W.partitionBy("step_ts").orderBy(F.desc("rate"), label)
    return rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def resample_linear(samples: DataFrame, n: int, series="series", idx="idx", value="value") -> DataFrame:
    """Linear resample of each series (dense index from 0) to ``n`` points spread over the same range.

    Grid points fetch their two neighbours by equality joins on (series, index), so a long series is not one group.
    """
    if n <= 1:
        return samples.select(series, idx, value)
    sizes = samples.groupBy(series).agg(F.max(idx).cast("bigint").alias("_last"))
    grid = sizes.select(series, "_last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    at = F.col("k") * F.col("_last") / F.lit(n - 1)
    low = F.least(F.floor(at), F.col("_last")).cast("bigint")
    grid = grid.select(series, "k", low.alias("_lo"), F.least(low + 1, F.col("_last")).alias("_hi"), (at - low).alias("_part"))
    left = samples.select(series, F.col(idx).cast("bigint").alias("_lo"), F.col(value).alias("_a"))
    right = samples.select(series, F.col(idx).cast("bigint").alias("_hi"), F.col(value).alias("_b"))
    joined = grid.join(left, [series, "_lo"]).join(right, [series, "_hi"])
    return joined.select(
        series, F.col("k").alias(idx), (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(value)
    )


def agent_cpu_history(messages: DataFrame, n: int = 60, agent="agent_id", ts="ts", order="seq", cpu="cpu") -> DataFrame:
    """The newest ``n`` messages, each with the CPU known then for every agent seen so far.

    The newest messages are a bounded top-n.  Each agent contributes its updates among them plus its last value from
    before them; every update then spans the ticks up to the agent's next one.
    """
    recent = bounded_history(messages.select(agent, ts, order, cpu), n, ts=ts, order=(order,))
    ticks = recent.select(
        F.row_number().over(W.orderBy(ts, order)).alias("tick"), F.col(ts).alias("tick_ts"), agent, cpu
    )  # at most n rows
    edges = recent.agg(F.struct(F.min(F.struct(ts, order)).alias("first"), F.count(F.lit(1)).alias("n"))).scalar()
    older = messages.select(agent, ts, order, cpu).withColumn("_edge", edges).where(
        F.struct(F.col(ts), F.col(order)) < F.col("_edge.first")
    )
    before = older.groupBy(agent).agg(F.max_by(cpu, F.struct(ts, order)).alias(cpu))
    updates = ticks.select(agent, "tick", cpu).unionByName(
        before.select(agent, F.lit(0).alias("tick"), cpu)
    )
    spans = updates.withColumn("_edge", edges).select(
        agent, cpu, F.greatest("tick", F.lit(1)).alias("_from"),
        (F.lead("tick").over(W.partitionBy(agent).orderBy("tick")) - 1).alias("_to"),
        F.col("_edge.n").cast("int").alias("_n"),
    ).withColumn("_to", F.coalesce("_to", "_n")).where(F.col("_from") <= F.col("_to"))
    known = spans.select(agent, cpu, F.explode(F.sequence("_from", "_to")).alias("tick"))
    return known.join(ticks.select("tick", "tick_ts"), "tick").select("tick", "tick_ts", agent, cpu)
