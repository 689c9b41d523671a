"""Comparison of measured scenarios against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scenario_stats(samples: DataFrame, scenario="scenario", metric="metric", value="value") -> DataFrame:
    """CPU average and maximum and mean throughput of every scenario, 0 without samples."""
    of = lambda name: F.when(F.col(metric) == name, F.col(value))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return samples.groupBy(scenario).agg(
        zero(F.avg(of("cpu")), "cpu_avg"),
        zero(F.max(of("cpu")), "cpu_max"),
        zero(F.avg(of("gbps")), "throughput_gbps"),
    )


def scenario_compare(stats: DataFrame, baseline: str, scenario="scenario") -> DataFrame:
    """Throughput loss against the baseline in percent (positive is a loss) and throughput per CPU percent."""
    base = stats.where(F.col(scenario) == baseline).agg(F.max("throughput_gbps")).scalar()
    gbps, cpu = F.col("throughput_gbps"), F.col("cpu_avg")
    based = stats.withColumn("_base", base)
    return based.select(
        scenario, "cpu_avg", "cpu_max", "throughput_gbps",
        F.when(F.col("_base") != 0, (F.col("_base") - gbps) / F.col("_base") * 100).alias("loss_pct"),
        F.when(cpu > 0, gbps / cpu).otherwise(0.0).alias("efficiency"),
    )
