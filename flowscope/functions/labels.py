"""Presentation expressions: units, score labels, axis ceilings.  Thresholds and texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3
CPU_CEILINGS = (5, 10, 25, 50, 100)


def _fixed(value: Column, digits: int) -> Column:
    """Half-even decimal text without grouping, as C's ``%.nf``."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def bytes_label(value: Column) -> Column:
    v = value.cast("double")
    return (
        F.when(v > GB, F.concat(_fixed(v / GB, 2), F.lit(" GB")))
        .when(v > MB, F.concat(_fixed(v / MB, 2), F.lit(" MB")))
        .otherwise(F.concat(_fixed(v / KB, 2), F.lit(" KB")))
    )


def mbps_label(value: Column) -> Column:
    return F.when(value > 1000, F.concat(_fixed(value / 1000, 2), F.lit(" Gbps"))).otherwise(
        F.concat(_fixed(value, 1), F.lit(" Mbps"))
    )


def score_label(score: Column) -> Column:
    return F.when(score >= 70, "likely low-and-slow").when(score >= 40, "anomalous").otherwise("normal")


def axis_ceiling(maximum: Column, ceilings=CPU_CEILINGS, headroom: float = 1.2) -> Column:
    """Smallest ceiling that leaves the headroom above ``maximum``, else the last one."""
    need = F.coalesce(maximum, F.lit(0.0)) * headroom
    fits = [F.when(need <= c, F.lit(c)) for c in ceilings]
    return F.coalesce(*fits, F.lit(ceilings[-1])).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
