"""Reports of running totals and sketches, one per trigger, and a final one when the stream stops.

Each micro-batch is sketched by itself; its cells and registers are merged into those so far, a table whose size the
shape of the sketches bounds, and the report is computed from that.  The table of every epoch is its own folder, so a
retried micro-batch merges into the same earlier state and writes the same report again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.hashing import HllSpec
from flowscope.operators.loglog import Registers, cardinalities, dimension_registers, diversity_score
from flowscope.streaming import sinks

TOTALS = ("flows", "bytes", "packets")
REGISTERS = "kind string, register bigint, value bigint"


def running_state(flows: DataFrame, spec: HllSpec = HllSpec()) -> DataFrame:
    """(kind, register, value): the registers of the five dimensions, and the totals under register 0."""
    registers = dimension_registers(flows, spec).table.select(
        F.col("dimension").alias("kind"), F.col("register").cast("bigint").alias("register"), F.col("rho").cast("bigint").alias("value"))
    counts = [F.lit(1).cast("bigint"), F.coalesce("bytes", F.lit(0)).cast("bigint"), F.coalesce("packets", F.lit(0)).cast("bigint")]
    sums = flows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{t}") for t, c in zip(TOTALS, counts, strict=True)])
    each = F.inline(F.array(*[F.struct(F.lit(f"total_{t}").alias("kind"), F.lit(0).cast("bigint").alias("register"),
                                       F.col(f"total_{t}").alias("value")) for t in TOTALS]))
    return registers.unionByName(sums.select(each))


def merged_state(*states: DataFrame) -> DataFrame:
    """Totals add up, registers keep their maximum."""
    rows = reduce(DataFrame.unionByName, states)
    value = F.when(F.col("kind").startswith("total_"), F.sum("value")).otherwise(F.max("value"))
    return rows.groupBy("kind", "register").agg(value.alias("value"))


def report_of(state: DataFrame, spec: HllSpec = HllSpec()) -> DataFrame:
    """One row: totals, the five estimates and their diversity."""
    totals = state.where(F.col("kind").startswith("total_")).agg(*[F.max(F.when(F.col("kind") == f"total_{t}", F.col("value"))).alias(f"total_{t}") for t in TOTALS])
    registers = state.where(~F.col("kind").startswith("total_")).select(F.col("kind").alias("dimension"), "register", F.col("value").alias("rho"))
    wide = diversity_score(cardinalities(Registers(spec, registers, ("dimension",))))
    one = F.lit(1)
    return totals.withColumn("_one", one).join(F.broadcast(wide.withColumn("_one", one)), "_one").drop("_one")


def report_batch(folder: str, spec: HllSpec = HllSpec()):
    """Micro-batch function for ``sinks.start``: returns the report after the batch; an empty batch repeats the last."""

    def apply(batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        state = running_state(batch, spec)
        if epoch:
            state = merged_state(spark.read.schema(REGISTERS).parquet(f"{folder}/state/epoch={epoch - 1}"), state)
        state.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")  # bounded by the sketches
        sinks.remove_epochs(spark, f"{folder}/state", epoch - 2)
        kept = spark.read.schema(REGISTERS).parquet(f"{folder}/state/epoch={epoch}")
        return report_of(kept, spec).withColumn("report", F.lit(epoch).cast("bigint"))

    return apply


def read_reports(spark: SparkSession, folder: str, spec: HllSpec = HllSpec()) -> DataFrame:
    """All reports of a stopped stream in order of ``report``; the final one, from its last state, has a null there."""
    last = sinks.epochs(spark, f"{folder}/state")[-1]
    final = report_of(spark.read.schema(REGISTERS).parquet(f"{folder}/state/epoch={last}"), spec)
    return sinks.read_all(spark, folder).unionByName(final.withColumn("report", F.lit(None).cast("bigint")))
