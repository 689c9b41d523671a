"""HyperLogLog sketches as sparse tables ``register, rho``, plus what is computed from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.hashing import CmsSpec, HllSpec, check_hll, hll_estimate_expr, hll_register, hll_rho, hll_word
from flowscope.functions.net import flow_key
from flowscope.operators.stored import read_version, save_version

KEYED = HllSpec(12, "A")
DIMENSIONS = ("src_ips", "dst_ips", "src_ports", "dst_ports", "flows")


class Registers(NamedTuple):
    """A register table with its precision and family, and the group columns it has one sketch for."""

    spec: HllSpec
    table: DataFrame
    by: tuple = ()


def hll_build(df: DataFrame, value, spec: HllSpec = HllSpec(), by=()) -> Registers:
    """Registers of a value column (cast to text), optionally one sketch per group.

    Grouping by (group, register) caps a group at 2^p partial rows per task, so the shuffle is small and a hot group
    is spread over its registers.
    """
    check_hll(spec)
    value = F.col(value) if isinstance(value, str) else value
    # Projected on its own: the hash feeds several expressions and must be computed once per row.
    words = df.select(*by, hll_word(value.cast("string"), spec).alias("_word"))
    rows = words.select(*by, hll_register(F.col("_word"), spec).alias("register"), hll_rho(F.col("_word"), spec).alias("_rho"))
    table = rows.groupBy(*by, "register").agg(F.max("_rho").alias("rho"))
    return Registers(spec, table, tuple(by))


def hll_merge(*sketches: Registers) -> Registers:
    """Register-wise maximum; different precision or family is refused."""
    first = sketches[0]
    if any((s.spec, s.by) != (first.spec, first.by) for s in sketches):
        raise ValueError("HyperLogLog sketches of different precision cannot be merged")
    table = first.table
    for s in sketches[1:]:
        table = table.unionByName(s.table)
    return Registers(first.spec, table.groupBy(*first.by, "register").agg(F.max("rho").alias("rho")), first.by)


def hll_count(sketch: Registers, name: str = "estimate") -> DataFrame:
    """Estimated distinct count per group (one row, 0 when empty, for an ungrouped sketch)."""
    inverse = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0))
    sums = sketch.table.groupBy(*sketch.by).agg(
        inverse.alias("_inv"), F.count(F.lit(1)).cast("double").alias("_filled")
    )
    return sums.select(*sketch.by, hll_estimate_expr(F.col("_inv"), F.col("_filled"), sketch.spec).alias(name))


def dimension_registers(flows: DataFrame, spec: HllSpec = HllSpec(), by=()) -> Registers:
    """Registers of the five traffic dimensions in one pass and one small shuffle."""
    values = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), value.alias("_value"))
            for name, value in zip(
                DIMENSIONS,
                [
                    F.col("src_ip"), F.col("dst_ip"), F.col("src_port").cast("string"),
                    F.col("dst_port").cast("string"), flow_key(),
                ],
            )
        ]
    )
    return hll_build(flows.select(*by, F.inline(values)), "_value", spec, (*by, "dimension"))


def cardinalities(registers: Registers) -> DataFrame:
    """The five estimates as one wide row per group."""
    by = [c for c in registers.by if c != "dimension"]
    tall = hll_count(registers)
    return tall.groupBy(*by).agg(
        *[
            F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("estimate"))), F.lit(0)).cast("bigint")
            .alias(f"unique_{d}")
            for d in DIMENSIONS
        ]
    )


def diversity_score(cards: DataFrame) -> DataFrame:
    """(sources + destinations) / (2 x flows), at most 1, and 0 without flows."""
    ratio = (F.col("unique_src_ips") + F.col("unique_dst_ips")) / (F.col("unique_flows") * 2)
    return cards.withColumn(
        "diversity_score", F.when(F.col("unique_flows") == 0, 0.0).otherwise(F.least(F.lit(1.0), ratio))
    )


def batch_diversity(flows: DataFrame, by=("agent_id", "poll_id"), key="flow_id") -> DataFrame:
    """Estimated distinct flows of each agent batch over its number of flows."""
    sketch = hll_build(flows, key, HllSpec(12, "B"), by)
    counted = flows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_flows"))
    joined = hll_count(sketch, "unique_flows").join(counted, list(by))
    score = F.col("unique_flows") / F.greatest(F.lit(1), F.col("n_flows"))
    return joined.select(*by, "n_flows", "unique_flows", score.alias("diversity_score"))


def cardinality_rows(cards: DataFrame) -> DataFrame:
    """Wide cardinalities as ``metric, value`` text rows for display."""
    text = cards.select(  # fixed values: the four names of the display
        F.col("unique_flows").cast("string").alias("Unique Flows"),
        F.col("unique_src_ips").cast("string").alias("Unique Sources"),
        F.col("unique_dst_ports").cast("string").alias("Unique Dest Ports"),
        F.call_function("format_number", "diversity_score", F.lit("0.00")).alias("Diversity Score"),
    )
    return text.unpivot([], list(text.columns), "metric", "value")


def approx_unique_flows(flows: DataFrame, rsd: float = 0.01, by=()) -> DataFrame:
    """Distinct flows by Spark's own sketches, HyperLogLog++ and a mergeable DataSketches HLL, beside the exact number."""
    return flows.groupBy(*by).agg(
        F.countDistinct(flow_key()).alias("exact"),
        F.approx_count_distinct(flow_key(), rsd).alias("approx_flows"),
        F.hll_sketch_estimate(F.hll_sketch_agg(flow_key(), 14)).alias("datasketch_flows"),
    )


def sketch_memory(flows: DataFrame, cms: CmsSpec = CmsSpec(), hll: HllSpec = HllSpec()) -> DataFrame:
    """Bytes the sketches would take in memory, and the raw-size ratio at 200 bytes per flow.

    Fixed values: 8 bytes per Count-Min cell in three sketches, one byte per register in five global sketches, and
    4096 bytes for the sketch of every tracked source and every tracked service.
    """
    counted = flows.agg(
        F.count(F.lit(1)).alias("flows_processed"),
        F.countDistinct("src_ip").alias("tracked_src_ips"),
        F.countDistinct("dst_port").alias("tracked_services"),
    )
    cms_bytes = F.lit(3 * cms.width * cms.depth * 8).cast("bigint")
    hll_bytes = F.lit(5 * hll.registers).cast("bigint") + (F.col("tracked_src_ips") + F.col("tracked_services")) * 4096
    sized = counted.select("*", cms_bytes.alias("cms_bytes"), hll_bytes.alias("hll_bytes"))
    total = F.col("cms_bytes") + F.col("hll_bytes")
    raw = F.col("flows_processed") * 200
    return sized.select(
        "*", total.alias("total_bytes"), raw.alias("raw_bytes"), (raw / total).alias("compression_ratio")
    )


def save_registers(sketch: Registers, path: str, sketch_id: str) -> None:
    shaped = sketch.table.select(
        "*", F.lit(sketch.spec.precision).alias("precision"), F.lit(sketch.spec.family).alias("family")
    )
    save_version(shaped, path, sketch_id)


def load_registers(spark: SparkSession, path: str, sketch_id: str, spec: HllSpec, by=()) -> Registers:
    """Read saved registers; another precision or family makes the query fail."""
    stored = read_version(spark, path, sketch_id)
    same = (F.col("precision") == spec.precision) & (F.col("family") == spec.family)
    rho = F.when(same, F.col("rho")).otherwise(F.raise_error(F.lit("stored registers have another precision")))
    return Registers(spec, stored.withColumn("rho", rho.cast("int")).drop("precision", "family"), tuple(by))
