"""Count-Min sketches as sparse tables ``row_i, col_j, cnt``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.functions.hashing import CmsSpec, check_cms, cms_column
from flowscope.functions.net import flow_key
from flowscope.operators.stored import read_version, save_version

METRICS = ("bytes", "packets", "flows")


class CountMin(NamedTuple):
    """A sketch table with its shape.  ``cells`` may carry a ``metric`` column."""

    spec: CmsSpec
    cells: DataFrame


def _placed(keyed: DataFrame, key: str, spec: CmsSpec) -> DataFrame:
    """One row per input row and sketch row, with the cell's column number in place of the key.

    Row numbers are exploded first, so the key is built once and each digest is one call in a plain projection.
    """
    others = [c for c in keyed.columns if c != key]
    rows = F.explode(F.array(*[F.lit(i) for i in range(spec.depth)])).alias("row_i")
    return keyed.select(*others, key, rows).select(
        *others, "row_i", cms_column(F.col(key), F.col("row_i"), spec).alias("col_j")
    )


def cms_build(df: DataFrame, key, value, spec: CmsSpec = CmsSpec(), by=()) -> CountMin:
    """Sketch of ``value`` by ``key`` (columns or names), optionally one per group.

    Keys are hashed where they are read and the partial aggregate keeps at most depth x width cells per task and
    group, so the shuffle does not grow with the number of keys and no hot key exists.
    """
    check_cms(spec)
    key = F.col(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    keyed = df.select(*by, value.cast("bigint").alias("_v"), key.alias("_k"))
    rows = _placed(keyed, "_k", spec)
    return CountMin(spec, rows.groupBy(*by, "row_i", "col_j").agg(F.sum("_v").cast("bigint").alias("cnt")))


def _wide_metrics(flows: DataFrame, spec: CmsSpec) -> DataFrame:
    """Cells with a column per metric.  The three sketches share positions, hence each key is hashed once."""
    check_cms(spec)
    zero = F.lit(0).cast("bigint")
    keyed = lambda key, packets, one: F.struct(
        key.alias("k"), F.col("bytes").cast("bigint").alias("b"), packets.alias("p"), one.alias("n")
    )
    entries = F.array(
        keyed(flow_key(), F.col("packets").cast("bigint"), F.lit(1).cast("bigint")),
        keyed(F.concat(F.lit("src:"), F.col("src_ip")), zero, zero),
        keyed(F.concat(F.lit("dst:"), F.col("dst_ip")), zero, zero),
    )
    rows = _placed(flows.select(F.inline(entries)), "k", spec)
    return rows.groupBy("row_i", "col_j").agg(
        F.sum("b").cast("bigint").alias("bytes"),
        F.sum("p").cast("bigint").alias("packets"),
        F.sum("n").cast("bigint").alias("flows"),
    )


def cms_build_metrics(flows: DataFrame, spec: CmsSpec = CmsSpec()) -> CountMin:
    """Bytes, packets and flows sketches in one pass, with a ``metric`` column.

    The bytes sketch also takes ``src:<ip>`` and ``dst:<ip>`` keys, so its mass is three times the traffic.
    """
    wide = _wide_metrics(flows, spec)
    cells = wide.unpivot(["row_i", "col_j"], list(METRICS), "metric", "cnt").where(F.col("cnt") != 0)
    return CountMin(spec, cells.select("metric", "row_i", "col_j", "cnt"))


def metric_sketch(sketch: CountMin, metric: str) -> CountMin:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return CountMin(sketch.spec, sketch.cells.where(F.col("metric") == metric).drop("metric"))


def cms_merge(*sketches: CountMin) -> CountMin:
    """Cell-wise sum; sketches of different shape or family are refused."""
    spec = sketches[0].spec
    if any(s.spec != spec for s in sketches):
        raise ValueError("Count-Min sketches of different shape cannot be merged")
    cells = sketches[0].cells
    for s in sketches[1:]:
        cells = cells.unionByName(s.cells)
    keys = [c for c in cells.columns if c != "cnt"]
    return CountMin(spec, cells.groupBy(*keys).agg(F.sum("cnt").cast("bigint").alias("cnt")))


def cms_mass(sketch: CountMin) -> DataFrame:
    """Total inserted count; every row of the sketch sums to it."""
    return sketch.cells.where(F.col("row_i") == 0).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("mass")
    )


def _dense(sketch: CountMin) -> DataFrame:
    """All cells as one array in row-major order; only used while depth x width is small."""
    spec = sketch.spec
    at = (F.col("row_i") * spec.width + F.col("col_j")).cast("bigint").alias("id")
    filled = sketch.cells.sparkSession.range(spec.width * spec.depth).join(sketch.cells.select(at, "cnt"), "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("cnt", F.lit(0)).alias("cnt"))))
    return filled.agg(F.transform(ordered, lambda x: x["cnt"]).alias("cells"))


def cms_estimate(sketch: CountMin, candidates: DataFrame, key_col: str = "key", dense: bool = True) -> DataFrame:
    """Point query: the smallest of the key's cells, a missing cell counting as 0.  Adds ``estimate``.

    ``dense`` turns the sketch into one array (8 bytes a cell; its size is fixed by its shape, not by the data),
    computed once as a scalar subquery: candidates of any number are answered in place, without join or shuffle.  For a
    sketch too wide for that, the caller asks for a join by (row, column) instead.  Both give the same rows: repeated
    candidates stay, a NULL key has a NULL estimate.
    """
    spec = check_cms(sketch.spec)
    if dense:
        cells = _dense(sketch).scalar()
        reads = [
            F.element_at(cells, F.lit(i * spec.width + 1) + cms_column(F.col(key_col), i, spec))
            for i in range(spec.depth)
        ]
        smallest = F.least(*reads) if len(reads) > 1 else reads[0]
        return candidates.select(*candidates.columns, smallest.alias("estimate"))
    keyed = candidates.select(F.col(key_col).alias("_k")).where("_k IS NOT NULL").distinct()
    placed = _placed(keyed.withColumn("_key", F.col("_k")), "_k", spec)
    looked = placed.join(sketch.cells, ["row_i", "col_j"], "left")
    least = looked.groupBy("_key").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("estimate"))
    return candidates.join(least, F.col(key_col) == F.col("_key"), "left").select(*candidates.columns, "estimate")


def flow_truth(flows: DataFrame) -> DataFrame:
    """Exact bytes, packets and flows of every observed flow key: the candidates of a heavy-hitter query."""
    return flows.groupBy(flow_key().alias("flow")).agg(
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("packets").cast("bigint").alias("packets"),
        F.count(F.lit(1)).alias("flows"),
    )


def cms_heavy_hitters(flows: DataFrame, sketch: CountMin, top_n: int = 10, metric: str = "bytes") -> DataFrame:
    """Observed flows with the largest estimates; ties go to the smaller key."""
    keys = flows.select(flow_key().alias("flow")).distinct()
    est = cms_estimate(metric_sketch(sketch, metric), keys, "flow")
    return est.orderBy(F.desc("estimate"), "flow").limit(top_n)


def cms_heavy_hitters_b(candidates: DataFrame, sketch: CountMin, top_k: int = 20, key_col: str = "flow_id") -> DataFrame:
    """Top-k candidates of a family B sketch; ties go to the larger key."""
    est = cms_estimate(sketch, candidates.select(key_col).distinct(), key_col)
    return est.orderBy(F.desc("estimate"), F.desc(key_col)).limit(top_k)


def cms_metric_estimates(flows: DataFrame, candidates: DataFrame, key_col: str = "key", spec: CmsSpec = CmsSpec()) -> DataFrame:
    """Adds ``bytes_estimate``, ``packets_estimate`` and ``flows_estimate``: one sketch pass and one lookup for all three."""
    wide = _wide_metrics(flows, spec)
    at = (F.col("row_i") * spec.width + F.col("col_j")).cast("bigint").alias("id")
    zero = [F.coalesce(m, F.lit(0)).alias(m) for m in METRICS]
    filled = wide.sparkSession.range(spec.width * spec.depth).join(wide.select(at, *METRICS), "id", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", *zero))), lambda x: F.struct(*[x[m].alias(m) for m in METRICS]))
    cells = filled.agg(listed.alias("cells")).scalar()
    reads = F.array(*[
        F.element_at(cells, F.lit(i * spec.width + 1) + cms_column(F.col(key_col), i, spec)) for i in range(spec.depth)
    ])
    found = candidates.select("*", reads.alias("_reads"))
    least = [F.array_min(F.col("_reads").getField(m)).alias(f"{m}_estimate") for m in METRICS]
    return found.select(*candidates.columns, *least)


def cms_heavy_hitters_all(flows: DataFrame, top_n: int = 10, spec: CmsSpec = CmsSpec()) -> DataFrame:
    """``metric, flow, estimate``: the largest estimates of each metric; ties go to the smaller key.

    The flows are read twice: for the sketch, and for the candidates.
    """
    keys = flows.select(flow_key().alias("flow")).distinct()
    tall = cms_metric_estimates(flows, keys, "flow", spec).select(
        "flow", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_estimate").alias("estimate")) for m in METRICS]))
    )
    order = W.partitionBy("metric").orderBy(F.desc("estimate"), "flow")
    ranked = tall.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
    return ranked.select("metric", "flow", "estimate")


def ip_statistics_both(flows: DataFrame, sketch: CountMin) -> DataFrame:
    """``ip_statistics`` of sources and destinations from one aggregate and one lookup."""
    sides = F.inline(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"{d}_ip").alias("ip")) for d in ("src", "dst")]))
    exact = flows.select("bytes", "packets", sides).groupBy("ip", "direction").agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.sum("packets").cast("bigint").alias("packets"), F.count(F.lit(1)).alias("flows")
    )
    keyed = exact.withColumn("key", F.concat_ws(":", "direction", "ip"))
    est = cms_estimate(metric_sketch(sketch, "bytes"), keyed, "key")
    return est.select("ip", "direction", F.col("estimate").alias("bytes_estimate"), "bytes", "packets", "flows")


def ip_statistics(flows: DataFrame, sketch: CountMin, direction: str = "src", ips: DataFrame | None = None) -> DataFrame:
    """Per-address bytes, packets and flows.

    ``bytes_estimate`` comes from the bytes sketch's per-address keys; the sketch holds no packets or flows for
    addresses, so those and the true bytes are computed exactly.
    """
    if direction not in ("src", "dst"):
        raise ValueError("direction must be 'src' or 'dst'")
    col = f"{direction}_ip"
    exact = flows.groupBy(F.col(col).alias("ip")).agg(
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("packets").cast("bigint").alias("packets"),
        F.count(F.lit(1)).alias("flows"),
    )
    if ips is not None:
        exact = ips.select("ip").distinct().join(exact, "ip", "left").na.fill(0, ["bytes", "packets", "flows"])
    keyed = exact.withColumn("key", F.concat(F.lit(f"{direction}:"), F.col("ip")))
    est = cms_estimate(metric_sketch(sketch, "bytes"), keyed, "key")
    return est.select("ip", F.lit(direction).alias("direction"), F.col("estimate").alias("bytes_estimate"),
                      "bytes", "packets", "flows")


def save_cms(sketch: CountMin, path: str, sketch_id: str) -> None:
    """Write a sketch as the newest version of ``sketch_id``, with its shape beside the cells."""
    spec = sketch.spec
    shaped = sketch.cells.select(
        "*", F.lit(spec.width).alias("width"), F.lit(spec.depth).alias("depth"), F.lit(spec.family).alias("family")
    )
    save_version(shaped, path, sketch_id)


def load_cms(spark: SparkSession, path: str, sketch_id: str, spec: CmsSpec) -> CountMin:
    """Read a saved sketch; cells of another shape make the query fail."""
    stored = read_version(spark, path, sketch_id)
    same = (F.col("width") == spec.width) & (F.col("depth") == spec.depth) & (F.col("family") == spec.family)
    cnt = F.when(same, F.col("cnt")).otherwise(F.raise_error(F.lit("stored Count-Min sketch has another shape")))
    cells = stored.withColumn("cnt", cnt.cast("bigint")).drop("width", "depth", "family")
    return CountMin(spec, cells)
