"""Flow-batch documents ``{timestamp, flow_count, flows: [...]}`` -> one row per flow record.

Readers return whole documents: copies of a document are dropped before its flows are exploded, never after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.schema import FLOW_BATCH


def read_flow_batches(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Batch documents from JSON files.

    One document per line is the splittable default; ``multi_line`` reads one pretty-printed document per file.
    """
    return spark.read.schema(FLOW_BATCH).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)


def parse_flow_batches(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """The same from a text column; passes the other columns through."""
    others = [c for c in lines.columns if c != text_col]
    return lines.withColumn("_d", F.from_json(F.col(text_col), FLOW_BATCH)).select(*others, "_d.*")


def explode_batches(docs: DataFrame) -> DataFrame:
    """One row per flow; unparsable and empty documents contribute nothing."""
    kept = [c for c in docs.columns if c not in ("timestamp", "flow_count", "flows")]
    rows = docs.where(F.col("timestamp").isNotNull() & (F.size("flows") > 0)).select(
        *kept, F.col("timestamp").alias("batch_ts"), F.explode("flows").alias("f")
    )
    return rows.select(
        *kept,
        "batch_ts",
        "f.src_ip", "f.dst_ip", "f.src_port", "f.dst_port",
        F.col("f.protocol").alias("proto"),
        F.col("f.packet_count").alias("packets"),
        F.col("f.byte_count").alias("bytes"),
        F.timestamp_seconds("f.first_seen").alias("first_seen"),
        F.timestamp_seconds("f.last_seen").alias("last_seen"),
    )


def dedup_batches(docs: DataFrame, keys=("agent", "timestamp"), order: Column | None = None) -> DataFrame:
    """Keep one document per batch key, with all of its flows.

    With ``order`` the survivor is the smallest by it (a max_by/min_by aggregate, partial before the shuffle);
    without it any copy may survive, which is right when copies are identical.
    """
    keys = list(keys)
    if order is None:
        return docs.dropDuplicates(keys)
    rest = [c for c in docs.columns if c not in keys]
    picked = docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
