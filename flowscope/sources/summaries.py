"""Per-peer summary documents, newest one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.schema import PEER_SUMMARY


def read_peer_summaries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Summary documents with the file's modification time as ``file_ts``; broken files are left out."""
    docs = (
        spark.read.schema(PEER_SUMMARY).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)
    )
    return docs.withColumn("file_ts", F.col("_metadata.file_modification_time"))


def parse_peer_summaries(lines: DataFrame, text_col: str = "value") -> DataFrame:
    others = [c for c in lines.columns if c != text_col]
    parsed = lines.withColumn("_s", F.from_json(F.col(text_col), PEER_SUMMARY))
    fields = [F.col(f"_s.{f.name}").alias(f.name) for f in PEER_SUMMARY if f.name not in others]
    return parsed.where(F.coalesce("_s.timestamp", "_s.peer").isNotNull()).select(*others, *fields)


def latest_per_peer(docs: DataFrame, by: str = "file_ts", peer: str = "peer") -> DataFrame:
    """All documents of each peer's newest file time.

    A summary may span several documents (its scanner list is written in parts), so the newest time is found by a
    small aggregate and joined back instead of ranking whole documents inside one window partition.
    """
    newest = docs.groupBy(peer).agg(F.max(by).alias(by))
    return docs.join(newest, [peer, by], "left_semi")


def select_peers(docs: DataFrame, view: str | None = None, peer: str = "peer") -> DataFrame:
    """All peers, or only the chosen one."""
    return docs if view is None else docs.where(F.col(peer) == view)


def heavy_hitter_rows(docs: DataFrame) -> DataFrame:
    """Bag union of the peers' heavy hitters, tagged with the peer that saw them."""
    rows = docs.select(F.col("peer").alias("detected_by"), F.explode("cms.heavy_hitters_bytes").alias("h"))
    return rows.select("detected_by", "h.flow", "h.bytes")


def scanner_rows(docs: DataFrame) -> DataFrame:
    """Bag union of the peers' scanners, tagged with their peer."""
    rows = docs.select(F.col("peer").alias("origin_peer"), F.explode("hll.port_scanners").alias("s"))
    return rows.select("origin_peer", "s.ip", "s.unique_ports")
