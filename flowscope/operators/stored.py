"""Sketches kept as tables under a name, one folder per version.

Saving never writes over what a reader, or the very query that is being saved, still reads: a sketch can be loaded,
merged with new data and saved under the same name.  The newest finished version counts; the one before it stays for
readers that have started, older ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowscope.streaming.sinks import epochs, remove_epochs


def save_version(rows: DataFrame, path: str, sketch_id: str) -> int:
    folder = f"{path}/sketch_id={sketch_id}"
    version = max(epochs(rows.sparkSession, folder), default=-1) + 1
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={version}")  # what a failed attempt left behind goes
    remove_epochs(rows.sparkSession, folder, version - 2)
    return version


def read_version(spark: SparkSession, path: str, sketch_id: str) -> DataFrame:
    folder = f"{path}/sketch_id={sketch_id}"
    known = epochs(spark, folder)
    if not known:
        raise FileNotFoundError(f"no saved sketch in {folder}")
    return spark.read.parquet(f"{folder}/epoch={known[-1]}")
