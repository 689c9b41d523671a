"""Documents that agents drop into a folder, as streams: counter dumps and flow batches.

A document is a file.  The file source remembers in the checkpoint which files it has read, so a restarted query goes on
with the next one; ``per_trigger`` limits what one micro-batch takes.  A document that is exported again under another
name is recognised by its key while the watermark still covers it, and dropped before its entries are decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.sources.flow_batches import explode_batches, parse_flow_batches
from flowscope.sources.snapshots import decode_counter_dumps

LATE = "10 minutes"


def document_files(spark: SparkSession, folder: str, columns: str = "", per_trigger: int = 1000) -> DataFrame:
    """(value, columns) of a stream of files below ``folder``, one row per file; ``columns`` are folder names ``name=value``."""
    schema = f"value string, {columns}" if columns else "value string"
    reader = spark.readStream.schema(schema).option("wholetext", True).option("maxFilesPerTrigger", per_trigger)
    return reader.format("text").load(folder)


def stream_counter_dumps(spark: SparkSession, folder: str, per_trigger: int = 1000, late: str = LATE) -> DataFrame:
    """Decoded map entries from dumps in ``agent_id=../poll_id=../polled=<epoch second>/part=../``.

    A part of an agent's poll counts once within ``late``, whatever its file is called.  Keys and values may be lists of
    hex strings, lists of numbers or one hex string; entries with a bad key are dropped, dumps that are no JSON give
    nothing.
    """
    files = document_files(spark, folder, "agent_id string, poll_id int, polled bigint, part int", per_trigger)
    once = files.withColumn("at", F.timestamp_seconds("polled")).withWatermark("at", late).dropDuplicatesWithinWatermark(["agent_id", "poll_id", "part"])
    return decode_counter_dumps(once.select("agent_id", "poll_id", F.col("value").alias("dump")))


def stream_flow_batches(spark: SparkSession, folder: str, per_trigger: int = 1000, late: str = LATE) -> DataFrame:
    """Flows of batch documents; a batch timestamp of an agent counts once within ``late``.

    Documents that cannot be parsed, and empty ones, give no rows.
    """
    docs = parse_flow_batches(document_files(spark, folder, per_trigger=per_trigger))
    timed = docs.where("timestamp is not null").withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return explode_batches(timed.dropDuplicatesWithinWatermark(["agent", "timestamp"]).drop("at"))
