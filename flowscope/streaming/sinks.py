"""Running a stream to a folder and reading the result back.

Every micro-batch is written to its own ``epoch`` folder and overwritten if the batch is retried, so a lost executor or
a restarted query never duplicates rows.  A result of which only the newest row of each key counts names its ``keys``:
every ``COMPACT`` epochs the rows so far are merged into one table, and what the merge before last holds is removed, so
a read meets a bounded number of epochs however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
COMPACT = 10


def use_rocksdb(spark: SparkSession) -> None:
    """Keep keyed state on disk: cumulative state grows with the number of distinct keys.

    A session setting; it holds for the streams that are started after it.
    """
    if spark.conf.get(PROVIDER_KEY, "") != ROCKSDB:
        spark.conf.set(PROVIDER_KEY, ROCKSDB)


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """Epochs whose rows are written completely, in order."""
    system, at = _files(spark, folder)
    if not system.exists(at):
        return []
    found = [s.getPath() for s in system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("epoch=")]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("epoch=")) for p in done)


def remove_epochs(spark: SparkSession, folder: str, upto: int) -> None:
    """Removes the epochs up to and including ``upto``; their rows are held elsewhere."""
    for epoch in epochs(spark, folder):
        if epoch <= upto:
            system, at = _files(spark, f"{folder}/epoch={epoch}")
            system.delete(at, True)


def _newest_rows(rows: DataFrame, keys) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct("epoch", *rest), "epoch").alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in ("epoch", *rest)])


def _recent(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest merged table and the epochs after it."""
    bases = [e for e in epochs(spark, f"{folder}/base") if before is None or e < before]
    since = bases[-1] if bases else -1
    parts = [spark.read.parquet(f"{folder}/base/epoch={since}")] if bases else []
    later = [e for e in epochs(spark, f"{folder}/data") if e > since]
    if later:
        paths = [f"{folder}/data/epoch={e}" for e in later]
        parts.append(spark.read.option("basePath", f"{folder}/data").parquet(*paths))
    if not parts:
        return None
    rows = parts[0].withColumn("epoch", F.col("epoch").cast("bigint"))
    for part in parts[1:]:
        rows = rows.unionByName(part.withColumn("epoch", F.col("epoch").cast("bigint")))
    return rows


def compact(spark: SparkSession, folder: str, keys, epoch: int) -> None:
    """Merges all rows up to ``epoch``; a retried epoch still finds what it was merged from."""
    rows = _recent(spark, folder, before=epoch)
    _newest_rows(rows, keys).write.mode("overwrite").parquet(f"{folder}/base/epoch={epoch}")
    older = [e for e in epochs(spark, f"{folder}/base") if e < epoch]
    if older:
        remove_epochs(spark, f"{folder}/data", older[-1])
        remove_epochs(spark, f"{folder}/base", older[-1] - 1)


def start(stream: DataFrame, folder: str, mode: str = "update",
          transform: Callable[[DataFrame, int], DataFrame] | None = None, every: str | None = None, keys=(),
          partition_by=()):
    """Start a query that writes each epoch's rows under ``folder``; ``transform`` gets the batch and its epoch.

    Without ``every`` it processes what is available and stops; with it, it keeps triggering at that interval.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        read_often = batch.persist() if transform else batch
        rows = transform(read_often, epoch) if transform else batch
        if partition_by:
            rows = rows.repartition(*partition_by)  # one file for each value
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/data/epoch={epoch}")
        if transform:
            read_often.unpersist()
        if keys and epoch and epoch % COMPACT == 0:
            compact(batch.sparkSession, folder, keys, epoch)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_available(stream: DataFrame, folder: str, mode: str = "update", transform=None, keys=(), partition_by=()):
    """Process what is there and return the finished query."""
    finished = start(stream, folder, mode, transform, None, keys, partition_by)
    finished.awaitTermination()
    return finished


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of an append-mode run."""
    return spark.read.parquet(f"{folder}/data").drop("epoch")


def read_latest(spark: SparkSession, folder: str, keys) -> DataFrame:
    """Current state of an update-mode run: the newest epoch's row of every key."""
    return _newest_rows(_recent(spark, folder), keys).drop("epoch")
