"""Session helpers: UTC pinning and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_local_base: str | None = None


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone so wall-clock and instant columns agree on every node.

    The setting stays for the rest of the session: results are lazy and read it when they run.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the folder the cluster shares between its nodes.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local-mode session without the setting
    falls back to a temporary folder; on a cluster a node-local path would be lost with its executor.
    """
    global _local_base
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all nodes")
        _local_base = _local_base or tempfile.mkdtemp(prefix="flowscope-")
        base = _local_base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors do not take it along."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package also when the driver was started from another folder.

    On a cluster the package has to be shipped, with ``--py-files`` or the image.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
