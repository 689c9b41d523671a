"""A streaming sink that publishes one document per row, exactly once: tasks stage files, a commit by batch id publishes.

Every task of a micro-batch stages its documents in a file of its own.  When all tasks are done the driver writes one
small manifest, named by the batch id, that lists the files; readers see listed files only.  A batch that is tried again
after its commit finds its manifest and takes its new files back, so no document is published twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from flowscope.session import ship_code

FORMAT = "push_documents"
STAGED, COMMITS = "staged", "commits"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    documents: int


class PushWriter(DataSourceStreamWriter):
    """Rows have one string column ``document``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{STAGED}", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{root}/{STAGED}/{name}") as out:
            for row in iterator:
                if row.document is not None:
                    out.write(row.document.encode() + b"\n")
                    n += 1
        return Staged(name, n)

    def _drop(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{root}/{STAGED}/{m.file}").is_file:
                system.delete_file(f"{root}/{STAGED}/{m.file}")

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        system, root = file_system(self.path)
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        manifest = f"{root}/{COMMITS}/{batchId:020d}.json"
        if system.get_file_info(manifest).is_file:
            self._drop(messages)
            return
        listed = [m.file for m in messages if m is not None and m.documents]
        self._drop([m for m in messages if m is not None and not m.documents])
        unfinished = f"{root}/{COMMITS}/_{uuid.uuid4().hex}"  # readers skip names with an underscore
        with system.open_output_stream(unfinished) as out:
            out.write(json.dumps({"batch": batchId, "files": listed}).encode())
        system.move(unfinished, manifest)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class PushDocuments(DataSource):
    """``writeStream.format("push_documents").option("path", ..)`` for rows with a string column ``document``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "document string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> PushWriter:  # noqa: N802
        if schema.names != ["document"]:
            raise ValueError("push_documents takes one column, document")
        return PushWriter(self.options["path"])


def push(documents: DataFrame, folder: str, every: str | None = None):
    """Starts publishing the ``document`` column of a stream below ``folder``."""
    spark = documents.sparkSession
    ship_code(spark)
    spark.dataSource.register(PushDocuments)
    writer = documents.select("document").writeStream.format(FORMAT).outputMode("append")
    writer = writer.option("path", f"{folder}/pushed").option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_pushed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, document) of all published documents."""
    commits = spark.read.schema("batch bigint, files array<string>").json(f"{folder}/pushed/{COMMITS}")
    listed = commits.select("batch", F.explode("files").alias("file"))
    lines = spark.read.text(f"{folder}/pushed/{STAGED}").select(F.col("value").alias("document"), F.col("_metadata.file_name").alias("file"))
    return lines.join(listed, "file").select("batch", "document")
