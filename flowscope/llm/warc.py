"""WARC archives as a Spark data source.

Writing: every task writes one archive file of gzip members, one per record, so a record can be skipped or read by
itself.  Reading: every file is a partition; filters on ``record_type`` and on header columns are taken over by the
reader, which parses a record's headers first, drops the record if they do not match, and decodes the payload only of
records that stay and only if the schema asks for it.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).where("record_type = 'response'")
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from flowscope.llm.common import ship_code, text_column
from flowscope.session import shared_folder

CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# record columns and the headers that hold them
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes bigint, payload binary"


def clean_header(value: str) -> str:
    """A header value on one line; percent signs and controls are percent-encoded, which ``read_header`` undoes."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def read_header(value: str) -> str:
    head, *rest = value.split("%")
    return head + "".join(chr(int(p[:2], 16)) + p[2:] for p in rest)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One record.  The HTTP header block gives the length of the payload, which a revisit record leaves out."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += b"" if revisit else payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = row.get(column)
        if value is not None:
            mark = "sha1:" if column == "payload_digest" else ""
            lines.append(f"{header}: {mark}{clean_header(value)}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


class Members:
    """Sequential reading of gzip members without holding a file: headers of a member first, the rest on demand."""

    def __init__(self, stream):
        self.stream, self.raw = stream, b""
        self.start()

    def start(self) -> None:
        self.inflate, self.text = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflates some more of this member; false at its end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        ended = not self.raw
        new = self.inflate.decompress(self.raw, CHUNK)
        if ended and not new:
            return False
        self.text += new
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Text up to and with ``mark``, taken away; null at the end of the file."""
        seen = 0
        while (at := self.text.find(mark, seen)) < 0:
            seen = max(0, len(self.text) - len(mark))
            if not self.more():
                return None
        out, self.text = self.text[: at + len(mark)], self.text[at + len(mark) :]
        return out

    def take(self, size: int) -> bytes:
        parts, have = [self.text], len(self.text)
        while have < size:
            self.text = b""
            if not self.more():
                raise EOFError("a WARC record is shorter than its header says")
            parts.append(self.text)
            have += len(self.text)
        whole = b"".join(parts)
        self.text = whole[size:]
        return whole[:size]

    def skip(self) -> bool:
        """To the next member; what is left of this one is inflated in pieces that are thrown away."""
        while not self.inflate.eof:
            self.text = b""
            if not self.more():
                return False
        self.start()
        return True


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:] if ": " in line)}


def header_row(header: dict[str, str]) -> dict[str, str | None]:
    row = {}
    for column, name in HEADERS.items():
        value = header.get(name.lower())
        if value is not None and column == "payload_digest":
            value = value.removeprefix("sha1:")
        row[column] = None if value is None else read_header(value)
    return row


def matches(row: dict, filters: list) -> bool:
    for f in filters:
        value = row[f.attribute[0]]
        if isinstance(f, EqualTo):
            ok = value == f.value
        elif isinstance(f, In):
            ok = value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = (value is None) == isinstance(f, IsNull)
        if not ok:
            return False
    return True


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.columns, self.filters = options["path"], schema.fieldNames(), []
        self.verify = options.get("verify", "false").lower() == "true"

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)) and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, root = pafs.FileSystem.from_uri(self.path)
        files = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        found = [File(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".warc.gz")]
        return found or [File("")]  # a source needs a partition

    def read(self, partition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        wants_payload, wants_size = "payload" in self.columns, "payload_bytes" in self.columns
        with system.open_input_stream(partition.path, compression=None) as stream:
            members = Members(stream)
            while (block := members.until(b"\r\n\r\n")) is not None:
                header = parse_header(block)
                row = header_row(header)
                if matches(row, self.filters):
                    if wants_payload or wants_size or self.verify:
                        size = int(header["content-length"])
                        http = members.until(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n") if ": " in x)
                        row["payload_bytes"] = int(fields["Content-Length"])
                        whole = row["record_type"] != "revisit"
                        if wants_payload or self.verify:
                            row["payload"] = members.take(size - len(http)) if whole else None
                            if self.verify and whole and digest(row["payload"]) != row["payload_digest"]:
                                raise ValueError(f"payload of {row['record_id']} does not match its digest")
                    yield tuple(row.get(c) for c in self.columns)
                if not members.skip():
                    return


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches) -> WriterCommitMessage:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}"
        kept = WrittenFile(f"{name}.tmp", f"{name}.warc.gz")
        with system.open_output_stream(kept.temporary, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(record_bytes(row)) + pack.flush())
        return kept

    def commit(self, messages):
        """Files of tasks that were retried or ran twice keep their temporary names and are never read."""
        system, root = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.path.endswith(".warc.gz"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)

    def abort(self, messages):
        system, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.temporary).type != pafs.FileType.NotFound:
                system.delete_file(m.temporary)


class WrittenFile(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class WarcSource(DataSource):
    """``warc``: a folder of ``*.warc.gz`` files.  A schema with fewer columns skips what it does not name."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), schema, overwrite)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def base32(hexadecimal):
    """Upper-case base32 of a hexadecimal string whose length is a multiple of ten (a SHA-1 has 40 digits)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.lpad(F.conv(F.substring(hexadecimal, 1, 10), 16, 2), 40, "0")
    for at in range(11, 41, 10):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 2), 40, "0"))
    digits = [
        F.substring(F.lit(alphabet), (F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1), F.lit(1)) for k in range(32)
    ]
    return F.concat(*digits)


def archive_pages(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url: str = "url",
                  html: str = "html") -> None:
    """Writes one record per row of ``pages`` to ``folder``.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is a response and the others
    revisit it; smaller payloads are all responses.  Null payloads are empty; a null url leaves its header out.  Rows
    without an id are responses that nothing revisits; of repeated rows of one id, each is written, all as the first or
    all as revisits.
    """
    ship_code(pages.sparkSession)
    pages.sparkSession.dataSource.register(WarcSource)
    payload = F.encode(text_column(pages, html), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    named = rows.select("id", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    # first the small table: which rows are revisits, and of what
    firsts = named.where("id is not null").groupBy("sha1", "size").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    firsts = firsts.where((F.col("copies") > 1) & (F.col("size") >= least)).drop("copies")
    revisits = named.join(firsts, ["sha1", "size"]).where("id > first").select("id", "sha1", "first").distinct()
    digested = rows.withColumn("sha1", F.sha1("payload"))
    whole = digested.join(revisits, ["id", "sha1"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    records = whole.select(
        name(F.col("id")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date"), base32(F.col("sha1")).alias("payload_digest"),
        name(F.col("first")).alias("refers_to"), F.length("payload").cast("bigint").alias("payload_bytes"), "payload",
    )
    records.write.format("warc").mode("append").save(as_uri(folder))


def read_archives(spark: SparkSession, folder: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records under ``folder``; without ``payload`` no payload is decoded, with ``verify`` digests are checked.

    Turns on filter push-down to Python sources in the session, without which Spark refuses a reader that takes filters.
    """
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    columns = SCHEMA if payload else SCHEMA.removesuffix(", payload binary")
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(as_uri(folder))


def page_id_of(record_id):
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).cast("bigint")


def page_archive_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
