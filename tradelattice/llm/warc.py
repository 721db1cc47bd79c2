"""WARC archives as a Spark data source (format ``warc``), and archives of pages with equal payloads stored once.

Writing makes gzipped WARC/1.1 files, one gzip member a record, each member with its own compressed size in an ``sl``
extra field, and a manifest of the files of tasks that were committed. Reading plans one partition a file, takes
equality and membership predicates on the header columns, inflates the first bytes of a member, parses the headers and
only then decides: the payload of a record that no one wants is passed over by a seek, without being inflated or copied
(members of other writers, without the size, are inflated but not decoded). ``option("payload", "false")`` leaves all
payloads out.

Paths are those of pyarrow's file systems. Defined results: a null payload is written as empty; records keep their
count, repeated ones too; an empty table writes no file and reads as no record.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from tradelattice.session import scratch_path, stage

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary")
FIELDS = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest")]
                   + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
HEADERS = {  # fixed values: names of the format
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
LENGTH = "X-Payload-Length"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_files.json"
FILE_BYTES, HEAD_BYTES, BATCH_BYTES = 64 << 20, 4096, 8 << 20


def record_bytes(record: dict) -> bytes:
    payload = (record["payload"] or b"") if record["record_type"] == "response" else b""
    block = b""
    if record["record_type"] == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", *(f"{name}: {clean(record[c])}" for c, name in HEADERS.items() if record[c] is not None)]
    if record["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {SAME_PAYLOAD}")
    lines += [f"{LENGTH}: {record['payload_bytes'] or 0}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header's value on one line."""
    return " ".join(str(value).split("\n")).replace("\r", " ")


def member(data: bytes) -> bytes:
    """A gzip member that says its own size."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.before = path, [] if overwrite else listed(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for record in batch.to_pylist():
                    if out is None:
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        files.append(name)
                        out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                    packed = member(record_bytes(record))
                    out.write(packed)
                    size += len(packed)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        names = self.before + [name for m in messages if m for name in m.files]
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.delete_file(f"{root}/{name}")


def listed(path: str) -> list[str]:
    """Names of the archives of a folder: those of its manifest, or all of a folder without one."""
    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with system.open_input_file(f"{root}/{MANIFEST}") as file:
            return json.loads(file.read())
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith((".warc.gz", ".warc")))


@dataclass
class OneFile(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else ""
            if name in HEADERS:
                self.wanted.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[OneFile]:
        return [OneFile(name) for name in listed(self.path)]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, root = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with system.open_input_file(f"{root}/{partition.name}") as file:
            walk = members(file) if partition.name.endswith(".gz") else plain_records(file)
            for headers, payload in walk:
                if all(headers.get(HEADERS[c]) in values for c, values in self.wanted):
                    rows.append(self.row(headers, payload))
                    size += len(rows[-1]["payload"] or b"") + 200
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FIELDS)

    def row(self, headers: dict[str, str], payload) -> dict:
        found = {c: headers.get(name) for c, name in HEADERS.items()}
        found["payload_bytes"] = int(headers[LENGTH]) if LENGTH in headers else None
        found["payload"] = payload() if self.payload and found["record_type"] != "revisit" else None
        if found["payload_bytes"] is None and found["payload"] is not None:
            found["payload_bytes"] = len(found["payload"])
        return found


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """A record's block without the HTTP headers that stand before the payload."""
    if headers.get("Content-Type", "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def members(file) -> Iterator[tuple[dict[str, str], object]]:
    """(headers, payload function) of each gzip member; payloads not asked for are passed over."""
    start, end = 0, file.size()
    while start < end:
        file.seek(start)
        lead = file.read(24)
        size = struct.unpack("<I", lead[16:20])[0] if len(lead) == 24 and lead[3] == 4 and lead[12:14] == b"sl" else 0
        file.seek(start)
        inflate, data, at = zlib.decompressobj(31), b"", start
        while b"\r\n\r\n" not in data and not inflate.eof and at < end:
            chunk = file.read(HEAD_BYTES)
            at += len(chunk)
            data += inflate.decompress(chunk)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        state = {"rest": [rest], "at": at}

        def inflate_all(inflate=inflate, state=state):
            while not inflate.eof and state["at"] < end:
                file.seek(state["at"])
                chunk = file.read(1 << 16)
                state["at"] += len(chunk)
                state["rest"].append(inflate.decompress(chunk))

        def payload(headers=headers, state=state, inflate_all=inflate_all):
            inflate_all()
            return payload_of(headers, b"".join(state["rest"])[:int(headers.get("Content-Length", 0))])

        yield headers, payload
        if size:
            start += size
        else:
            inflate_all()
            start = state["at"] - len(inflate.unused_data)


def plain_records(file) -> Iterator[tuple[dict[str, str], object]]:
    """The same for a file that is not compressed."""
    start, end = 0, file.size()
    while start < end:
        file.seek(start)
        data = b""
        while b"\r\n\r\n" not in data and start + len(data) < end:
            data += file.read(HEAD_BYTES)
        head = data.partition(b"\r\n\r\n")[0]
        if not head.strip():
            return
        headers, begin = parse_headers(head), start + len(head) + 4
        length = int(headers.get("Content-Length", 0))

        def payload(headers=headers, begin=begin, length=length):
            file.seek(begin)
            return payload_of(headers, file.read(length))

        yield headers, payload
        start = begin + length + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(digest: Column) -> Column:
    """A hexadecimal digest of 40 digits in base 32, without a UDF: five digits are four characters."""
    letters, out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(8):
        number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least_bytes`` bytes the largest page_id is a response, the others revisit it.

    Rows that repeat that page_id are responses too; pages without id revisit it, and are responses where no page has one.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    copied = stage(
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 and kept is not null").select("sha1", "kept"), "copied",
    )
    marked = rows.join(copied, "sha1", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return marked.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").cast("string").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        "payload_bytes", F.when(revisit, F.concat(F.lit("urn:page:"), F.col("kept").cast("string"))).alias("refers_to"),
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def archive(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> str:
    """Write pages as archives; returns the folder (a new one below the shared folder, if none is given)."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    # A path without a scheme is one of the session's default file system.
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    path = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    page_records(pages, least_bytes).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
