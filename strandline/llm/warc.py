"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from strandline.llm.common import qualified, scratch_folder, store

# Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = {  # column: header
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}

SCHEMA = (
    "file string, offset long, record_type string, record_id string, date string, target_uri string, refers_to string, "
    "payload_digest string, content_type string, content_length long, headers map<string, string>, http_length long, payload binary"
)
CHUNK = 1 << 18
ROWS, BYTES = 500, 8 << 20  # of a batch handed to Spark
ROLL = 128 << 20  # a task starts another file beyond that many bytes


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field ``sl`` has its own length and that of the data, so that it can be skipped."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = struct.pack("<2sHII", b"sl", 8, (len(body) + 32) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if len(body) + 32 >> 32 or len(data) >> 32:
        extra = struct.pack("<2sH8x", b"--", 8)  # too long for the field
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """One record: response with an HTTP head and the payload; revisit with the head alone."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    values = {**row, "content_type": "application/http; msgtype=response"}
    lines = [f"{header}: {_clean(values[c]) if c == 'target_uri' else values[c]}" for c, header in NAMES.items() if values.get(c) is not None]
    if revisit:
        lines.append(f"WARC-Profile: {SAME_PAYLOAD}")
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # name while the job runs, name after it


class WarcWriter(DataSourceArrowWriter):
    """Files get their names when all tasks have ended well; what a failed attempt left is hidden."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, sink, place, size = [], None, "", 0
        fs, root = store(self.folder)
        fs.create_dir(root)
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    place, size = f"{root}/_{name}", 0
                    files.append((f"_{name}", f"part-{name}"))
                    sink = fs.open_output_stream(place, compression=None)
                data = member(record(row))
                sink.write(data)
                size += len(data)
                if size > ROLL:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        fs.create_dir(root)
        for message in messages:
            for before, after in message.files if message else ():
                fs.move(f"{root}/{before}", f"{root}/{after}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.folder)
        for message in messages:
            for before, _ in message.files if message else ():
                fs.delete_file(f"{root}/{before}")


class _Members:
    """Records of a gzip file one after the other: heads first, bodies only where asked for."""

    def __init__(self, source):
        self.source, self.place, self.size = source, 0, source.size()

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], _Members]]:
        while self.place < self.size:
            start = self.place
            self.source.seek(start)
            self.raw = self.source.read(min(CHUNK, self.size - start))
            if self.raw[:2] != b"\x1f\x8b":
                raise ValueError(f"no gzip member at {start}")
            self.length = 0
            if self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\x00":
                self.length = struct.unpack("<I", self.raw[16:20])[0]
            self.inflate, self.data, self.read_to = zlib.decompressobj(31), b"", start
            self.at = start + len(self.raw)
            while (end := self.data.find(b"\r\n\r\n")) < 0 and self._more(4096):
                pass
            if end < 0:
                raise ValueError(f"no record at {start}")
            head, self.data = self.data[:end], self.data[end + 4 :]
            yield start, parse(head), self
            self.place = start + self.length if self.length else self._end()

    def _more(self, most: int) -> bool:
        if self.inflate.eof:
            return False
        feed = self.inflate.unconsumed_tail or self.raw
        if not feed:
            feed = self.source.read(min(CHUNK, self.size - self.at))
            self.at += len(feed)
            if not feed:
                return False
        self.raw = b""
        self.data += self.inflate.decompress(feed, most)
        return True

    def body(self, length: int) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < length:
            self.data = b""
            if not self._more(CHUNK):
                raise ValueError("a record is shorter than its Content-Length")
            parts.append(self.data)
            have += len(self.data)
        whole = b"".join(parts)
        self.data = whole[length:]
        return whole[:length]

    def _end(self) -> int:
        while not self.inflate.eof:
            self.data = b""
            if not self._more(CHUNK):
                raise ValueError("a gzip member is cut off")
        return self.at - len(self.inflate.unused_data)


class _Plain:
    """Records of a file that is not compressed; bodies that are not asked for are not read."""

    def __init__(self, source):
        self.source, self.size = source, source.size()

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], _Plain]]:
        place = 0
        while place < self.size:
            data = b""
            self.source.seek(place)
            while (end := data.find(b"\r\n\r\n")) < 0:
                more = self.source.read(4096)
                if not more:
                    if data.strip():
                        raise ValueError(f"no record at {place}")
                    return
                data += more
            headers = parse(data[:end])
            self.start = place + end + 4
            yield place, headers, self
            place = self.start + int(headers.get("content-length", 0)) + 4

    def body(self, length: int) -> bytes:
        self.source.seek(self.start)
        return self.source.read(length)


def parse(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that starts with white space continues the one before."""
    text = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace"))
    out = {}
    for line in text.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """A partition for each file. Predicates on columns that come from the record's head are applied before
    the payload is touched; records of other types and payloads nobody reads are skipped, not inflated."""

    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload, self.filters = folder, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and f.attribute[0] in NAMES and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, root = store(self.folder)
        info = fs.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            return []
        if info.type == arrow_fs.FileType.File:
            return [File(root)]
        found = fs.get_file_info(arrow_fs.FileSelector(root))
        return [File(i.path) for i in sorted(found, key=lambda i: i.path) if i.base_name.endswith((".warc", ".warc.gz")) and i.base_name[0] not in "_."]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for f in self.filters:
            value = headers.get(NAMES[f.attribute[0]].lower())
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value:
                return False
            if isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringEndsWith) and not value.endswith(f.value):
                return False
            if isinstance(f, StringContains) and f.value not in value:
                return False
        return True

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        schema = pa.schema([
            ("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in NAMES], ("content_length", pa.int64()),
            ("headers", pa.map_(pa.string(), pa.string())), ("http_length", pa.int64()), ("payload", pa.binary()),
        ])
        rows, size = [], 0
        fs, _ = store(self.folder)
        with fs.open_input_file(partition.path) as source:
            for offset, headers, record_ in (_Members if partition.path.endswith(".gz") else _Plain)(source):
                if not self._wanted(headers):
                    continue
                length = int(headers.get("content-length", 0))
                payload, http_length = None, None
                http = headers.get("content-type", "").startswith("application/http")
                if self.payload or http and headers.get("warc-type") == "revisit":
                    payload = record_.body(length)
                    if http:
                        head, _, payload = payload.partition(b"\r\n\r\n")
                        http_length = parse(head).get("content-length")
                        http_length = int(http_length) if http_length and http_length.isdigit() else None
                row = [partition.path, offset, *[headers.get(h.lower()) for h in NAMES.values()], length, list(headers.items()), http_length, payload if self.payload else None]
                rows.append(row)
                size += len(payload or b"")
                if len(rows) >= ROWS or size >= BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    """Options: ``path``, a folder or file with its file system; ``payload`` (default true) to read payloads.

    Writing takes the columns record_type, record_id, date, target_uri, refers_to, payload_digest
    and payload; it adds files to the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode('append')")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(
    pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes the smallest page id's is the response.

    The others are revisits that refer to it. Only payloads that occur more than once meet the pages, by
    digest; the join is split where one payload has a large share of the pages.

    Defined cases: null html is an empty payload, null urls are left out of the record; rows that
    repeat the response's page id are responses too; null ids never win over others, and are
    responses where there is no other; record ids are ``urn:page:`` and the id (``none`` for null), so
    rows with equal ids have equal record ids. Other columns are not stored.
    """
    paged = pages.select(
        F.col(page_id).alias("page"), F.col(url).cast("string").alias("target_uri"),
        F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    repeated = (
        paged.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page"))
    return paged.join(repeated, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page").alias("record_id"),
        F.lit(date).alias("date"),
        "target_uri",
        F.when(again, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload",
    )


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and list them from the archives read back.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``. Bytes and
    digest of a response are those of the payload that was read, those of a revisit are from its heads.
    """
    spark = pages.sparkSession
    register(spark)
    folder = qualified(spark, scratch_folder(spark, "archives"))
    page_records(pages, **options).write.format("warc").mode("append").save(folder)
    records = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
