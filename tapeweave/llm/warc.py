"""WARC archives as a PySpark data source, and pages to archives and back.

spark.read.format("warc") plans one partition per archive file. A reader gets each record's header
block first; the record-type and header predicates that Spark pushed down are tried there, and the
payload of a record that fails them, or whose payload column isn't wanted (option payload=false),
is skipped over without being decoded. df.write.format("warc") writes one record per row. Each file
is written under an attempt's own name, and only those of committed tasks are moved into place.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tapeweave.llm.common import shared_dir

CHUNK = 1 << 16
LEVEL = 2  # of gzip
# Fixed values of the format, WARC/1.1.
VERSION = b"WARC/1.1"
TYPE, ID, URI, DATE, LENGTH, DIGEST, REFERS = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Refers-To"
PROFILE, SAME_PAYLOAD = "WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL_LENGTH = "X-Full-Payload-Length"  # our own field: bytes of the payload that a revisit leaves out
COLUMNS = {"record_type": TYPE, "record_id": ID, "target_uri": URI, "date": DATE, "payload_digest": DIGEST, "refers_to": REFERS, "full_length": FULL_LENGTH}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, full_length string, payload binary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    final: str | None


class Stream:
    """Bytes of a run of gzip members, or of a plain file, with bounded memory."""

    def __init__(self, raw, packed: bool):
        self.raw, self.packed, self.inner, self.buffer = raw, packed, None, b""

    def _more(self) -> bool:
        chunk = self.raw.read(CHUNK)
        if not self.packed:
            self.buffer += chunk
            return bool(chunk)
        while chunk:
            self.inner = self.inner or zlib.decompressobj(31)
            self.buffer += self.inner.decompress(chunk)
            chunk = self.inner.unused_data if self.inner.eof else b""
            if self.inner.eof:
                self.inner = None
            if not chunk:
                return True
        return False

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.buffer = self.buffer[: end + 1], self.buffer[end + 1 :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        out = io.BytesIO()
        while n > 0:
            if not self.buffer and not self._more():
                break
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            if keep:
                out.write(part)
        return out.getvalue()


def records(stream: Stream, wanted, payload: bool) -> Iterator[dict[str, str | bytes | None]]:
    """Header fields of each record that wanted(header) accepts, with its payload under "" if asked for."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header: dict[str, str | bytes | None] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip()] = value.strip()
        keep = wanted(header)
        body = stream.take(int(header.get(LENGTH) or 0), keep and payload)
        if keep:
            yield header | {"": body if payload else None}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.equal: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, (EqualTo, In)) and name in COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[COLUMNS[name]] = self.equal.get(COLUMNS[name], values) & values
            elif isinstance(f, IsNotNull) and name in COLUMNS:
                self.present.add(COLUMNS[name])
            else:
                yield f

    def partitions(self) -> list[File]:
        where, root = place(self.path)
        found = [f.path for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path]
        return [File(p) for p in sorted(found)]

    def wanted(self, header: dict[str, str]) -> bool:
        return all(header.get(k) in v for k, v in self.equal.items()) and all(k in header for k in self.present)

    def read(self, part: File) -> Iterator[tuple]:
        if part is None:
            return
        where, _ = place(self.path)
        with where.open_input_stream(part.path, compression=None) as raw:
            for h in records(Stream(raw, part.path.endswith(".gz")), self.wanted, self.payload):
                yield (*(h.get(name) for name in COLUMNS.values()), h[""])


class WarcWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.packed = options["path"], str(options.get("compress", "true")).lower() != "false"
        if overwrite:
            raise ValueError("archives are only appended to")

    def write(self, rows: Iterator) -> Written:
        where, root = place(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed
        attempt, final = f"{root}/_tmp-{name}", f"{root}/{name}"
        where.create_dir(root, recursive=True)
        out, count = None, 0
        for row in rows:
            out = out or where.open_output_stream(attempt, compression=None)
            out.write(record(row.asDict(), self.packed))
            count += 1
        if out is None:
            return Written(None, None)
        out.close()
        return Written(attempt, final)

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = place(self.path)
        for m in messages:
            if m is not None and m.path:
                where.move(m.path, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = place(self.path)
        for m in messages:
            if m is not None and m.path:
                where.delete_file(m.path)


def record(row: dict, packed: bool) -> bytes:
    """One record; a null field is left out, a null payload is empty."""
    body = bytes(row.get("payload") or b"")
    head = [VERSION, *(f"{name}: {_line(row[c])}".encode() for c, name in COLUMNS.items() if row.get(c) is not None)]
    if row.get("record_type") == "revisit":
        head.append(f"{PROFILE}: {SAME_PAYLOAD}".encode())
    head.append(f"{LENGTH}: {len(body)}".encode())
    data = b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"
    if not packed:
        return data
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(value: str) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_of_hex(digest) -> F.Column:
    """Upper-case base 32 of a 40-digit hex column: four numbers of 40 bits, eight letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = F.transform(F.array(*[F.lit(at) for at in (1, 11, 21, 31)]), lambda at: F.conv(F.substring(digest, at, F.lit(10)), 16, 10).cast("bigint"))
    letter = lambda x, i: F.substring(letters, (F.shiftright(x, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(*[letter(x, i) for i in range(8)])), "")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page into path.

    Of equal payloads of at least least_bytes bytes the row with the smallest page_id is a response,
    the others are revisits that refer to it and carry no payload. Null html is empty, a null url is
    left out. Of rows that share the smallest page_id each is a response; where no row has a page_id,
    each is one. The html goes through one shuffle, by digest.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    first = rows.select("page_id", "sha1").groupBy("sha1").agg(F.min("page_id").alias("first"))
    again = (F.octet_length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.join(first, "sha1").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"))).alias("payload_digest"),
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        F.octet_length("payload").cast("string").alias("full_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (bare), record_type, refers_to (page_id), url, intact.

    A response's bytes and digest are those of the payload that was read, and intact says that its
    header agrees; a revisit has no payload, so its header counts.
    """
    got = read_archive(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    real = F.col("record_type") == "response"
    digest = F.when(real, base32_of_hex(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    size = F.when(real, F.octet_length("payload")).otherwise(F.col("full_length").cast("int")).cast("long")
    return got.select(
        number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
        (F.concat(F.lit("sha1:"), digest).eqNullSafe(F.col("payload_digest")) & (size.cast("string") == F.col("full_length"))).alias("intact"),
    )


def through_archives(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages written to archives in the shared folder and read back; see page_records."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path, least_bytes)
    return page_records(spark, path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
