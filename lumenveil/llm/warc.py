"""WARC archives as a PySpark data source: spark.read.format("warc") and df.write.format("warc").

Files are gzip with one member for each record, and every member says its length in an extra field ("sl"), so
that a reader can hop from record to record. The reader plans partitions from the writer's manifest: files, cut
at record boundaries into ranges of about SPLIT bytes (files without a manifest are one range each). In a range it
inflates only a record's head, puts the pushed-down predicates on record type and headers to it, and leaves
the payload of a record alone if the record is unwanted or no payload column is asked for.

A writer's task writes a file of its own name; the manifest that names the files is written once, at
commit, so files of failed or repeated tasks are never read. Paths are URIs of any file system
that pyarrow knows (file, hdfs, s3, ...).

Record types: of equal payloads of at least REVISIT_BYTES bytes the row with the smallest page_id is the response and the
others revisit it; smaller payloads are all responses.

Defined cases: null html is an empty payload; a null page_id is written as such, read back as null, and
never the one that others revisit unless all are null (then all are responses); repeated rows with the smallest page_id are
responses each; control characters and blanks in a url are percent-encoded; a null url has no header; an
empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from ._common import broadcast_if_small, materialize

REVISIT_BYTES = 100
SPLIT = 32 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes bigint, payload binary, computed_digest string"
)
ARROW = {n: {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t] for n, t in (x.split() for x in SCHEMA.split(", "))}
#: Columns that need the payload; all others come from the head.
DEEP = {"payload", "computed_digest"}


def _fs(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


# ---------------------------------------------------------------- records


def head(record_type: str, record_id: str, uri: str | None, digest: str, refers_to: str | None, n_payload: int) -> bytes:
    """The WARC and HTTP headers of a record; the HTTP Content-Length is the full payload's in revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_payload}\r\n\r\n".encode()
    block = len(http) + (n_payload if record_type == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + http


def member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds the member's length and the data's, so that it can be skipped."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    length = 12 + 16 + len(body) + 8
    return (
        b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 16) + b"sl" + struct.pack("<HIQ", 12, len(data) & 0xFFFFFFFF, length) + body
        + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    )


def _parse(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Headers of a record (HTTP ones prefixed http:) and where the payload starts; None if raw is cut short."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = end + 4
    if found.get("content-type", "").startswith("application/http"):
        stop = raw.find(b"\r\n\r\n", start)
        if stop < 0:
            return None
        for x in raw[start:stop].decode("latin-1").split("\r\n")[1:]:
            k, _, v = x.partition(":")
            found["http:" + k.strip().lower()] = v.strip()
        start = stop + 4
    return found, start


_COLUMN_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def _row(headers: dict[str, str]) -> dict:
    out: dict = {c: headers.get(h) for c, h in _COLUMN_OF.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c].strip("<>") if out[c] is not None else None
    if out["payload_digest"] is not None:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha256:")
    size = headers.get("http:content-length") or headers.get("content-length")
    out["payload_bytes"] = int(size) if size is not None else None
    return out


# ---------------------------------------------------------------- reading


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int | None):
        super().__init__((uri, start, end))
        self.uri, self.start, self.end = uri, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.wanted = path, names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes predicates on header columns; gives the rest back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _COLUMN_OF and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, base = _fs(self.path)
        try:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
            return [Range(f"{self.path}/{x['name']}", a, b) for x in files for a, b in zip(x["cuts"], [*x["cuts"][1:], x["size"]]) if b > a]
        except FileNotFoundError:
            found = [x for x in fs.get_file_info(FileSelector(base)) if x.is_file and x.base_name.endswith((".warc.gz", ".warc"))]
            return [Range(f"{self.path}/{x.base_name}", 0, None) for x in sorted(found, key=lambda x: x.path)]

    def _keeps(self, row: dict) -> bool:
        for f in self.wanted:
            v = row[f.attribute[0]]
            if isinstance(f, IsNotNull):
                ok = v is not None
            elif isinstance(f, EqualTo):
                ok = v == f.value
            elif isinstance(f, In):
                ok = v in f.value
            else:
                ok = v is not None and v.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without records has no partitions
            return
        schema = pa.schema([(n, ARROW[n]) for n in self.names])
        deep = bool(DEEP & set(self.names))
        rows: list[dict] = []
        size = 0
        fs, path = _fs(partition.uri)
        with fs.open_input_file(path) as f:
            at, end = partition.start, partition.end if partition.end is not None else f.size()
            while at < end:
                f.seek(at)
                start = f.read(4096)
                length = None
                if start[3] & 4 and start[12:14] == b"sl":
                    length = struct.unpack("<Q", start[20:28])[0]
                    raw = zlib.decompressobj(-15).decompress(start[28:], 2048)
                else:
                    raw = zlib.decompressobj(31).decompress(start, 2048)
                parsed, whole = _parse(raw), None
                if parsed is None or length is None:
                    whole, length = self._inflate(f, at, length)
                    parsed = _parse(whole)
                if parsed is None:
                    raise ValueError(f"no WARC record at {at} of {partition.uri}")
                headers, payload_at = parsed
                row = _row(headers)
                if self._keeps(row):
                    if deep and row["record_type"] != "revisit":
                        if whole is None:
                            whole, _ = self._inflate(f, at, length)
                        block = whole.find(b"\r\n\r\n") + 4 + int(headers["content-length"])
                        row["payload"] = whole[payload_at:block]
                        if "computed_digest" in self.names:
                            row["computed_digest"] = hashlib.sha256(row["payload"]).hexdigest()
                        size += len(row["payload"]) * ("payload" in self.names)
                    rows.append({n: row.get(n) for n in schema.names})
                at += length
                if len(rows) >= 2048 or size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _inflate(f, at: int, length: int | None) -> tuple[bytes, int]:
        """The member at an offset, whole, and its length."""
        f.seek(at)
        d = zlib.decompressobj(31)
        if length is not None:
            return d.decompress(f.read(length)), length
        out, n = [], 0
        while not d.eof and (part := f.read(1 << 16)):
            out.append(d.decompress(part))
            n += len(part)
        return b"".join(out), n - len(d.unused_data)


# ---------------------------------------------------------------- writing


class Written(WriterCommitMessage):
    def __init__(self, name: str, size: int, cuts: list[int]):
        self.name, self.size, self.cuts = name, size, cuts


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, html, payload_digest, refers_to) -> records. refers_to is null for responses."""

    def __init__(self, path: str):
        self.path = path
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _fs(self.path)
        name, size, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in iterator:
                for page_id, url, text, digest, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to", "revisit"))):
                    payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    kind = "revisit" if revisit.as_py() else "response"
                    first = head(kind, record_id(page_id.as_py()), url.as_py(), digest.as_py(), record_id(refers_to.as_py()), len(payload))
                    data = member(first + (payload if kind == "response" else b"") + b"\r\n\r\n")
                    if size - cuts[-1] >= SPLIT:
                        cuts.append(size)
                    out.write(data)
                    size += len(data)
        return Written(name, size, cuts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps([{"name": m.name, "size": m.size, "cuts": m.cuts} for m in messages if m is not None and m.size]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{base}/{m.name}")


def record_id(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"].rstrip("/"), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"].rstrip("/"))


# ---------------------------------------------------------------- operator


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every page."""
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    own = own.withColumn("payload_digest", F.sha2(F.col("html"), 256))
    large = F.octet_length("html") >= REVISIT_BYTES
    # Only payloads that occur more than once; summed before the shuffle, without the payloads.
    first = own.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    first = materialize(first.select(F.col("payload_digest").alias("known"), "first"), "payloads")
    joined = own.join(broadcast_if_small(first, 96), (own["payload_digest"] == F.col("known")) & large, "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = joined.select("page_id", "url", "html", "payload_digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    rows.write.format("warc").mode("append").save(path)


def read_archive(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archive's records; columns: those of SCHEMA that are wanted, so that payloads can stay packed."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns:
        types = dict(x.split() for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {types[c]}" for c in columns))
    return reader.load(path)
