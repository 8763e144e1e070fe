"""WARC archives as a Spark data source, with payload deduplication by revisit records.

Files hold one gzip member per record, whose header names the member's length ("sl" extra field), so that a reader
that does not want a record skips it after its headers. Plain, and gzipped files without that field, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from quillspark.llm.common import narrowed, scratch

READ = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose "sl" field holds its own length and the record's."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if len(body) >= 2**31 or len(record) >= 2**31:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, digest: str, length: int, refers_to: str | None) -> bytes:
    """One record: an HTTP head naming the payload's length and, in responses, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else "%0D%0A"[3 * (c == "\n") :][:3] for c in uri))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Files(InputPartition):
    files: list


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Window:
    """Reads of a file at any place, from a chunk held in memory."""

    def __init__(self, file, chunk: int = 1 << 22):
        self.file, self.chunk, self.start, self.held = file, chunk, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.held)):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, self.chunk))
        return self.held[at - self.start : at - self.start + n]


def _header(raw: bytes) -> dict[str, str]:
    """Names and values of a record's header; lines that begin with a blank go on with the value before them."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name.strip().lower()] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    """Plans file partitions from the manifest, takes header predicates, and decodes payloads last.

    Predicates on header columns are evaluated on the parsed headers; the payload of a record that fails is neither
    inflated nor read beyond the chunk at hand. Option payload=false leaves all payloads out. Payloads that are
    decoded are held against their digests unless verify=false.
    """

    def __init__(self, options: dict):
        self.path, self.tests = options["path"], []
        self.wanted, self.verify = options.get("payload", "true") == "true", options.get("verify", "true") == "true"
        self.target = int(options.get("partitionbytes", 64 << 20))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            known = column in NAMES or column == "content_length"
            kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts", IsNotNull: "there"}
            if known and type(f) in kinds:
                self.tests.append((column, kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _place(self.path)
        with_manifest = fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File
        if with_manifest:
            files = [(f"{path}/{name}", size) for name, size in json.loads(fs.open_input_stream(f"{path}/{MANIFEST}").read())]
        elif fs.get_file_info(path).type == pafs.FileType.File:
            files = [(path, fs.get_file_info(path).size)]
        else:
            files = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.path.rsplit("/", 1)[1][0] not in "._"]
        out, size = [], self.target
        for name, n in sorted(files):
            if size + n > self.target:
                out.append(_Files([]))
                size = 0
            out[-1].files.append(name)
            size += n
        return out or [_Files([])]

    def _keeps(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            x = row[column]
            if x is None:
                return False
            if not {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "starts": lambda: x.startswith(value), "there": lambda: True}[kind]():
                return False
        return True

    def _records(self, fs, name: str) -> Iterator[dict]:
        end = fs.get_file_info(name).size
        with fs.open_input_file(name) as file:
            window, at = _Window(file), 0
            while at < end:
                first = window.get(at, min(1024, end - at))
                packed = first[:2] == b"\x1f\x8b"
                if packed:
                    length = struct.unpack_from("<I", first, 16)[0] if first[3] & 4 and first[12:14] == b"sl" else None
                    inflate, fed, seen = zlib.decompressobj(31), 0, b""
                    step = 2048

                    def more(most: int, at=at, inflate=inflate, length=length) -> bytes:
                        nonlocal fed
                        if inflate.unconsumed_tail:
                            return inflate.decompress(inflate.unconsumed_tail, most)
                        piece = window.get(at + fed, min(max(step, most // 2), (at + length if length else end) - at - fed))
                        fed += len(piece)
                        return inflate.decompress(piece, most)
                else:
                    inflate, fed, seen, length = None, 0, b"", None

                    def more(most: int, at=at) -> bytes:
                        nonlocal fed
                        piece = window.get(at + fed, min(most, end - at - fed))
                        fed += len(piece)
                        return piece

                while b"\r\n\r\n" not in seen:
                    piece = more(4096)
                    if not piece and (not packed or inflate.eof or at + fed >= end):
                        raise ValueError(f"{name}: no record at {at}")
                    seen += piece
                raw, _, seen = seen.partition(b"\r\n\r\n")
                headers = _header(raw)
                size = int(headers["content-length"])
                row = {c: headers.get(h) for c, h in NAMES.items()} | {"content_length": size, "headers": list(headers.items()), "payload": None, "payload_length": None}
                row["payload_digest"] = (row["payload_digest"] or "").rpartition(":")[2] or None
                if self._keeps(row):
                    need = size if self.wanted else 0
                    parts, got = [seen], len(seen)
                    http = "http" in (row["content_type"] or "")
                    while got < need or (http and got < size and b"\r\n\r\n" not in parts[0]):
                        piece = more(max(1 << 16, need - got))
                        if not piece and (not packed or inflate.eof):
                            raise ValueError(f"{name}: the record at {at} is cut short")
                        if len(parts) == 1 and not self.wanted:
                            parts[0] += piece
                        else:
                            parts.append(piece)
                        got += len(piece)
                    block = b"".join(parts)[:size]
                    body = block
                    row["payload_length"] = size
                    if http:
                        top, _, body = block.partition(b"\r\n\r\n")
                        row["payload_length"] = int(_header(top).get("content-length", size - len(top) - 4))
                    if self.wanted and row["record_type"] != "revisit":
                        row["payload"] = body
                        if self.verify and row["payload_digest"] and base32_sha1(body) != row["payload_digest"]:
                            raise ValueError(f"{name}: the payload of {row['record_id']} does not have its digest")
                    yield row
                if packed and length:
                    at += length
                elif packed:
                    while not inflate.eof:
                        if not more(1 << 20) and at + fed >= end and not inflate.unconsumed_tail and not inflate.eof:
                            raise ValueError(f"{name}: the member at {at} is cut short")
                    at += fed - len(inflate.unused_data)
                else:
                    at += len(raw) + 4 + size + 4

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        schema = pa.schema([(name, kinds.get(name, pa.string())) for name in (c.split()[0] for c in READ.split(", "))])
        fs = _place(self.path)[0]
        rows, size = [], 0
        for name in partition.files:
            for row in self._records(fs, name):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    """Writes records to files of bounded size; only files named in the manifest, written at commit, count.

    A lost or repeated task leaves files that no manifest names; commit and abort remove them.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.roll, self.level = int(options.get("filebytes", 128 << 20)), int(options.get("level", 6))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                payload = r["payload"] or b""
                raw = member(record(r["record_type"], r["record_id"], r["target_uri"], r["date"], payload, base32_sha1(payload), len(payload), r["refers_to"]), self.level)
                if out is None or size + len(raw) > self.roll:
                    if out is not None:
                        out.close()
                        files.append((name, size))
                    name, size = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def _clear(self, fs, path: str, kept: set) -> None:
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            name = f.path.rsplit("/", 1)[1]
            if f.type == pafs.FileType.File and name not in kept and (self.overwrite or name.startswith(f"part-{self.job}")):
                fs.delete_file(f.path)

    def commit(self, messages: list) -> None:
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        files = [x for m in messages if m for x in m.files]
        if not self.overwrite and fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            files = json.loads(fs.open_input_stream(f"{path}/{MANIFEST}").read()) + files
        with fs.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())
        self._clear(fs, path, {name for name, _ in files} | {MANIFEST})

    def abort(self, messages: list) -> None:
        fs, path = _place(self.path)
        if not self.overwrite:
            self._clear(fs, path, {MANIFEST})


class WarcDataSource(DataSource):
    """spark.read.format("warc") and df.write.format("warc"); paths are anything pyarrow's file systems open."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(df: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each row: of equal payloads of at least `least` bytes, the smallest key's is the response.

    Null bodies are empty payloads. Rows that share the smallest key of their payload are all responses, and so is a
    payload of null keys alone; a null key never stands for others. The grouping by digest is a partial minimum, and
    only digests found twice meet the rows again, in a join whose hot keys adaptive execution splits.
    """
    rows = narrowed(df, key=key, uri=uri, body=body).select(F.col("key").cast("long").alias("key"), F.col("uri").cast("string").alias("uri"), F.coalesce(F.col("body").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = rows.join(groups.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.octet_length("payload") >= least) & ~F.col("key").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("key")).alias("record_id"), F.col("uri").alias("target_uri"),
        F.lit(date).alias("date"), "payload", F.when(revisit, name(F.col("first"))).alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as records and reads the archives back: payloads of responses, headers alone of revisits.

    An empty table gives empty archives and no rows; columns besides page_id, url and html play no part.
    """
    register(spark)
    path = scratch(spark, "warc")
    records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").option("level", 1).save(path)
    read = spark.read.format("warc").option("path", path)
    answers = read.load().where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = read.option("payload", "false").load().where("record_type = 'revisit'").withColumn("payload_bytes", F.col("payload_length"))
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    both = answers.drop("payload").unionByName(again.drop("payload"))
    return both.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")
