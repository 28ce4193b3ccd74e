"""WARC archives, and a normaliser of those that are one gzip stream.

Archives from a plain gzip of a whole file can't be read in parts. The normaliser inflates such a stream once, from front to back, and writes each
record as a gzip member of its own, with a sidecar index of one JSON line per record: archive, offset and length of its member, record id, type and
payload digest. Readers then take any records by seeking. All is streamed: no archive and no record need fit in memory but for the one payload a
reader asks for.

Archives are written by tasks to the shared folder, under a name of the attempt that is then changed to the task's, so that a repeated task replaces its
file and a lost executor costs its own tasks only. Null payloads count as empty, null urls are left out of the header, and a null id is written as
such. Of repeated rows each is a record; those that share both the payload and the largest id are all responses. Extra columns are left out. An
empty table gives no records."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import materialise, new_path

LEAST_BYTES = 1000
ARCHIVE_BYTES = 512 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, type string, digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def head(page_id: int | None, url: str | None, digest: bytes, payload_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """Of a record: the WARC header and the HTTP header, which counts to the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http;msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode()]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else payload_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class Archive:
    """A file under an attempt's name until it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, path = located(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}-{uuid.uuid4().hex}"
        self.uri = f"{folder}/{name}"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def write_batches(batches: Iterable[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    """Columns: page_id, url, payload (binary), revisit, refers_to. Gives the archives written."""
    task, number, archive, size = TaskContext.get().partitionId(), 0, None, 0
    for b in batches:
        columns = [b.column(i) for i in range(5)]
        for i in range(b.num_rows):
            page_id, url, payload, revisit, refers_to = (c[i].as_py() for c in columns)
            if archive is None:
                archive, deflate, size = Archive(folder, f"part-{task:06d}-{number:04d}.warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                archive.out.write(deflate.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:0>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
            first = head(page_id, url, hashlib.sha1(payload).digest(), len(payload), refers_to, revisit)
            for part in (first, b"" if revisit else payload, b"\r\n\r\n"):
                archive.out.write(deflate.compress(part))
            size += len(first) + len(payload)
            if size >= ARCHIVE_BYTES:
                archive.out.write(deflate.flush())
                archive.close()
                yield pa.RecordBatch.from_pydict({"archive": [archive.uri]})
                archive, number = None, number + 1
    if archive is not None:
        archive.out.write(deflate.flush())
        archive.close()
        yield pa.RecordBatch.from_pydict({"archive": [archive.uri]})


class Inflated:
    """Reads of a gzip file, of one member or many, inflated as they are asked for."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.inflate, self.held, self.ended = raw, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        rest = self.inflate.unconsumed_tail
        if self.inflate.eof:
            rest = self.inflate.unused_data or self.raw.read(CHUNK)
            if not rest.strip(b"\0"):
                self.ended = True
                return False
            self.inflate = zlib.decompressobj(31)
        elif not rest:
            rest = self.raw.read(CHUNK)
            if not rest:
                raise EOFError("the gzip stream is cut off")
        self.held += self.inflate.decompress(rest, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to mark and with it; empty at the end."""
        at = -1
        while (at := self.held.find(mark, max(0, at))) < 0:
            at = len(self.held) - len(mark) + 1
            if not self.more():
                if self.held.strip():
                    raise EOFError("the last record is cut off")
                return b""
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise EOFError("the last record is cut off")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def fields(header: bytes) -> dict[str, str]:
    out = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def normalise_file(source: str, folder: str, level: int) -> list[dict]:
    """Writes the archive anew with a member for each record, and its index beside it; gives the index."""
    fs, path = located(source)
    name = source.rsplit("/", 1)[1]
    archive, offset, rows = Archive(folder, name), 0, []
    with fs.open_input_stream(path, compression=None) as raw:
        stream = Inflated(raw)
        while header := stream.until(b"\r\n\r\n"):
            known = fields(header.lstrip(b"\r\n"))
            deflate, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for part in (header.lstrip(b"\r\n"),):
                length += archive.out.write(z) if (z := deflate.compress(part)) else 0
            for part in stream.take(int(known.get("content-length", 0))):
                length += archive.out.write(z) if (z := deflate.compress(part)) else 0
            for part in stream.take(4):
                length += archive.out.write(z) if (z := deflate.compress(part)) else 0
            length += archive.out.write(deflate.flush())
            rows.append({"archive": archive.uri, "offset": offset, "length": length, "record_id": known.get("warc-record-id"), "type": known.get("warc-type"), "digest": known.get("warc-payload-digest")})
            offset += length
    archive.close()
    side = Archive(folder + "/index", name.removesuffix(".warc.gz") + ".jsonl")
    for r in rows:
        side.out.write((json.dumps(r) + "\n").encode())
    side.close()
    return rows


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """archive: the URIs of the archives written, each one gzip stream. pages: page_id, url, payload (binary), revisit, refers_to."""
    rows = pages.select("page_id", "url", "payload", "revisit", "refers_to")
    return materialise(rows.mapInArrow(lambda bs: write_batches(bs, folder, level), "archive string"), "warc-written")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Normalises each archive into folder; INDEX of all records, as read from the sidecars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"archive": [uri], "records": [len(normalise_file(uri, folder, level))]})

    n = archives.count()
    materialise(archives.repartition(max(1, n), "archive").mapInArrow(run, "archive string, records long"), "warc-normalised")
    spark = archives.sparkSession
    return spark.read.schema(INDEX).json(folder + "/index") if n else spark.createDataFrame([], INDEX)


def record_at(file: pa.NativeFile, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header and block of the record whose member is there."""
    file.seek(offset)
    whole = zlib.decompress(file.read(length), 31)
    header, _, rest = whole.partition(b"\r\n\r\n")
    known = fields(header)
    return known, rest[: int(known.get("content-length", 0))]


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_records(index: DataFrame) -> DataFrame:
    """RECORDS of each response and revisit, read by the index."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for b in batches:
            out: dict[str, list] = {f.split(" ")[0]: [] for f in RECORDS.split(", ")}
            for uri, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if uri != now:
                    fs, path = located(uri)
                    now, file = uri, fs.open_input_file(path)
                known, block = record_at(file, offset, length)
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = known["warc-type"] == "revisit"
                out["page_id"].append(page_of(known["warc-record-id"]))
                out["payload_bytes"].append(int(fields(http)["content-length"]) if revisit else len(payload))
                out["payload_digest"].append(base64.b32decode(known["warc-payload-digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest())
                out["record_type"].append(known["warc-type"])
                out["refers_to"].append(page_of(known.get("warc-refers-to")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    wanted = index.where(F.col("type").isin("response", "revisit")).select("archive", "offset", "length")
    return wanted.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)


def deduplicated(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, revisit, refers_to: of equal payloads of least_bytes or more, the largest page_id is stored, the others refer to it."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.length("payload")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy(F.col("sha").alias("g_sha"), F.col("size").alias("g_size"))
    repeated = materialise(groups.agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    both = rows.join(repeated, (F.col("sha") == F.col("g_sha")) & (F.col("size") == F.col("g_size")), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return both.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("kept")).alias("refers_to"))


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder, normalises these, and gives the index."""
    folder = new_path(spark, "warc")
    return normalise(write_archives(deduplicated(pages), folder + "/written"), folder + "/normal")
