"""WARC archives as a Spark data source, written and read by Python workers.

Writing: each task writes gzip members, one a record, whose extra field gives the member's
length; a manifest names the files of the attempts that were committed, so files of lost
attempts are never read. Reading: file partitions are planned from the manifest (or a listing);
predicates on record types and headers are applied to headers, which are parsed before anything
else; payloads nobody asked for are stepped over without being inflated.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: Columns of the source; all but the payload come from headers.
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
HEADERS = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"


def _id(page: int | None) -> str:
    return "<urn:page:none>" if page is None else f"<urn:page:{page}>"


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _safe(url: str) -> str:
    """Without characters that would end a header."""
    return "".join(f"%{b:02X}" if b < 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1").decode()


def record(row: dict, date: str) -> bytes:
    """A WARC record: response with its payload, or revisit with the HTTP header alone."""
    payload = row["payload"] if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_id(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_safe(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (payload or b"") + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the extra field sl: lengths of the member and of the data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    return struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date, self.overwrite = options["path"], options.get("date", "1970-01-01T00:00:00Z"), overwrite
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name, out, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    data = member(record(row, self.date))
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    size += len(data)
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, size)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        files = [{"name": m.name, "size": m.size} for m in messages if m is not None and m.name]
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            files = json.loads(fs.open_input_stream(f"{root}/{MANIFEST}").read()) + files
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


def _comparison(f: Filter) -> Callable[[dict], bool] | None:
    """A predicate on headers, or None for one that Spark must apply."""
    if len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    c = f.attribute[0]
    if isinstance(f, EqualTo):
        return lambda r: r[c] is not None and r[c] == f.value
    if isinstance(f, In):
        values = set(f.value)
        return lambda r: r[c] in values and r[c] is not None
    if isinstance(f, IsNotNull):
        return lambda r: r[c] is not None
    if isinstance(f, IsNull):
        return lambda r: r[c] is None
    for kind, ok in ((GreaterThan, lambda a, b: a > b), (GreaterThanOrEqual, lambda a, b: a >= b), (LessThan, lambda a, b: a < b), (LessThanOrEqual, lambda a, b: a <= b)):
        if isinstance(f, kind):
            return lambda r: r[c] is not None and ok(r[c], f.value)
    return None


class WarcReader(DataSourceReader):
    """Options: path; payload (true or false); partition_mb."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.size = float(options.get("partition_mb", "64")) * 1e6
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _comparison(f) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            files = [(f"{root}/{x['name']}", x["size"]) for x in json.loads(fs.open_input_stream(f"{root}/{MANIFEST}").read())]
        elif fs.get_file_info(root).type == pafs.FileType.File:
            files = [(root, 0)]
        else:
            files = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        plan: list[Files] = []
        room = 0.0
        for path, size in sorted(files):
            if not plan or room < size:
                plan.append(Files([]))
                room = self.size
            plan[-1].paths.append(path)
            room -= size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [_comparison(f) for f in self.filters]
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                for head, body in _records(source):
                    if all(t(head) for t in tests):
                        head["payload"] = body() if self.payload and head["record_type"] != "revisit" else None
                        size += len(head["payload"] or b"") + 200
                        rows.append(head)
                    if size > 4_000_000 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _described(warc: bytes, http: bytes) -> dict:
    """The columns that headers give."""
    w, h = _headers(warc), _headers(http)
    return {
        "page_id": _page(w.get("warc-record-id")),
        "url": w.get("warc-target-uri"),
        "record_type": w.get("warc-type"),
        "refers_to": _page(w.get("warc-refers-to")),
        "payload_digest": w["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in w else None,
        "payload_bytes": int(h["content-length"]) if "content-length" in h else None,
    }


def _split(data: bytes) -> tuple[bytes, bytes, int] | None:
    """WARC header, HTTP header and where the payload starts, if data reaches so far."""
    a = data.find(b"\r\n\r\n")
    b = data.find(b"\r\n\r\n", a + 4) if a >= 0 else -1
    return (data[:a], data[a + 4 : b], b + 4) if b >= 0 else None


def _records(source) -> Iterator[tuple[dict, Callable[[], bytes]]]:
    """Headers of each record and how to get its payload. Members without sl are inflated whole."""
    while True:
        start = source.read(24)
        if len(start) < 24:
            return
        if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
            size = struct.unpack("<I", start[16:20])[0]
            packed = source.read(size - 24)
            inflate = zlib.decompressobj(-15)
            data, step = b"", 2048
            while (found := _split(data)) is None:
                more = inflate.decompress(inflate.unconsumed_tail if data else packed, step)
                if not more:
                    break
                data += more
            if found is None:
                continue
            warc, http, at = found
            head = _described(warc, http)

            def body(data=data, inflate=inflate, at=at, n=head["payload_bytes"]) -> bytes:
                return (data[at:] + inflate.decompress(inflate.unconsumed_tail))[:n]

            yield head, body
        else:
            yield from _plain(start, source)
            return


def _plain(start: bytes, source) -> Iterator[tuple[dict, Callable[[], bytes]]]:
    """Records of a file that other tools wrote: plain, or gzip members without lengths."""
    inflate = zlib.decompressobj(31) if start[:2] == b"\x1f\x8b" else None
    raw, data, ended = start, b"", False

    def fill() -> bool:
        nonlocal raw, data, inflate, ended
        if not raw:
            raw = source.read(1 << 20)
        if not raw:
            return False
        if inflate is None:
            data, raw = data + raw, b""
        else:
            data += inflate.decompress(raw)
            raw = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill():
                return
        size = int(_headers(data[:end]).get("content-length", "0"))
        while len(data) < end + 4 + size + 4 and fill():
            pass
        block = data[end + 4 : end + 4 + size]
        cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
        http, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (b"", block)
        head = _described(data[:end], http)
        if head["payload_bytes"] is None:
            head["payload_bytes"] = len(payload)
        data = data[end + 4 + size :].lstrip(b"\r\n")
        yield head, lambda p=payload: p


class WarcSource(DataSource):
    """format("warc"): SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def as_records(pages: DataFrame, *, least: int = 1000, html: str = "html") -> DataFrame:
    """Rows of SCHEMA for pages (page_id, url, html): the first copy of a payload and revisits.

    Of pages with equal payloads of at least `least` bytes that with the largest page_id is the
    response, and the others revisit it; smaller ones are responses. A null html is an empty payload.
    Rows that repeat the largest page_id with the same payload are responses each; where all
    page_ids of a payload are null, all are responses. Other columns are dropped; an empty
    table gives an empty result.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("page_id", "url", F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), "payload")
    heads = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(heads.select("payload_digest", "last"), "payload_digest", "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    none = F.lit(None)
    return joined.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).otherwise(none.cast("long")).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Writes rows of SCHEMA to a new archive folder."""
    register(records.sparkSession)
    records.select([c.split()[0] for c in SCHEMA.split(", ")]).write.format("warc").mode("overwrite").option("path", path).save()


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA; filters on header columns are applied before payloads are inflated."""
    return register(spark).read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()
