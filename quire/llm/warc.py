"""WARC archives as a PySpark data source (format "warc"), read and written.

Written files hold one gzip member for each record. A member's header carries the sub-field `sl`
of the WARC guidelines (compressed and plain length), so a reader can jump over a record without
inflating it. Reading plans one partition for each file, takes predicates on record type and
headers, inflates a record's headers first, and leaves its payload alone if the predicates or the
option payload=false say so. Files come from local and remote stores alike (pyarrow's filesystems).

A write goes to files that are unique to the task's attempt; committing writes a manifest with the
files of the attempts that count, and readers of a folder with a manifest read no others. So a
task that was lost and ran again leaves no record twice.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .common import scratch, table

MANIFEST = "_manifest.json"
#: Data source column to WARC header.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes string, payload binary"
COLUMNS = [*HEADERS, "payload"]
HEAD = 10 + 2 + 12  # gzip header, length of its extra field, the sub-field sl
PIECE = 1 << 16


def filesystem(path: str):
    """pyarrow's filesystem for a path or URI, and the path within it."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def member(record: bytes) -> bytes:
    """One gzip member with the lengths in its header."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, (HEAD + len(body) + 8) & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def clean(value: str) -> str:
    """A header's value: controls, which would end the header, as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def unclean(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record(row: dict) -> bytes:
    """A WARC record; payload None: a record without a block, as revisits are."""
    payload = row.get("payload")
    block, kind = b"", "application/http;msgtype=response"
    if payload is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + bytes(payload)
    lines = ["WARC/1.1", *(f"{name}: {clean(str(row[k]))}" for k, name in HEADERS.items() if row.get(k) is not None)]
    if row.get("record_type") == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class File(InputPartition):
    path: str
    size: int = 0


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def block_payload(block: bytes, kind: str) -> bytes:
    """The payload of a record's block: what follows the HTTP headers, where it has such."""
    return block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block


def read_members(f, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an open archive (gzip members with or without `sl`, or plain text) that `wanted`
    takes by their headers. A member's headers are inflated first; the rest only if needed."""
    ahead = b""
    if (start := f.read(2)) == b"WA":
        yield from read_plain(f, start, wanted, payloads)
        return
    ahead = start
    while True:
        ahead += f.read(max(0, HEAD - len(ahead)))
        if not ahead:
            return
        if ahead[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member where a record should start")
        length = struct.unpack("<I", ahead[16:20])[0] if len(ahead) >= HEAD and ahead[3] & 4 and ahead[12:14] == b"sl" else None
        inflate, plain, read = zlib.decompressobj(31), bytearray(), len(ahead)
        chunk, head, size, take = ahead, None, None, True
        while True:
            plain += inflate.decompress(chunk)
            if head is None and (end := plain.find(b"\r\n\r\n")) >= 0:
                head = headers(bytes(plain[:end]))
                size, take = int(head.get("content-length", 0)), wanted(head)
                del plain[: end + 4]
                if length is not None and not (take and payloads):
                    break
            if head is not None and not (take and payloads):
                plain.clear()
            if inflate.eof:
                break
            most = PIECE if length is None else max(0, min(PIECE, length - read))
            chunk = f.read(most)
            if not chunk:
                raise ValueError("an archive that ends within a record")
            read += len(chunk)
        if length is not None:
            if not inflate.eof:
                left = length - read
                while left > 0 and (skipped := f.read(min(left, 1 << 20))):
                    left -= len(skipped)
            ahead = b""
        else:
            ahead = inflate.unused_data
        if head is not None and take:
            yield head, block_payload(bytes(plain[:size]), head.get("content-type", "")) if payloads else None


def read_plain(f, ahead: bytes, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As read_members, of an archive that is not compressed."""
    buffer = bytearray(ahead)
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            more = f.read(PIECE)
            if not more:
                if buffer.strip():
                    raise ValueError("an archive that ends within a record")
                return
            buffer += more
        head = headers(bytes(buffer[:end]).lstrip(b"\r\n"))
        size, take = int(head.get("content-length", 0)), wanted(head)
        del buffer[: end + 4]
        kept, left = bytearray(), size
        while left > 0:
            if not buffer:
                buffer += f.read(PIECE)
                if not buffer:
                    raise ValueError("an archive that ends within a record")
            part = min(left, len(buffer))
            if take and payloads:
                kept += buffer[:part]
            del buffer[:part]
            left -= part
        while buffer[:1] in (b"\r", b"\n") or not buffer:
            if not buffer:
                buffer += f.read(PIECE)
                if not buffer:
                    break
            else:
                del buffer[:1]
        if take:
            yield head, block_payload(bytes(kept), head.get("content-type", "")) if payloads else None
        if not buffer:
            return


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.tests = path, payloads, []

    def pushFilters(self, filters):
        """Equality, membership and presence of a header are decided before a payload is touched."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNotNull)):
                values = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((HEADERS[column].lower(), values))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [File(root, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [File(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(x.path, x.size) for x in sorted(found, key=lambda x: -x.size) if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path)]

    def read(self, partition):
        if partition is None:
            return
        store, _ = filesystem(self.path)

        def wanted(head):
            return all(name in head and (values is None or unclean(head[name]) in values) for name, values in self.tests)

        schema = pa.schema([(k, pa.string()) for k in HEADERS] + [("payload", pa.binary())])
        rows, held = [], 0
        with store.open_input_stream(partition.path, compression=None, buffer_size=1 << 18) as f:
            for head, payload in read_members(f, wanted, self.payloads):
                row = {k: unclean(v) if (v := head.get(name.lower())) is not None else None for k, name in HEADERS.items()}
                row["payload"] = payload if row["record_type"] != "revisit" else None
                rows.append(row)
                held += len(payload or b"") + 200
                if held > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool, limit: int):
        self.path, self.names, self.overwrite, self.limit = path, names, overwrite, limit

    def write(self, iterator):
        store, root = filesystem(self.path)
        files, out, size = [], None, 0
        store.create_dir(root, recursive=True)
        try:
            for row in iterator:
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{root}/{name}", compression=None), 0
                packed = member(record(dict(zip(self.names, row))))
                out.write(packed)
                size += len(packed)
                if size >= self.limit:
                    out.close()
                    files.append((name, size))
                    out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files = sorted((tuple(x) for m in messages if m is not None for x in m.files), key=lambda x: (-x[1], x[0]))
        at = f"{root}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(at).type == fs.FileType.File:
            with store.open_input_stream(at) as f:
                files = [tuple(x) for x in json.loads(f.read())] + files
        with store.open_output_stream(at) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages):
        store, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", ...).load(path), and df.write.format("warc").save(path).

    A written DataFrame has any of COLUMNS; max_file_bytes (256 MB) ends a file. Names of
    filesystem stores are those that pyarrow knows.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], schema.fieldNames(), overwrite, int(self.options.get("max_file_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(column):
    """Upper-case base32 without padding of a 20-byte digest given as lowercase hex: native, by
    turning each five hex digits (20 bits) into four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        word = F.conv(F.substring(column, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(word, 5 * (3 - j)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def records(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A WARC record for each page (page_id, url, html).

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads (SHA-1 and
    length) of at least min_bytes the smallest page_id becomes a response, repeated rows of it
    too, the others revisits that refer to it and carry no payload. A null page_id counts as
    larger than all others; if all are null, all are responses. The ids of records name the page.
    Payloads are hashed where they are read; only digests are grouped (partial sums first), and
    the join back deals hot digests out by adaptive skew handling.
    """
    digest = F.sha1(F.col("payload"))
    p = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.select("page_id", "url", "payload", digest.alias("hex"), F.octet_length("payload").cast("long").alias("n"))
    first = pages.select("page_id", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    first = first.select("page_id", digest.alias("hex2"), F.octet_length("payload").cast("long").alias("n2")).where(F.col("n2") >= min_bytes)
    first = first.groupBy("hex2", "n2").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    j = p.join(first, (F.col("hex") == F.col("hex2")) & (F.col("n") == F.col("n2")), "left")
    again = F.coalesce(F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return j.select(
        F.concat(F.lit("<"), urn(F.col("page_id")), F.lit(">")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha1:"), base32(F.col("hex"))).alias("payload_digest"),
        F.when(again, F.concat(F.lit("<"), urn(F.col("first_id")), F.lit(">"))).alias("refers_to"),
        F.col("n").cast("string").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives, read them back: responses by their pushed record type with payloads, whose
    digest and length are worked out anew, and revisits without any payload, whose digest and length
    are those in their headers. A null html is an empty payload; a null page_id names its record so;
    repeated rows are records each; nothing comes from an empty table."""
    register(spark)
    path = scratch(spark, "warc")
    records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    found = spark.read.format("warc").load(path).where("record_type = 'response'")
    again = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    back = found.unionByName(again)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = F.col("record_type") == "response"
    return back.select(
        F.when(number(F.col("record_id")) != "", number(F.col("record_id"))).cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes").cast("long")).alias("payload_bytes"),
        F.when(whole, base32(F.sha1("payload"))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        "record_type",
        F.when(number(F.col("refers_to")) != "", number(F.col("refers_to"))).cast("long").alias("refers_to"),
    )


SQL = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, n, min(page_id) AS first_id FROM h GROUP BY ALL)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h JOIN f USING (x, n)
"""
