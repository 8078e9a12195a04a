"""Legacy ARC archives to WARC.

An ARC file starts with a version block that declares its header fields: version 1 has URL, IP address, date,
content type and length; version 2 adds result code, checksum, location, offset and file name. A record is its
header line, as many bytes as declared, and a line end. The converter makes of each an equivalent WARC record:
a name-based UUID, an ISO date from the 14 digits, a type by content, and SHA-1 digests of block and payload.

Each record of both formats is a gzip member of its own. Archives are rolled at a bounded size and written by Spark's
text writer, one row a file, so that they may lie in any store; they are read by the binaryFile reader, member by
member. Payloads go from archive to archive within a task: only digests and identifiers are shuffled to find revisits.

Defined cases: a null payload is empty; a null URL becomes urn:x-page:ID; blanks and non-ASCII bytes in URLs are
percent-encoded; a record larger than the rolling size is a file of its own; of equal payloads the row with the
largest page_id (null lowest; of equal rows the one last by record id) is the response; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, scratch, sized_join

ROLL_BYTES = 16 << 20
V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
RECORD = "archive string, number long, page_id long, uri string, date string, kind string, mime string, record_id string, digest string, payload_bytes long, http binary, payload binary"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """data as a gzip member, the same for the same data."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of data hold, one after the other; data that isn't compressed is one."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("a gzip member is cut short")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


# ARC


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, offset: int = 0, filename: str = "-", result: str = "200", location: str = "-") -> bytes:
    """Header line and content, without the line end that closes the record."""
    head = [quote(url, safe="%/:?#[]@!$&'()*+,;=~|"), ip, date, mime.replace(" ", "") or "-"]
    if version == 2:
        head += [result, hashlib.md5(content).hexdigest(), location, str(offset), filename]
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content


def arc_version_block(version: int, filename: str, date: str) -> bytes:
    content = (b"1 0 tidewright\n" + V1 if version == 1 else b"2 0 tidewright\n" + V2) + b"\n"
    return arc_record(version, f"filedesc://{filename}", "0.0.0.0", date, "text/plain", content, 0, filename)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, compressed or not, the version block left out. The block tells which header lines to
    expect."""
    fields = None
    for part in members(data):
        at = 0
        while at < len(part):
            if part[at] in b"\r\n":
                at += 1
                continue
            end = part.index(b"\n", at)
            line = part[at:end].rstrip(b"\r")
            length = int(line[line.rindex(b" ") + 1 :])
            content = part[end + 1 : end + 1 + length]
            if len(content) < length:
                raise ValueError(f"a record declares {length} bytes, of which {len(content)} are there: {line[:200]!r}")
            at = end + 1 + length
            if fields is None:
                version = content[: content.index(b" ")]
                if version not in (b"1", b"2"):
                    raise ValueError(f"unknown ARC version {version!r}")
                fields, name = content.split(b"\n")[1].decode().split(" "), line.split(b" ", 1)[0].decode("latin-1")
                continue
            values = line.decode("latin-1").rsplit(" ", len(fields) - 1)  # an old URL may hold blanks
            if len(values) != len(fields):
                raise ValueError(f"a header line has {len(values)} of {len(fields)} fields: {line[:200]!r}")
            yield dict(zip(fields, values)) | {"content": content, "archive": name}


def _blobs(parts: Iterator[bytes], head) -> Iterator[bytes]:
    """Archives of about ROLL_BYTES, each part a gzip member; head(n) opens the n-th."""
    n, size, rows = 0, 0, []
    for p in map(member, parts):
        if rows and size + len(p) > ROLL_BYTES:
            yield b"".join(rows)
            n, size, rows = n + 1, 0, []
        if not rows:
            rows, size = [member(head(n))], 0
        rows.append(p)
        size += len(p)
    if rows:
        yield b"".join(rows)


def _write(blobs: DataFrame, path: str) -> None:
    """One file a row. The text writer ends a row with a line separator, here a gzip member without content."""
    text = blobs.select(F.col("archive").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20200101000000") -> None:
    """pages (page_id, url, html) as ARC files under path, version 1 and 2 by turns. The payload follows an HTTP
    header that bears the page's id."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records():
            for b in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode()
                    yield arc_record(version, url or f"urn:x-page:{page_id}", "0.0.0.0", date, "text/html", http + html, 0, f"{part}.arc") + b"\n"

        for blob in _blobs(records(), lambda n: arc_version_block(version, f"{part}-{n}.arc", date) + b"\n"):
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["archive"])

    _write(rows.mapInArrow(run, "archive binary"), path)


# conversion

_ID = re.compile(rb"^X-Page-Id: *(-?\d+)\r?$", re.M | re.I)


def convert(record: dict, place: str = "") -> dict:
    """The WARC terms of an ARC record: identifier, date, type, digests, HTTP header and payload apart. place, the
    archive's name and the record's number in it, keeps the identifiers of equal records apart."""
    d, content, mime = record["Archive-date"].ljust(14, "0"), record["content"], record["Content-type"]
    http = b""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        end = len(content) if end < 0 else end + 4
        http, content = content[:end], content[end:]
    m = _ID.search(http)
    payload = digest(content)
    name = " ".join([record["URL"], d, payload, m[1].decode() if m else "", place])
    return {
        "page_id": int(m[1]) if m else None, "uri": record["URL"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "kind": "response" if http else "resource", "mime": "application/http; msgtype=response" if http else mime,
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "digest": payload, "payload_bytes": len(content), "http": http, "payload": content,
    }


def converted(data: bytes) -> Iterator[dict]:
    """The converted records of an ARC file, with their number in it."""
    for k, r in enumerate(parse_arc(data)):
        yield convert(r, f"{r['archive']} {k}") | {"number": k}


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The converted records of all ARC files under path. archive and number tell where each lies."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for place, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for x in converted(data.as_py()):
                    if not payload:
                        x["http"] = x["payload"] = None
                    rows.append(x | {"archive": place})
                    size += len(x["payload"] or b"") + 400
                    if size > 4 << 20:
                        yield from pa.Table.from_pylist(rows, _SCHEMA()).to_batches()
                        rows, size = [], 0
                yield from pa.Table.from_pylist(rows, _SCHEMA()).to_batches()

    return _read(spark, path).mapInArrow(run, RECORD)


def _SCHEMA():
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])


def mark_revisits(keys: DataFrame) -> DataFrame:
    """(archive, number, first) of the records of read_arc() that revisit another, first. Counts are made before rows
    move; groups of one need no partner; AQE splits large groups."""
    last = F.max(F.struct("page_id", "record_id", "uri", "date")).alias("first")
    groups = keys.groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), last).filter("n > 1").drop("n")
    out = keys.select("archive", "number", "record_id", "digest", "payload_bytes").join(groups.hint("merge"), ["digest", "payload_bytes"])
    return out.filter(F.col("first.record_id") != F.col("record_id")).select("archive", "number", "first")


# WARC


def warc_record(x: dict, first: dict | None = None) -> bytes:
    """A WARC/1.0 record without its closing line ends. A revisit has the HTTP header for its block."""
    block = x["http"] + (b"" if first else x["payload"])
    head = {
        "WARC-Type": "revisit" if first else x["kind"], "WARC-Record-ID": x["record_id"], "WARC-Date": x["date"], "WARC-Target-URI": x["uri"],
        "WARC-Payload-Digest": "sha1:" + x["digest"], "WARC-Block-Digest": "sha1:" + digest(block), "X-Payload-Length": str(x["payload_bytes"]),
    }
    if x["page_id"] is not None:
        head["X-Page-Id"] = str(x["page_id"])
    if first:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": first["record_id"], "WARC-Refers-To-Target-URI": first["uri"], "WARC-Refers-To-Date": first["date"]}
        if first["page_id"] is not None:
            head["X-Refers-To-Page-Id"] = str(first["page_id"])
    head |= {"Content-Type": x["mime"], "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def warcinfo(name: str) -> bytes:
    block = b"software: tidewright\r\nformat: WARC File Format 1.0\r\n"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def write_warc(spark: SparkSession, arcs: str, marks: DataFrame, path: str) -> None:
    """The ARC files under arcs as WARC files under path, revisits as mark_revisits() has them. An archive's marks are no
    more than its records; they join the compressed archive, by broadcast if all marks are few."""
    lists = materialize(marks.groupBy("archive").agg(F.collect_list(F.struct("number", "first")).alias("marks")).withColumnRenamed("archive", "path"), "marks")
    joined = sized_join(_read(spark, arcs), lists, ["path"], "left", 300 * F.size("marks") + 200).select("content", "marks")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records():
            for b in batches:
                for data, marks in zip(b.column(0), b.column(1)):
                    first = {m["number"]: m["first"] for m in marks.as_py() or []}
                    for x in converted(data.as_py()):
                        yield warc_record(x, first.get(x["number"])) + b"\r\n\r\n"

        for blob in _blobs(records(), lambda n: warcinfo(f"{part}-{n}.warc") + b"\r\n\r\n"):
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["archive"])

    _write(joined.mapInArrow(run, "archive binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file, compressed or not."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.index(b"\r\n\r\n", at)
            lines = part[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}: {lines[0][:80]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(head["content-length"])
            block = part[end + 4 : end + 4 + n]
            if len(block) < n:
                raise ValueError(f"a record at byte {at} is cut short")
            at = end + 4 + n + 4
            yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, record_type, uri, date, payload_digest, payload_bytes and refers_to of every record but
    warcinfo. Digests of stored payloads are computed anew and must agree with what the record says."""

    def run(batches):
        import pyarrow as pa

        number = lambda v: int(v) if v else None
        for b in batches:
            for data in b.column(1):
                rows = []
                for h, block in parse_warc(data.as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    n, sha = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] != "revisit":
                        body = block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
                        if digest(body) != sha:
                            raise ValueError(f"{h['warc-record-id']}: the payload doesn't have the digest that its record says")
                        n = len(body)
                    rows.append((number(h.get("x-page-id")), h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"], sha, n, number(h.get("x-refers-to-page-id"))))
                if rows:
                    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["page_id", "record_id", "record_type", "uri", "date", "payload_digest", "payload_bytes", "refers_to"])

    return _read(spark, path).mapInArrow(run, "page_id long, record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, refers_to long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arcs)
    keys = materialize(read_arc(spark, arcs, payload=False).drop("http", "payload"), "arc-keys")
    write_warc(spark, arcs, mark_revisits(keys), warcs)
    discard(spark, arcs)
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), q AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM p
)
SELECT *, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM q WINDOW w AS (PARTITION BY payload_digest, payload_bytes)
"""
