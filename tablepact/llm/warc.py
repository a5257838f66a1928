"""WARC records in ZIP archives: written by Spark tasks, and read by byte ranges without extraction.

An archive is a ZIP file whose members are stored, not deflated: WARC files under ``archive/``, one gzip member for each WARC
record (or plain), and CDX or CDXJ files under ``indexes/``, plain or packed by gzip, one line for each record with its file,
offset and length. A reader takes the end of the ZIP file, follows the (ZIP64) end record to the central directory, finds the
stored members through it and their local headers, reads the indexes, and fetches each record by its range. A WARC file that no
index names is walked through record by record. ``write_archives`` makes one WARC file and one CDXJ index in each archive.

Files are reached through pyarrow's file systems, so the folder may be any that all executors share. Tasks choose names of
their own; only files in the list that a finished job returns are read, so a lost executor's half-written files are
ignored. Null payloads are empty; a record with a null id takes part in no revisit group. Repeated ids with one payload
are all responses if they are the largest. Ids must be whole numbers; under ANSI mode others raise. Other columns are ignored. An empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

ARCHIVES, INDEXES, DATA, INDEX = "archive/", "indexes/", "data.warc.gz", "index.cdxj"
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: An archive is closed beyond this many bytes of records; read requests join neighbouring records up to CHUNK bytes.
ROLL_BYTES, CHUNK = 32 << 20, 4 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "offset long, length long, archive string, member string, record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: 160 bits in 32 letters, five bits each, in SQL functions."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(4):  # 40 bits a time
        n = F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), F.shiftright(n, 35 - 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int") + 1, 1) for k in range(8)]
    return F.concat(*out)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def warc_record(record_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: {record_id}")
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in uri if c >= " "))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record; payload is null for revisits. A response whose payload doesn't have its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError(f"{fields.get('warc-record-id')} is cut off")
    http, _, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    kind, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    revisit = fields.get("warc-type") == "revisit"
    if not revisit and digest and kind in ("", "sha1") and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"payload digest differs in {fields.get('warc-record-id')}")
    return {
        "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"),
        "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else body,
    }


def zip_bytes(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """Parts of a ZIP file of stored members. ``zip64`` writes the 64-bit fields also where 32 bits do."""
    out: list[bytes] = []
    at, directory = 0, []
    for name, parts in members:
        size, crc = sum(map(len, parts)), 0
        for p in parts:
            crc = binascii.crc32(p, crc)
        wide = zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        raw, short = name.encode(), 0xFFFFFFFF if wide else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        head = struct.pack("<4s5H3L2H", LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        directory.append(struct.pack("<4s6H3L5H2L", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(more), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + more)
        out += [head, *parts]
        at += len(head) + size
    tail = b"".join(directory)
    n, wide = len(members), zip64 or at >= 0xFFFFFFFF
    end = b""
    if wide:
        end = struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, n, n, len(tail), at) + struct.pack("<4sLQL", LOCATOR64, 0, at + len(tail), 1)
    end += struct.pack("<4s4H2LH", END, 0, 0, n, n, len(tail), 0xFFFFFFFF if wide else at, 0)
    return [*out, tail, end]


class StoredZip:
    """The central directory of a ZIP file, and ranges of its stored members. ``read_at(offset, length)`` reads the file."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
            at = tail.rfind(END, 0, at)  # within a comment: the end record's comment reaches to the end of the file
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<H2L", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", tail, at - 12)
            record = read_at(end64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<3Q", record, 32)
        directory = read_at(start, length)
        self.members: dict[str, tuple[int, int, int]] = {}
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("bad central directory")
            method, packed, full = struct.unpack_from("<H8x2L", directory, at + 10)
            n_name, n_extra, n_comment = struct.unpack_from("<3H", directory, at + 28)
            (local,) = struct.unpack_from("<L", directory, at + 42)
            name = directory[at + 46 : at + 46 + n_name].decode()
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, size_of = struct.unpack_from("<2H", extra)
                if kind == 1:  # holds, in this order, those fields that are all ones
                    wide = list(struct.unpack_from(f"<{size_of // 8}Q", extra, 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + size_of :]
            self.members[name] = (local, packed, method)
            at += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes in the file."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored but packed by method {method}")
        head = self.read_at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("bad local header")
        n_name, n_extra = struct.unpack_from("<2H", head, 26)
        return local + 30 + n_name + n_extra, size


def cdxj_line(uri: str | None, digest: str, offset: int, length: int) -> str:
    """Key (host parts reversed, then the path), timestamp and a JSON object, as CDXJ has them."""
    host, _, path = (uri or "").partition("://")[2].partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")/" + path.lower() if host else "-"
    found = {"url": uri, "digest": f"sha1:{digest}", "offset": str(offset), "length": str(length), "filename": DATA}
    return f"{quote(key, safe='/,)?&=:;@!$*+~')} {''.join(c for c in DATE if c.isdigit())} {json.dumps(found)}\n"


def index_entries(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of the lines of a CDXJ or CDX index; the first line of the latter names its columns by letters."""
    if raw[:2] == b"\x1f\x8b":
        raw = b"".join(zlib.decompress(raw[at : at + n], 31) for at, n in gzip_members(lambda at, n: raw[at : at + n], 0, len(raw)))
    letters: list[str] = []
    for line in raw.decode("utf-8", "replace").splitlines():
        if line.split()[:1] == ["CDX"]:
            letters = line.split()[1:]
        elif (at := line.find("{")) >= 0 and not letters:
            x = json.loads(line[at:])
            yield x["filename"], int(x["offset"]), int(x["length"])
        elif line.strip() and letters:
            x = dict(zip(letters, line.split()))
            yield x["g"], int(x["V"]), int(x["S"])


def gzip_members(read_at, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length, from ``start`` on, of gzip members that follow one another over ``size`` bytes."""
    at, base, buffer = 0, 0, memoryview(b"")
    while at < size:
        unpack, pos = zlib.decompressobj(31), at
        while not unpack.eof:
            if pos >= size:
                raise ValueError("a gzip member is cut off")
            if not base <= pos < base + len(buffer):
                base, buffer = pos, memoryview(read_at(start + pos, min(CHUNK, size - pos)))
            piece = buffer[pos - base : pos - base + 65_536]
            unpack.decompress(piece)
            pos += len(piece) - len(unpack.unused_data)
        yield at, pos - at
        at = pos


def plain_records(read_at, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of the records of a WARC file that isn't packed."""
    at = 0
    while at < size:
        head = b""
        while b"\r\n\r\n" not in head:
            more = read_at(start + at + len(head), min(4096, size - at - len(head)))
            if not more:
                raise ValueError("a WARC record is cut off")
            head += more
        head = head[: head.index(b"\r\n\r\n")]
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        n = min(len(head) + 4 + length + 4, size - at)
        yield at, n
        at += n


def completed(z: StoredZip, start: int, size: int, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of an index, and those of the records that it doesn't name: what lies between is walked through, but for line ends."""
    walk = gzip_members if size > 1 and z.read_at(start, 2) == b"\x1f\x8b" else plain_records
    out, at = [], 0
    for offset, length in [*places, (size, 0)]:
        if offset > at and (offset - at > 8 or z.read_at(start + at, offset - at).strip(b"\r\n")):
            out += [(at + o, n) for o, n in walk(z.read_at, start + at, offset - at)]
        out += [(offset, length)] if length else []
        at = max(at, offset + length)
    if at > size:
        raise ValueError("an index names a place beyond its file")
    return out


def record_places(z: StoredZip) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Each WARC file of an archive with its place in the ZIP file, and offset and length of its records in ascending order."""
    found: dict[str, set[tuple[int, int]]] = {n: set() for n in z.members if n.startswith(ARCHIVES) and not n.endswith("/")}
    for name in z.members:
        if name.startswith(INDEXES) and re.search(r"\.cdxj?(?:\.gz)?$", name):
            for file, offset, length in index_entries(z.read_at(*z.locate(name))):
                member = ARCHIVES + file if ARCHIVES + file in found else file
                if member not in found:
                    raise ValueError(f"{name} names {file}, which isn't in the archive")
                found[member].add((offset, length))
    for member, places in found.items():
        start, size = z.locate(member)
        yield member, start, completed(z, start, size, sorted(places))


def write_archives(records: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, zip64: bool = False, level: int = 1) -> DataFrame:
    """Archives of ``records`` (record_id, target_uri, payload binary, payload_digest, refers_to), one or more for each task.

    Returns a lazy (path, n_records, n_bytes); what a finished job has of it lists the whole archives.
    """
    base = records.select("record_id", "target_uri", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        parts: list[bytes] = []
        lines: list[str] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            total = 0
            with files.open_output_stream(f"{root}/{name}") as f:
                for p in zip_bytes([(ARCHIVES + DATA, parts), (INDEXES + INDEX, ["".join(sorted(lines)).encode()])], zip64):
                    f.write(p)
                    total += len(p)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(lines)], "n_bytes": [total]})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rid, uri, payload, digest, refers = row
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(warc_record(rid, uri, payload or b"", digest, refers)) + packer.flush()
                lines.append(cdxj_line(uri, digest, size, len(packed)))
                parts.append(packed)
                size += len(packed)
                if size >= roll_bytes:
                    yield close()
                    parts, lines, size = [], [], 0
        if lines:
            yield close()

    return base.mapInArrow(run, "path string, n_records long, n_bytes long")


def read_archives(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in column path, as ``RECORD``; payload stays null unless ``with_payload``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RECORD.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = filesystem(path)
                with files.open_input_file(name) as f:
                    read_at = lambda at, n: f.read_at(n, at)
                    for member, start, places in record_places(StoredZip(read_at, f.size())):
                        i = 0
                        while i < len(places):
                            first, j = places[i][0], i + 1
                            while j < len(places) and sum(places[j]) - first <= CHUNK:
                                j += 1
                            chunk, rows = read_at(start + first, sum(places[j - 1]) - first), []
                            for offset, length in places[i:j]:
                                raw = chunk[offset - first : offset - first + length]
                                record = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                                if not with_payload:
                                    record["payload"] = None
                                rows.append(record | {"offset": offset, "length": length, "archive": path, "member": member})
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            i = j

    return archives.select("path").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, **options) -> DataFrame:
    """Write a record for each page; of equal payloads of at least ``least_bytes`` that with the largest id is the response.

    The payloads are shuffled once, by their digest; groups of any size are reduced before that join, and the join has one
    row of the reduced side for each digest, so a hot digest can be split among tasks.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    digest = F.sha1("payload")
    size = F.octet_length("payload")
    firsts = rows.select("id", digest.alias("hex"), size.alias("n")).groupBy("hex", "n").agg(F.max("id").alias("first"))
    rows = rows.withColumns({"hex": digest, "n": size})
    joined = rows.join(firsts, ["hex", "n"], "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = (F.col("n") >= least_bytes) & (F.col("id") < F.col("first"))
    return write_archives(
        joined.select(urn(F.col("id")).alias("record_id"), "target_uri", "payload", base32_sha1(F.col("hex")).alias("payload_digest"), F.when(revisit, urn(F.col("first"))).alias("refers_to")), folder, **options
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, *, with_payload: bool = False, **options) -> DataFrame:
    """Write ``pages`` into archives in the shared folder, and read every record back."""
    archives = materialize(archive_pages(pages, scratch_path(spark, "warc"), **options), "warc-list")
    return read_archives(archives.repartition(max(1, 2 * spark.sparkContext.defaultParallelism)), with_payload=with_payload)


#: The letters of base32.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST(('0x' || substr(hex, CAST(1 + 10 * (k // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
