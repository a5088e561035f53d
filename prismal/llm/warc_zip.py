"""WARC records in ZIP packages: a writer and a reader that never extracts.

A package holds stored (uncompressed) members: ``archive/data.warc.gz`` with one
gzip member per record, and ``indexes/index.jsonl`` with every record's place.
The reader finds the central directory through the end record or its ZIP64
form, locates the stored members in the package and reads ranges of it only.
Packages lie in the shared folder, which any ``pyarrow`` file system can be.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismal.llm.common import join_split, scratch, ship, slices, written

#: Bytes of compressed records after which a package is closed.
PACKAGE_BYTES = 16 << 20
#: Neighbouring records are fetched in ranges of at most this size, or one record.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
ALL16, ALL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ``zip64``, or where sizes ask for it, in ZIP64 form."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        wide = zip64 or len(data) >= ALL32 or at >= ALL32
        size = ALL32 if wide else len(data)
        local_extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += struct.pack("<4s5H3I2H", LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local_extra)) + raw + local_extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        central += struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, ALL32 if wide else at) + raw + extra
    start, n = len(out), len(members)
    out += central
    wide = zip64 or start >= ALL32 or n >= ALL16
    if wide:
        out += struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<4sIQI", LOCATOR64, 0, start + len(central), 1)
    out += struct.pack("<4s4H2IH", END, 0, 0, ALL16 if wide else n, ALL16 if wide else n, ALL32 if wide else len(central), ALL32 if wide else start, 0)
    return bytes(out)


class ZipReader:
    """Directory and stored members of a ZIP file that is read by ranges: ``read(start, size) -> bytes``."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - (22 + ALL16 + 20))
        tail = read(tail_at, size - tail_at)
        i = tail.rfind(END)
        while i >= 0 and (len(tail) < i + 22 or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
            i = tail.rfind(END, 0, i)
        if i < 0:
            raise ValueError("no ZIP end record")
        _, _, _, n, length, start = struct.unpack_from("<4H2I", tail, i + 4)
        if i >= 20 and tail[i - 20 : i - 16] == LOCATOR64:
            (at,) = struct.unpack_from("<Q", tail, i - 12)
            end64 = read(at, 56)
            if end64[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            n, length, start = struct.unpack_from("<3Q", end64, 32)
        elif ALL32 in (length, start) or n == ALL16:
            raise ValueError("ZIP64 locator is missing")
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, at = read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken ZIP central directory")
            flags, how, _, _, _, packed, plain, a, b, c = struct.unpack_from("<4H3I3H", directory, at + 8)
            (place,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
            extra, j = directory[at + 46 + a : at + 46 + a + b], 0
            while j + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, j)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{m // 8}Q", extra, j + 4))
                    plain = wide.pop(0) if plain == ALL32 else plain
                    packed = wide.pop(0) if packed == ALL32 else packed
                    place = wide.pop(0) if place == ALL32 else place
                j += 4 + m
            self.members[name] = how, packed, plain, place
            at += 46 + a + b + c

    def locate(self, name: str) -> tuple[int, int]:
        """(first byte in the file, size) of a stored member."""
        how, packed, plain, place = self.members[name]
        if how or packed != plain:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(place, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: broken local header")
        a, b = struct.unpack_from("<2H", head, 26)
        return place + 30 + a + b, plain


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A gzip member with one record; with ``refers_to`` a revisit that holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """Fields of one gzip member; a response's digest is checked against its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
    number = lambda uri: int(x) if (x := uri[len("<urn:page:") : -1]) else None
    kind, declared = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != declared or len(payload) != int(said["content-length"])):
        raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(said["content-length"]), "payload_digest": declared,
        "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None,
    }


def _file_system(uri: str):
    """File system and path; the schemes by which Spark knows S3 are read as ``s3``."""
    from pyarrow.fs import FileSystem

    scheme, mark, rest = uri.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write rows ``page_id, url, html, refers_to`` as packages below ``folder``; returns ``path, n_records, n_bytes`` of each.

    A task holds one open package.  Names are unique to an attempt, so a
    repeated task leaves the files of the lost one unlisted.
    """
    ship(pages.sparkSession)
    out = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def close(records: list[bytes], index: list[str]) -> pa.RecordBatch:
        data = zip_package([(DATA, b"".join(records)), (INDEX, "".join(index).encode())], zip64)
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        fs, where = _file_system(path)
        fs.create_dir(where.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(where) as f:
            f.write(data)
        return pa.RecordBatch.from_pylist([{"path": path, "n_records": len(index), "n_bytes": len(data)}], out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        records, index, at = [], [], 0
        for batch in batches:
            for part in slices(batch, 8 << 20):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    r = warc_record(page_id, url, (html or "").encode("utf-8"), refers_to)
                    index.append(json.dumps({"id": page_id, "offset": at, "length": len(r)}) + "\n")
                    records.append(r)
                    at += len(r)
                    if at >= package_bytes:
                        yield close(records, index)
                        records, index, at = [], [], 0
        if index:
            yield close(records, index)

    return pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(run, "path string, n_records long, n_bytes long")


def package_records(path: str) -> Iterator[dict]:
    """Every record of one package, by range reads along its index."""
    fs, where = _file_system(path)
    with fs.open_input_file(where) as f:

        def read(start: int, size: int) -> bytes:
            f.seek(start)
            return f.read(size)

        package = ZipReader(read, f.size())
        at, size = package.locate(INDEX)
        places = [(x["offset"], x["length"]) for x in map(json.loads, read(at, size).decode().splitlines())]
        base, _ = package.locate(DATA)
        i = 0
        while i < len(places):
            first, end, j = places[i][0], sum(places[i]), i + 1
            while j < len(places) and places[j][0] == end and end + places[j][1] - first <= RANGE_BYTES:
                end, j = sum(places[j]), j + 1
            chunk = read(base + first, end - first)
            for start, length in places[i:j]:
                yield parse_record(chunk[start - first : start - first + length])
            i = j


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the packages listed in column ``path``; payloads of responses only, or null throughout without ``payloads``."""
    ship(packages.sparkSession)
    from prismal.llm.common import _arrow_schema

    schema = _arrow_schema(packages.sparkSession, RECORDS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in package_records(path):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.select("path").mapInArrow(run, RECORDS)


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: the smallest page_id with an equal payload of at least ``min_bytes``, null for that page itself."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("_key"))
    ids = keyed.filter(F.octet_length("html") >= min_bytes).select("page_id", "_key")
    first = written(ids.groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).filter("n > 1"), "first_pages")
    # only the ids are joined on the payload's digest; payloads move once, dealt by page
    again = join_split(ids, first, "_key").filter(F.col("page_id") > F.col("_first")).select("page_id", "_key", F.col("_first").alias("refers_to")).distinct()
    return keyed.join(again, ["page_id", "_key"], "left").drop("_key")


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages and read every record back.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to``.  A null html is empty.  Repeated rows of one page are all
    responses if the page is the first of its payload.  A page with a null id
    is a response that nothing refers to.  Other columns are ignored.
    """
    listed = written(write_packages(with_originals(pages, min_bytes), folder or scratch(spark, "packages")), "packages-list")
    n = max(1, listed.count())
    records = read_packages(listed.repartition(min(n, 4096)), payloads=False)
    return records.drop("payload")


def round_trip_sql() -> str:
    """The round trip of table ``pages`` as DuckDB SQL; each five hex digits of the SHA-1 give four base32 signs."""
    sign = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31) + 1, 1)"
    base32 = f"""array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)),
         lambda v: {" || ".join(sign(k) for k in (15, 10, 5, 0))}), '')"""
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, url
FROM d"""
