"""TIFF as a media column: a writer for payloads and a page reader.

The reader walks the image directories of little- or big-endian files, decodes
uncompressed, PackBits, LZW and deflate strips and tiles, undoes horizontal
differencing and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import map_rows

# Fixed values of the TIFF 6.0 format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
PLANAR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + run
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF LZW: codes from the most significant bit, width growing one code early."""
    table = {bytes((i,)): i for i in range(256)}
    code, width, acc, bits, out = 258, 9, 256, 9, bytearray()

    def flush():
        nonlocal acc, bits
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    flush()
    prefix = b""
    for b in data:
        longer = prefix + bytes((b,))
        if longer in table:
            prefix = longer
            continue
        acc, bits = acc << width | table[prefix], bits + width
        flush()
        table[longer] = code
        code += 1
        if code == 4094:
            acc, bits = acc << width | 256, bits + width
            flush()
            table, code, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif code >= 1 << width:
            width += 1
        prefix = bytes((b,))
    if prefix:
        acc, bits = acc << width | table[prefix], bits + width
        flush()
        if code >= (1 << width) - 1 and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    flush()
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, width, acc, bits, last = bytearray(), 9, 0, 0, None
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table or code > len(table):
            raise ValueError("LZW data without a first clear code, or with a code not yet known")
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def squeeze(data: bytes, how: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: packbits_encode, LZW: lzw_encode}[how](data)


def unsqueeze(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    raise ValueError(f"TIFF compression {how} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 512, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of 8-bit grey pages ``[rows, columns]``, in strips or in tiles ``(rows, columns)``."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytearray(4)
    link = 4
    for page in pages:
        rows, cols = page.shape
        if tile:
            th, tw = tile
            blocks = [np.pad(b := page[y : y + th, x : x + tw], ((0, th - b.shape[0]), (0, tw - b.shape[1]))) for y in range(0, rows, th) for x in range(0, cols, tw)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, rows, rows_per_strip)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)) for b in blocks]
        stored = [squeeze(np.ascontiguousarray(b).tobytes(), compression) for b in blocks]
        offsets = []
        for s in stored:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) & 1)
        counts = [len(s) for s in stored]
        tags = {WIDTH: (4, [cols]), LENGTH: (4, [rows]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PLANAR: (3, [1])}
        tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_LENGTH: (4, [tile[0]]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_COUNTS: (4, counts)}
        if predictor != 1:
            tags[PREDICTOR] = (3, [predictor])
        if len(out) >= 1 << 32:
            raise ValueError("a TIFF holds less than 4 GB")
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tag values) of every image directory; a link to one seen before ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            size = TYPE_SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * i)[0]
            form = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
            tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, place) if form else (data[place : place + size],)
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """(description, samples ``[rows, columns, samples]``) of every page."""
    for order, tags in directories(data):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: E731, B023
        rows, cols, spp, bits = one(LENGTH), one(WIDTH), one(SAMPLES, 1), one(BITS, 1)
        how, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
        if bits not in (8, 16) or one(PLANAR, 1) != 1 and spp > 1:
            raise ValueError(f"TIFF with {bits} bits or separate planes is not supported")
        if predictor not in (1, 2) or one(FILL_ORDER, 1) != 1 or one(SAMPLE_FORMAT, 1) != 1:
            raise ValueError(f"TIFF with predictor {predictor}, reversed bits or samples that are no unsigned integers is not supported")
        kind = np.dtype(f"{order}u{bits // 8}")
        th, tw = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, rows), rows), cols)
        page = np.zeros((rows, cols, spp), kind.newbyteorder("="))
        across = -(-cols // tw)
        where = zip(tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else zip(tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
        for i, (start, size) in enumerate(where):
            y, x = i // across * th, i % across * tw
            high = th if tiled else min(th, rows - y)
            want = high * tw * spp * kind.itemsize
            raw = unsqueeze(data[start : start + size], how, want)[:want]
            if len(raw) < want:
                raise ValueError(f"TIFF block {i} ends after {len(raw)} of {want} bytes")
            block = np.frombuffer(raw, kind).reshape(high, tw, spp)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=page.dtype)
            part = page[y : y + high, x : x + tw]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield {"rows": rows, "cols": cols, "samples": spp, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled}, page


PAGES_SCHEMA = "media_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
#: What damaged or unknown files raise while they are read.
_BAD = (ValueError, TypeError, KeyError, IndexError, ZeroDivisionError, MemoryError, OverflowError, struct.error, zlib.error)


def explode_pages(media: DataFrame, id_col: str = "media_id", data_col: str = "media") -> DataFrame:
    """One row per page of every TIFF in ``data_col``; a null or empty file has no page.

    Where a file cannot be read on, a row with null values says why in ``error``,
    after the pages before; null elsewhere.  Null and repeated ids are kept.
    """

    def pages(data: bytes | None) -> Iterator[tuple[dict, np.ndarray | None]]:
        try:
            yield from read_pages(data) if data else ()
        except _BAD as e:
            yield {"error": f"{type(e).__name__}: {e}"}, None

    def run(cols: list[list]) -> dict[str, list]:
        same = ("samples", "bits", "compression", "predictor", "tiled", "error")
        out: dict[str, list] = {k: [] for k in ("media_id", "page", "width", "height", "pixels", *same)}
        for key, data in zip(*cols):
            for i, (d, page) in enumerate(pages(data)):
                values = {"media_id": key, "page": i, "width": d.get("cols"), "height": d.get("rows"), "pixels": None if page is None else page.tobytes()}
                for k, v in (values | {k: d.get(k) for k in same}).items():
                    out[k].append(v)
        return out

    return map_rows(media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("media")), run, PAGES_SCHEMA)


#: Rows of 64 samples to a page: a long payload becomes several pages of one file.
PAGE_ROWS = 1 << 14


def payload_tiff(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, TIFF of them padded with zeros to a positive multiple of 64 samples)."""
    raw = (text or "").encode("utf-8")
    padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    grey = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    return len(raw), write_tiff([grey[i : i + PAGE_ROWS] for i in range(0, len(grey), PAGE_ROWS)])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text losslessly as a TIFF: ``media_id, n_bytes, media``. A null text counts as empty."""

    def run(cols: list[list]) -> dict[str, list]:
        made = [payload_tiff(t) for t in cols[1]]
        return {"media_id": cols[0], "n_bytes": [x[0] for x in made], "media": [x[1] for x in made]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("media_id"), F.col(text_col).alias("text")), run, "media_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Read the stored files page by page and describe what they hold, one row per file.

    ``feature`` gives pages, width, rows, mean, spread and the share of the
    most common sample value, all of the samples read back.
    """

    def run(cols: list[list]) -> dict[str, list]:
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict[str, list] = {k: [] for k in names}
        for key, n, data in zip(*cols):
            sha, size, tail, pages, rows, hist = hashlib.sha256(), 0, b"", 0, 0, np.zeros(256, np.int64)
            for _, page in read_pages(data):
                got = page.tobytes()
                sha.update(got)
                size, tail, pages, rows = size + len(got), (tail + got)[-64:], pages + 1, rows + len(page)
                hist += np.bincount(page.ravel(), minlength=256)
            mean = float(hist @ np.arange(256)) / size
            var = float(hist @ (np.arange(256) - mean) ** 2) / size
            feature = f"pages={pages};width=64;rows={rows};mean={mean:.6f};sd={var**0.5:.6f};mode={int(hist.argmax())}:{hist.max() / size:.6f}"
            for k, v in zip(names, (key, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature)):
                out[k].append(v)
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(media.select("media_id", "n_bytes", "media"), run, schema)
