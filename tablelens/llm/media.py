"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the image directories, decodes PackBits, LZW or deflate in
strips or tiles, undoes the horizontal predictor and gives the samples of every
page: 1, 2, 4, 8 or 16 bits, interleaved or in planes, either fill order.  The
writer stores 8-bit pages.

Defined cases: each page stands for itself, so a damaged or unsupported one gives
a row with ``error`` set and the others stay; a null, empty or foreign file gives
one such row; a chain of directories that breaks or loops ends with an error row
behind the pages before it; a page of more than ``PAGE_BYTES`` uncompressed is an
error, as is a strip that holds less than it should (more is cut off).  A null text
is stored as an empty one; a very long text is one tall page in many strips.
Repeated rows give repeated pages; an empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts

#: Fixed values of the TIFF 6.0 format: bytes per field type, tags, compressions.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 266, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

PAYLOAD_WIDTH = 64
STRIP_ROWS = 1024
#: The largest page that is read, uncompressed: what one task may hold.
PAGE_BYTES = 1 << 30
DAMAGE = (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error)
#: Bytes with their bits in the opposite order.
MIRRORED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def unpack_bits(data: bytes, limit: int | None = None) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and (limit is None or len(out) < limit):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of equal bytes as pairs, the rest as literals of up to 128 bytes."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
        else:
            while run < 128 and at + run < n and (at + run + 1 >= n or data[at + run] != data[at + run + 1]):
                run += 1
            out.append(run - 1)
            out += data[at : at + run]
        at += run
    return bytes(out)


def lzw_decode(data: bytes, limit: int | None = None) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one entry early."""
    table: list[bytes] = []
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            entry = table[code]
        elif code > len(table):
            raise ValueError("an LZW code is out of order")
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        if limit is not None and len(out) >= limit:
            break
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of ``lzw_decode``."""
    out, bits, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}
    size = 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    table, seen = {bytes([i]): i for i in range(256)}, b""
    for i in range(len(data)):
        more = seen + data[i : i + 1]
        if more in table:
            seen = more
            continue
        put(table[seen])
        table[more] = size
        size += 1
        seen = data[i : i + 1]
        if size == 4094:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if seen:
        put(table[seen])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def decompress(data: bytes, compression: int, limit: int) -> bytes:
    """About ``limit`` bytes at most, whatever the data unpacks to."""
    if compression == NONE:
        return data[:limit]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, limit)
    if compression == PACKBITS:
        return unpack_bits(data, limit)
    if compression == LZW:
        return lzw_decode(data, limit)
    raise ValueError(f"compression {compression} is not supported")


def directories(data: bytes) -> Iterator[tuple[str, dict] | Exception]:
    """Byte order and fields (tag -> tuple of values) of every image directory, or
    what is wrong with its fields."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the chain of directories is broken")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise ValueError("a directory is cut off")
        try:
            yield order, dict(fields(data, order, at + 2, n))
        except DAMAGE as e:
            yield e
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def fields(data: bytes, order: str, at: int, n: int) -> Iterator[tuple[int, tuple]]:
    for where in range(at, at + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, where)
        if kind not in TYPE_CODES:
            continue
        size, where = TYPE_BYTES[kind] * count, where + 8
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size > len(data):
            raise ValueError(f"the values of tag {tag} are cut off")
        yield tag, struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where)


def samples_of(raw: bytes, rows: int, columns: int, per_pixel: int, bits: int, order: str) -> np.ndarray:
    """rows x columns x samples; rows begin at whole bytes."""
    values = columns * per_pixel
    if bits == 16:
        x = np.frombuffer(raw, order + "u2", rows * values).astype(np.uint16)
    else:
        x = np.frombuffer(raw, np.uint8, rows * -(-values * bits // 8))
        if bits < 8:
            shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
            x = (x[:, None] >> shifts & ((1 << bits) - 1)).reshape(rows, -1)[:, :values]
    return np.ascontiguousarray(x).reshape(rows, columns, per_pixel)


def page_samples(data: bytes, order: str, tags: dict) -> np.ndarray:
    """The samples of one page as height x width x samples, 16-bit ones as uint16."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANES, 1)
    if set(tags.get(BITS, (1,))) - {bits} or bits not in (1, 2, 4, 8, 16) or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError("samples of this form are not supported")
    if not width or not height or not samples or planes not in (1, 2):
        raise ValueError("the page has no size")
    if width * height * samples * (2 if bits == 16 else 1) > PAGE_BYTES:
        raise ValueError("the page is too large")
    per_pixel, layers = (1, samples) if planes == 2 else (samples, 1)
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not w or not h or w * h * per_pixel * bits > 8 * PAGE_BYTES:
        raise ValueError("a strip or tile has no usable size")
    where, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down = -(-width // w), -(-height // h)
    if min(len(where), len(sizes)) < across * down * layers:
        raise ValueError("a strip or tile is missing")
    page = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    for layer in range(layers):
        for k in range(across * down):
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            at, size = where[layer * across * down + k], sizes[layer * across * down + k]
            part = data[at : at + size]
            need = rows * -(-w * per_pixel * bits // 8)
            raw = decompress(part.translate(MIRRORED) if one(FILL_ORDER, 1) == 2 else part, compression, need)
            if len(raw) < need:
                raise ValueError("a strip or tile is cut off")
            block = samples_of(raw, rows, w, per_pixel, bits, order)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            page[y : y + rows, x : x + w, layer if planes == 2 else slice(None)] = (block[..., 0] if planes == 2 else block)[: height - y, : width - x]
    return page


def read_pages(data: bytes | None) -> Iterator[np.ndarray | Exception]:
    """The pages of a file, one at a time; an exception stands for a bad one."""
    try:
        for found in directories(data or b""):
            try:
                yield found if isinstance(found, Exception) else page_samples(data, *found)
            except DAMAGE as e:
                yield e
    except DAMAGE as e:  # the chain ends here
        yield e


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, level: int = 1) -> bytes:
    """A little-endian TIFF of 8-bit pages (height x width or height x width x samples)."""
    pack = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        page = page.reshape(*page.shape[:2], -1)
        height, width, samples = page.shape
        if tile:
            h, w = tile
            padded = np.pad(page, ((0, -height % h), (0, -width % w), (0, 0)))
            parts = [padded[y : y + h, x : x + w] for y in range(0, padded.shape[0], h) for x in range(0, padded.shape[1], w)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1)
            stored = pack(np.ascontiguousarray(p).tobytes())
            at.append(len(out))
            sizes.append(len(stored))
            out += stored + b"\0" * (len(stored) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"<{len(values)}{TYPE_CODES[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def explode_pages(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per page of every file: id, page (from 0), width, height, samples,
    pixels (row by row, samples of 16 bits low byte first), feature, error."""

    def row(i, k, page):
        if isinstance(page, Exception):
            return i, k, None, None, None, None, None, str(page) or type(page).__name__
        height, width, samples = page.shape
        return i, k, width, height, samples, page.astype(page.dtype.newbyteorder("<")).tobytes(), page_feature(page), None

    def make():
        return lambda ids, files: [row(i, k, page) for i, data in zip(ids, files) for k, page in enumerate(read_pages(data))]

    schema = f"{field(df, id_col)}, page int, width int, height int, samples int, pixels binary, feature string, error string"
    return map_texts(df, make, schema, id_col, data_col, "binary")


def page_feature(page: np.ndarray) -> str:
    """Size, sum and sum of squares of the samples, zero samples, and the largest."""
    x = page.astype(np.int64)
    return f"{page.shape[1]}x{page.shape[0]};sum={int(x.sum())};sq={int((x * x).sum())};zeros={int((x == 0).sum())};max={int(x.max())}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every text's padded payload as the one page of a TIFF."""

    def row(i, text):
        payload, n = payload_of(text)
        return i, n, write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH)])

    return map_texts(df, lambda: lambda ids, texts: list(map(row, ids, texts)), f"{field(df, id_col)}, n_bytes long, media binary", id_col, text_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF, read the stored column's pages and describe both.
    A stored text has one page, so its page's row is the text's."""
    stored = store_texts(df, id_col, text_col)
    about = F.struct(F.col(id_col).alias("id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = explode_pages(stored.select(about.alias("file"), "media"), "file", "media")
    return pages.select(
        F.col("file.id").alias(id_col),
        "file.n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "file.media_bytes",
        "file.media_sha256",
        "feature",
        "error",
    )
