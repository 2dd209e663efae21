"""TIFF columns: one row per page of each file, with decoded samples; and a writer for tests and storage.

Read: both byte orders, classic and big files, chains of image directories and sub-directories, strips
and tiles, chunky and planar samples of 1, 2, 4, 8, 16, 32 or 64 bits, no compression, PackBits, LZW
and deflate, predictors 1, 2 (horizontal) and 3 (floating point). Tag numbers, code widths and magic
numbers are the format's fixed values.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.common import fresh

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIP_OFFSETS, _SAMPLES, _ROWS_PER_STRIP, _STRIP_COUNTS, _PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
_PREDICTOR, _TILE_WIDTH, _TILE_LENGTH, _TILE_OFFSETS, _TILE_COUNTS, _SUB_DIRECTORIES, _SAMPLE_FORMAT = 317, 322, 323, 324, 325, 330, 339
_FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_CLEAR, _END_OF_DATA = 256, 257
MAX_PAGE_BYTES = 1 << 30


class TiffError(ValueError):
    """What is wrong with a file."""


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    photometric: int
    samples: bytes = field(repr=False)


# --- codecs -----------------------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    at = 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()

    def literals(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    last = 0
    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literals(data[last : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.extend(run[1])
        last = run.end()
    literals(data[last:])
    return bytes(out)


_SINGLES = [bytes((i,)) for i in range(256)] + [b"", b""]
#: Codes that a writer of ours gives between two clears, so that the table stays below 4,096 entries.
_SEGMENT = 4094 - 258
#: Widths of the codes after a clear, by place, and where their bits begin. From 4,096 entries on all have 12 bits.
_WIDTHS = np.array([9 + (f >= 512) + (f >= 1024) + (f >= 2048) for f in range(258, 258 + 4096)])
_BITS_BEFORE = np.concatenate(([0], np.cumsum(_WIDTHS)))


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; a code grows one entry early. The codes up to the next clear
    are cut out at once, as their widths follow from their places."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    bits, at = 8 * len(data), 0
    out: list[bytes] = []
    made, table, previous, place = 0, list(_SINGLES), b"", 0
    while at + 9 <= bits and made < size:
        if place < len(_WIDTHS):
            widths, begin = _WIDTHS[place:], at + _BITS_BEFORE[place:-1] - _BITS_BEFORE[place]
        else:
            widths, begin = np.full(4096, 12), at + 12 * np.arange(4096)
        n = int(np.searchsorted(begin + widths, bits, "right"))
        if not n:
            break
        begin, widths = begin[:n], widths[:n]
        byte = begin >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = window >> (24 - (begin & 7) - widths).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == _CLEAR) | (codes == _END_OF_DATA))
        used = int(stops[0]) if len(stops) else n
        for code in codes[:used].tolist():
            known = len(table)
            if code < known:
                entry = table[code]
                if previous and known < 4096:
                    table.append(previous + entry[:1])
            elif code == known and previous:
                entry = previous + previous[:1]
                if known < 4096:
                    table.append(entry)
            else:
                raise TiffError("LZW code out of range")
            out.append(entry)
            previous = entry
            made += len(entry)
            if made >= size:
                break
        if used == n:
            place, at = place + n, int(begin[-1] + widths[-1])
        elif codes[used] == _END_OF_DATA:
            break
        else:
            at, place = int(begin[used] + widths[used]), 0
            table, previous = list(_SINGLES), b""
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes = [_CLEAR]
    if data:
        put, table, following = codes.append, {}, 258
        prefix = data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            code = table.get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            table[key] = following
            following += 1
            if following >= 258 + _SEGMENT:
                put(_CLEAR)
                table, following = {}, 258
            prefix = byte
        put(prefix)
    codes.append(_END_OF_DATA)
    all_codes = np.array(codes, np.uint16)
    widths = np.concatenate(([9], _WIDTHS[np.arange(len(codes) - 1) % (_SEGMENT + 1)]))
    # each code's bits, most significant first, without the leading ones of narrow codes
    table = (all_codes[:, None] >> np.arange(11, -1, -1, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(table[np.arange(12) >= 12 - widths[:, None]]).tobytes()


def _decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)[:size]
    if compression == LZW:
        return lzw_decode(data, size)[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    raise TiffError(f"compression {compression}")


def _compress(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[compression](data)


# --- reading ----------------------------------------------------------------------------------------


class _File:
    def __init__(self, data: bytes) -> None:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or len(data) < 8:
            raise TiffError("no TIFF header")
        self.data, self.order = data, order
        magic = self.number("H", 2)
        if magic == 42:
            self.big, self.first = False, self.number("I", 4)
        elif magic == 43 and self.number("H", 4) == 8:
            self.big, self.first = True, self.number("Q", 8)
        else:
            raise TiffError("no TIFF header")

    def number(self, kind: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + kind, self.data, at)[0]
        except struct.error:
            raise TiffError("directory beyond the end") from None

    def directory(self, at: int) -> tuple[dict[int, list], int]:
        """Tags of the directory at ``at`` and the place of the next."""
        count, entry, word, head = (self.number("Q", at), 20, "Q", 8) if self.big else (self.number("H", at), 12, "I", 2)
        tags: dict[int, list] = {}
        if count * entry > len(self.data):
            raise TiffError("directory beyond the end")
        for i in range(count):
            p = at + head + i * entry
            tag, kind = self.number("H", p), self.number("H", p + 2)
            n = self.number(word, p + 4)
            if kind not in _FIELD:
                continue
            size = struct.calcsize(_FIELD[kind]) * n
            inline = 8 if self.big else 4
            where = p + 4 + inline if size <= inline else self.number(word, p + 4 + inline)
            if where + size > len(self.data):
                raise TiffError(f"tag {tag} beyond the end")
            tags[tag] = list(struct.unpack_from(f"{self.order}{n}{_FIELD[kind]}", self.data, where))
        return tags, self.number(word, at + head + count * entry)

    def page(self, tags: dict[int, list]) -> Page:
        def one(tag: int, default: int | None = None) -> int:
            if tags.get(tag):
                return int(tags[tag][0])
            if default is None:
                raise TiffError(f"no tag {tag}")
            return default

        width, height, channels = one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1)
        bits, compression, predictor = one(_BITS, 1), one(_COMPRESSION, NONE), one(_PREDICTOR, 1)
        if len(set(tags.get(_BITS, [1]))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise TiffError(f"bits per sample {tags.get(_BITS)}")
        if width * height * channels * bits > 8 * MAX_PAGE_BYTES:
            raise TiffError("page too large")
        planes = channels if one(_PLANAR, 1) == 2 else 1
        inner = channels // planes
        if tags.get(_TILE_OFFSETS):
            w, h = one(_TILE_WIDTH), one(_TILE_LENGTH)
            offsets, counts = tags[_TILE_OFFSETS], tags.get(_TILE_COUNTS, [])
        else:
            w, h = width, min(height, one(_ROWS_PER_STRIP, height) or height)
            offsets, counts = tags.get(_STRIP_OFFSETS, []), tags.get(_STRIP_COUNTS, [])
        if min(w, h, width, height, channels) < 1:
            raise TiffError("empty page")
        across, down = -(-width // w), -(-height // h)
        if not len(counts) == len(offsets) == across * down * planes:
            raise TiffError("number of strips or tiles")
        kind = np.dtype("u1" if bits < 8 else f"{self.order}u{bits // 8}")
        page = np.zeros((planes, height, width, inner), kind)
        for k, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            plane, place = divmod(k, across * down)
            top, left = place // across * h, place % across * w
            rows = h if tags.get(_TILE_OFFSETS) else min(h, height - top)
            block = self._block(self.data[offset : offset + count], compression, predictor, (rows, w, inner), bits, kind)
            tall, wide = min(rows, height - top), min(w, width - left)
            page[plane, top : top + tall, left : left + wide] = block[:tall, :wide]
        samples = np.moveaxis(page, 0, 2).reshape(height, width, channels)
        little = samples.astype(samples.dtype.newbyteorder("<"), copy=False)
        return Page(width, height, channels, bits, compression, one(_PHOTOMETRIC, 0), little.tobytes())

    def _block(self, data: bytes, compression: int, predictor: int, shape: tuple[int, int, int], bits: int, kind: np.dtype) -> np.ndarray:
        rows, w, inner = shape
        row_bytes = (w * inner * bits + 7) // 8
        raw = _decompress(data, compression, rows * row_bytes)
        if len(raw) < rows * row_bytes:
            raise TiffError("strip or tile too short")
        if bits < 8:
            unpacked = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), axis=1)
            fields = unpacked[:, : w * inner * bits].reshape(rows, w, inner, bits)
            return (fields @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
        if predictor == 3:
            planes = np.frombuffer(raw, np.uint8).reshape(rows, row_bytes // inner, inner).cumsum(axis=1, dtype=np.uint8)
            parts = planes.reshape(rows, bits // 8, w * inner)  # most significant bytes first
            return np.ascontiguousarray(np.moveaxis(parts, 1, 2)).view(f">u{bits // 8}").reshape(shape).astype(kind)
        block = np.frombuffer(raw, kind).reshape(shape)
        if predictor == 2:
            native = block.astype(kind.newbyteorder("="))
            return native.cumsum(axis=1, dtype=native.dtype)
        if predictor != 1:
            raise TiffError(f"predictor {predictor}")
        return block


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in the order of the directories' chain, each followed by those of its sub-directories."""
    f = _File(data)
    seen: set[int] = set()
    todo = [(f.first, True)]
    while todo:
        at, chained = todo.pop()
        if not at:
            continue
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags, following = f.directory(at)
        yield f.page(tags)
        if chained:
            todo.append((following, True))
        todo.extend((int(x), False) for x in reversed(tags.get(_SUB_DIRECTORIES, [])))


# --- writing ----------------------------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64, order: str = "<") -> bytes:
    """A classic file of (height, width, channels) arrays of unsigned samples of 8, 16 or 32 bits."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, channels = page.shape
        kind = page.dtype.newbyteorder(order)
        h, w = tile or (min(rows_per_strip, height), width)
        places: list[tuple[int, int]] = []
        for top in range(0, height, h):
            for left in range(0, width, w):
                block = page[top : top + h, left : left + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                raw = _compress(np.ascontiguousarray(block, kind).tobytes(), compression)
                places.append((len(out), len(raw)))
                out += raw
        out += b"\0" * (len(out) % 2)
        bits = 8 * page.dtype.itemsize
        tags = {_WIDTH: [width], _HEIGHT: [height], _BITS: [bits] * channels, _COMPRESSION: [compression], _PHOTOMETRIC: [2 if channels == 3 else 1], _SAMPLES: [channels], _PLANAR: [1], _PREDICTOR: [predictor]}
        offsets, counts = [p[0] for p in places], [p[1] for p in places]
        tags |= {_TILE_WIDTH: [w], _TILE_LENGTH: [h], _TILE_OFFSETS: offsets, _TILE_COUNTS: counts} if tile else {_STRIP_OFFSETS: offsets, _ROWS_PER_STRIP: [h], _STRIP_COUNTS: counts}
        body = bytearray()
        long_at = len(out) + 2 + 12 * len(tags) + 4
        extra = bytearray()
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}I", *values)
            body += struct.pack(order + "HHI", tag, 4, len(values))
            if len(raw) <= 4:
                body += raw
            else:
                body += struct.pack(order + "I", long_at + len(extra))
                extra += raw
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(body)
        out += struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", 0) + extra
        out += b"\0" * (len(out) % 2)
    return bytes(out)


# --- columns ----------------------------------------------------------------------------------------

_PAGE_FIELDS = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("channels", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("photometric", T.IntegerType()), ("samples", T.BinaryType()), ("error", T.StringType())]
BATCH_BYTES = 8 << 20


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns of ``df``, then ``page`` (from 0), ``width, height, channels,
    bits, compression, photometric, samples`` (row by row, channels together, little-endian; samples
    below 8 bits take a byte each) and ``error``.

    A file that cannot be read gives its pages up to there and a row with ``error`` set and the page
    null; so does a null or empty file. Repeated files repeat their pages. New names that clash with
    columns of ``df`` get ``_`` added. Pages of a file stay together, in order; nothing is shuffled.
    """
    at = df.columns.index(media_col)
    kept = [f for f in df.schema.fields if f.name != media_col]
    names = fresh(df.drop(media_col), *(n for n, _ in _PAGE_FIELDS))
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, (_, k) in zip(names, _PAGE_FIELDS, strict=True))])
    arrow = to_arrow_schema(schema)

    def rows_of(data: bytes | None) -> Iterator[tuple]:
        k = 0
        try:
            for k, p in enumerate(read_pages(data or b""), 1):
                yield (k - 1, p.width, p.height, p.channels, p.bits, p.compression, p.photometric, p.samples, None)
        except TiffError as e:
            yield (None, None, None, None, None, None, None, None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for i, c in enumerate(batch.columns) if i != at]
            index: list[int] = []
            found: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                taken = [c.take(pa.array(index, pa.int64())) for c in others]  # noqa: B023
                return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow.types[len(others) :], strict=True))], schema=arrow)  # noqa: B023

            for i in range(batch.num_rows):
                for row in rows_of(batch.column(at)[i].as_py()):
                    index.append(i)
                    found.append(row)
                    size += len(row[7] or b"")
                    if size > BATCH_BYTES:
                        yield out()
                        index, found, size = [], [], 0
            if found:
                yield out()

    return df.mapInArrow(run, schema)
