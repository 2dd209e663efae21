import hashlib
import struct
import zlib

import numpy as np
import pytest

from sparkloom.llm import text_media, tiff

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    for kind in (np.uint8, np.uint16, np.uint32):
        for channels in (1, 3):
            pages = [(RNG.integers(0, 4, (h, w, channels)) * 37).astype(kind) for h, w in ((1, 1), (5, 7), (70, 33))]
            got = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, tile, 32, order)))
            assert [(p.height, p.width, p.channels) for p in got] == [p.shape for p in pages]
            assert all(p.samples == a.astype(a.dtype.newbyteorder("<")).tobytes() for a, p in zip(pages, got, strict=True))


def test_known_streams():
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # codes 256 7 258 8 8 258 6 6 257 of nine bits, the format's own example
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("size", [0, 1, 255, 3838, 5000, 300_000])
def test_lzw_widths(size):
    for most in (1, 2, 255):
        raw = RNG.integers(0, most + 1, size, dtype=np.uint8).tobytes()
        assert tiff.lzw_decode(tiff.lzw_encode(raw), size) == raw
        assert tiff.packbits_decode(tiff.packbits_encode(raw), size) == raw


def simple(tags, tail=b"", order="<"):
    body = b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return struct.pack(order + "2sHI", b"II", 42, 8) + struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", 0) + tail


def test_bits_planes_and_float_predictor():
    start = 8 + 2 + 12 * 7 + 4
    one_bit = simple({256: 10, 257: 2, 258: 1, 259: 1, 273: start, 278: 2, 279: 4}, b"\xa5\x40\x0f\x80")
    assert list(next(tiff.read_pages(one_bit)).samples) == [1, 0, 1, 0, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    values = np.array([[1.5, -2.25, 1e-3, 7.0]], ">f4")
    planes = np.frombuffer(values.tobytes(), np.uint8).reshape(4, 4).T.reshape(-1)
    coded = np.concatenate((planes[:1], np.diff(planes.astype(np.int16)).astype(np.uint8)))
    start += 12
    f = simple({256: 4, 257: 1, 258: 32, 259: 1, 273: start, 278: 1, 279: 16, 317: 3}, coded.tobytes())
    assert np.frombuffer(next(tiff.read_pages(f)).samples, "<f4").tolist() == values[0].tolist()


def test_bad_files_give_an_error_row(spark):
    good = tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)] * 2)
    loop = bytearray(good)
    second = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, second)[0]
    struct.pack_into("<I", loop, second + 2 + 12 * n, second)
    df = spark.createDataFrame([(1, bytes(good), "x"), (2, None, "x"), (3, b"", "x"), (4, b"II*\0\xff\xff\0\0", "x"), (5, bytes(loop), "x"), (6, good[:-60], "x")], "id int, media binary, page string")
    rows = tiff.tiff_pages(df).collect()
    assert rows[0].__fields__[:3] == ["id", "page", "page_"]
    by = {k: [(r["page_"], r["error"] is None) for r in rows if r["id"] == k] for k in range(1, 7)}
    assert by[1] == [(0, True), (1, True)] and by[2] == by[3] == by[4] == [(None, False)]
    assert by[5] == [(0, True), (None, False)] and by[6][-1] == (None, False)


def never_cleared(data):
    """LZW by a writer that keeps its full table, a bit at a time."""
    table, bits, prefix, size = {bytes((i,)): i for i in range(256)}, format(256, "09b"), b"", 258
    width = lambda: 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        bits += format(table[prefix], f"0{width()}b")
        if size < 4096:
            table[longer] = size
            size += 1
        prefix = data[i : i + 1]
    bits += format(table[prefix], f"0{width()}b")
    bits += format(257, "012b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("size", [1, 3836, 3837, 3838, 9000, 60_000])
def test_lzw_of_any_length_and_of_writers_that_keep_a_full_table(size):
    rng = np.random.default_rng(size)
    for high in (2, 40, 256):
        data = rng.integers(0, high, size).astype(np.uint8).tobytes()
        coded = tiff.lzw_encode(data)
        assert tiff.lzw_decode(coded, size) == data and tiff.lzw_decode(coded, size // 2)[: size // 2] == data[: size // 2]
        if size >= 3836:
            assert tiff.lzw_decode(never_cleared(data), size) == data
    assert tiff.lzw_decode(tiff.lzw_encode(b""), 0) == b""
    with pytest.raises(tiff.TiffError):
        tiff.lzw_decode(bytes([0x80, 0x7F, 0xFF, 0xFF]), 9)


def plain_feature(payload):
    """Pages of 2,048 rows of 64 pixels, statistics of all samples, and page 0 as 8 x 8 bits, one value at a time."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    first = [[sum(r[3 * x : 3 * x + 3]) / 3 for x in range(64)] for r in rows[:2048]]
    h = len(first)
    cells = []
    for i in range(8):
        band = first[i * h // 8 : max(i * h // 8 + 1, (i + 1) * h // 8)]
        means = [sum(r[x] for r in band) / len(band) for x in range(64)]
        cells += [sum(means[8 * j : 8 * j + 8]) / 8 for j in range(8)]
    middle = sum(cells) / 64
    mean = sum(payload) / len(payload)
    spread = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
    bits = "".join("1" if c > middle + 1e-9 else "0" for c in cells)
    return f"{-(-len(rows) // 2048)};64x{len(rows)}x3;{mean:.4f};{spread:.4f};{int(bits, 2):016x}"


def test_each_codec_serves_a_third():
    texts = [f"text {i} " * (i % 20) for i in range(900)]
    used = [next(tiff.read_pages(text_media.store(text_media.payload(t)))).compression for t in texts]
    assert {c: 270 < used.count(c) < 340 for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE)} == {tiff.LZW: True, tiff.PACKBITS: True, tiff.DEFLATE: True}


def test_query_columns_against_plain_python(spark, make_docs):
    long = "Überlang " * 60_000
    rows = [(1, None), (2, ""), (3, "a"), (4, "x" * 192), (5, long), (None, "a"), (6, "naïve\n" * 77), (6, "naïve\n" * 77)]
    rows += [(100 + i, f"text {i} " * (i % 50)) for i in range(150)]
    got = text_media.text_media(make_docs(*rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (_, text) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0)), sorted(rows, key=lambda x: x[0] or 0), strict=True):
        raw = (text or "").encode()
        filled = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(filled), hashlib.sha256(filled).hexdigest(), zlib.crc32(filled[-16:]))
        stored = text_media.store(filled)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"] == plain_feature(filled)
    assert text_media.text_media(make_docs((1, "a")).where("false")).count() == 0
