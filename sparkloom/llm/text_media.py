"""Texts stored as TIFF files and read back: payloads, storage, and features of what was read."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import tiff
from sparkloom.llm.common import col

UNIT = 192
PIXELS, CHANNELS = 64, 3
PAGE_ROWS = 2048


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with spaces to a positive multiple of UNIT bytes."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def store(raw: bytes) -> bytes:
    """Pages of RGB rows of UNIT bytes. The payload's checksum picks codec, layout and byte order, so
    equal payloads are stored alike and each decoder serves a third of the table."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, PIXELS, CHANNELS)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    pick = zlib.crc32(raw)
    codec = (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE)[pick % 3]
    return tiff.write_tiff(
        pages,
        compression=codec,
        predictor=1 if codec == tiff.PACKBITS else 2,
        tile=(64, 64) if pick >> 8 & 3 == 0 else None,
        order=">" if pick >> 16 & 1 else "<",
    )


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                texts = batch.column(1).slice(part, 500).to_pylist()
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part, 500), pa.array(sizes, pa.int64()), pa.array([store(payload(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return df.select(col(df, id_col).cast("long").alias("doc_id"), col(df, text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``.

    Payload and feature come from the samples of the decoded pages. A null text counts as empty, an
    empty one is a payload of spaces; null ids and repeated rows stay rows of their own. The feature
    holds pages, mean and deviation of the samples, and a hash of 8 x 8 mean brightnesses of page 0.
    """
    files = stored_texts(df, id_col, text_col).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff.tiff_pages(files, "media")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of a file follow each other; page 0 starts the next file."""
        held: list = []
        done: list[tuple] = []
        for batch in batches:
            for doc_id, n_bytes, media_bytes, media_sha, page, height, samples, error in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "height", "samples", "error")), strict=True):
                if error:
                    raise tiff.TiffError(f"a stored file cannot be read back: {error}")
                if page == 0:
                    if held:
                        done.append(_digest(held))
                    held = [doc_id, n_bytes, media_bytes, media_sha, []]
                held[4].append((height, samples))
            if len(done) > 500:
                yield _rows(done)
                done = []
        if held:
            done.append(_digest(held))
        if done:
            yield _rows(done)

    return pages.mapInArrow(fold, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _digest(held: list) -> tuple:
    doc_id, n_bytes, media_bytes, media_sha, pages = held
    raw = b"".join(s for _, s in pages)
    values = np.frombuffer(raw, np.uint8)
    first = np.frombuffer(pages[0][1], np.uint8).reshape(pages[0][0], PIXELS, CHANNELS).mean(axis=2)
    bands = np.array([first[i * len(first) // 8 : max(i * len(first) // 8 + 1, (i + 1) * len(first) // 8)].mean(axis=0) for i in range(8)])
    grid = bands.reshape(8, 8, PIXELS // 8).mean(axis=2)
    bits = int("".join("1" if x else "0" for x in (grid > grid.mean()).reshape(-1)), 2)
    feature = f"{len(pages)};{PIXELS}x{sum(h for h, _ in pages)}x{CHANNELS};{values.mean():.4f};{values.std():.4f};{bits:016x}"
    return doc_id, n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), media_bytes, media_sha, feature


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
