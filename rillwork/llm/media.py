"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Images live in binary columns. Decoding, resizing and hashing run per row in Arrow batches, so a task holds one batch
and one image at a time; the integral image is built in row blocks, so that an image of any height needs memory for its
bytes and one block only.

Payloads: a text's bytes are the samples of a grey image 64 wide, a PGM up to PGM_ROWS rows and an 8-bit BMP beyond. The
stored form depends on the bytes alone, so equal texts give equal values.

Defined cases: a null or undecodable image gives null features; a null or empty text is stored as one row of 64 zero bytes;
a long text is one image, held whole once stored and once read; repeated rows each have their own; other columns are not
read by the payload functions, and `add_tiles` replaces columns named like its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, prepare

WIDTH = 64
BLOCK_ROWS = 4096
PGM_ROWS = 64
TILE = 8


def _netpbm_tokens(data: bytes, start: int, count: int) -> tuple[list[int], int]:
    """Header numbers of a Netpbm file, comments skipped, and the place after the one white space that ends them."""
    found, at, n = [], start, len(data)
    while len(found) < count:
        while at < n and data[at : at + 1].isspace():
            at += 1
        if at < n and data[at] == 0x23:
            while at < n and data[at] not in b"\r\n":
                at += 1
            continue
        end = at
        while end < n and 0x30 <= data[end] <= 0x39:
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: uint8 (or uint16 above 255) array of rows x columns, with a third axis for P3 and P6."""
    if data[:1] != b"P" or data[1:2] not in b"123456" or len(data) < 3:
        raise ValueError("not Netpbm")
    kind = data[1] - 0x30
    bitmap = kind in (1, 4)
    numbers, at = _netpbm_tokens(data, 2, 2 if bitmap else 3)
    width, height = numbers[:2]
    depth = 3 if kind in (3, 6) else 1
    peak = 1 if bitmap else numbers[2]
    if not 0 < peak < 65536:
        raise ValueError("bad maximum")
    wide = peak > 255
    if kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        out = 1 - np.unpackbits(raw, axis=1)[:, :width]
    elif kind in (5, 6):
        out = np.frombuffer(data, ">u2" if wide else np.uint8, width * height * depth, at)
    elif kind == 1:
        bits = np.frombuffer(data, np.uint8)[at:]
        out = (0x31 - bits[(bits == 0x30) | (bits == 0x31)][: width * height]).astype(np.uint8)
    else:
        out = np.array(data[at:].split()[: width * height * depth], dtype=np.int64)
    if out.size != width * height * depth:
        raise ValueError("short image")
    out = out.astype(np.uint16 if wide else np.uint8, copy=False)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8, copy=False).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.astype(np.uint8, copy=False).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: grey (rows x columns) if its palette is grey, else RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, header = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw if height < 0 else raw[::-1]
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1])
    if bits == 8:
        index = raw[:, :width]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    colours = used or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey as 8 bits with a grey palette, RGB as 24 bits; rows bottom-up, padded to 4 bytes."""
    height, width = pixels.shape[:2]
    grey = pixels.ndim == 2
    body = pixels if grey else pixels[:, :, ::-1].reshape(height, -1)
    stride = (body.shape[1] + 3) // 4 * 4
    padded = np.zeros((height, stride), np.uint8)
    padded[:, : body.shape[1]] = body[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1) if grey else np.zeros((0, 4), np.uint8)
    if grey:
        palette[:, 3] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + padded.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, padded.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + padded.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _integral_at(pixels: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of the integral image at fractional row edges (linear between rows: pixels are constant squares).

    Column sums are carried over blocks of rows; the result is summed along the columns by the caller.
    """
    height, width = pixels.shape
    out = np.zeros((len(edges), width + 1))
    low = np.floor(edges).astype(np.int64)
    carry = np.zeros(width)
    for start in range(0, height, BLOCK_ROWS):
        block = pixels[start : start + BLOCK_ROWS].astype(np.float64)
        sums = np.vstack([carry, carry + np.cumsum(block, axis=0)])
        last = start + len(block)
        here = np.flatnonzero((low >= start) & ((low < last) | ((low == last) & (last == height))))
        for k in here:
            i = low[k] - start
            part = edges[k] - low[k]
            out[k, 1:] = sums[i] if part == 0 else sums[i] + part * (sums[i + 1] - sums[i])
        carry = sums[-1]
    return np.cumsum(out, axis=1)


def area_resize(pixels: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the source area under each target cell, from four corners of the integral image."""
    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, c], rows, cols) for c in range(pixels.shape[2])], axis=2)
    height, width = pixels.shape
    if not height or not width:
        raise ValueError("empty image")
    at_rows = _integral_at(pixels, np.linspace(0, height, rows + 1))
    x = np.linspace(0, width, cols + 1)
    low = np.minimum(np.floor(x).astype(np.int64), width - 1)
    corners = at_rows[:, low] + (x - low) * (at_rows[:, low + 1] - at_rows[:, low])
    boxes = np.diff(np.diff(corners, axis=0), axis=1)
    return boxes / ((height / rows) * (width / cols))


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """size*size bits, 1 where a cell of the area-resized image is brighter than its left neighbour, as hex."""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, size, size + 1), 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


def npy_tile(pixels: np.ndarray, rows: int = 32, cols: int = 32) -> bytes:
    """The area-resized image as the bytes of an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, rows, cols)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def add_tiles(df: DataFrame, image: str = "image", rows: int = 32, cols: int = 32) -> DataFrame:
    """All columns, then width int, height int, tile binary (NPY bytes), dhash string. Undecodable or null: null."""
    prepare(df.sparkSession)
    own = "`tile` binary, `dhash` string, `width` int, `height` int"
    kept = [c for c in df.columns if c.lower() not in ("tile", "dhash", "width", "height")]
    schema = df.select(*[f"`{c}`" for c in kept]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(image).to_pylist():
                try:
                    pixels = decode_image(bytes(data))
                    found.append((npy_tile(pixels, rows, cols), difference_hash(pixels), pixels.shape[1], pixels.shape[0]))
                except (ValueError, TypeError, struct.error, IndexError):
                    found.append((None, None, None, None))
            tile, mark, width, height = zip(*found) if found else ((), (), (), ())
            extra = [pa.array(tile, pa.binary()), pa.array(mark, pa.string()), pa.array(width, pa.int32()), pa.array(height, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + extra, kept + ["tile", "dhash", "width", "height"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), own])
    return df.mapInArrow(frugal(work), ddl)


def store_payload(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """key, n_bytes and media: the text's UTF-8 bytes (null: none), zero bytes up to a positive multiple of 64, as PGM or BMP."""
    prepare(df.sparkSession)
    source = df.select(key.alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("raw"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, stored = [], []
            for cell in batch.column("raw"):
                data = cell.as_buffer() if cell.is_valid else b""
                size = len(data)
                rows = max(1, -(-size // WIDTH))
                pixels = np.zeros(rows * WIDTH, np.uint8)
                pixels[:size] = np.frombuffer(data, np.uint8)
                sizes.append(size)
                stored.append((encode_pgm if rows <= PGM_ROWS else encode_bmp)(pixels.reshape(rows, WIDTH)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return source.mapInArrow(frugal(work), f"doc_id {kind}, n_bytes long, media binary")


def read_payload(df: DataFrame) -> DataFrame:
    """Decode the stored media and describe the samples that come back; `tile` is an NPY file of the area-resized image."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for cell in batch.column("media"):
                media = cell.as_buffer().to_pybytes()
                pixels = decode_image(media)
                payload = pixels.tobytes()
                row = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), npy_tile(pixels, TILE, TILE),
                )
                for col, value in zip(cols, row):
                    col.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"],
            )

    return df.mapInArrow(
        frugal(work),
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile binary",
    )
