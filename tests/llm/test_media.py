import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import media


def test_netpbm_kinds_round_trip():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    rgb = rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    assert (media.decode_netpbm(media.encode_pgm(grey)) == grey).all()
    assert (media.decode_netpbm(media.encode_ppm(rgb)) == rgb).all()
    plain = b"P2\n# c\n3 2\n9\n1 2 3\n4 5 6\n"
    assert media.decode_netpbm(plain).tolist() == [[1, 2, 3], [4, 5, 6]]
    assert media.decode_netpbm(b"P1\n3 2\n1 0 1\n010").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode_netpbm(b"P4\n9 1\n\xff\x80").tolist() == [[0] * 9]
    wide = media.decode_netpbm(b"P5\n2 1\n65535\n\x01\x02\x03\x04")
    assert wide.tolist() == [[258, 772]]
    with pytest.raises(ValueError):
        media.decode_netpbm(b"P5\n4 4\n255\nxx")


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (4, 4), (7, 2)])
def test_bmp_round_trip(shape):
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, shape, dtype=np.uint8), rng.integers(0, 256, (*shape, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_bmp(grey)) == grey).all()
    assert (media.decode_image(media.encode_bmp(rgb)) == rgb).all()


def _area_brute(p, rows, cols):
    h, w = p.shape
    k = 60  # cells divided so finely that all borders fall on sub-cells
    fine = np.repeat(np.repeat(p.astype(float), rows * k // np.gcd(h, rows * k), 0), cols * k // np.gcd(w, cols * k), 1)
    fh, fw = fine.shape
    return fine.reshape(rows, fh // rows, cols, fw // cols).mean((1, 3)) if fh % rows == 0 and fw % cols == 0 else None


@pytest.mark.parametrize("shape", [(1, 64), (3, 64), (64, 64), (10, 9)])
def test_area_resize_against_brute_force(shape, monkeypatch):
    p = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    want = _area_brute(p, 8, 9)
    assert want is not None
    for block in (1, 2, 4096):
        monkeypatch.setattr(media, "BLOCK_ROWS", block)
        assert np.allclose(media.area_resize(p, 8, 9), want)


def test_npy_tile_reads_back():
    p = np.arange(4096, dtype=np.uint8).reshape(64, 64)
    tile = np.load(io.BytesIO(media.npy_tile(p, 8, 8)))
    assert tile.shape == (8, 8) and tile.dtype == np.uint8


def test_payload_columns(spark):
    texts = [(1, "abc", 9), (2, None, 9), (3, "", 9), (4, "é" * 100, 9), (5, "x" * 300_000, 9), (5, "abc", 9)]
    df = spark.createDataFrame(texts, "doc_id long, text string, media int")
    rows = media.read_payload(media.store_payload(df, F.col("doc_id"), F.col("text"))).collect()
    assert len(rows) == 6
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _ in texts[:5]:
        raw = (text or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = next(x for x in seen[doc_id] if x.n_bytes == len(raw))
        assert r.payload_bytes == len(pad) and r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-64:])
        pixels = np.frombuffer(pad, np.uint8).reshape(-1, 64)
        form = media.encode_pgm(pixels) if len(pixels) <= media.PGM_ROWS else media.encode_bmp(pixels)
        assert form[:2] == (b"BM" if len(raw) > 4096 else b"P5") and r.media_bytes == len(form) and r.media_sha256 == hashlib.sha256(form).hexdigest()
        assert (np.load(io.BytesIO(bytes(r.tile))) == np.clip(np.rint(media.area_resize(pixels, 8, 8)), 0, 255)).all()
        cells = media.area_resize(pixels, 8, 9)
        bits = [round(cells[i, j + 1], 9) > round(cells[i, j], 9) for i in range(8) for j in range(8)]
        assert r.feature == f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"
    assert seen[2][0].media_sha256 == seen[3][0].media_sha256
    empty = media.read_payload(media.store_payload(df.limit(0), F.col("doc_id"), F.col("text")))
    assert empty.count() == 0


def test_tiles_of_bad_images(spark):
    grey = np.arange(100, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(grey)), "t"), (2, None, "t"), (3, bytearray(b"junk"), "t")], "id int, image binary, tile string")
    rows = {r.id: r for r in media.add_tiles(df, rows=4, cols=4).collect()}
    assert rows[1].width == 10 and np.load(io.BytesIO(bytes(rows[1].tile))).shape == (4, 4)
    assert rows[2].tile is None and rows[3].dhash is None
