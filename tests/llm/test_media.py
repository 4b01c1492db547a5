import hashlib
import io
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import media as M


def brute_means(image, height, width):
    rows, columns = image.shape
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            y0, y1, x0, x1 = Fraction(y * rows, height), Fraction((y + 1) * rows, height), Fraction(x * columns, width), Fraction((x + 1) * columns, width)
            total = sum(int(image[r, c]) * max(0, min(y1, r + 1) - max(y0, r)) * max(0, min(x1, c + 1) - max(x0, c)) for r in range(rows) for c in range(columns))
            out[y, x] = int(total / ((y1 - y0) * (x1 - x0)) + Fraction(1, 2))
    return out


@pytest.mark.parametrize("shape", [(1, 64), (3, 5), (8, 9), (13, 64), (40, 7)])
def test_resize_is_the_area_mean(shape, monkeypatch):
    monkeypatch.setattr(M, "BAND", 4)
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for size in ((8, 9), (16, 16), (2, 3), (1, 1)):
        assert (M.area_resize(image, *size) == brute_means(image, *size)).all()


def test_round_trips():
    image = np.random.default_rng(2).integers(0, 256, (7, 13), dtype=np.uint8)
    assert (M.decode(M.encode_pgm(image)) == image).all() and (M.decode(M.encode_bmp(image)) == image).all()


def test_netpbm_kinds():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert M.decode(b"P2\n2 1\n# c\n300\n7 299\n").tolist() == [[7, 299]]
    assert M.decode(b"P3 1 1 255 1 2 3 ").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[1, 0, 1], [0, 1, 0]]
    assert M.decode(b"P5 2 1 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256, 2]]
    assert M.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    for bad in (b"P9 1 1 255\n", b"P5\nx", b"P5 9 9 255\nab", b"BMxx"):
        with pytest.raises(ValueError):
            M.decode(bad)


def test_text_media(spark):
    texts = {1: None, 2: "", 3: "aé\n", 4: "x" * 64, 5: "long " * 60_000, 6: "aé\n"}
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in M.text_media(docs, digests=False).collect()}
    for k, v in texts.items():
        raw = (v or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert M.decode(bytes(r.media)).tobytes() == payload and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert np.load(io.BytesIO(bytes(r.tile_npy))).shape == (16, 16) and len(r.feature) == 16
    assert got[3].asDict() | {"doc_id": 0} == got[6].asDict() | {"doc_id": 0} and got[1].feature == got[2].feature
    assert M.text_media(docs.limit(0)).count() == 0


def test_media_tiles(spark):
    image = np.arange(70, dtype=np.uint8).reshape(7, 10)
    rows = spark.createDataFrame([(1, bytearray(M.encode_bmp(image))), (2, None)], "id long, media binary")
    a, b = M.media_tiles(rows, "id", "media").orderBy("id").collect()
    assert (a.width, a.height, a.channels, a.dhash) == (10, 7, 1, "0" * 16) and b.tile_npy is None


def test_media_tiles_bad_files(spark):
    good = M.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    rows = spark.createDataFrame([(1, good, "x"), (2, b"P5 8 8 255\n", "x"), (3, b"??", "x"), (3, b"??", "x"), (4, None, "x"), (5, b"", "x")], "id long, media binary, error string")
    found = {r.id: r for r in M.media_tiles(rows, "id", "media").collect()}
    assert found[1].error is None and found[1].width == 8 and found[1].tile_npy
    assert all(found[k].error and found[k].width is None and found[k].tile_npy is None for k in (2, 3, 5)) and found[4].error is None and found[4].width is None
    assert M.media_tiles(rows.where("false"), "id", "media").collect() == []
