"""Media columns: Netpbm and BMP decoding, area resizing, NPY tiles and difference hashes.

Images are read from the stored bytes into numpy arrays, resized by integral images (box sums from
a running two-dimensional sum, so every source sample counts by the area that it shares with the
target cell), stored as NPY tiles and hashed by comparing neighbouring cells.

Null media give null results; a file that can't be read gives nulls too, and what is wrong in a column
of its own, so one bad file costs no other. Repeated rows get equal results each, an empty table gives no
rows, and only the id and the media are carried, so other columns can't clash.
Large images are summed in bands of rows, so memory follows the band and not the image.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import table

#: Samples of a row of a text stored as an image, and rows that are summed at once.
TEXT_WIDTH, BAND = 64, 65_536
TILE, HASH = 16, 8


# -- Netpbm --------------------------------------------------------------------------------------


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers behind the magic, comments skipped, and where the samples begin."""
    found: list[int] = []
    at = 2
    while len(found) < fields:
        while at < len(data) and (data[at] in b" \t\r\n\v\f" or data[at] == 0x23):
            if data[at] == 0x23:
                at = data.find(b"\n", at)
                if at < 0:
                    raise ValueError("netpbm: comment without an end")
            at += 1
        begin = at
        while at < len(data) and 0x30 <= data[at] <= 0x39:
            at += 1
        if begin == at:
            raise ValueError("netpbm: bad header")
        found.append(int(data[begin:at]))
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of shape (height, width) or (height, width, 3); bitmaps as 0 and 1, 1 is black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("netpbm: unknown magic")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *most), at = _header(data, 2 if bitmap else 3)
    top = most[0] if most else 1
    if not 0 < top < 65536:
        raise ValueError("netpbm: bad maximum")
    count = width * height * channels
    if kind == b"P1":
        digits = np.frombuffer(data, np.uint8, offset=at - 1)
        flat = digits[(digits == 0x30) | (digits == 0x31)][:count] - 0x30
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[:count], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at)
    if len(flat) != count:
        raise ValueError("netpbm: too few samples")
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8, copy=False).tobytes()


# -- BMP -----------------------------------------------------------------------------------------


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width) where all colours are grey, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("bmp: bad header")
    offset, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("bmp: only uncompressed images")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits >= 24:
        pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
        return pixels if (pixels[:, :, :1] != pixels).any() else pixels[:, :, 0]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(colours, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)
        index = (index if bits == 1 else index.reshape(rows, -1, 4) @ np.array([8, 4, 2, 1], np.uint8))[:, :width]
    return palette[index] if (palette[:, :1] != palette).any() else palette[:, 0][index]


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP; rows are padded to 4 bytes and stored from the last to the first."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    grey = np.where(np.arange(4) == 3, 0, grey).astype(np.uint8)
    body = 14 + 40 + 1024
    return b"BM" + struct.pack("<IHHI", body + rows.size, 0, 0, body) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + grey.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# -- resizing and hashing ------------------------------------------------------------------------


def _borders(samples: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell borders in units of 1/cells of a sample: whole samples before each, and the rest."""
    at = np.arange(cells + 1, dtype=np.int64) * samples
    return at // cells, at % cells


def _at_borders(sums: np.ndarray, whole: np.ndarray, rest: np.ndarray, cells: int) -> np.ndarray:
    """cells times the running sum at each border; sums[k] is the sum of the first k samples."""
    following = np.minimum(whole + 1, len(sums) - 1)
    tail = (slice(None),) + (None,) * (sums.ndim - 1)
    return sums[whole] * cells + (sums[following] - sums[whole]) * rest[tail]


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Integral-image box sums: cell (y, x) holds height·width times the area-weighted sum of its samples.

    Exact integers. Rows are summed in bands; of the integral image only the rows at cell borders stay.
    """
    rows, columns = image.shape
    whole, rest = _borders(rows, height)
    x_whole, x_rest = _borders(columns, width)
    needed = np.unique(np.concatenate([whole, np.minimum(whole + 1, rows)]))
    kept = np.zeros((len(needed), width), np.int64)
    total, at = np.zeros(columns, np.int64), 0
    for k, row in enumerate(needed):
        while at < row:
            step = min(BAND, row - at)
            total += image[at : at + step].sum(axis=0, dtype=np.int64)
            at += step
        across = np.concatenate([[0], np.cumsum(total)])
        kept[k] = np.diff(_at_borders(across, x_whole, x_rest, width))
    first, second = np.searchsorted(needed, whole), np.searchsorted(needed, np.minimum(whole + 1, rows))
    down = kept[first] * height + (kept[second] - kept[first]) * rest[:, None]
    return np.diff(down, axis=0)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted means, rounded half up."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], axis=2)
    if 0 in image.shape:
        raise ValueError("an empty image can't be resized")
    area = image.shape[0] * image.shape[1]  # in units of which a cell holds height·width shares
    return ((2 * area_sums(image, height, width) + area) // (2 * area)).astype(image.dtype if image.dtype.itemsize <= 2 else np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    """Rec. 601 luma in integers."""
    return image if image.ndim == 2 else ((image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(image.dtype)


def difference_hash(image: np.ndarray, size: int = HASH) -> str:
    """size·size bits in hex: whether a cell is brighter than its right neighbour, by exact area sums."""
    sums = area_sums(grey(image), size, size + 1)
    return np.packbits(sums[:, :-1] > sums[:, 1:]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


# -- Spark operators -----------------------------------------------------------------------------


def media_tiles(images: DataFrame, id_col: str, media_col: str, tile: int = TILE) -> DataFrame:
    """For each image (id, width, height, channels, tile_npy, dhash, error); nulls stay null.

    ``tile_npy`` is the tile of ``tile``·``tile`` cells as an NPY file, ready for a binary sink.
    """

    def describe(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = decode(data)
        except ValueError as why:
            return (*(None,) * 5, str(why))
        return image.shape[1], image.shape[0], image.shape[2] if image.ndim == 3 else 1, npy_bytes(area_resize(image, tile, tile)), difference_hash(image), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        for part in (x for batch in batches for x in slices(batch, 1, rows=64)):
            rows = [describe(data.as_py()) for data in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [id_col, "width", "height", "channels", "tile_npy", "dhash", "error"])

    rows = images.select(id_col, media_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, width int, height int, channels int, tile_npy binary, dhash string, error string")


def store_text(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, PGM file of its UTF-8 bytes padded by zeros to rows of 64)."""
    raw = (text or "").encode("utf-8", "replace")
    padded = raw + bytes(-len(raw) % TEXT_WIDTH if raw else TEXT_WIDTH)
    return len(raw), encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, TEXT_WIDTH))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Store each whole text losslessly as a grey image, read the stored bytes back and describe them.

    With ``digests``: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, tile_sha256); else also the stored file ``media`` and its ``tile_npy``.
    A null text counts as empty; an empty text has one row of zeros. Equal texts give equal values.
    """
    numbers = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    fields = [x.split() for x in numbers.split(", ")] + ([] if digests else [["media", "binary"], ["tile_npy", "binary"]])
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def describe(text: str | None) -> tuple:
        n, media = store_text(text)
        image = decode(media)
        payload = image.tobytes()
        tile = npy_bytes(area_resize(image, TILE, TILE))
        out = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(tile).hexdigest())
        return out if digests else (*out, media, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1, rows=256)):
            rows = [describe(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields))], [id_col, *(name for name, _ in fields)])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, " + ", ".join(" ".join(x) for x in fields))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a PGM image, read back, with its digests and difference hash."""
    return text_media(table(spark, sf_dir, "documents"))
