"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, free, materialise, text_udf

#: Bytes in a row of the images that ``stored`` makes: 64 pixels of 3 samples.
ROW = 192
#: Side of the thumbnail, and of the tiles that it is cut to; images of texts are 64 wide and, in the mean, lower than 16.
SIDE, TILE = 16, 8

_HEADER = re.compile(rb"P([2356])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)\s")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 (rows, columns) or P6 (rows, columns, 3) of unsigned 8-bit samples."""
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, w, h) + image.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P2, P3 (text) and P5, P6 (binary) of at most 255 levels, scaled to 255."""
    m = _HEADER.match(data)
    if not m or not 0 < int(m[7]) < 256:
        raise ValueError("not a supported Netpbm image")
    w, h, depth = int(m[3]), int(m[5]), 3 if m[1] in b"36" else 1
    if m[1] in b"23":
        flat = np.array(data[m.end() :].split()[: w * h * depth], np.uint8)
    else:
        flat = np.frombuffer(data, np.uint8, w * h * depth, m.end())
    if (top := int(m[7])) < 255:
        flat = ((np.minimum(flat, top).astype(np.uint16) * 255 + top // 2) // top).astype(np.uint8)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, bottom row first, blue before green before red; rows end at multiples of four bytes."""
    h, w = image.shape[:2]
    pad = -3 * w % 4
    rows = np.pad(image[::-1, :, ::-1].reshape(h, 3 * w), ((0, 0), (0, pad)))
    size = rows.size
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed images of 24 bits a pixel, or of 8 bits with a palette; either row order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at = struct.unpack_from("<I", data, 10)[0]
    head, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24):
        raise ValueError("not a supported BMP image")
    stride, down = (w * bits // 8 + 3) // 4 * 4, h < 0
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows if down else rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, at - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(h), w, 3)[:, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the target's pixels cover, from the integral image; fractions of pixels count in part."""
    h, w = image.shape[:2]
    planes = image.reshape(h, w, -1).astype(np.float64)
    total = np.zeros((h + 1, w + 1, planes.shape[2]))
    total[1:, 1:] = planes.cumsum(0).cumsum(1)

    def at(edges: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """sums along axis 0 at fractional places."""
        low = np.minimum(edges.astype(int), len(sums) - 2)
        part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
        return sums[low] * (1 - part) + sums[low + 1] * part

    rows = at(np.linspace(0, h, height + 1), total)
    cells = at(np.linspace(0, w, width + 1), rows.swapaxes(0, 1)).swapaxes(0, 1)
    out = np.diff(np.diff(cells, axis=0), axis=1) * (height * width / (h * w))
    return out.reshape(height, width, *image.shape[2:])


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means of the grey image is below its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_resize(grey, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tiles(image: np.ndarray, tile: int = TILE) -> list[bytes]:
    """The image in tiles (smaller ones at the right and lower edge), row by row, each as an NPY file."""
    out = []
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            np.save(f := io.BytesIO(), np.ascontiguousarray(image[y : y + tile, x : x + tile]))
            out.append(f.getvalue())
    return out


def thumbnail(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    return np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)


def payload_of(text: bytes | None) -> bytes:
    """The text with spaces up to a positive multiple of ROW bytes."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def image_of(payload: bytes) -> bytes:
    """The payload as the samples of an image of 64 columns: BMP or PPM, by the payload."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return encode_bmp(image) if zlib.crc32(payload) & 1 else encode_netpbm(image)


def _store(texts: pa.Array) -> pa.Array:
    raw = texts.to_pylist()
    return pa.StructArray.from_arrays([pa.array([len(x or b"") for x in raw], pa.int64()), pa.array([image_of(payload_of(x)) for x in raw], pa.binary())], ["n_bytes", "media"])


_stored = text_udf("n_bytes long, media binary", _store)


def stored(docs: DataFrame, text_col: str = "text", mark: str = "__media") -> DataFrame:
    """docs, all rows and columns, with a struct ``mark``: n_bytes of the text as UTF-8, and media, its bytes as an image.

    A null text counts as an empty one, which is one row of spaces. Equal texts, repeated rows too, have equal images; very long
    ones are stored whole. An empty table gives an empty result. A column of docs named like the mark raises an error.
    """
    return docs.withColumn(free(docs, mark), _stored(F.col(text_col).cast("binary")))


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tiles array<binary>"


def _describe(media: pa.Array) -> pa.Array:
    out = []
    for data in media.to_pylist():
        if data is None:
            out.append(None)
            continue
        image = decode(data)
        payload = image.tobytes()
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(image):016x}", npy_tiles(thumbnail(image))))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary())]
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    return pa.StructArray.from_arrays([pa.array([x and x[i] for x in out], k) for i, k in enumerate(kinds)], names)


_described = text_udf(_FEATURES, _describe)


def described(media: DataFrame, media_col: str, mark: str = "__features") -> DataFrame:
    """media, all rows and columns, with a struct ``mark`` of what the decoded images give: see _FEATURES.

    Null media give null fields. Bytes that are no supported image raise an error, as does a column named like the mark.
    """
    return media.withColumn(free(media, mark), _described(F.col(media_col)))


def tiles(rows: DataFrame, id_col: str, tiles_col: str = "tiles") -> DataFrame:
    """(id_col, tile, npy): a row for each tile, numbered from 0, row by row of the image; npy is a whole NPY file."""
    return rows.select(id_col, F.posexplode(tiles_col).alias("tile", "npy"))


def through_storage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, the fields of _FEATURES), a row for each row of docs: written as images, read back and decoded; the tiles
    of the thumbnails are written as NPY files, in a column, and read back too.

    Null ids and repeated rows are rows as others; see ``stored`` for texts. Other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "__media.*")
    media = materialise(rows, "media")
    out = materialise(described(media, "media").select("id", "n_bytes", "__features.*"), "tiles")
    dropped(media)
    return out.withColumnRenamed("id", id_col)
