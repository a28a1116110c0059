"""Media columns: Netpbm and BMP images, NPY tiles and difference hashes (operator 8).

Images are binary column values.  ``decode`` reads PBM, PGM, PPM (plain and raw, 8 and 16 bit) and
uncompressed BMP (1, 4, 8, 24 and 32 bit) into numpy arrays; ``resize`` averages areas with integral
images, in bands of rows, so its memory does not grow with the height; ``npy`` writes an array as NPY
bytes; ``difference_hash`` compares neighbours of a 9 x 8 reduction.

``text_media`` stores texts as 8-bit grey images, ``media_features`` reads the stored bytes back.  Rows
are independent of each other: there is no shuffle and no state.

Defined results: null text is the empty text, stored as 64 zero bytes; equal texts have equal values;
images that cannot be read raise an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
TILE = 16
BAND = 1 << 15

_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, header = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _NUMBER.match(data, at)
        header.append(int(found[1]))
        at = found.end()
    width, height, top = (*header, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * channels
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:count]
        values = 1 - (np.frombuffer(digits, np.uint8) - 48)
    elif kind == b"P4":
        row = -(-width // 8)
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = 1 - np.unpackbits(bits, axis=1)[:, :width]
    elif kind in (b"P2", b"P3"):
        text = re.sub(rb"#[^\n]*\n", b" ", data[at:])
        values = np.array(text.split()[:count], np.uint16 if top > 255 else np.uint8)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if values.size != count:
        raise ValueError("image data is cut short")
    shape = (height, width, 3) if channels == 3 else (height, width)
    return values.astype(np.uint16 if top > 255 else np.uint8, copy=False).reshape(shape)


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("compressed BMP")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if depth >= 24:
        step = depth // 8
        return raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    if depth == 8:
        index = raw[:, :width]
    elif depth == 4:
        index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """Array of an image: height x width, or height x width x 3."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def pgm(image: np.ndarray) -> bytes:
    """Raw PGM of an 8-bit grey image."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def bmp(image: np.ndarray) -> bytes:
    """8-bit BMP of a grey image, rows from the bottom up."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 54 + len(palette)
    size = start + rows.size
    head = struct.pack("<2sIHHI", b"BM", size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette + rows.tobytes()


def npy(array: np.ndarray) -> bytes:
    """NPY 1.0 bytes of an array."""
    array = np.ascontiguousarray(array)
    head = f"{{'descr': {array.dtype.str!r}, 'fortran_order': False, 'shape': {array.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin1") + array.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image[:, :, :3].astype(np.float64) @ (0.299, 0.587, 0.114)).round().astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area below every output pixel of a grey image, as float64.

    An integral image holds the sum above and left of every point; between points it is linear, so
    fractional areas are exact.  Bands of rows are summed one after the other.
    """
    rows, cols = image.shape
    ys, xs = np.linspace(0, rows, height + 1), np.linspace(0, cols, width + 1)
    left = np.minimum(xs.astype(int), cols - 1)
    across = xs - left
    out = np.zeros((height, width))
    for top in range(0, rows, BAND):
        band = image[top : top + BAND]
        sums = np.zeros((len(band) + 1, cols + 1))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
        y = np.clip(ys - top, 0, len(band))
        above = np.minimum(y.astype(int), len(band) - 1)
        down = (y - above)[:, None]
        lines = sums[above] * (1 - down) + sums[above + 1] * down
        points = lines[:, left] * (1 - across) + lines[:, left + 1] * across
        out += np.diff(np.diff(points, axis=0), axis=1)
    return out * (height * width / (rows * cols))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is a pixel of the 9 x 8 reduction darker than its right neighbour?"""
    small = resize(image, 8, 9).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tiles(image: np.ndarray, size: int = TILE) -> list[bytes]:
    """The image reduced to at most 4 x 4 tiles of ``size`` pixels, each as NPY bytes.

    Large images keep their proportions in whole tiles; small ones give one tile.
    """
    rows, cols = image.shape
    down = int(min(4, max(1, round(rows / max(cols, size)))))
    across = int(min(4, max(1, round(cols / max(rows, size)))))
    small = resize(image, down * size, across * size).round(6).astype("<f4")
    return [
        npy(small[r * size : (r + 1) * size, c * size : (c + 1) * size])
        for r in range(down)
        for c in range(across)
    ]


STORED_TYPE = "doc_id bigint, n_bytes bigint, media binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURE_TYPE = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,"
    " media_bytes bigint, media_sha256 string, feature string, tiles array<binary>"
)
_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("tiles", pa.list_(pa.binary())),
    ]
)


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a grey image of 64 columns ('pgm' or 'bmp')."""

    def run(batches):
        store = {"pgm": pgm, "bmp": bmp}[form]
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                sizes.append(len(text))
                payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
                media.append(store(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=_STORED
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, STORED_TYPE)


def media_features(media: DataFrame, with_tiles: bool = True) -> DataFrame:
    """Features of stored images; ``tiles`` is null unless wanted."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = decode(data)
                samples = np.ascontiguousarray(image).tobytes()
                flat = grey(image)
                rows.append(
                    (
                        doc, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]),
                        len(data), hashlib.sha256(data).hexdigest(), difference_hash(flat),
                        tiles(flat) if with_tiles else None,
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[]] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _FEATURES, strict=True)], schema=_FEATURES
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURE_TYPE)
