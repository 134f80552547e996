"""Media columns: Netpbm and BMP to arrays, area resizing, NPY tiles, difference hashes.

A media column holds whole files as binary. decode() reads Netpbm P1 to P6 and uncompressed BMP
(8, 24, 32 bits) to an array of (height, width, channels). area_resize() averages over exact areas:
sums are read off an integral image, between its entries by interpolation, which is exact as a
pixel is constant over its square. Only the rows and columns of the integral image that the target
needs are kept, and rows are taken in strips, so a very large image needs little more memory than
itself. The difference hash has a bit for each pair of neighbours in an 8 x 9 luminance tile.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm import common

#: Pixels in a row of a stored text: 64 RGB pixels, 192 bytes.
WIDTH = 64
#: Rows that are summed at once.
STRIP = 4096
TILE = (8, 8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of a Netpbm or BMP file. ValueError if it is neither, or cut short."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - ord("0"), 2, []
    token = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\n]*\n)*([0-9]+)")
    while len(numbers) < (2 if kind in (1, 4) else 3):
        found = token.match(data, at)
        if not found:
            raise ValueError("bad Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, most = (*numbers, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        got = np.frombuffer(data[at:], np.uint8)
        got = 1 - (got[(got == 48) | (got == 49)][:n] - 48)
    elif kind in (2, 3):
        got = np.array(data[at:].split()[:n], np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1)
        got = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    else:
        got = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(got) != n:
        raise ValueError("Netpbm file cut short")
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm header")
    return got.reshape(height, width, channels)


def most(data: bytes) -> int:
    """The sample value of full brightness: a Netpbm file's own, else 255 (1 for bitmaps)."""
    if data[:2] == b"BM":
        return 255
    if data[1:2] in b"14":
        return 1
    return int(re.match(rb"P[2356](?:(?:[ \t\r\n\v\f]|#[^\n]*\n)*[0-9]+){2}(?:[ \t\r\n\v\f]|#[^\n]*\n)*([0-9]+)", data)[1])


def _bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[:: -1 if height > 0 else 1, : width * bits // 8]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        if rows.size and rows.max() >= len(palette):
            raise ValueError("BMP pixel beyond its palette")
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm (P6) of (height, width, 3) bytes."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of (height, width, 3) bytes."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _between(integral: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries of an integral (first axis) at fractional places."""
    low = np.minimum(at.astype(np.int64), len(integral) - 2)
    part = (at - low).reshape(-1, *[1] * (integral.ndim - 1))
    return integral[low] * (1 - part) + integral[low + 1] * part


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, as float64 of (height, width, channels)."""
    h, w, channels = pixels.shape
    if not h or not w:
        return np.zeros((height, width, channels))
    across, down = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    total, sums = np.zeros((width, channels)), np.zeros((height + 1, width, channels))
    for top in range(0, h, STRIP):
        strip = pixels[top : top + STRIP].astype(np.float64)
        by_x = np.concatenate([np.zeros((1, *strip.transpose(1, 0, 2).shape[1:])), strip.transpose(1, 0, 2).cumsum(axis=0)])
        cells = np.diff(_between(by_x, across), axis=0).transpose(1, 0, 2)  # rows, target columns
        by_y = np.concatenate([total[None], total + cells.cumsum(axis=0)])
        inside = (down >= top) & (down <= top + len(strip))
        sums[inside] = _between(by_y, down[inside] - top)
        total = by_y[-1]
    return np.diff(sums, axis=0) / (h / height * w / width)


def luminance(pixels: np.ndarray) -> np.ndarray:
    """ITU-R BT.601 weights; one channel stays as it is."""
    return pixels @ np.array([[0.299], [0.587], [0.114]]) if pixels.shape[2] == 3 else pixels[:, :, :1].astype(np.float64)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether luminance rises from one cell of an 8 x 9 tile to the next."""
    small = np.rint(luminance(area_resize(pixels, 8, 9)) * 256).astype(np.int64)[:, :, 0]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(pixels: np.ndarray, size: tuple[int, int] = TILE, full: int = 255) -> bytes:
    """The image resized to 8-bit samples, `full` brightness becoming 255, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(pixels, *size) * (255 / full)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def with_features(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows with width, height, channels, tile (NPY) and dhash of a media column.

    Null and unreadable files give nulls. Other columns stay; they must not be called like a new one.
    """
    new = [T.StructField(n, k) for n, k in (("width", T.LongType()), ("height", T.LongType()), ("channels", T.LongType()), ("tile", T.BinaryType()), ("dhash", T.StringType()))]
    if clash := {f.name for f in new} & set(media.columns):
        raise ValueError(f"columns named like new ones: {sorted(clash)}")

    def one(data: bytes | None) -> tuple:
        try:
            p = decode(data or b"")
        except (ValueError, struct.error):
            return (None,) * 5
        return p.shape[1], p.shape[0], p.shape[2], tile(p, full=most(data)), difference_hash(p)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        got = list(zip(*(one(x.as_py()) for x in b.column(column)), strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=[*b.schema.names, *(f.name for f in new)])

    return common.by_batch(media, each, T.StructType([*media.schema.fields, *new]))


def store(text: bytes) -> bytes:
    """A text as an image: its UTF-8 bytes, spaces to a positive multiple of 192, as rows of 64 RGB pixels."""
    whole = max(1, -(-len(text) // (3 * WIDTH))) * 3 * WIDTH
    return encode_ppm(np.frombuffer(text.ljust(whole), np.uint8).reshape(-1, WIDTH, 3))


def text_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text stored as an image, read back, and described. Null texts are empty; other columns are ignored.

    feature: the difference hash and the SHA-256 of the NPY tile, a colon between. doc_id keeps its
    type. Repeated rows are documents of their own; equal texts have equal values. A text of any length
    is one tall image, resized in strips. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def one(raw: bytes) -> tuple:
        media = store(raw)
        pixels = decode(media)
        payload = pixels.tobytes()
        feature = f"{difference_hash(pixels)}:{hashlib.sha256(tile(pixels)).hexdigest()}"
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in batches:
            got = list(zip(*map(one, common.utf8(b.column("text"))), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, schema)
