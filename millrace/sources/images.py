"""Pixels of PNG files, their luminance, and difference hashes of them, over Arrow batches of files.

No image library is at hand, so PNG is read here: chunks with their checksums, the five row
filters, grey, colour and palette pixels of 1 to 16 bits with or without transparency.
Interlaced files, and those of other formats, are reported with a fault and not guessed at.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
#: More pixels than this are refused before they are decompressed.
MAX_PIXELS = 90_000_000
#: Weights of red, green and blue in luminance, in 65536ths, and the size of the grid that is hashed. Fixed values.
_LUMINANCE = (19595, 38470, 7471)
WIDTH, HEIGHT = 9, 8
#: Lobes of the resampling kernel.
_LOBES = 3


class ImageFault(ValueError):
    """A file that is no image, or not one that is read here."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise ImageFault("no PNG file")
    at = len(SIGNATURE)
    while at < len(data):
        if at + 8 > len(data):
            raise ImageFault("cut off")
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ImageFault("cut off, or a checksum is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ImageFault("no end")


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """The rows of bytes of filtered rows, of which each begins with its filter; `step` is the size of a pixel in bytes."""
    height, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            made = row
        elif kind == 1:  # the sum of all before it, pixel by pixel
            made = np.add.accumulate(np.pad(row, (0, -width % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif kind == 2:
            made = row + above
        elif kind in (3, 4):
            made = np.frombuffer(_in_turn(kind, row.tobytes(), above.tobytes(), step), np.uint8)
        else:
            raise ImageFault("a row has no known filter")
        out[y] = made
        above = out[y]
    return out


def _in_turn(kind: int, row: bytes, above: bytes, step: int) -> bytes:
    """The two filters in which each byte needs the one before it: the mean of left and above, and the nearest to left + above - corner."""
    out = bytearray(len(row))
    for i, value in enumerate(row):
        left = out[i - step] if i >= step else 0
        up = above[i]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = above[i - step] if i >= step else 0
            far = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = (left, up, corner)[far.index(min(far))]
        out[i] = (value + guess) & 255
    return bytes(out)


def decode_png(data: bytes) -> tuple[str, np.ndarray]:
    """Mode and pixels (rows, columns, channels; 8 bits each) of a PNG file; palettes are resolved to red, green and blue."""
    head, palette, packed = None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ImageFault("no header")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or interlaced or not width or not height:
        raise ImageFault("interlaced" if interlaced else "a header that is not read here")
    if width * height > MAX_PIXELS:
        raise ImageFault("too many pixels")
    channels = _CHANNELS[colour]
    line = -(-width * channels * depth // 8)
    unzip = zlib.decompressobj()
    try:
        raw = unzip.decompress(b"".join(packed), height * (line + 1))
    except zlib.error as e:
        raise ImageFault(f"not decompressed: {e}") from e
    if len(raw) != height * (line + 1):
        raise ImageFault("rows are missing")
    rows = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1)).sum(2).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise ImageFault("a pixel is beyond the palette")
        pixels = palette[pixels[..., 0]]
    return MODES[colour], pixels


def encode_png(pixels: np.ndarray, row_filter: int = 0) -> bytes:
    """A PNG file of 8-bit grey (rows, columns) or colour pixels (rows, columns, 3), its rows unfiltered or as differences to the row above."""
    if row_filter not in (0, 2):
        raise ValueError("rows are written as they are, or as differences to the row above")
    rows = pixels.reshape(len(pixels), -1).astype(np.uint8)
    if row_filter:
        rows = rows - np.vstack((np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]))
    raw = np.hstack((np.full((len(rows), 1), row_filter, np.uint8), rows)).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Grey values of pixels; transparency plays no part."""
    if pixels.shape[2] < 3:
        return pixels[..., 0]
    weighed = sum(pixels[..., i].astype(np.int64) * w for i, w in enumerate(_LUMINANCE))
    return ((weighed + 32768) >> 16).astype(np.uint8)


def resampling(size: int, to: int) -> np.ndarray:
    """Weights (to, size) of a windowed sinc kernel, which is stretched where there are fewer places than before."""
    scale = size / to
    stretch = max(scale, 1.0)
    out = np.zeros((to, size))
    for i in range(to):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - _LOBES * stretch + 0.5)), min(size, int(centre + _LOBES * stretch + 0.5))
        x = (np.arange(first, last) + 0.5 - centre) / stretch
        weight = np.where(np.abs(x) < _LOBES, np.sinc(x) * np.sinc(x / _LOBES), 0.0)
        out[i, first:last] = weight / weight.sum()
    return out


def shrunk(grey: np.ndarray, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """Grey values of another size: across, then down, rounded to 8 bits after each."""
    fit = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = fit(grey.astype(np.float64) @ resampling(grey.shape[1], width).T)
    return fit(resampling(grey.shape[0], height) @ across).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 places of 8 rows is brighter than the next one, the first as the highest bit."""
    small = shrunk(grey)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def inspected(pictures: DataFrame) -> DataFrame:
    """(path, width, height, mode, hash, fault) of files (path, content); where there is a fault, the others are null."""
    ship(pictures.sparkSession)
    names = ["path", "width", "height", "mode", "hash", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    mode, pixels = decode_png(content.as_py() or b"")
                    rows.append((path.as_py(), pixels.shape[1], pixels.shape[0], mode, difference_hash(luminance(pixels)), None))
                except ImageFault as e:
                    rows.append((path.as_py(), None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return pictures.select("path", "content").mapInArrow(run, "path string, width int, height int, mode string, hash string, fault string")


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the PNG files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root).select("path", "content")


def drawn(values: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(path, content) of grey pictures made of rows (path, values: array of int of width * height numbers from 0 to 255)."""
    ship(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(np.array(v, np.uint8).reshape(height, width), 2 * (i % 2)) for i, v in enumerate(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return values.select("path", "values").mapInArrow(run, "path string, content binary")
