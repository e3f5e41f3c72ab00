"""PNG files against a plain encoder and decoder of all filters, and hashes of pictures."""

import random
import struct
import zlib

import numpy as np
import pytest

from millrace.sources import images


def filtered(row, above, step, kind):
    """One row by the rules of the format, byte by byte."""
    out = bytearray([kind])
    for i, v in enumerate(row):
        a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        p = a + b - c
        nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
    return bytes(out)


def png(rows, width, depth, colour, kinds, extra=b"", interlace=0):
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    raw, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        raw += filtered(row, above, step, kind)
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    packed = zlib.compress(raw)
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_all_filters(colour, channels, depth):
    rng = np.random.default_rng(colour + depth)
    for kinds in ([0] * 5, [1] * 5, [2] * 5, [3] * 5, [4] * 5, [0, 1, 2, 3, 4], [4, 3, 2, 1, 0]):
        pixels = rng.integers(0, 256, (5, 7, channels * depth // 8)).astype(np.uint8)
        mode, got = images.decode_png(png([r.tobytes() for r in pixels], 7, depth, colour, kinds))
        assert mode == images.MODES[colour] and np.array_equal(got, pixels[..., :: depth // 8])


def test_few_bits_and_palettes():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    _, got = images.decode_png(png([bytes([0b10110000, 0b10000000])], 9, 1, 0, [0]))
    assert got[0, :, 0].tolist() == [255, 0, 255, 255, 0, 0, 0, 0, 255]
    _, got = images.decode_png(png([bytes([0b00011011])], 4, 2, 0, [1]))
    assert got[0, :, 0].tolist() == [0, 85, 170, 255]
    colours = chunk(b"PLTE", bytes([1, 2, 3, 250, 240, 230]))
    _, got = images.decode_png(png([bytes([0, 1, 1])], 3, 8, 3, [0], colours))
    assert got[0].tolist() == [[1, 2, 3], [250, 240, 230], [250, 240, 230]]
    with pytest.raises(images.ImageFault, match="palette"):
        images.decode_png(png([bytes([0, 2, 1])], 3, 8, 3, [0], colours))


def test_faults():
    good = png([bytes(range(9))] * 8, 9, 8, 0, [0] * 8)
    for bad, said in ((b"GIF89a", "no PNG"), (good[:-20], "checksum|cut off"), (good[:-13], "cut off|no end"), (good[:50] + bytes([good[50] ^ 1]) + good[51:], "checksum"), (png([b"\0" * 3], 3, 8, 0, [0], interlace=1), "interlaced"), (b"", "no PNG")):
        with pytest.raises(images.ImageFault, match=said):
            images.decode_png(bad)


def test_round_trip_of_written_pictures():
    rng = np.random.default_rng(1)
    for shape in ((5, 6), (5, 6, 3)):
        for row_filter in (0, 2):
            pixels = rng.integers(0, 256, shape).astype(np.uint8)
            _, got = images.decode_png(images.encode_png(pixels, row_filter))
            assert np.array_equal(got.reshape(shape), pixels)


def test_shrinking():
    rng = np.random.default_rng(2)
    small = rng.integers(0, 256, (8, 9)).astype(np.uint8)
    assert np.array_equal(images.shrunk(small), small)  # of its own size a picture stays as it is
    assert np.allclose(images.resampling(100, 9).sum(1), 1)
    ramp = np.tile(np.linspace(0, 255, 180), (160, 1)).astype(np.uint8)
    assert images.difference_hash(ramp) == "0" * 16 and images.difference_hash(ramp[:, ::-1]) == "f" * 16
    big = np.kron(small, np.ones((20, 20), np.uint8))
    assert (int(images.difference_hash(big), 16) ^ int(images.difference_hash(small), 16)).bit_count() <= 6


def test_luminance():
    pixels = np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)
    assert images.luminance(pixels)[0].tolist() == [255, 76, 150, 29]


def test_folder_of_pictures(spark, tmp_path):
    draw = random.Random(1)
    rows = [bytes(draw.randrange(256) for _ in range(27)) for _ in range(8)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(rows, 9, 8, 2, [4] * 8))
    (tmp_path / "a" / "y.png").write_bytes(b"broken")
    (tmp_path / "a" / "z.txt").write_bytes(b"other")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.inspected(images.pictures(spark, str(tmp_path))).collect()}
    assert set(got) == {"x.png", "y.png"}
    _, pixels = images.decode_png(png(rows, 9, 8, 2, [0] * 8))
    assert tuple(got["x.png"])[1:] == (9, 8, "RGB", images.difference_hash(images.luminance(pixels)), None)
    assert got["y.png"]["fault"] == "no PNG file" and got["y.png"]["hash"] is None
