"""Interlacing, palettes, packed strips, colour maps and keyed padding; the JVM's writers are the other side where they can."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import palette, raster
from rasterloom.sources import codecs, containers, jpeg, probe


def shades(color, width=21, height=13, kind=np.uint8, seed=2):
    n = codecs.CHANNELS[color]
    y, x = np.mgrid[:height, :width]
    v = np.stack([(x * (3 + c) + y * 2) // 9 * 9 for c in range(n)], 2) + np.random.default_rng(seed).integers(0, 2, (height, width, n))
    return codecs.Image(width, height, color, (v % 256 * (257 if kind is np.uint16 else 1)).astype(kind))


def written(spark, image, fmt, packing=None, progressive=False):
    """Bytes of an 8-bit gray or RGB image by the JVM."""
    jvm = spark._jvm
    b = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(codecs.encode_png(image)))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(fmt).next()
    how = writer.getDefaultWriteParam()
    if packing:
        how.setCompressionMode(2)  # MODE_EXPLICIT
        how.setCompressionType(packing)
    if progressive:
        how.setProgressiveMode(1)  # MODE_DEFAULT
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(b, None, None), how)
    stream.flush()
    writer.dispose()
    return bytes(out.toByteArray())


def read(spark, data):
    """The JVM's RGBA of a file."""
    jvm = spark._jvm
    b = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    w, h = b.getWidth(), b.getHeight()
    argb = np.array(list(b.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], 2)


@pytest.mark.parametrize("color", codecs.CHANNELS)
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("size", [(21, 13), (1, 1), (3, 9), (8, 2)])
def test_interlaced_round_trip(color, kind, size):
    i = shades(color, *size, kind)
    out = codecs.decode_png(codecs.encode_png(i, interlaced=True))
    assert (out.color, out.depth) == (color, i.depth) and (out.samples == i.samples).all()


@pytest.mark.parametrize("color", ["gray", "rgb"])
def test_interlaced_by_the_jvm(spark, color):
    i = shades(color)
    assert (codecs.decode_png(written(spark, i, "png", progressive=True)).samples == i.samples).all()
    mine = read(spark, codecs.encode_png(shades("rgb"), interlaced=True))
    assert (mine[:, :, :3] == shades("rgb").pixels).all()


@pytest.mark.parametrize("most", [2, 4, 16, 200])
def test_palette_png(spark, most):
    r = np.random.default_rng(most)
    colours = np.unique(r.integers(0, 256, (most, 4)), axis=0)
    colours[::3, 3] = 255
    index = r.integers(0, len(colours), (11, 19))
    data = codecs.encode_palette_png(colours, index)
    out = codecs.decode_png(data)
    assert out.color == "rgba" and (out.pixels == colours[index]).all()
    assert data[24] == next(d for d in (1, 2, 4, 8) if len(colours) <= 1 << d) and (read(spark, data) == colours[index]).all()
    opaque = np.concatenate([colours[:, :3], np.full((len(colours), 1), 255)], 1)
    assert codecs.decode_png(codecs.encode_palette_png(opaque, index)).color == "rgb"
    found = palette.quantise(codecs.Image(19, 11, "rgba", colours[index].astype(np.uint8)), 256)
    assert (codecs.decode_png(codecs.encode_palette_png(*found)).pixels == colours[index]).all()
    with pytest.raises(codecs.CodecError):
        codecs.encode_palette_png(np.zeros((257, 4)), index)


@pytest.mark.parametrize("color", ["gray", "rgb"])
@pytest.mark.parametrize("packing", ["LZW", "PackBits", "Deflate", "ZLib"])
def test_packed_tiff(spark, color, packing):
    for size in ((21, 13), (300, 120)):
        i = shades(color, *size)
        out = containers.decode_tiff(written(spark, i, "tiff", packing))
        assert out.color == color and (out.samples == i.samples).all()


def test_tiles_and_broken_tiff():
    i = shades("gray", 20, 10)
    tile = [np.pad(i.pixels[y : y + 16, x : x + 16, 0], ((0, max(0, y + 16 - 10)), (0, max(0, x + 16 - 20)))).tobytes() for y in (0,) for x in (0, 16)]
    at = 8 + 512
    tags = [(256, 20), (257, 10), (258, 8), (259, 1), (262, 1), (277, 1), (322, 16), (323, 16), (324, at + 2 + 10 * 12 + 4), (325, at + 2 + 10 * 12 + 12)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 2 if t > 323 else 1, v) for t, v in tags) + b"\0" * 4
    body += struct.pack("<IIII", 8, 8 + 256, 256, 256)
    data = b"II*\0" + struct.pack("<I", at) + b"".join(tile) + body
    assert (containers.decode_tiff(data).samples == i.samples).all()
    r = containers.extended(codecs.standard())
    for packed in (5, 8, 32773):
        torn = data.replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, packed))
        with pytest.raises((codecs.CodecError, ValueError, IndexError, struct.error)):
            r.decode(torn[:300] + torn[400:])


def tga(kind, width, height, bits, body, mapped=0, table=b"", entries=0, table_bits=0, flags=32):
    return struct.pack("<BBBHHBHHHHBB", 0, mapped, kind, 0, entries, table_bits, 0, 0, width, height, bits, flags) + table + body


def test_colour_maps_and_small_words():
    colours = np.random.default_rng(1).integers(0, 256, (5, 3)).astype(np.uint8)
    index = np.arange(12).reshape(3, 4) % 5
    data = tga(1, 4, 3, 8, index.astype(np.uint8).tobytes(), 1, colours[:, ::-1].tobytes(), 5, 24)
    assert (codecs.decode_tga(data).pixels == colours[index]).all()
    assert (codecs.decode_tga(tga(1, 4, 3, 8, index.astype(np.uint8).tobytes(), 1, colours[:, ::-1].tobytes(), 5, 24, 0)).pixels == colours[index][::-1]).all()
    assert (codecs.decode_tga(tga(1, 4, 3, 8, index.astype(np.uint8).tobytes(), 1, colours[:, ::-1].tobytes(), 5, 24, 48)).pixels == colours[index][:, ::-1]).all()
    assert codecs.decode_tga(tga(2, 1, 1, 16, struct.pack("<H", 31 << 10 | 31))).samples.tolist() == [255, 0, 255]
    with pytest.raises(codecs.CodecError):
        codecs.decode_tga(tga(1, 1, 1, 8, b"\7", 1, colours.tobytes(), 5, 24))


def test_one_rule_for_tga(spark):
    """The rule on bytes and the one on columns agree on headers near the valid ones."""
    r = np.random.default_rng(7)
    files = [b"", b"x" * 17, b"x" * 30 + b"TRUEVISION-XFILE.\0"]
    for _ in range(400):
        kind, bits = int(r.choice([0, 1, 2, 3, 4, 9, 10, 11])), int(r.choice([8, 15, 16, 24, 32, 12]))
        mapped = int(kind in (1, 9)) if r.random() < 0.8 else int(r.integers(0, 3))
        entries = int(r.integers(1, 4)) * (mapped if r.random() < 0.9 else 1)
        need = entries * 3 + 6 * -(-bits // 8)
        files.append(tga(kind, int(r.integers(0, 3)), 3, bits, b"\1" * int(need - r.integers(0, 2)), mapped, b"", entries, int(r.choice([24, 24, 7])), int(r.choice([0, 8, 32, 64, 9]))))
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "i int, content binary").select("i", probe.is_tga(F.col("content")).alias("t")).collect()
    assert {r_["i"]: r_["t"] for r_ in got} == {i: codecs.is_tga(b) for i, b in enumerate(files)}
    assert 20 < sum(map(codecs.is_tga, files)) < 380


def test_padding_many_images(spark):
    rows = [("a", 0, 0, 1), ("a", 0, 1, 2), (None, 0, 0, 3)]
    pixels = spark.createDataFrame(rows, "name string, y long, x long, v long")
    out = raster.padded(pixels, 3, 2, 1, 1, {"v": 9}, ["name"]).collect()
    by = {n: {(r["y"], r["x"]): r["v"] for r in out if r["name"] == n} for n in ("a", None)}
    assert len(out) == 12 and by["a"] == {(0, 0): 9, (0, 1): 9, (0, 2): 9, (1, 0): 9, (1, 1): 1, (1, 2): 2}
    assert by[None][(1, 1)] == 3 and by[None][(1, 2)] == 9
    assert raster.padded(pixels.limit(0), 3, 2, 1, 1, {"v": 9}, ["name"]).count() == 0


@pytest.mark.parametrize("color", ["gray", "rgb"])
@pytest.mark.parametrize("size", [(21, 13), (1, 1), (130, 90)])
def test_progressive_jpeg(spark, color, size):
    """Scans in bands and by bits give the coefficients that one scan gives."""
    i = shades(color, *size)
    plain, scans = written(spark, i, "jpeg"), written(spark, i, "jpeg", progressive=True)
    assert b"\xff\xc2" in scans and scans.count(b"\xff\xda") > 3
    assert (jpeg.decode_jpeg(scans).samples == jpeg.decode_jpeg(plain).samples).all()
    raster_ = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(scans)).getRaster()
    theirs = np.array(list(raster_.getPixels(0, 0, *size, None)))
    near = np.abs(jpeg.decode_jpeg(scans).samples.astype(int) - theirs)
    assert near.max() <= 2 if color == "gray" else near.mean() < 6  # the JVM smooths halved colours
    for n in range(20, len(scans), max(1, len(scans) // 25)):
        try:
            jpeg.decode_jpeg(scans[:n])
        except codecs.CodecError as e:
            assert e.kind in ("decode", "unsupported")
