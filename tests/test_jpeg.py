"""JPEG against the JVM's own reader and writer, and on broken files."""

import numpy as np
import pytest

from rasterloom.sources import codecs, containers, jpeg


def picture(color, width, height, seed=1):
    """Smooth shades with an edge."""
    y, x = np.mgrid[:height, :width]
    planes = [(x * 3 + y + 40 * c) % 256 * 0.5 + 60 + 20 * np.sin(x / (5 + c)) for c in range(codecs.CHANNELS[color])]
    v = np.stack(planes, 2)
    v[height // 3 :, : width // 4] = 30
    return codecs.Image(width, height, color, np.clip(v, 0, 255).astype(np.uint8))


def jvm_encode(spark, image):
    jvm = spark._jvm
    gray = image.color == "gray"
    b = jvm.java.awt.image.BufferedImage(image.width, image.height, 10 if gray else 1)  # TYPE_BYTE_GRAY, TYPE_INT_RGB
    for y in range(image.height):
        for x in range(image.width):
            p = [int(v) for v in image.pixels[y, x]]
            if gray:
                b.getRaster().setSample(x, y, 0, p[0])
            else:
                b.setRGB(x, y, p[0] << 16 | p[1] << 8 | p[2])
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(b, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("color", ["gray", "rgb"])
@pytest.mark.parametrize("size", [(16, 16), (1, 1), (37, 21), (8, 50)])
@pytest.mark.parametrize("halved", [False, True])
def test_round_trip(color, size, halved):
    image = picture(color, *size)
    for quality, most in ((100, 3 if not halved else 40), (90, 10 if not halved else 45)):
        got = jpeg.decode_jpeg(jpeg.encode_jpeg(image, quality, halved))
        assert (got.width, got.height, got.color) == (image.width, image.height, image.color)
        assert np.abs(got.samples.astype(int) - image.samples).mean() < most / 3
        if not halved:
            assert np.abs(got.samples.astype(int) - image.samples).max() <= 4 * most


def test_quality_orders_size_and_error():
    image = picture("rgb", 64, 48)
    files = [jpeg.encode_jpeg(image, q) for q in (10, 40, 70, 95)]
    errors = [np.abs(jpeg.decode_jpeg(f).samples.astype(int) - image.samples).mean() for f in files]
    assert [len(f) for f in files] == sorted(len(f) for f in files) and errors == sorted(errors, reverse=True)
    noise = codecs.Image(80, 80, "rgb", np.random.default_rng(1).integers(0, 256, 80 * 80 * 3).astype(np.uint8))
    assert np.abs(jpeg.decode_jpeg(jpeg.encode_jpeg(noise, 100)).samples.astype(int) - noise.samples).max() <= 6


@pytest.mark.parametrize("color", ["gray", "rgb"])
@pytest.mark.parametrize("halved", [False, True])
def test_jvm_reads_what_is_written(spark, color, halved):
    image = picture(color, 40, 27)
    data = jpeg.encode_jpeg(image, 92, halved)
    raster = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
    assert (raster.getWidth(), raster.getHeight()) == (40, 27)
    ours = jpeg.decode_jpeg(data).pixels.astype(int)
    for y in range(0, 27, 2):
        for x in range(0, 40, 3):
            if color == "gray":
                theirs = [raster.getRaster().getSample(x, y, 0)]
            else:
                p = raster.getRGB(x, y)
                theirs = [p >> 16 & 255, p >> 8 & 255, p & 255]
            assert np.abs(ours[y, x] - theirs).max() <= (3 if not halved or color == "gray" else 90)


@pytest.mark.parametrize("color", ["gray", "rgb"])
def test_what_the_jvm_writes_is_read(spark, color):
    image = picture(color, 33, 18)
    got = jpeg.decode_jpeg(jvm_encode(spark, image))
    assert (got.width, got.height, got.color) == (33, 18, color)
    assert np.abs(got.samples.astype(int) - image.samples).mean() < 12


def test_broken_files_are_told():
    data = jpeg.encode_jpeg(picture("rgb", 40, 30), 80)
    every = containers.extended(codecs.standard())
    assert every.decode(data)[0] == "jpeg" and every.encoder("jpeg").lossy
    for end in range(0, len(data), 7):
        with pytest.raises(codecs.CodecError):
            jpeg.decode_jpeg(data[:end])
    rng = np.random.default_rng(3)
    for _ in range(150):
        broken = bytearray(data)
        for at in rng.integers(2, len(data), 4):
            broken[at] = rng.integers(0, 256)
        try:
            jpeg.decode_jpeg(bytes(broken), 1 << 16)
        except codecs.CodecError:
            pass
    with pytest.raises(codecs.CodecError) as e:
        jpeg.decode_jpeg(data, 100)
    assert e.value.kind == "too_large"
    with pytest.raises(codecs.CodecError) as e:
        jpeg.decode_jpeg(data.replace(b"\xff\xc0", b"\xff\xc2"))
    assert e.value.kind == "unsupported"


def test_codes_have_at_most_16_bits():
    counts = {s: 2 ** min(s, 40) for s in range(60)}
    lengths = jpeg.code_lengths(counts)
    assert max(n for n, _ in lengths) <= 16 and sum(2.0**-n for n, _ in lengths) < 1
    assert len(set(jpeg._codes(lengths).values())) == 60
    assert jpeg.code_lengths({5: 9}) == [(1, 5)]
