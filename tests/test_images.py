"""Resampling, padding, palettes and containers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import palette
from rasterloom.operators.resample import KERNELS, padded, resample, through_matrix, upright
from rasterloom.sources import codecs, containers


def noise(color, kind=np.uint8, width=24, height=16, seed=0):
    most = {np.uint8: 256, np.uint16: 65536}.get(kind)
    r = np.random.default_rng(seed)
    n = width * height * codecs.CHANNELS[color]
    return codecs.Image(width, height, color, r.integers(0, most, n).astype(kind) if most else r.random(n).astype(np.float32))


@pytest.mark.parametrize("name", [*KERNELS, "nearest"])
@pytest.mark.parametrize("color", codecs.CHANNELS)
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_flat_images_stay_flat(name, color, kind):
    i = noise(color, kind)
    i.samples[:] = np.array(0.4 if kind is np.float32 else 100).astype(kind)
    for size in ((7, 5), (24, 16), (50, 33)):
        out = resample(i, *size, name)
        assert (out.width, out.height, out.depth) == (*size, i.depth) and np.allclose(out.samples, i.samples[0], atol=1e-5)


def test_kernels():
    i = noise("rgb")
    assert (resample(i, 24, 16, "box").samples == i.samples).all() and (resample(i, 24, 16, "catmull-rom").samples == i.samples).all()
    f = noise("gray", np.float32)
    assert np.allclose(resample(f, 12, 8, "box").pixels[:, :, 0], f.pixels[:, :, 0].reshape(8, 2, 12, 2).mean((1, 3)), atol=1e-6)
    part = resample(i, 10, 6, "nearest", crop=(4, 2, 10, 6))
    assert (part.pixels == i.pixels[2:8, 4:14]).all()
    with pytest.raises(codecs.CodecError):
        resample(i, 0, 5)


def test_clear_pixels_lend_no_colour():
    i = codecs.Image(2, 1, "rgba", np.array([255, 0, 0, 255, 0, 255, 0, 0], np.uint8))
    assert resample(i, 1, 1, "box").pixels[0, 0].tolist() == [255, 0, 0, 128]


@pytest.mark.parametrize("color", codecs.CHANNELS)
def test_pad_then_crop_is_the_image(color):
    i = noise(color)
    for back in ((9, 9, 9, 255), (1, 2, 3, 255), (9, 9, 9, 100)):
        out = padded(i, 40, 30, 5, 6, back)
        inner = out.pixels[6:22, 5:29]
        grey = color.startswith("gray")
        assert (inner[:, :, : 1 if grey else 3] == i.pixels[:, :, : 1 if grey else 3]).all()
        assert out.pixels[0, 0, 0] == back[0] and (out.color.endswith("a")) == (color in ("gray_alpha", "rgba") or back[3] < 255)
    with pytest.raises(codecs.CodecError):
        padded(i, 10, 10, 0, 0, (0, 0, 0, 255))


def test_orientations_are_a_group():
    i = noise("rgb")
    once = [upright(i, o).pixels for o in range(1, 9)]
    assert len({p.tobytes() + bytes(p.shape) for p in once}) == 8
    assert (upright(upright(i, 6), 8).pixels == i.pixels).all() and upright(i, 6).width == 16


def test_matrix():
    i = noise("rgba", np.float32)
    same = through_matrix(i, np.eye(3))
    assert np.allclose(same.samples, i.samples) and (through_matrix(i, -np.eye(3)).pixels[:, :, :3] == 0).all()
    with pytest.raises(codecs.CodecError):
        through_matrix(i, np.ones((3, 3)))


@pytest.mark.parametrize("dither", [0, 100])
def test_palettes(dither):
    i = noise("rgba")
    for size in (2, 16, 256):
        colours, index = palette.quantise(i, size, dither)
        assert len(colours) <= size and index.shape == (16, 24) and index.max() < len(colours)
    few = codecs.Image(24, 16, "rgba", noise("rgba").samples // 128 * 128)
    colours, index = palette.quantise(few, 16, dither)
    assert palette.within(few, 16) and (colours[index] == few.pixels).all() and not palette.within(i, 16)
    errors = [np.abs(palette.quantise(i, n, 0)[0][palette.quantise(i, n, 0)[1]].astype(int) - i.pixels).mean() for n in (2, 16, 128)]
    assert errors == sorted(errors, reverse=True)


def gif(width, height, index, colours, clear=None, frames=1, interlaced=False):
    bits = 3
    codes, value, have, out = [], 0, 0, bytearray()
    for i in index:
        codes += [1 << bits, i]  # a clear code before each: codes stay short
    for c in [*codes, (1 << bits) + 1]:
        value |= c << have
        have += bits + 1
        while have >= 8:
            out.append(value & 255)
            value, have = value >> 8, have - 8
    out.append(value & 255)
    blocks = b"".join(bytes([len(out[i : i + 255])]) + bytes(out[i : i + 255]) for i in range(0, len(out), 255)) + b"\0"
    control = b"" if clear is None else bytes([0x21, 0xF9, 4, 1, 0, 0, clear, 0])
    frame = b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 64 if interlaced else 0) + bytes([bits]) + blocks
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x82, 0, 0) + bytes(colours) + (control + frame) * frames + b";"


def test_gif():
    r = np.random.default_rng(3)
    index, colours = r.integers(0, 8, 9 * 10), r.integers(0, 256, 24)
    out = containers.decode_gif(gif(9, 10, index.tolist(), colours.tolist()))
    assert out.color == "rgb" and (out.pixels == colours.reshape(8, 3)[index.reshape(10, 9)]).all()
    out = containers.decode_gif(gif(9, 10, index.tolist(), colours.tolist(), clear=int(index[0])))
    assert out.color == "rgba" and out.pixels[0, 0].tolist() == [0, 0, 0, 0]
    order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, 10, s)]
    out = containers.decode_gif(gif(9, 10, index.reshape(10, 9)[order].ravel().tolist(), colours.tolist(), interlaced=True))
    assert (out.pixels == colours.reshape(8, 3)[index.reshape(10, 9)]).all()
    assert containers.gif_animated(gif(9, 10, index.tolist(), colours.tolist(), frames=2)) and not containers.gif_animated(gif(9, 10, index.tolist(), colours.tolist()))


def test_long_codes():
    """Codes that grow to twelve bits, against a plain encoder."""
    r = np.random.default_rng(5)
    data = bytes(r.integers(0, 4, 30000).astype(np.uint8))
    table, width, out, value, have = {bytes([i]): i for i in range(4)}, 3, bytearray(), 0, 0

    def put(code):
        nonlocal value, have
        value |= code << have
        have += width
        while have >= 8:
            out.append(value & 255)
            value, have = value >> 8, have - 8

    put(4)
    nxt, now = 6, b""
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        if nxt < 4096:
            table[now + bytes([b])] = nxt
            nxt += 1
            if nxt == (1 << width) + 1 and width < 12:
                width += 1
        now = bytes([b])
    put(table[now])
    put(5)
    out.append(value & 255)
    assert containers._lzw(bytes(out), 2, len(data)) == data


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize(("color", "kind"), [("rgb", np.uint8), ("gray", np.uint16), ("rgba", np.float32), ("gray_alpha", np.uint8)])
def test_tiff(end, color, kind):
    i = noise(color, kind)
    raw = i.samples.astype(np.dtype(kind).newbyteorder(end)).tobytes()
    n, bits = codecs.CHANNELS[color], np.dtype(kind).itemsize * 8
    tags = [(256, 24), (257, 16), (258, bits), (259, 1), (262, 1 if n < 3 else 2), (273, 8), (277, n), (279, len(raw)), (339, 3 if kind is np.float32 else 1)]
    body = struct.pack(end + "H", len(tags)) + b"".join(struct.pack(end + "HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 4
    data = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8 + len(raw)) + raw + body
    fmt, out = containers.extended(codecs.standard()).decode(data)
    assert (fmt, out.color, out.depth) == ("tiff", color, i.depth) and (out.samples == i.samples).all()


def test_ico():
    i = noise("rgba", width=8, height=4)
    png = codecs.encode_png(i)
    rows = i.pixels[::-1][:, :, [2, 1, 0, 3]].tobytes()
    bitmap = struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 32, 0, 0, 0, 0, 0, 0) + rows + b"\0" * 16
    for body in (png, bitmap):
        data = struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", 8, 4, 0, 0, 1, 32, len(body), 22) + body
        assert (containers.decode_ico(data).samples == i.samples).all()


def test_boxes(spark):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    ispe = box(b"ispe", struct.pack(">III", 0, 640, 480))
    data = box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", ispe + box(b"irot", b"\1")))) + b"\0\0\0\x05bad"
    assert [(n, p, k) for n, p, k, _, _ in containers.boxes(data)] == [(0, -1, "ftyp"), (1, -1, "meta"), (2, 1, "iprp"), (3, 2, "ipco"), (4, 3, "ispe"), (5, 3, "irot")]
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    assert sorted((r[0], r[1], r[2]) for r in containers.heif_sizes(files).collect()) == [("a", 640, 480), ("b", None, None), ("c", None, None)]
    rows = files.lateralJoin(containers.Boxes(F.col("content").outer())).filter("type = 'ispe'").collect()
    assert [(r["path"], r["end"] - r["start"]) for r in rows] == [("a", 12)]
