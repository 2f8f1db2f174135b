"""More containers: GIF, TIFF and ICO decoders, and the boxes of HEIF files as rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from rasterloom.sources.codecs import MAX_PIXELS, PNG, CodecError, Decoder, Encoder, Image, Registry, _sized, decode_png
from rasterloom.sources.jpeg import decode_jpeg, encode_jpeg


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _gif_blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """(kind, place) of each extension (0x21) and image (0x2C)."""
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 128 else 0)
    while at < len(data) and data[at] in (0x21, 0x2C):
        yield data[at], at
        if data[at] == 0x21:
            _, at = _sub_blocks(data, at + 2)
        else:
            flags = data[at + 9]
            _, at = _sub_blocks(data, at + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))


def gif_animated(data: bytes) -> bool:
    """Whether there are two images."""
    return sum(kind == 0x2C for kind, _ in _gif_blocks(data)) > 1


def _lzw(data: bytes, bits: int, size: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, before = list(start), bits + 1, b""
    out = bytearray()
    value = have = at = 0
    while len(out) < size:
        while have < width:
            if at >= len(data):
                return bytes(out)
            value |= data[at] << have
            have, at = have + 8, at + 1
        code, value, have = value & (1 << width) - 1, value >> width, have - width
        if code == clear:
            table, width, before = list(start), bits + 1, b""
            continue
        if code == end:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise CodecError("decode", "bad code")
        out += entry
        if before and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        before = entry
    return bytes(out)


def decode_gif(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """The first frame on the logical screen: RGB where it is full and opaque, else RGBA."""
    width, height, flags = struct.unpack("<HHB", data[6:11])
    _sized(width, height, limit)
    shared = data[13 : 13 + (3 << (flags & 7) + 1)] if flags & 128 else b""
    clear = None
    for kind, at in _gif_blocks(data):
        if kind == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            continue
        x, y, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = shared
        if own & 128:
            n = 3 << (own & 7) + 1
            colours, at = data[at : at + n], at + n
        packed, _ = _sub_blocks(data, at + 1)
        index = np.frombuffer(_lzw(packed, data[at], w * h), np.uint8)
        if len(index) < w * h:
            raise CodecError("decode", "samples end early")
        index = index[: w * h].reshape(h, w)
        if own & 64:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            index = index[np.argsort(order)]
        table = np.zeros((256, 4), np.uint8)
        table[: len(colours) // 3, :3] = np.frombuffer(colours, np.uint8).reshape(-1, 3)
        table[:, 3] = 255
        if clear is not None:
            table[clear] = 0
        out = np.zeros((height, width, 4), np.uint8)
        part = out[y : y + h, x : x + w]
        part[:] = table[index][: part.shape[0], : part.shape[1]]
        return Image(width, height, "rgb", out[:, :, :3]) if (out[:, :, 3] == 255).all() else Image(width, height, "rgba", out)
    raise CodecError("decode", "no image")


def _packbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _tiff_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before = list(start), 9, b""
    out = bytearray()
    value = have = at = 0
    while len(out) < size:
        while have < width:
            if at >= len(data):
                return bytes(out)
            value, have, at = value << 8 | data[at], have + 8, at + 1
        have -= width
        code, value = value >> have, value & (1 << have) - 1
        if code == 256:
            table, width, before = list(start), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise CodecError("decode", "bad code")
        out += entry
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        width = min(12, max(9, (len(table) + 1).bit_length()))
        before = entry
    return bytes(out)


def _inflated(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise CodecError("decode", str(e)) from e


#: Fixed values (TIFF 6.0 and its supplements): how samples may be packed.
UNPACK = {1: lambda data, size: data[:size], 5: _tiff_lzw, 8: _inflated, 32946: _inflated, 32773: _packbits}


def decode_tiff(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """The first directory of a classic TIFF in strips or tiles, plain, PackBits, LZW or deflate, with differences
    of whole samples undone: grey, RGB, alpha, palettes; 8, 16 or float."""
    end = "<" if data[:2] == b"II" else ">"
    if struct.unpack(end + "H", data[2:4])[0] != 42:
        raise CodecError("unsupported", "BigTIFF")
    at = struct.unpack(end + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(end + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if (c := {1: "B", 3: "H", 4: "I"}.get(kind)) is None:
            continue
        size = struct.calcsize(c) * n
        place = at + 10 + 12 * i if size <= 4 else struct.unpack(end + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        tags[tag] = list(struct.unpack(f"{end}{n}{c}", data[place : place + size]))
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, bits, channels, mode = one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(262, 1)
    _sized(width, height, limit)
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits, one(339, 1)))
    unpack, differs = UNPACK.get(one(259, 1)), one(317, 1)
    places, sizes = tags.get(324, tags.get(273)), tags.get(325, tags.get(279, [len(data)]))
    if unpack is None or kind is None or mode > 3 or one(284, 1) != 1 or channels > 4 or not places or differs > 2 or (differs == 2 and kind == "f4"):
        raise CodecError("unsupported", "planar or unusual TIFF")
    wide, tall = (one(322, 0), one(323, 0)) if 324 in tags else (width, min(one(278, height), height))
    if not wide or not tall:
        raise CodecError("decode", "a strip or tile without a side")
    _sized(wide, tall, limit)
    across = -(-width // wide)
    if min(len(places), len(sizes)) < across * -(-height // tall):
        raise CodecError("decode", "samples end early")
    v = np.zeros((height, width, channels), kind)
    for i, (a, n) in enumerate(zip(places, sizes, strict=False)):
        y, x = i // across * tall, i % across * wide
        if y >= height:
            break
        rows = tall if 324 in tags else min(tall, height - y)
        need = rows * wide * channels * v.itemsize
        raw = unpack(data[a : a + n], need)
        if len(raw) < need:
            raise CodecError("decode", "samples end early")
        part = np.frombuffer(raw[:need], end + kind).astype(kind).reshape(rows, wide, channels)
        if differs == 2:
            part = np.cumsum(part, 1, dtype=kind)
        v[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    if mode == 3:
        planes = np.array(tags[320], np.uint16).reshape(3, -1)
        if channels != 1 or v.max() >= planes.shape[1]:
            raise CodecError("decode", "colour beyond the palette")
        v = planes[:, v[:, :, 0]].transpose(1, 2, 0)
    elif mode == 0:
        v[:, :, 0] = (np.iinfo(kind).max if kind != "f4" else 1) - v[:, :, 0]
    return Image(width, height, {1: "gray", 2: "gray_alpha", 3: "rgb", 4: "rgba"}[v.shape[2]], v)


def decode_ico(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """The largest entry: PNG, or a bitmap of 24 or 32 bits with its mask."""
    n = struct.unpack("<H", data[4:6])[0]
    entries = [struct.unpack("<BBBBHHII", data[6 + 16 * i : 22 + 16 * i]) for i in range(n)]
    best = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = data[best[7] : best[7] + best[6]]
    if body.startswith(PNG):
        return decode_png(body, limit)
    head, width, double, _, bits, packed = struct.unpack("<IiiHHI", body[:20])
    height = double // 2
    _sized(width, height, limit)
    if bits not in (24, 32) or packed:
        raise CodecError("unsupported", f"icon of {bits} bits")
    line, mask = (width * bits // 8 + 3) // 4 * 4, (width + 31) // 32 * 4
    if len(body) < head + line * height:
        raise CodecError("decode", "samples end early")
    px = np.frombuffer(body, np.uint8, line * height, head).reshape(height, line)[::-1, : width * bits // 8].reshape(height, width, -1)
    if bits == 32 and px[:, :, 3].any():
        return Image(width, height, "rgba", px[:, :, [2, 1, 0, 3]])
    gone = np.zeros((height, width), np.uint8)
    if len(body) >= head + (line + mask) * height:
        gone = np.unpackbits(np.frombuffer(body, np.uint8, mask * height, head + line * height).reshape(height, mask)[::-1], axis=1)[:, :width]
    return Image(width, height, "rgba", np.concatenate([px[:, :, 2::-1], ((1 - gone) * 255).astype(np.uint8)[:, :, None]], 2))


def extended(registry: Registry) -> Registry:
    """registry with the decoders of this module and JPEG, ahead of those that have no mark of their own."""
    registry.encoders.append(Encoder("jpeg", "jpeg", encode_jpeg, lossy=True, lossless=False, alpha=False))
    registry.decoders[:0] = [
        Decoder("jpeg", lambda b: b.startswith(b"\xff\xd8\xff"), decode_jpeg),
        Decoder("gif", lambda b: b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 13, decode_gif),
        Decoder("tiff", lambda b: b[:4] in (b"II*\0", b"MM\0*"), decode_tiff),
        Decoder("ico", lambda b: b[:4] in (b"\0\0\1\0", b"\0\0\2\0") and len(b) >= 6 and b[4:6] != b"\0\0", decode_ico),
    ]
    return registry


#: Boxes that hold boxes, and the bytes before the first of them.
PARENTS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "trak": 0, "dinf": 0}


def boxes(data: bytes) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, parent, type, body start, body end) of each box, depth first; -1: no parent. Stops at damage."""
    number = 0
    todo = [(0, len(data), -1)]
    while todo:
        at, end, parent = todo.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            continue
        name = kind.decode("latin-1")
        yield number, parent, name, at + head, at + size
        todo.append((at + size, end, parent))
        if name in PARENTS:
            todo.append((at + head + PARENTS[name], at + size, number))
        number += 1


@udtf(returnType="number: int, parent: int, type: string, start: int, end: int")
class Boxes:
    """boxes() for SQL and lateral joins."""

    def eval(self, content: bytes):
        if content is not None:
            yield from boxes(bytes(content))


def heif_sizes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, width, height) that image properties of HEIF files say, the largest of each."""

    def largest(data: bytes | None) -> tuple[int, int] | None:
        data = bytes(data or b"")
        found = [struct.unpack(">II", data[a + 4 : a + 12]) for _, _, kind, a, b in boxes(data) if kind == "ispe" and b - a >= 12]
        return max(found, key=lambda s: s[0] * s[1], default=None)

    size = F.udf(largest, "width long, height long", useArrow=True)
    return files.select(path, size(F.col(content)).alias("s")).select(path, "s.width", "s.height")
