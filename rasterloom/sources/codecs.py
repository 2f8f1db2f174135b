"""Codecs behind a registry, and the Arrow functions that run them on rows.

A decoder turns bytes into an `Image`, an encoder an `Image` into bytes. Both are plain Python
objects; `decoded()` and `encoded()` wrap a registry as pandas functions whose rows fail one by
one: a bad file gives an error_kind and an error, never a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels by layout.
CHANNELS = {"gray": 1, "gray_alpha": 2, "rgb": 3, "rgba": 4}
LAYOUTS = {n: c for c, n in CHANNELS.items()}
#: Pixels that a decoder takes at most.
MAX_PIXELS = 268_435_456
IMAGE = "struct<width:int,height:int,color:string,depth:string,samples:binary,error_kind:string,error:string>"


class CodecError(Exception):
    """kind: unknown, unavailable, decode, encode, too_large, unsupported or params."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Image:
    """Interleaved samples, rows first: uint8, uint16 or float32 (linear light)."""

    width: int
    height: int
    color: str
    samples: np.ndarray

    def __post_init__(self) -> None:
        self.samples = np.asarray(self.samples).reshape(-1)
        if self.width < 1 or self.height < 1 or len(self.samples) != self.width * self.height * CHANNELS[self.color]:
            raise CodecError("decode", "samples don't match the size")

    @property
    def depth(self) -> str:
        return {"uint8": "u8", "uint16": "u16", "float32": "f32"}[self.samples.dtype.name]

    @property
    def pixels(self) -> np.ndarray:
        return self.samples.reshape(self.height, self.width, -1)


def capped(width: int, height: int, limit: int) -> None:
    if width * height > limit:
        raise CodecError("too_large", f"{width} x {height} pixels are over {limit}")


def _sized(width: int, height: int, limit: int) -> None:
    if width < 1 or height < 1:
        raise CodecError("decode", "a side is zero")
    capped(width, height, limit)


def decode_pnm(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """PBM, PGM and PPM, plain or raw, 8 or 16 bits."""
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise CodecError("decode", "header ends early")
        numbers.append(int(data[at:end]))
        at = end
    width, height, most = (*numbers, 1)[:3]
    _sized(width, height, limit)
    if not 0 < most < 65536 or kind not in range(1, 7):
        raise CodecError("decode", "not a supported PNM")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        digits = [c - 48 for c in b"".join(line.split(b"#")[0] for line in data[at:].split(b"\n")) if c in (48, 49)]
        values = np.array(digits[:n])
    elif kind < 4:
        values = np.array(b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n")).split()[:n], dtype=np.int64)
    elif kind == 4:
        row = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1) if len(data) > at + row * height else np.zeros(0, np.uint8))
        values = bits.reshape(height, -1)[:, :width].ravel() if len(bits) else bits
    else:
        kind_ = ">u2" if most > 255 else "u1"
        values = np.frombuffer(data[at + 1 : at + 1 + n * np.dtype(kind_).itemsize], kind_).astype(np.int64)
    if len(values) < n:
        raise CodecError("decode", "samples end early")
    if kind in (1, 4):
        values = 1 - values.astype(np.int64)
    full = 65535 if most > 255 else 255
    return Image(width, height, "rgb" if channels == 3 else "gray", ((values * full + most // 2) // most).astype(np.uint16 if most > 255 else np.uint8))


def encode_pnm(image: Image) -> bytes:
    if image.color not in ("gray", "rgb") or image.depth == "f32":
        raise CodecError("unsupported", "PNM takes grey or RGB whole samples")
    most = 255 if image.depth == "u8" else 65535
    head = f"P{5 if image.color == 'gray' else 6}\n{image.width} {image.height}\n{most}\n".encode()
    return head + image.samples.astype("u1" if most == 255 else ">u2").tobytes()


PNG = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def png_animated(data: bytes) -> bool:
    """Whether an animation chunk comes before the first samples."""
    for name, _ in _chunks(data):
        if name in (b"acTL", b"IDAT"):
            return name == b"acTL"
    return False


def _unfilter(raw: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """The five line filters, undone."""
    out = np.zeros((rows + 1, line + step), np.uint8)
    for y in range(rows):
        kind, data = raw[y * (line + 1)], raw[y * (line + 1) + 1 : (y + 1) * (line + 1)]
        up, now = out[y, step:], out[y + 1, step:]
        if kind == 0:
            now[:] = data
        elif kind == 2:
            now[:] = data + up
        elif kind == 1:
            now[:] = np.cumsum(data.reshape(-1, step), 0, dtype=np.uint8).ravel() if line % step == 0 else data
        elif kind in (3, 4):
            full, above = out[y + 1], out[y]
            for i in range(line):
                left, over, corner = int(full[i]), int(above[i + step]), int(above[i])
                if kind == 3:
                    guess = (left + over) // 2
                else:
                    p = left + over - corner
                    guess = min((abs(p - left), 0, left), (abs(p - over), 1, over), (abs(p - corner), 2, corner))[2]
                full[i + step] = (int(data[i]) + guess) & 255
        else:
            raise CodecError("decode", f"filter {kind}")
    return out[1:, step:]


#: Fixed values (the PNG specification): first column, first row, column step and row step of each interlacing pass.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _grid(raw: np.ndarray, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples of filtered lines, and the bytes they took."""
    line = -(-width * channels * depth // 8)
    if len(raw) < (line + 1) * height:
        raise CodecError("decode", "samples end early")
    rows = _unfilter(raw, height, line, max(1, channels * depth // 8))
    if depth == 16:
        v = rows.reshape(height, -1).view(">u2").astype(np.uint16).reshape(height, width, channels)
    elif depth == 8:
        v = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        v = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(height, width, 1)
    return v, (line + 1) * height


def decode_png(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """PNG, interlaced or not: all layouts and depths, palettes and their transparency expanded."""
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts[name] = parts.get(name, b"") + body if name == b"IDAT" else body
    if b"IHDR" not in parts or b"IDAT" not in parts:
        raise CodecError("decode", "no header or no samples")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][:13])
    _sized(width, height, limit)
    if interlaced > 1 or kind not in (0, 2, 3, 4, 6):
        raise CodecError("unsupported", "unknown PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8)
    except zlib.error as e:
        raise CodecError("decode", str(e)) from e
    if interlaced:
        v = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
        for x, y, across, down in PASSES:
            if x < width and y < height:
                part, used = _grid(raw, -(-(width - x) // across), -(-(height - y) // down), depth, channels)
                v[y::down, x::across], raw = part, raw[used:]
    else:
        v, _ = _grid(raw, width, height, depth, channels)
    clear = parts.get(b"tRNS")
    if kind == 3:
        table = np.frombuffer(parts.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if v.max() >= len(table):
            raise CodecError("decode", "colour beyond the palette")
        if clear:
            alpha = np.full(len(table), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(table)]
            table = np.concatenate([table, alpha[:, None]], 1)
        v = table[v[:, :, 0]]
    else:
        if clear:
            key = np.frombuffer(clear, ">u2")[:channels]
            gone = (v == key).all(2)
        if depth < 8:
            v = (v * (255 // (2**depth - 1))).astype(np.uint8)
        if clear:
            most = 65535 if depth == 16 else 255
            v = np.concatenate([v, np.where(gone, 0, most).astype(v.dtype)[:, :, None]], 2)
    return Image(width, height, LAYOUTS[v.shape[2]], v)


def _filtered(rows: np.ndarray, step: int) -> bytes:
    """Lines with the filter of least absolute sum for each among none, left and up."""
    left, up = rows.copy(), rows.copy()
    left[:, step:] -= rows[:, :-step]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int32)).sum(2)
    best = cost.argmin(0)
    return np.concatenate([best.astype(np.uint8)[:, None], tried[best, np.arange(len(rows))]], 1).tobytes()


def _png(width: int, height: int, depth: int, kind: int, interlaced: bool, body: bytes, level: int, more: list[tuple[bytes, bytes]] = ()) -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)
    return PNG + b"".join(chunk(*c) for c in [(b"IHDR", head), *more, (b"IDAT", zlib.compress(body, level)), (b"IEND", b"")])


def encode_png(image: Image, level: int = 6, interlaced: bool = False) -> bytes:
    """PNG of 8 or 16 bits; level: zlib's effort."""
    if image.depth == "f32":
        raise CodecError("unsupported", "PNG takes whole samples")
    wide = image.depth == "u16"
    step = CHANNELS[image.color] * (2 if wide else 1)
    v = image.pixels.astype(">u2" if wide else "u1")
    parts = [v[y::down, x::across] for x, y, across, down in PASSES] if interlaced else [v]
    body = b"".join(_filtered(np.frombuffer(p.tobytes(), np.uint8).reshape(len(p), -1), step) for p in parts if p.size)
    return _png(image.width, image.height, 16 if wide else 8, {"gray": 0, "gray_alpha": 4, "rgb": 2, "rgba": 6}[image.color], interlaced, body, level)


def encode_palette_png(colours: np.ndarray, index: np.ndarray, level: int = 6) -> bytes:
    """PNG of at most 256 RGBA colours and an index (height, width) into them, at the least of 1, 2, 4 and 8 bits.

    Colours that aren't opaque come first, so that the table of alphas ends with the last of them.
    """
    if not 1 <= len(colours) <= 256:
        raise CodecError("params", "a palette has 1 to 256 colours")
    order = np.argsort(colours[:, 3] == 255, kind="stable")
    colours, index = colours[order].astype(np.uint8), np.argsort(order)[index].astype(np.uint8)
    depth = next(d for d in (1, 2, 4, 8) if len(colours) <= 1 << d)
    height, width = index.shape
    bits = np.unpackbits(index[:, :, None], axis=2)[:, :, 8 - depth :].reshape(height, -1)
    rows = np.packbits(bits, axis=1)
    clear = int((colours[:, 3] < 255).sum())
    more = [(b"PLTE", colours[:, :3].tobytes()), *([(b"tRNS", colours[:clear, 3].tobytes())] if clear else [])]
    plain = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()  # neighbouring indices aren't near colours
    return _png(width, height, depth, 3, False, plain, level, more)


def decode_bmp(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """Uncompressed BMP of 24 or 32 bits."""
    start, _, width, height, _, bits, packed = struct.unpack("<4xI I i i H H I", data[6:34])
    flipped, height = height > 0, abs(height)
    _sized(width, height, limit)
    if bits not in (24, 32) or packed not in (0, 3):
        raise CodecError("unsupported", f"BMP of {bits} bits")
    line = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + line * height:
        raise CodecError("decode", "samples end early")
    rows = np.frombuffer(data, np.uint8, line * height, start).reshape(height, line)[:, : width * bits // 8].reshape(height, width, -1)
    return Image(width, height, "rgb", (rows[::-1] if flipped else rows)[:, :, 2::-1])


def decode_qoi(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """QOI, by its published specification."""
    width, height, channels = struct.unpack(">IIB", data[4:13])
    _sized(width, height, limit)
    seen, px = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255)
    out: list[tuple[int, int, int, int]] = []
    at, n = 14, width * height
    while len(out) < n:
        if at >= len(data):
            raise CodecError("decode", "samples end early")
        b = data[at]
        at += 1
        r, g, u, a = px
        if b == 0xFE:
            px, at = (*data[at : at + 3], a), at + 3
        elif b == 0xFF:
            px, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = ((r + (b >> 4 & 3) - 2) & 255, (g + (b >> 2 & 3) - 2) & 255, (u + (b & 3) - 2) & 255, a)
        elif b >> 6 == 2:
            d = (b & 63) - 32
            e = data[at]
            at += 1
            px = ((r + d + (e >> 4) - 8) & 255, (g + d) & 255, (u + d + (e & 15) - 8) & 255, a)
        else:
            out.extend([px] * (b & 63))
        if len(px) < 4:
            raise CodecError("decode", "samples end early")
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out.append(px)
    v = np.array(out[:n], np.uint8)
    return Image(width, height, "rgba" if channels == 4 else "rgb", v[:, :channels])


def is_tga(data: bytes) -> bool:
    """The rule of probe.is_tga() on bytes: a signature at the end, or fields that agree and data as long as they say."""
    if len(data) < 18:
        return False
    if data.endswith(b"TRUEVISION-XFILE.\0"):
        return True
    id_size, mapped, kind, _, n_map, map_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    own = (8, 16) if kind in (1, 9, 3, 11) else (15, 16, 24, 32)
    table = n_map > 0 and map_bits in (15, 16, 24, 32) if mapped else n_map == 0
    sane = kind in (1, 2, 3, 9, 10, 11) and bits in own and width and height and flags < 64 and flags % 16 <= 8 and mapped == (kind in (1, 9)) and table
    need = 18 + id_size + mapped * n_map * -(-map_bits // 8) + width * height * -(-bits // 8)
    return bool(sane) and (kind > 8 or len(data) >= need)


def _tga_colours(v: np.ndarray, bits: int, alpha: bool) -> np.ndarray:
    """(n, 1, 3 or 4) samples of n pixels of little-endian bytes: grey, grey and alpha, 5 bits a channel, or 8."""
    if bits in (15, 16):
        word = v[:, 0].astype(np.int64) | v[:, 1].astype(np.int64) << 8
        five = np.stack([word >> s & 31 for s in (10, 5, 0)], 1)
        rgb = (five * 255 + 15) // 31
        return np.concatenate([rgb, (word >> 15)[:, None] * 255], 1).astype(np.uint8) if alpha and bits == 16 else rgb.astype(np.uint8)
    return v[:, [2, 1, 0, 3][: v.shape[1]]]


def decode_tga(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """True-colour, mapped and grey TGA, plain or run-length coded, from either side and end."""
    id_size, mapped, kind, first, n_map, map_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    _sized(width, height, limit)
    if kind not in (1, 2, 3, 9, 10, 11) or bits not in ((8, 16) if kind % 8 in (1, 3) else (15, 16, 24, 32)):
        raise CodecError("unsupported", f"TGA type {kind} of {bits} bits")
    step, at, n = -(-bits // 8), 18 + id_size, width * height
    size = -(-map_bits // 8)
    table = np.frombuffer(data[at : at + n_map * size], np.uint8) if mapped else np.zeros(0, np.uint8)
    at += n_map * size if mapped else 0
    if kind < 8:
        flat = data[at : at + n * step]
    else:
        parts, have = [], 0
        while have < n and at < len(data):
            run = (data[at] & 127) + 1
            if data[at] & 128:
                parts.append(data[at + 1 : at + 1 + step] * run)
                at += 1 + step
            else:
                parts.append(data[at + 1 : at + 1 + step * run])
                at += 1 + step * run
            have += run
        flat = b"".join(parts)[: n * step]
    if len(flat) < n * step:
        raise CodecError("decode", "samples end early")
    v = np.frombuffer(flat, np.uint8).reshape(n, step)
    alpha = flags & 15 > 0
    if kind % 8 == 1:
        if map_bits not in (15, 16, 24, 32) or len(table) < n_map * size:
            raise CodecError("decode", "bad colour map")
        index = v[:, 0].astype(np.int64) - first + (v[:, 1].astype(np.int64) << 8 if step > 1 else 0)
        if index.min() < 0 or index.max() >= n_map:
            raise CodecError("decode", "colour beyond the map")
        v = _tga_colours(table.reshape(-1, size), map_bits, alpha)[index]
    elif kind % 8 == 2:
        v = _tga_colours(v, bits, alpha)
    v = v.reshape(height, width, -1)
    v = v[:, ::-1] if flags & 16 else v
    v = v if flags & 32 else v[::-1]
    return Image(width, height, LAYOUTS[v.shape[2]], v)


def quantise(image: Image, quality: float, least: int = 1) -> Image:
    """The closed-form lossy codec of the tests, on 8-bit samples."""
    step = max(int(np.floor(1 + (100 - quality) / 100 * 63 + 0.5)), least)
    v = image.samples.astype(np.int64)
    return Image(image.width, image.height, image.color, np.minimum(255, (v + step // 2) // step * step).astype(np.uint8))


Sniff = Callable[[bytes], bool]


@dataclass
class Decoder:
    format: str
    probe: Sniff
    decode: Callable[[bytes, int], Image]
    available: Callable[[], str | None] = field(default=lambda: None)  # why not, or None


@dataclass
class Encoder:
    format: str
    name: str
    encode: Callable[[Image], bytes]
    lossy: bool = False
    lossless: bool = True
    alpha: bool = True


@dataclass
class Registry:
    """Decoders are asked in order of registration; of a format's encoders the last counts."""

    decoders: list[Decoder] = field(default_factory=list)
    encoders: list[Encoder] = field(default_factory=list)
    sniffers: list[tuple[str, Sniff]] = field(default_factory=list)

    def probe(self, data: bytes) -> Decoder | None:
        return next((d for d in self.decoders if d.probe(data) and d.available() is None), None)

    def identify(self, data: bytes) -> str | None:
        return next((d.format for d in self.decoders if d.probe(data)), None) or next((f for f, s in self.sniffers if s(data)), None)

    def decode(self, data: bytes, limit: int = MAX_PIXELS) -> tuple[str, Image]:
        reasons = []
        for d in self.decoders:
            if d.probe(data):
                if (why := d.available()) is None:
                    return d.format, d.decode(data, limit)
                reasons.append(why)
        fmt = self.identify(data)
        if fmt:
            raise CodecError("unavailable", "; ".join([f"no decoder for {fmt}", *reasons]))
        raise CodecError("unknown", "not a known format")

    def encoder(self, fmt: str) -> Encoder:
        own = [e for e in self.encoders if e.format == fmt]
        if not own:
            raise CodecError("unavailable", f"no encoder for {fmt}")
        return own[-1]


def standard() -> Registry:
    """What numpy and the standard library can do."""
    r = Registry()
    r.decoders += [
        Decoder("png", lambda b: b.startswith(PNG), decode_png),
        Decoder("bmp", lambda b: b.startswith(b"BM") and len(b) >= 26, decode_bmp),
        Decoder("qoi", lambda b: b.startswith(b"qoif") and len(b) >= 14, decode_qoi),
        Decoder("pnm", lambda b: len(b) > 2 and b[:1] == b"P" and b[1:2] in b"1234567" and (b[2:3].isspace() or b[2:3] == b"#"), decode_pnm),
        Decoder("tga", is_tga, decode_tga),
    ]
    r.encoders += [Encoder("pnm", "pnm", encode_pnm, alpha=False), Encoder("png", "png", encode_png)]
    r.sniffers += [("jpeg", lambda b: b.startswith(b"\xff\xd8\xff")), ("gif", lambda b: b[:6] in (b"GIF87a", b"GIF89a")), ("webp", lambda b: b[:4] == b"RIFF" and b[8:12] == b"WEBP")]
    return r


def decoded(content: Column, registry: Registry | None = None, limit: int = MAX_PIXELS) -> Column:
    """IMAGE of each file; samples are little-endian bytes."""

    def one(data: bytes | None, r: Registry) -> tuple:
        try:
            if data is None:
                raise CodecError("unknown", "no content")
            _, i = r.decode(bytes(data), limit)
            return i.width, i.height, i.color, i.depth, i.samples.tobytes(), None, None
        except CodecError as e:
            return None, None, None, None, None, e.kind, str(e)
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, None, "decode", str(e)

    @F.pandas_udf(IMAGE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = registry or standard()
        for s in parts:
            yield pd.DataFrame([one(x, r) for x in s], columns=["width", "height", "color", "depth", "samples", "error_kind", "error"]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


def encoded(image: Column, fmt: str, registry: Registry | None = None) -> Column:
    """struct<content: binary, error_kind, error: string> of an IMAGE."""

    def one(row: dict, r: Registry) -> tuple:
        try:
            if row["error_kind"] is not None:
                return None, row["error_kind"], row["error"]
            kind = {"u8": "u1", "u16": "<u2", "f32": "<f4"}[row["depth"]]
            i = Image(int(row["width"]), int(row["height"]), row["color"], np.frombuffer(row["samples"], kind))
            return r.encoder(fmt).encode(i), None, None
        except CodecError as e:
            return None, e.kind, str(e)

    @F.pandas_udf("struct<content:binary,error_kind:string,error:string>")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = registry or standard()
        for d in parts:
            yield pd.DataFrame([one(x, r) for x in d.to_dict("records")], columns=["content", "error_kind", "error"])

    return run(image)
