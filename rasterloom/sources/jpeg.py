"""JPEG with Huffman codes: transforms and bit packing in numpy, reading codes one by one.

Written: 8-bit gray and RGB, 4:4:4 or 4:2:0, sequential, with Huffman tables made for the image.
Read: what is written, other sampling factors, restarts, several scans, progressive files.
Arithmetic, lossless, 12-bit and four-channel files are told as unsupported.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np

from rasterloom.sources.codecs import MAX_PIXELS, CodecError, Image, capped

#: Fixed values (ITU-T T.81, annex K): quantisation steps of luma and chroma at quality 50.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_CORNER = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
#: The order of coefficients: along diagonals, back and forth.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_DCT = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Fixed values (JFIF): luma's and the colour differences' shares of red, green and blue.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
_ENTROPY_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def steps(quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Quantisation steps of luma and chroma, row by row, for a quality of 1 to 100."""
    q = min(100.0, max(1.0, quality))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = CHROMA_CORNER
    return tuple(np.clip((np.asarray(t).reshape(64) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (LUMA, chroma))


def _tiles(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def _grown(plane: np.ndarray, unit: int) -> np.ndarray:
    h, w = plane.shape
    return np.pad(plane, ((0, -h % unit), (0, -w % unit)), mode="edge")


def code_lengths(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, symbol) of a prefix code by length, none over 16 bits and none all ones."""
    # the dummy symbol is the rarest, so it gets the longest code, the one of ones alone
    heap = [(n, -1 - s, (s,)) for s, n in counts.items()] + [(0, -1 << 20, (-1,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    while len(heap) > 1:
        n, k, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, k, a + b))
    number = [0] * (max(64, *depth.values()) + 2)
    for d in depth.values():
        number[d] += 1
    for d in range(len(number) - 1, 16, -1):  # pairs of too long codes: one takes their parent, the other halves a shorter code
        while number[d]:
            j = d - 2
            while not number[j]:
                j -= 1
            number[d] -= 2
            number[d - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    sizes = [d for d, n in enumerate(number) for _ in range(n)][: len(counts)]
    return list(zip(sizes, sorted(counts, key=lambda s: (-counts[s], s)), strict=True))


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(code, length) by symbol: consecutive codes by length."""
    out, code, before = {}, 0, 0
    for size, s in lengths:
        code <<= size - before
        out[s] = (code, size)
        code, before = code + 1, size
    return out


def _bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1] * (v != 0)


def _tokens(coefficients: np.ndarray, chroma: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
    """Table (0, 1: DC; 2, 3: AC), symbol, extra bits and their number of each code, in the order of the scan."""
    n = len(coefficients)
    dc = np.empty(n, np.int64)
    for c in np.unique(component):
        own = component == c
        dc[own] = np.diff(coefficients[own, 0], prepend=0)
    block, k = np.nonzero(coefficients[:, 1:])
    k += 1
    value = coefficients[block, k]
    first = np.diff(block, prepend=-1) != 0
    run = k - np.where(first, 0, np.roll(k, 1)) - 1
    long = np.repeat(np.arange(len(k)), run // 16)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    ends = np.flatnonzero(last < 63)
    size = _bit_size(value)
    parts = [  # block, place, table, symbol, value, bits
        (np.arange(n), np.zeros(n, np.int64), chroma * 1, _bit_size(dc), dc, _bit_size(dc)),
        (block[long], 2 * k[long], 2 + chroma[block[long]], np.full(len(long), 0xF0), 0 * long, 0 * long),
        (block, 2 * k + 1, 2 + chroma[block], run % 16 * 16 + size, value, size),
        (ends, np.full(len(ends), 200), 2 + chroma[ends], 0 * ends, 0 * ends, 0 * ends),
    ]
    where, place, table, symbol, value, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, where))
    extra = np.where(value < 0, value + (1 << bits) - 1, value)
    return tuple(x[order] for x in (table, symbol, extra, bits))


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Numbers of size bits each, one after another, filled with ones and with a zero after each byte of ones."""
    total = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(size)), size)
    shift = np.repeat(total[1:], size) - np.arange(total[-1]) - 1
    bits = ((value[of] >> shift) & 1).astype(np.uint8)
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_jpeg(image: Image, quality: float = 75.0, halved: bool = False) -> bytes:
    """halved: colour differences at half the size both ways (4:2:0)."""
    if image.depth != "u8" or image.color not in ("gray", "rgb"):
        raise CodecError("unsupported", "JPEG takes 8-bit gray or RGB samples")
    if max(image.width, image.height) > 65535:
        raise CodecError("unsupported", "JPEG sides are 65535 at most")
    gray = image.color == "gray"
    halved = halved and not gray
    v = image.pixels.astype(np.float64)
    planes = [v[:, :, 0] - 128] if gray else list(np.moveaxis(v @ TO_YCC.T, 2, 0) - np.array([128, 0, 0])[:, None, None])
    planes = [_grown(p, 16 if halved else 8) for p in planes]
    if halved:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)) for p in planes[1:]]
    tables = steps(quality)
    blocks, component = [], []
    for c, p in enumerate(planes):
        t = _DCT @ _tiles(p) @ _DCT.T
        t = np.round(t.reshape(*t.shape[:2], 64) / tables[c > 0]).astype(np.int64)[:, :, ZIGZAG]
        side = 2 if halved and c == 0 else 1
        r, w = t.shape[:2]
        blocks.append(t.reshape(r // side, side, w // side, side, 64).swapaxes(1, 2).reshape(-1, side * side, 64))  # by unit of the scan
        component += [c] * (side * side)
    flat = np.concatenate(blocks, 1)
    component = np.tile(component, len(flat))
    table, symbol, extra, bits = _tokens(flat.reshape(-1, 64), (component > 0).astype(np.int64), component)
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for c in range(1 if gray else 2):
        out += _segment(0xDB, bytes([c]) + bytes(tables[c][ZIGZAG].tolist()))
    sampling = [0x22 if halved and c == 0 else 0x11 for c in range(len(planes))]
    out += _segment(0xC0, struct.pack(">BHHB", 8, image.height, image.width, len(planes)) + b"".join(bytes([c + 1, s, int(c > 0)]) for c, s in enumerate(sampling)))
    value, size = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    for t in range(4):
        own = table == t
        if not own.any():
            continue
        names, counts = np.unique(symbol[own], return_counts=True)
        lengths = code_lengths(dict(zip(names.tolist(), counts.tolist(), strict=True)))
        code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s, (c, n) in _codes(lengths).items():
            code[s], length[s] = c, n
        value[own], size[own] = code[symbol[own]] << bits[own] | extra[own], length[symbol[own]] + bits[own]
        number = [sum(n == i for n, _ in lengths) for i in range(1, 17)]
        out += _segment(0xC4, bytes([t // 2 * 16 + t % 2, *number, *(s for _, s in lengths)]))
    out += _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in range(len(planes))) + b"\0\x3f\0")
    return out + _packed(value, size) + b"\xff\xd9"


@dataclass
class _Component:
    name: int
    across: int
    down: int
    table: int
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole units


def _lookup(number: bytes, symbols: bytes) -> list[int]:
    """Length * 256 + symbol by the next 16 bits; 0 where no code fits."""
    lengths = [(i + 1, None) for i, n in enumerate(number) for _ in range(n)]
    if len(symbols) < len(lengths):
        raise CodecError("decode", "a Huffman table ends early")
    out = np.zeros(1 << 16, np.int64)
    code, before = 0, 0
    for (size, _), s in zip(lengths, symbols, strict=False):
        code <<= size - before
        at = code << (16 - size)
        if at + (1 << (16 - size)) > 1 << 16:
            raise CodecError("decode", "a Huffman table has too many codes")
        out[at : at + (1 << (16 - size))] = size * 256 + s
        code, before = code + 1, size
    return out.tolist()


def _read(data: bytes, order: list[tuple[int, np.ndarray]], tables: list[tuple[list[int], list[int]]]) -> None:
    """Reads blocks from one run of codes into their coefficient arrays."""
    acc = have = at = 0
    past = len(data) + 16
    before = [0] * len(tables)
    for c, block in order:
        dc, ac = tables[c]
        k = 0
        while k < 64:
            while have < 32:
                part = data[at : at + 4]
                acc = (acc & ((1 << have) - 1)) << 32 | int.from_bytes(part + b"\xff" * (4 - len(part)))
                at, have = at + 4, have + 32
                if at > past:
                    raise CodecError("decode", "samples end early")
            entry = (dc if k == 0 else ac)[acc >> (have - 16) & 0xFFFF]
            if not entry:
                raise CodecError("decode", "a code that no table has")
            have -= entry >> 8
            symbol = entry & 0xFF
            run, size = (0, symbol) if k == 0 else (symbol >> 4, symbol & 15)
            if size > 15:
                raise CodecError("decode", "a number of too many bits")
            value = 0
            if size:
                have -= size
                value = acc >> have & ((1 << size) - 1)
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
            if k == 0:
                before[c] += value
                block[0] = before[c]
                k = 1
            elif size:
                k += run
                if k > 63:
                    raise CodecError("decode", "a coefficient beyond its block")
                block[k] = value
                k += 1
            elif run == 15:
                k += 16
            else:
                break


class _Bits:
    """Bits of one run of codes, ones behind its end."""

    def __init__(self, data: bytes):
        self.data, self.acc, self.have, self.at = data, 0, 0, 0

    def _fill(self) -> None:
        if self.at > len(self.data) + 16:
            raise CodecError("decode", "samples end early")
        part = self.data[self.at : self.at + 4]
        self.acc = (self.acc & ((1 << self.have) - 1)) << 32 | int.from_bytes(part + b"\xff" * (4 - len(part)))
        self.at, self.have = self.at + 4, self.have + 32

    def take(self, n: int) -> int:
        if self.have < n:
            self._fill()
        self.have -= n
        return self.acc >> self.have & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.have < 16:
            self._fill()
        entry = table[self.acc >> (self.have - 16) & 0xFFFF]
        if not entry:
            raise CodecError("decode", "a code that no table has")
        self.have -= entry >> 8
        return entry & 0xFF

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v


def _read_means(bits: _Bits, order: list[tuple[int, np.ndarray]], tables: list, low: int, again: bool) -> None:
    """A progressive scan of first coefficients: their high bits, or (again) one bit more of each."""
    before = [0] * len(tables)
    for c, block in order:
        if again:
            block[0] |= bits.take(1) << low
            continue
        size = bits.symbol(tables[c])
        if size > 15:
            raise CodecError("decode", "a number of too many bits")
        before[c] += bits.signed(size)
        block[0] = before[c] << low


def _read_band(bits: _Bits, order: list[tuple[int, np.ndarray]], table: list[int], first: int, last: int, low: int) -> None:
    """A progressive scan that gives the high bits of one component's coefficients first to last."""
    empty = 0
    for _, block in order:
        if empty:
            empty -= 1
            continue
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if not size and run < 15:
                empty = (1 << run) - 1 + bits.take(run)
                break
            k += run
            if size:
                if k > last:
                    raise CodecError("decode", "a coefficient beyond its band")
                block[k] = bits.signed(size) << low
            k += 1


def _refine_band(bits: _Bits, order: list[tuple[int, np.ndarray]], table: list[int], first: int, last: int, low: int) -> None:
    """A progressive scan that gives one bit more: of known coefficients where they are passed, and new ones of that size."""
    empty, one = 0, 1 << low
    for _, block in order:
        known = block[first : last + 1].tolist()
        k, n = 0, len(known)
        new: dict[int, int] = {}

        def passed(k: int) -> None:
            if bits.take(1):
                new[k] = known[k] + (one if known[k] > 0 else -one)  # noqa: B023

        while k < n and not empty:
            run, size = divmod(bits.symbol(table), 16)
            if size > 1:
                raise CodecError("decode", "a new coefficient of more than a bit")
            if not size and run < 15:
                empty = (1 << run) + bits.take(run)
                break
            value = (one if bits.take(1) else -one) if size else 0
            while k < n and (known[k] or run):
                if known[k]:
                    passed(k)
                else:
                    run -= 1
                k += 1
            if value:
                if k >= n:
                    raise CodecError("decode", "a coefficient beyond its band")
                new[k] = value
            k += 1
        if empty:
            for j in range(k, n):
                if known[j]:
                    passed(j)
            empty -= 1
        for j, v in new.items():
            block[first + j] = v


class _File:
    def __init__(self, data: bytes, limit: int):
        self.data, self.limit = data, limit
        self.steps: dict[int, np.ndarray] = {}
        self.codes: dict[int, list[int]] = {}
        self.components: list[_Component] = []
        self.restart = 0
        self.transform: int | None = None
        self.progressive = False

    def decode(self) -> Image:
        at, data = 2, self.data
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9":
                raise CodecError("decode", "the file ends early")
            if data[at] != 0xFF:
                raise CodecError("decode", "no marker where one must be")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDA:
                at = self.scan(body, at)
            else:
                self.segment(marker, body)
        return self.image()

    def segment(self, marker: int, body: bytes) -> None:
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                step = np.full(64, 0, np.int64)
                step[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                self.steps[n] = step
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                self.codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            self.restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            self.transform = body[11]
        elif marker in (0xC0, 0xC1, 0xC2):
            self.progressive = marker == 0xC2
            self.frame(body)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise CodecError("unsupported", "only sequential and progressive JPEG with Huffman codes is read")

    def frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3):
            raise CodecError("unsupported", f"{depth}-bit JPEG with {n} components")
        if not self.width or not self.height or self.components:
            raise CodecError("decode", "a side is zero, or a second frame")
        capped(self.width, self.height, self.limit)
        for i in range(n):
            name, s, t = body[6 + 3 * i : 9 + 3 * i]
            if not 1 <= s >> 4 <= 4 or not 1 <= s & 15 <= 4:
                raise CodecError("decode", "bad sampling factors")
            self.components.append(_Component(name, s >> 4, s & 15, t))
        if n == 1:
            self.components[0].across = self.components[0].down = 1
        self.most_across, self.most_down = (max(getattr(c, k) for c in self.components) for k in ("across", "down"))
        self.units = -(-self.height // (8 * self.most_down)), -(-self.width // (8 * self.most_across))
        for c in self.components:
            c.coefficients = np.zeros((self.units[0] * c.down, self.units[1] * c.across, 64), np.int32)

    def scan(self, body: bytes, at: int) -> int:
        by = {c.name: c for c in self.components}
        told = [(by.get(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
        if not told or any(c is None for c, _ in told):
            raise CodecError("decode", "a scan of unknown components")
        first, last, high, low = *body[1 + 2 * body[0] : 3 + 2 * body[0]], *divmod(body[3 + 2 * body[0]], 16)
        means, bands = not self.progressive or first == 0 and not high, not self.progressive or first > 0
        if self.progressive and first == 0 < last:
            raise CodecError("unsupported", "a progressive scan of first coefficients and others")
        if self.progressive and (first > last or last > 63 or low > 13 or (first and len(told) > 1)):
            raise CodecError("decode", "a scan of no possible band")
        try:
            tables = [(self.codes[t >> 4] if means else None, self.codes[16 + (t & 15)] if bands else None) for _, t in told]
        except KeyError:
            raise CodecError("decode", "a scan without its Huffman tables") from None
        if len(told) == 1:
            c = told[0][0]
            rows, columns = (-(-(-(-side * own // most)) // 8) for side, own, most in ((self.height, c.down, self.most_down), (self.width, c.across, self.most_across)))
            units = [[(0, c.coefficients[y, x])] for y in range(rows) for x in range(columns)]
        else:
            units = [
                [(i, c.coefficients[y * c.down + v, x * c.across + h]) for i, (c, _) in enumerate(told) for v in range(c.down) for h in range(c.across)]
                for y in range(self.units[0]) for x in range(self.units[1])
            ]
        end = _ENTROPY_END.search(self.data, at)
        stop = end.start() if end else len(self.data)
        runs = _RESTART.split(self.data[at:stop])
        each = self.restart or len(units)
        if len(runs) < -(-len(units) // each):
            raise CodecError("decode", "samples end early")
        for i in range(0, len(units), each):
            run, order = runs[i // each].replace(b"\xff\x00", b"\xff"), [b for u in units[i : i + each] for b in u]
            if not self.progressive:
                _read(run, order, tables)
            elif first == 0:
                _read_means(_Bits(run), order, [t for t, _ in tables], low, high > 0)
            else:
                (_refine_band if high else _read_band)(_Bits(run), order, tables[0][1], first, last, low)
        return stop

    def image(self) -> Image:
        if not self.components:
            raise CodecError("decode", "no frame")
        planes = []
        for c in self.components:
            if c.table not in self.steps:
                raise CodecError("decode", "no quantisation table")
            rows = np.zeros(c.coefficients.shape, np.float64)
            rows[:, :, ZIGZAG] = c.coefficients
            t = _DCT.T @ (rows * self.steps[c.table]).reshape(*rows.shape[:2], 8, 8) @ _DCT + 128
            plane = t.swapaxes(1, 2).reshape(8 * rows.shape[0], 8 * rows.shape[1])
            down, across = (np.arange(n) * own // most for n, own, most in ((self.height, c.down, self.most_down), (self.width, c.across, self.most_across)))
            planes.append(np.clip(np.round(plane), 0, 255)[down[:, None], across])
        v = np.stack(planes, 2)
        if len(planes) == 1:
            return Image(self.width, self.height, "gray", v.astype(np.uint8))
        if self.transform != 0 and [c.name for c in self.components] != [*b"RGB"]:
            v = (v - np.array([0, 128, 128])) @ np.linalg.inv(TO_YCC).T
        return Image(self.width, self.height, "rgb", np.clip(np.round(v), 0, 255).astype(np.uint8))


def decode_jpeg(data: bytes, limit: int = MAX_PIXELS) -> Image:
    """Samples of colour differences are repeated to full size."""
    if not data.startswith(b"\xff\xd8\xff"):
        raise CodecError("decode", "not a JPEG")
    try:
        return _File(data, limit).decode()
    except (IndexError, struct.error, ValueError) as e:
        raise CodecError("decode", f"the file ends early: {e}") from None
