"""Lossless WebP (VP8L), alone or in VP8X, with raw or VP8L alpha."""

from __future__ import annotations

import numpy as np

from .base import Image, fail, image, need

# Fixed value: the order in which code lengths of the length code are stored.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _near() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: pixels above and left, nearest first.

    Of equally near ones the less far sideways comes first, and left before right.
    """
    spots = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return sorted(spots, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.most = data, 0, len(data) * 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        a = self.at >> 3
        word = int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.most:
            fail("truncated", "WebP: too few bits")
        return word & (1 << n) - 1

    def peek16(self) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 4], "little") >> (self.at & 7) & 0xFFFF


class _Code:
    """A prefix code: of the next bits, lowest first, the symbol."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        self.table: dict[tuple[int, int], int] = {}
        self.most = max(lengths, default=0)
        if self.only is None:
            code, left = 0, 1 << 15
            for n in range(1, self.most + 1):
                code <<= 1
                for s in used:
                    if lengths[s] == n:
                        self.table[n, int(f"{code:0{n}b}"[::-1], 2)] = s
                        code += 1
                        left -= 1 << 15 - n
            if left:
                fail("encoding", "WebP: an incomplete code")

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        word = bits.peek16()
        for n in range(1, self.most + 1):
            s = self.table.get((n, word & (1 << n) - 1))
            if s is not None:
                bits.read(n)
                return s
        fail("encoding", "WebP: no such code")


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s < alphabet:
                lengths[s] = 1
        return _Code(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[_LENGTH_ORDER[i]] = bits.read(3)
    code = _Code(first)
    most = alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < alphabet and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            last = n or last
            at += 1
            continue
        value, count = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + count > alphabet:
            fail("encoding", "WebP: too many code lengths")
        lengths[at : at + count] = [value] * count
        at += count
    return _Code(lengths)


def _amount(symbol: int, bits: _Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def _pixels(bits: _Bits, w: int, h: int, main: bool) -> list[int]:
    """``w * h`` ARGB values of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        fail("encoding", "WebP: colour cache")
    groups, tile, tiles_across = 1, 0, 0
    which = None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles_across = (w + (1 << tile) - 1) >> tile
        which = [p >> 8 & 0xFFFF for p in _pixels(bits, tiles_across, (h + (1 << tile) - 1) >> tile, False)]
        groups = max(which) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    all_codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else []
    near = _near()
    out: list[int] = []
    total = w * h
    cached = 0
    slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache_bits
    while len(out) < total:
        i = len(out)
        green, red, blue, alpha, distance = all_codes[which[(i // w >> tile) * tiles_across + (i % w >> tile)] if which else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = _amount(s - 256, bits)
            d = _amount(distance.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = near[d - 1]
                d = max(1, dx + dy * w)
            if d > i or length > total - i:
                fail("encoding", "WebP: a copy from outside")
            for _ in range(length):
                out.append(out[-d])
        else:
            while cached < i:
                cache[slot(out[cached])] = out[cached]
                cached += 1
            if s - 280 >= len(cache):
                fail("encoding", "WebP: outside the colour cache")
            out.append(cache[s - 280])
    return out


def _average(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _clamped(a: int, b: int, c: int, half: bool) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        x, y, z = a >> k & 255, b >> k & 255, c >> k & 255
        if half:
            v = (x + y) // 2
            d = v - z
            v += (abs(d) // 2) * (1 if d > 0 else -1)
        else:
            v = x + y - z
        out |= min(255, max(0, v)) << k
    return out


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for k in (0, 8, 16, 24):
        x, y, z = left >> k & 255, top >> k & 255, corner >> k & 255
        to_left += abs(y - z)
        to_top += abs(x - z)
    return left if to_left < to_top else top


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    return _clamped(left, top, corner, False) if mode == 12 else _clamped(_average(left, top), _average(left, top), corner, True)


def vp8l(data: bytes) -> np.ndarray:
    """Rows of RGBA of a VP8L payload."""
    need(data, 5)
    if data[0] != 0x2F:
        fail("encoding", "WebP: no VP8L signature")
    bits = _Bits(data[1:])
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        fail("unsupported", "WebP: version")
    return _image(bits, w, h)


def _image(bits: _Bits, w: int, h: int) -> np.ndarray:
    transforms, seen, coded_w = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            fail("encoding", "WebP: a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            tw = (coded_w + (1 << size) - 1) >> size
            transforms.append((kind, coded_w, size, tw, _pixels(bits, tw, (h + (1 << size) - 1) >> size, False)))
        elif kind == 2:
            transforms.append((kind, coded_w, 0, 0, None))
        else:
            n = bits.read(8) + 1
            table = _pixels(bits, n, 1, False)
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, coded_w, pack, 0, table))
            coded_w = (coded_w + (1 << pack) - 1) >> pack
    out = _pixels(bits, coded_w, h, True)
    for kind, tw_pixels, size, tiles, table in reversed(transforms):
        if kind == 2:
            a = np.array(out, np.uint32)
            green = a >> 8 & 255
            out = (a & 0xFF00FF00 | ((a >> 16 & 255) + green & 255) << 16 | (a & 255) + green & 255).tolist()
        elif kind == 1:
            a = np.array(out, np.int64).reshape(h, tw_pixels)
            part = np.array(table, np.int64).reshape(-1, tiles)
            part = np.repeat(np.repeat(part, 1 << size, 0)[:h], 1 << size, 1)[:, :tw_pixels]
            signed = lambda v: (v & 255) - ((v & 128) << 1)
            green = signed(a >> 8)
            red = (a >> 16 & 255) + (signed(part) * green >> 5) & 255
            blue = (a & 255) + (signed(part >> 8) * green >> 5) + (signed(part >> 16) * signed(red) >> 5) & 255
            out = (a & 0xFF00FF00 | red << 16 | blue).reshape(-1).tolist()
        elif kind == 0:
            width = tw_pixels
            for i in range(len(out)):
                y, x = divmod(i, width)
                if not y:
                    guess = out[i - 1] if x else 0xFF000000
                elif not x:
                    guess = out[i - width]
                else:
                    mode = table[(y >> size) * tiles + (x >> size)] >> 8 & 15
                    guess = _predict(mode, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
                out[i] = _add(out[i], guess)
        else:
            packed_w = (tw_pixels + (1 << size) - 1) >> size
            rows = (np.array(out, np.int64).reshape(h, packed_w) >> 8) & 255
            per = 1 << size
            if per > 1:
                width = 8 >> size
                rows = (rows[:, :, None] >> np.arange(per) * width & (1 << width) - 1).reshape(h, -1)[:, :tw_pixels]
            colours = np.zeros(256, np.int64)
            colours[: len(table)] = table
            out = colours[rows].reshape(-1).tolist()
    a = np.array(out, np.uint32).reshape(h, w)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], axis=-1).astype(np.uint8)


def chunks(data: bytes):
    """(four characters, body) of a RIFF file."""
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > len(data):
            fail("truncated", "WebP: a chunk runs past the end")
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def decode(data: bytes) -> Image:
    """RGB, or RGBA where the file says that it has alpha."""
    need(data, 20)
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        fail("encoding", "WebP: no signature")
    canvas = alpha = None
    has_alpha = False
    for kind, body in chunks(data):
        if kind == b"VP8X":
            need(body, 10)
            if body[0] & 2:
                fail("unsupported", "WebP: animation")
            has_alpha = bool(body[0] & 16)
            canvas = (int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1)
            if max(canvas) > 16384:
                fail("invalid_arg", "WebP: canvas")
        elif kind == b"ALPH":
            alpha = body
        elif kind == b"VP8 ":
            fail("unsupported", "WebP: lossy")
        elif kind == b"VP8L":
            need(body, 5)
            pixels = vp8l(body)
            if canvas and canvas != (pixels.shape[1], pixels.shape[0]):
                fail("encoding", "WebP: the canvas has another size")
            if alpha is not None:
                pixels = pixels.copy()
                pixels[:, :, 3] = _alpha_plane(alpha, *pixels.shape[:2])
                has_alpha = True
            has_alpha |= bool(body[4] & 16)
            return image(pixels if has_alpha else pixels[:, :, :3], "rgba" if has_alpha else "rgb")
    fail("encoding", "WebP: no image")


def _alpha_plane(body: bytes, h: int, w: int) -> np.ndarray:
    need(body, 1)
    if body[0] >> 2 & 3:
        fail("unsupported", "WebP: filtered alpha")
    if body[0] & 3 == 0:
        need(body, 1 + w * h)
        return np.frombuffer(body, np.uint8, w * h, 1).reshape(h, w)
    if body[0] & 3 == 1:
        return _image(_Bits(body[1:]), w, h)[:, :, 1]
    fail("unsupported", "WebP: alpha compression")
