"""Baseline JPEG: full and one-eighth decoding, and encoding."""

from __future__ import annotations

import struct

import numpy as np

from .base import Image, check_size, fail, image, need

# The zigzag order, and the example tables of the standard's Annex K.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)
DC_BITS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_BITS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_LUMA = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71,
    0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72,
    0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37,
    0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
    0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83,
    0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
    0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
    0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
    0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
AC_CHROMA = (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22,
    0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1,
    0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36,
    0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
    0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A,
    0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A,
    0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA,
    0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
    0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)

_k = np.arange(8)
#: Row u, column x: the basis of the 8-point transform.
DCT = (np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)


def codes(bits, values) -> dict[int, tuple[int, int]]:
    """Canonical codes: value to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Table:
    """Of the next 16 bits, the value and length of the code they begin with."""

    def __init__(self, bits, values):
        self.value, self.length = bytearray(65536), bytearray(65536)
        for value, (code, length) in codes(bits, values).items():
            low, n = code << 16 - length, 1 << 16 - length
            if low + n > 65536:
                fail("encoding", "JPEG: Huffman table")
            self.value[low : low + n] = bytes([value]) * n
            self.length[low : low + n] = bytes([length]) * n


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 8:
                fail("truncated", "JPEG: too few bits")
            self.at += 1
            self.hold = (self.hold << 8 | byte) & 0xFFFFFFFFFF
            self.have += 8

    def symbol(self, table: _Table) -> int:
        self.fill(16)
        peek = self.hold >> self.have - 16 & 0xFFFF
        length = table.length[peek]
        if not length:
            fail("encoding", "JPEG: no such code")
        self.have -= length
        return table.value[peek]

    def signed(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        self.have -= n
        v = self.hold >> self.have & (1 << n) - 1
        return v if v >> n - 1 else v - (1 << n) + 1


def size(data: bytes) -> tuple[int, int]:
    """(width, height) from the frame header, (0, 0) if there is none."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xD0 <= mark <= 0xD9 or mark == 1:
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 0, 0


def decode(data: bytes, eighth: bool = False) -> Image:
    """Gray or RGB. ``eighth``: an eighth of the size on each side, from the DC terms alone."""
    need(data, 4)
    if data[:2] != b"\xff\xd8":
        fail("encoding", "JPEG: no signature")
    quant, dc, ac = {}, {}, {}
    frame, interval, at = None, 0, 2
    while True:
        need(data, at + 4)
        if data[at] != 0xFF:
            fail("encoding", "JPEG: no marker")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            fail("truncated", "JPEG: no scan")
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        need(data, at + 2 + n)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                step = 128 if wide else 64
                need(body, 1 + step)
                table = np.zeros(64, np.float32)
                table[list(ZIGZAG)] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quant[which], body = table, body[1 + step :]
        elif mark == 0xC4:
            while body:
                need(body, 17)
                bits, which = body[1:17], body[0]
                values = body[17 : 17 + sum(bits)]
                need(values, sum(bits))
                (ac if which >> 4 else dc)[which & 15], body = _Table(bits, values), body[17 + sum(bits) :]
        elif mark == 0xDD:
            need(body, 2)
            interval = int.from_bytes(body[:2], "big")
        elif mark == 0xC0:
            need(body, 6)
            depth, h, w, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts not in (1, 3):
                fail("unsupported", "JPEG: depth or components")
            check_size(w, h)
            need(body, 6 + 3 * parts)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            if any(not (1 <= c[1] <= 4 and 1 <= c[2] <= 4) for c in frame):
                fail("encoding", "JPEG: sampling")
        elif 0xC1 <= mark <= 0xCF and mark != 0xC8:
            fail("unsupported", "JPEG: not baseline")
        elif mark == 0xDA:
            if frame is None:
                fail("invalid_arg", "JPEG: a scan before the frame")
            need(body, 1)
            if body[0] != len(frame):
                fail("unsupported", "JPEG: more than one scan")
            need(body, 1 + 2 * len(frame))
            picked = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    segments, start, i = [], at, at
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            segments.append(data[start:])
            break
        if data[i + 1] == 0:
            i += 2
        elif 0xD0 <= data[i + 1] <= 0xD7:
            segments.append(data[start:i])
            start = i = i + 2
        elif data[i + 1] == 0xFF:
            i += 1
        else:
            segments.append(data[start:i])
            break
    most_h, most_v = max(c[1] for c in frame), max(c[2] for c in frame)
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        most_h = most_v = 1
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    try:
        plan = [(c, dc[picked[c[0]] >> 4], ac[picked[c[0]] & 15], quant[c[3]]) for c in frame]
    except KeyError:
        fail("encoding", "JPEG: a table is missing")
    planes = [np.zeros((down * c[2], across * c[1], 64), np.int32) for c in frame]
    bits, last, segment = _Bits(segments[0].replace(b"\xff\x00", b"\xff")), [0] * len(frame), 0
    for mcu in range(across * down):
        if interval and mcu and mcu % interval == 0:
            segment += 1
            if segment >= len(segments):
                fail("truncated", "JPEG: a restart is missing")
            bits, last = _Bits(segments[segment].replace(b"\xff\x00", b"\xff")), [0] * len(frame)
        row, column = divmod(mcu, across)
        for k, ((_, ch, cv, _), dc_table, ac_table, _) in enumerate(plan):
            for v in range(cv):
                for u in range(ch):
                    block = planes[k][row * cv + v, column * ch + u]
                    last[k] += bits.signed(bits.symbol(dc_table))
                    block[0] = last[k]
                    z = 1
                    while z < 64:
                        symbol = bits.symbol(ac_table)
                        run, width = symbol >> 4, symbol & 15
                        if not width:
                            if run != 15:
                                break
                            z += 16
                            continue
                        z += run
                        if z > 63:
                            fail("encoding", "JPEG: a run past the block")
                        block[ZIGZAG[z]] = bits.signed(width)
                        z += 1
    if bits.at - bits.have // 8 > len(bits.data) + 2:
        fail("truncated", "JPEG: too few bits")
    out_w, out_h = (-(-w // 8), -(-h // 8)) if eighth else (w, h)
    full = []
    for plane, (c, _, _, q) in zip(planes, plan, strict=True):
        if eighth:
            samples = plane[:, :, 0] * (q[0] / 8)
        else:
            blocks = (plane * q).reshape(*plane.shape[:2], 8, 8).astype(np.float32)
            samples = (DCT.T @ blocks @ DCT).transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, -1)
        y, x = np.arange(out_h) * c[2] // most_v, np.arange(out_w) * c[1] // most_h
        full.append(samples[y][:, x] + np.float32(128))
    if len(full) == 1:
        return image(np.clip(np.floor(full[0] + 0.5), 0, 255).astype(np.uint8), "gray")
    lum, cb, cr = full[0], full[1] - 128, full[2] - 128
    rgb = np.stack([lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb], axis=-1)
    return image(np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8), "rgb")


def decode_scaled(data: bytes, max_edge: int) -> tuple[Image, int, int]:
    """(image, source width, source height): an eighth where both sides stay at ``max_edge`` or more."""
    if max_edge < 1:
        fail("invalid_arg", "max_edge: at least 1")
    w, h = size(data)
    return decode(data, bool(w) and -(-w // 8) >= max_edge and -(-h // 8) >= max_edge), w, h


def _quant(table, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def encode(img: Image, quality: int = 90) -> bytes:
    """Gray or RGB without subsampling; quality 1 to 100."""
    if img.colorspace not in ("gray", "rgb"):
        fail("unsupported", "JPEG: gray or RGB")
    if not 1 <= quality <= 100:
        fail("invalid_arg", "JPEG: quality from 1 to 100")
    h, w = img.height, img.width
    if w > 65535 or h > 65535:
        fail("encoding", "JPEG: over 65535 pixels wide or high")
    pixels = np.pad(img.data, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float32)
    if img.channels == 1:
        planes = [pixels[:, :, 0] - 128]
    else:
        r, g, b = pixels.transpose(2, 0, 1)
        planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    tables = [_quant(LUMA, quality), _quant(CHROMA, quality)][: 2 if len(planes) > 1 else 1]
    ac_values = [AC_LUMA, AC_CHROMA]
    huffman = [(codes(DC_BITS[i], range(12)), codes(AC_BITS[i], ac_values[i])) for i in range(2)]
    levels = []
    for k, plane in enumerate(planes):
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        scaled = (DCT @ blocks @ DCT.T).reshape(-1, 64) / tables[min(k, 1)].astype(np.float32)
        levels.append((np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(int)[:, list(ZIGZAG)].tolist())
    out, hold, have = bytearray(), 0, 0

    def put(value: int, n: int) -> None:
        nonlocal hold, have
        hold, have = hold << n | value, have + n
        while have >= 8:
            byte = hold >> have - 8 & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            have -= 8
            hold &= (1 << have) - 1

    def put_level(v: int, n: int) -> None:
        if n:
            put(v if v > 0 else v + (1 << n) - 1, n)

    last = [0] * len(planes)
    for i in range(len(levels[0])):
        for k, plane in enumerate(levels):
            dc_codes, ac_codes = huffman[min(k, 1)]
            block = plane[i]
            step = block[0] - last[k]
            last[k] = block[0]
            n = abs(step).bit_length()
            put(*dc_codes[n])
            put_level(step, n)
            run = 0
            for v in block[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(*ac_codes[0xF0])
                    run -= 16
                n = abs(v).bit_length()
                put(*ac_codes[run << 4 | n])
                put_level(v, n)
                run = 0
            if run:
                put(*ac_codes[0])
    if have:
        put((1 << 8 - have) - 1, 8 - have)
    segment = lambda mark, body: b"\xff" + bytes([mark]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i, table in enumerate(tables):
        head += segment(0xDB, bytes([i]) + bytes(table[list(ZIGZAG)].tolist()))
    n = len(planes)
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n)))
    for i in range(len(tables)):
        head += segment(0xC4, bytes([i]) + bytes(DC_BITS[i]) + bytes(range(12))) + segment(0xC4, bytes([0x10 | i]) + bytes(AC_BITS[i]) + bytes(ac_values[i]))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(n)) + b"\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"
