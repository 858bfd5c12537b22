"""GIF: the first frame, as RGBA."""

from __future__ import annotations

import struct

import numpy as np

from .base import Image, check_size, fail, image, need, rgba


def lzw(data: bytes, bits: int, size: int) -> bytes:
    """``size`` bytes of a GIF's LZW stream of codes from ``bits`` + 1 to 12 bits."""
    clear, end = 1 << bits, (1 << bits) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, hold, have, last = bits + 1, 0, 0, None
    out = bytearray()
    for byte in data:
        hold |= byte << have
        have += 8
        while have >= width:
            code = hold & (1 << width) - 1
            hold >>= width
            have -= width
            if code == clear:
                del table[end + 1 :]
                width, last = bits + 1, None
                continue
            if code == end:
                return bytes(out[:size])
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last is not None:
                entry = last + last[:1]
            else:
                fail("encoding", "GIF: a code ahead of its table")
            out += entry
            if len(out) >= size:
                return bytes(out[:size])
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def decode(data: bytes) -> Image:
    need(data, 13)
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        fail("encoding", "GIF: no signature")
    flags, at = data[10], 13

    def table(flags: int, at: int):
        if not flags & 128:
            return None, at
        n = 3 << (flags & 7) + 1
        need(data, at + n)
        return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            need(data, at + 1)
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            need(data, at + 1 + n)
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    common, at = table(flags, at)
    clear = -1
    while True:
        need(data, at + 1)
        mark = data[at]
        if mark == 0x21:
            need(data, at + 2)
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                clear = body[3] if body[0] & 1 else -1
        elif mark == 0x2C:
            break
        else:
            fail("encoding", "GIF: no image")
    need(data, at + 11)
    w, h, flags = struct.unpack_from("<HHB", data, at + 5)
    check_size(w, h)
    palette, at = table(flags, at + 10)
    palette = common if palette is None else palette
    if palette is None:
        fail("encoding", "GIF: no palette")
    need(data, at + 1)
    bits = data[at]
    if not 2 <= bits <= 8:
        fail("encoding", "GIF: code size")
    body, _ = blocks(at + 1)
    index = lzw(body, bits, w * h)
    if len(index) < w * h:
        fail("truncated", "GIF: too few pixels")
    rows = np.frombuffer(index, np.uint8).reshape(h, w)
    if rows.max(initial=0) >= len(palette):
        fail("encoding", "GIF: a colour outside the palette")
    if flags & 64:
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
        straight = np.empty_like(rows)
        straight[order] = rows
        rows = straight
    colours = rgba(palette)
    if 0 <= clear < len(colours):
        colours[clear, 3] = 0
    return image(colours[rows], "rgba")
