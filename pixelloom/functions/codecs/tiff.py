"""TIFF: the first directory, in strips or tiles."""

from __future__ import annotations

import zlib

import numpy as np

from .base import Image, check_size, fail, image, need, rgba, unpack_bits

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def directory(data: bytes) -> tuple[str, dict[int, list[int]]]:
    """(byte order, tag to integer values) of the first directory."""
    need(data, 8)
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or int.from_bytes(data[2:4], order) != 42:
        fail("encoding", "TIFF: no signature")
    at = int.from_bytes(data[4:8], order)
    need(data, at + 2)
    tags = {}
    count = int.from_bytes(data[at : at + 2], order)
    need(data, at + 2 + 12 * count)
    for i in range(count):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = (int.from_bytes(entry[a:b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        if kind not in (1, 3, 4):
            continue
        size = _SIZES[kind]
        raw = entry[8 : 8 + size * n]
        if size * n > 4:
            place = int.from_bytes(entry[8:12], order)
            need(data, place + size * n)
            raw = data[place : place + size * n]
        tags[tag] = [int.from_bytes(raw[j * size : j * size + size], order) for j in range(n)]
    return order, tags


def lzw(data: bytes, limit: int) -> bytes:
    """TIFF's LZW: codes from the highest bit, wider one code early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    width, hold, have, last, out = 9, 0, 0, None, bytearray()
    for byte in data:
        hold = hold << 8 | byte
        have += 8
        if have < width:
            continue
        code = hold >> have - width
        have -= width
        hold &= (1 << have) - 1
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            fail("encoding", "TIFF: a code ahead of its table")
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        last = entry
        if len(out) >= limit:
            break
    return bytes(out[:limit])


def packbits(data: bytes, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < limit:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:limit])


def _plain(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        out = data[:size]
    elif compression == 5:
        out = lzw(data, size)
    elif compression == 32773:
        out = packbits(data, size)
    else:
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as error:
            fail("encoding", f"TIFF: {error}")
    if len(out) < size:
        fail("truncated", "TIFF: too few bytes")
    return out


def decode(data: bytes) -> Image:
    """Bilevel, gray, RGB, palette (RGBA) and CMYK of 1, 4, 8 or 16 bits, chunky."""
    order, tags = directory(data)
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    w, h = one(256), one(257)
    if not w or not h:
        fail("encoding", "TIFF: no size")
    check_size(w, h)
    n, compression, kind, predictor = one(277, 1), one(259, 1), one(262), one(317, 1)
    depths = tags.get(258) or [1]
    depth = depths[0]
    if kind is None:
        fail("encoding", "TIFF: no photometric interpretation")
    if any(d != depth for d in depths) or depth not in (1, 4, 8, 16) or compression not in (1, 5, 8, 32773, 32946) or kind > 5 or kind == 4 or predictor not in (1, 2):
        fail("unsupported", "TIFF: depth, compression, interpretation or predictor")
    if n > 1 and one(284, 1) != 1:
        fail("unsupported", "TIFF: planes")
    if depth < 8 and n > 1 or n > 5 or n < {2: 3, 5: 4}.get(kind, 1):
        fail("unsupported", "TIFF: samples")
    tiled = 322 in tags
    tw, th = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    starts, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not tw or not th or not starts or not sizes:
        fail("encoding", "TIFF: no data")
    check_size(tw, th)
    across, down = -(-w // tw), -(-h // th)
    if len(starts) < across * down or len(sizes) < across * down:
        fail("truncated", "TIFF: too few strips or tiles")
    stride = (tw * n * depth + 7) // 8
    out = np.zeros((down * th, across * tw, n), np.uint8)
    for i in range(across * down):
        y, x = i // across * th, i % across * tw
        rows_here = th if tiled else min(th, h - y)
        need(data, starts[i] + sizes[i])
        raw = np.frombuffer(_plain(data[starts[i] : starts[i] + sizes[i]], compression, stride * rows_here), np.uint8).reshape(rows_here, stride)
        if depth == 16:
            wide = raw.view(">u2" if order == "big" else "<u2").reshape(rows_here, tw, n)
            if predictor == 2:
                wide = np.cumsum(wide, axis=1, dtype=np.uint16)
            part = (wide >> 8).astype(np.uint8)
        else:
            part = unpack_bits(raw, tw * n, depth).reshape(rows_here, tw, n)
            if predictor == 2 and depth == 8:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[y : y + rows_here, x : x + tw] = part
    pixels = out[:h, :w]
    if kind == 3:
        table = tags.get(320) or []
        if len(table) < 3 << depth:
            fail("encoding", "TIFF: no palette")
        palette = (np.array(table[: 3 << depth]).reshape(3, -1).T >> 8).astype(np.uint8)
        return image(rgba(palette)[pixels[:, :, 0]], "rgba")
    if kind in (0, 1):
        gray = pixels[:, :, 0] * np.uint8({1: 255, 4: 17}.get(depth, 1))
        return image(255 - gray if kind == 0 else gray, "gray")
    if kind == 5:
        return image(pixels[:, :, :4], "cmyk")
    return image(pixels[:, :, :4], "rgba") if n >= 4 else image(pixels, "rgb")
