"""PNG: all types and depths without interlace; 8-bit encoder."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .base import Image, check_size, fail, image, need, unpack_bits

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    """(type, body) up to IEND, checksums verified."""
    at = 8
    while True:
        if at + 12 > len(data):
            fail("truncated", "PNG: no IEND")
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            fail("truncated", "PNG: a chunk runs past the end")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            fail("encoding", "PNG: a checksum is wrong")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def inflate_exact(data: bytes, size: int) -> bytes:
    """Exactly ``size`` bytes of a zlib stream."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, size)
    except zlib.error as error:
        fail("encoding", f"zlib: {error}")
    if len(out) < size:
        fail("truncated", "zlib: too few bytes")
    return out


def unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Rows without their filter byte; Sub and Up are running sums, the others go pixel by pixel."""
    rows = raw[:, 1:].copy()
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(raw[:, 0]):
        row = rows[y]
        if kind == 1:
            n = -(-len(row) // bpp) * bpp
            wide = np.zeros(n, np.uint8)
            wide[: len(row)] = row
            row[:] = np.cumsum(wide.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
        elif kind == 2:
            row += above
        elif kind == 3:
            left = [0] * bpp
            up, out = above.tolist(), row.tolist()
            for i, v in enumerate(out):
                out[i] = (v + ((left[i % bpp] + up[i]) >> 1)) & 255
                left[i % bpp] = out[i]
            row[:] = out
        elif kind == 4:
            up, out = above.tolist(), row.tolist()
            for i, v in enumerate(out):
                a, b, c = (out[i - bpp], up[i], up[i - bpp]) if i >= bpp else (0, up[i], 0)
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                out[i] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            row[:] = out
        elif kind:
            fail("encoding", "PNG: unknown filter")
        above = row
    return rows


def decode(data: bytes) -> Image:
    """Gray, RGB or RGBA; palettes and gray with alpha become RGBA; 16 bits keep the high byte."""
    need(data, 33)
    if data[:8] != SIGNATURE:
        fail("encoding", "PNG: no signature")
    header = palette = transparent = None
    body = []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            if len(part) != 13:
                fail("encoding", "PNG: IHDR")
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            if not part or len(part) % 3 or len(part) > 768:
                fail("encoding", "PNG: PLTE")
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            transparent = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
    if header is None:
        fail("encoding", "PNG: no IHDR")
    w, h, depth, kind, compression, filters, interlace = header
    check_size(w, h)
    if kind not in _DEPTHS or depth not in _DEPTHS[kind] or compression or filters:
        fail("unsupported", "PNG: type, depth or method")
    if interlace:
        fail("unsupported", "PNG: interlaced")
    samples = _SAMPLES[kind]
    stride = (w * samples * depth + 7) // 8
    raw = np.frombuffer(inflate_exact(b"".join(body), h * (stride + 1)), np.uint8).reshape(h, stride + 1)
    rows = unfilter(raw, max(1, samples * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    if depth < 8:
        rows = unpack_bits(rows, w, depth)
    if kind == 3:
        if palette is None:
            fail("encoding", "PNG: no palette")
        if rows.max(initial=0) >= len(palette):
            fail("encoding", "PNG: a colour outside the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        if transparent is not None:
            n = min(len(transparent), len(alpha))
            alpha[:n] = transparent[:n]
        return image(np.concatenate([palette, alpha[:, None]], axis=1)[rows], "rgba")
    if depth < 8:
        rows = rows * np.uint8({1: 255, 2: 85, 4: 17}[depth])
    pixels = rows.reshape(h, w, samples)
    if kind == 4:
        return image(pixels[:, :, [0, 0, 0, 1]], "rgba")
    return image(pixels, {1: "gray", 3: "rgb", 4: "rgba"}[samples])


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def encode(img: Image) -> bytes:
    kinds = {"gray": 0, "rgb": 2, "rgba": 6}
    if img.colorspace not in kinds:
        fail("unsupported", "PNG: gray, RGB or RGBA")
    rows = np.zeros((img.height, img.width * img.channels + 1), np.uint8)
    rows[:, 1:] = img.data.reshape(img.height, -1)
    header = struct.pack(">IIBBBBB", img.width, img.height, 8, kinds[img.colorspace], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
