"""BMP, QOI, PNM and PAM, TGA, PCX and Radiance HDR."""

from __future__ import annotations

import re
import struct

import numpy as np

from .base import Image, check_size, fail, image, need, rgba, unpack_bits


def decode_bmp(data: bytes) -> Image:
    """Uncompressed 1, 4, 8, 24 and 32 bits; alpha is forced to 255."""
    need(data, 54)
    if data[:2] != b"BM":
        fail("encoding", "BMP: no signature")
    start, header, w, h, planes, bits, compression = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if header < 40 or compression or bits not in (1, 4, 8, 24, 32):
        fail("unsupported", "BMP: header, compression or depth")
    flip, h = h > 0, abs(h)
    check_size(w, h)
    stride = (w * bits + 31) // 32 * 4
    need(data, start + stride * h)
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    if flip:
        rows = rows[::-1]
    if bits >= 24:
        n = bits // 8
        pixels = rows[:, : w * n].reshape(h, w, n)[:, :, 2::-1]
        return image(pixels, "rgb") if bits == 24 else image(rgba(pixels), "rgba")
    count = colours or 1 << bits
    if count > 1 << bits:
        fail("encoding", "BMP: too many colours")
    need(data, 14 + header + 4 * count)
    palette = np.frombuffer(data, np.uint8, 4 * count, 14 + header).reshape(-1, 4)[:, 2::-1]
    index = unpack_bits(rows, w, bits)
    if index.max(initial=0) >= count:
        fail("encoding", "BMP: a colour outside the palette")
    return image(rgba(palette)[index], "rgba")


def encode_bmp(img: Image) -> bytes:
    if img.colorspace not in ("rgb", "rgba"):
        fail("unsupported", "BMP: RGB or RGBA")
    n = img.channels
    stride = (img.width * n + 3) // 4 * 4
    size = 54 + stride * img.height
    if size >= 1 << 32:
        fail("encoding", "BMP: over 4 GiB")
    rows = np.zeros((img.height, stride), np.uint8)
    order = [2, 1, 0, 3][:n]
    rows[:, : img.width * n] = img.data[::-1][:, :, order].reshape(img.height, -1)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", size, 0, 54, 40, img.width, img.height, 1, n * 8, 0, size - 54, 2835, 2835, 0, 0) + rows.tobytes()


def _qoi_slot(r: int, g: int, b: int, a: int) -> int:
    return (r * 3 + g * 5 + b * 7 + a * 11) % 64


def decode_qoi(data: bytes) -> Image:
    need(data, 14)
    if data[:4] != b"qoif":
        fail("encoding", "QOI: no signature")
    w, h, channels, _ = struct.unpack_from(">IIBB", data, 4)
    check_size(w, h)
    if channels not in (3, 4):
        fail("encoding", "QOI: channels")
    total, at, out = w * h, 14, bytearray()
    seen = [(0, 0, 0, 0)] * 64
    pixel = (0, 0, 0, 255)
    while len(out) < total * 4:
        if at >= len(data):
            fail("truncated", "QOI: too few bytes")
        tag, run = data[at], 1
        at += 1
        r, g, b, a = pixel
        if tag >= 0xFE:
            n = 3 if tag == 0xFE else 4
            if at + n > len(data):
                fail("truncated", "QOI: too few bytes")
            pixel = (*data[at : at + 3], a) if n == 3 else tuple(data[at : at + 4])
            at += n
        elif tag < 0x40:
            pixel = seen[tag]
        elif tag < 0x80:
            pixel = ((r + (tag >> 4 & 3) - 2) & 255, (g + (tag >> 2 & 3) - 2) & 255, (b + (tag & 3) - 2) & 255, a)
        elif tag < 0xC0:
            if at >= len(data):
                fail("truncated", "QOI: too few bytes")
            green, both = (tag & 63) - 32, data[at]
            at += 1
            pixel = ((r + green + (both >> 4) - 8) & 255, (g + green) & 255, (b + green + (both & 15) - 8) & 255, a)
        else:
            run = (tag & 63) + 1
            if len(out) + run * 4 > total * 4:
                fail("encoding", "QOI: a run past the end")
        seen[_qoi_slot(*pixel)] = pixel
        out += bytes(pixel) * run
    pixels = np.frombuffer(bytes(out), np.uint8).reshape(h, w, 4)
    return image(pixels[:, :, :channels], "rgb" if channels == 3 else "rgba")


def encode_qoi(img: Image) -> bytes:
    if img.colorspace not in ("rgb", "rgba"):
        fail("unsupported", "QOI: RGB or RGBA")
    flat = img.data.reshape(-1, img.channels)
    pixels = flat if img.channels == 4 else rgba(flat)
    out = bytearray(struct.pack(">4sIIBB", b"qoif", img.width, img.height, img.channels, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for pixel in map(tuple, pixels.tolist()):
        if pixel == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = _qoi_slot(*pixel)
        if seen[slot] == pixel:
            out.append(slot)
        else:
            seen[slot] = pixel
            r, g, b = ((n - o + 128) % 256 - 128 for n, o in zip(pixel[:3], last[:3], strict=True))
            if pixel[3] != last[3]:
                out += bytes((0xFF, *pixel))
            elif -2 <= r < 2 and -2 <= g < 2 and -2 <= b < 2:
                out.append(0x40 | r + 2 << 4 | g + 2 << 2 | b + 2)
            elif -32 <= g < 32 and -8 <= r - g < 8 and -8 <= b - g < 8:
                out += bytes((0x80 | g + 32, r - g + 8 << 4 | b - g + 8))
            else:
                out += bytes((0xFE, *pixel[:3]))
        last = pixel
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + bytes(7) + b"\x01"


def _scaled(samples: np.ndarray, most: int) -> np.ndarray:
    if samples.max(initial=0) > most:
        fail("encoding", "PNM: a sample over the largest value")
    return ((samples.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)


def decode_pnm(data: bytes) -> Image:
    """P1 to P6, and PAM (P7) of depth 1, 3 or 4."""
    need(data, 3)
    kind = data[:2]
    if kind == b"P7":
        return _decode_pam(data)
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        fail("encoding", "PNM: no signature")
    blank = rb"(?:\s|#[^\n]*\n)+"
    fields = 2 if kind in (b"P1", b"P4") else 3
    head = re.compile(kind + (blank + rb"(\d+)") * fields + rb"\s").match(data)
    if head is None:
        fail("truncated", "PNM: header")
    w, h, *rest = map(int, head.groups())
    check_size(w, h)
    most = rest[0] if rest else 1
    if not 0 < most < 65536:
        fail("encoding", "PNM: largest value")
    n = 3 if kind in (b"P3", b"P6") else 1
    body = data[head.end() :]
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*\n|\s", b"", body)[: w * h]
        need(digits, w * h)
        samples = np.frombuffer(digits, np.uint8) - 48
        if samples.max(initial=0) > 1:
            fail("encoding", "PNM: not a bit")
        return image((255 - samples * np.uint8(255)).reshape(h, w), "gray")
    if kind == b"P4":
        stride = (w + 7) // 8
        need(body, stride * h)
        return image(255 - unpack_bits(np.frombuffer(body, np.uint8, stride * h).reshape(h, stride), w, 1) * np.uint8(255), "gray")
    if kind in (b"P2", b"P3"):
        values = re.sub(rb"#[^\n]*(\n|$)", b" ", body).split()[: w * h * n]
        if len(values) < w * h * n:
            fail("truncated", "PNM: too few samples")
        try:
            samples = np.array([int(v) for v in values])
        except ValueError:
            fail("encoding", "PNM: not a number")
    else:
        samples = _binary_samples(body, w * h * n, most)
    return image(_scaled(samples, most).reshape(h, w, n), "rgb" if n == 3 else "gray")


def _binary_samples(body: bytes, n: int, most: int) -> np.ndarray:
    width = 1 if most < 256 else 2
    need(body, n * width)
    return np.frombuffer(body, ">u2" if width == 2 else np.uint8, n)


def _decode_pam(data: bytes) -> Image:
    end = data.find(b"ENDHDR\n")
    if end < 0:
        fail("truncated", "PAM: header")
    fields = dict(line.split(maxsplit=1) for line in data[2:end].split(b"\n") if line and not line.startswith(b"#") and b" " in line)
    try:
        w, h, n, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError):
        fail("encoding", "PAM: header")
    check_size(w, h)
    if n not in (1, 3, 4) or not 0 < most < 65536:
        fail("unsupported", "PAM: depth or largest value")
    samples = _binary_samples(data[end + 7 :], w * h * n, most)
    return image(_scaled(samples, most).reshape(h, w, n), {1: "gray", 3: "rgb", 4: "rgba"}[n])


def encode_pnm(img: Image) -> bytes:
    """P5, P6 or P7 (RGBA)."""
    if img.colorspace == "rgba":
        head = f"P7\nWIDTH {img.width}\nHEIGHT {img.height}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"
    elif img.colorspace in ("gray", "rgb"):
        head = f"{'P5' if img.colorspace == 'gray' else 'P6'}\n{img.width} {img.height}\n255\n"
    else:
        fail("unsupported", "PNM: gray, RGB or RGBA")
    return head.encode() + img.data.tobytes()


def decode_tga(data: bytes) -> Image:
    """True colour, gray and palette, plain or run-length, of 8, 24 and 32 bits."""
    need(data, 18)
    id_size, has_map, kind, map_first, map_n, map_bits, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    if kind not in (1, 2, 3, 9, 10, 11):
        fail("unsupported", "TGA: type")
    check_size(w, h)
    base = kind & 7
    if bits not in {1: (8,), 2: (24, 32), 3: (8,)}[base]:
        fail("unsupported", "TGA: depth")
    at = 18 + id_size
    palette = None
    if has_map:
        if base == 1 and map_bits not in (24, 32):
            fail("unsupported", "TGA: palette depth")
        step = (map_bits + 7) // 8
        need(data, at + map_n * step)
        if base == 1:
            palette = np.frombuffer(data, np.uint8, map_n * step, at).reshape(-1, step)
        at += map_n * step
    elif base == 1:
        fail("encoding", "TGA: no palette")
    n, total = bits // 8, w * h
    if kind < 8:
        need(data, at + total * n)
        flat = np.frombuffer(data, np.uint8, total * n, at)
    else:
        out = bytearray()
        while len(out) < total * n:
            need(data, at + 1)
            count, repeat = (data[at] & 127) + 1, data[at] & 128
            at += 1
            size = n if repeat else n * count
            need(data, at + size)
            out += data[at : at + n] * count if repeat else data[at : at + size]
            at += size
        if len(out) > total * n:
            fail("encoding", "TGA: a run past the end")
        flat = np.frombuffer(bytes(out), np.uint8)
    pixels = flat.reshape(h, w, n)
    if base == 1:
        index = pixels[:, :, 0].astype(np.int64) - map_first
        if index.min() < 0 or index.max() >= len(palette):
            fail("encoding", "TGA: a colour outside the palette")
        pixels = palette[index]
    if pixels.shape[2] > 1:
        pixels = pixels[:, :, [2, 1, 0, 3][: pixels.shape[2]]]
    if not flags & 32:
        pixels = pixels[::-1]
    if flags & 16:
        pixels = pixels[:, ::-1]
    return image(pixels, {1: "gray", 3: "rgb", 4: "rgba"}[pixels.shape[2]])


def encode_tga(img: Image) -> bytes:
    if img.colorspace not in ("gray", "rgb", "rgba"):
        fail("unsupported", "TGA: gray, RGB or RGBA")
    if img.width > 65535 or img.height > 65535:
        fail("encoding", "TGA: over 65535 pixels wide or high")
    n = img.channels
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, img.width, img.height, n * 8, 8 if n == 4 else 0)
    pixels = img.data[::-1] if n == 1 else img.data[::-1][:, :, [2, 1, 0, 3][:n]]
    return head + np.ascontiguousarray(pixels).tobytes()


def decode_pcx(data: bytes) -> Image:
    """24-bit, 8-bit with palette (RGBA) or gray, and 1-bit."""
    need(data, 128)
    if data[0] != 10:
        fail("encoding", "PCX: no signature")
    coded, bits = data[2], data[3]
    x0, y0, x1, y1 = struct.unpack_from("<4H", data, 4)
    planes, stride, info = data[65], *struct.unpack_from("<HH", data, 66)
    w, h = x1 - x0 + 1, y1 - y0 + 1
    check_size(w, h)
    if (bits, planes) not in ((8, 3), (8, 1), (1, 1)):
        fail("unsupported", "PCX: depth")
    if stride * 8 < w * bits:
        fail("encoding", "PCX: line size")
    total = stride * planes * h
    if coded == 1:
        out, at = bytearray(), 128
        while len(out) < total:
            need(data, at + 1)
            byte = data[at]
            at += 1
            if byte >= 0xC0:
                need(data, at + 1)
                out += bytes([data[at]]) * (byte & 63)
                at += 1
            else:
                out.append(byte)
        rows = np.frombuffer(bytes(out[:total]), np.uint8)
    elif coded == 0:
        need(data, 128 + total)
        rows = np.frombuffer(data, np.uint8, total, 128)
    else:
        fail("unsupported", "PCX: encoding")
    rows = rows.reshape(h, planes, stride)
    if planes == 3:
        return image(rows[:, :, :w].transpose(0, 2, 1), "rgb")
    if bits == 1:
        return image(unpack_bits(rows[:, 0], w, 1) * np.uint8(255), "gray")
    if info == 2:
        return image(rows[:, 0, :w], "gray")
    need(data, 128 + 769)
    if data[-769] != 12:
        fail("encoding", "PCX: no palette")
    return image(rgba(np.frombuffer(data[-768:], np.uint8).reshape(256, 3))[rows[:, 0, :w]], "rgba")


def decode_hdr(data: bytes) -> Image:
    """Radiance RGBE as float32 RGB: (m + 0.5) * 2**(e - 136), and 0 where e is 0."""
    if data[:2] != b"#?":
        fail("encoding", "HDR: no signature")
    end = data.find(b"\n\n")
    size = re.compile(rb"([-+])Y (\d+) \+X (\d+)\n").match(data, end + 2) if end >= 0 else None
    if size is None:
        fail("unsupported" if end >= 0 else "truncated", "HDR: header")
    h, w = int(size[2]), int(size[3])
    check_size(w, h)
    at, rows = size.end(), np.empty((h, w, 4), np.uint8)
    for y in range(h):
        need(data, at + 4)
        if 8 <= w < 32768 and data[at] == 2 and data[at + 1] == 2 and data[at + 2] < 128:
            if data[at + 2] << 8 | data[at + 3] != w:
                fail("encoding", "HDR: line size")
            at += 4
            for c in range(4):
                line = bytearray()
                while len(line) < w:
                    need(data, at + 1)
                    n = data[at]
                    at += 1
                    if n > 128:
                        need(data, at + 1)
                        line += bytes([data[at]]) * (n - 128)
                        at += 1
                    elif n:
                        need(data, at + n)
                        line += data[at : at + n]
                        at += n
                    else:
                        fail("encoding", "HDR: an empty run")
                if len(line) > w:
                    fail("encoding", "HDR: a run past the line")
                rows[y, :, c] = np.frombuffer(bytes(line), np.uint8)
        else:
            need(data, at + 4 * w)
            rows[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
            if ((rows[y, :, 0] == 1) & (rows[y, :, 1] == 1) & (rows[y, :, 2] == 1)).any():
                fail("unsupported", "HDR: old run-length lines")
            at += 4 * w
    if size[1] == b"+":
        rows = rows[::-1]
    exponent = rows[:, :, 3:].astype(np.int32)
    values = np.ldexp(rows[:, :, :3].astype(np.float32) + np.float32(0.5), exponent - 136)
    return image(np.where(exponent > 0, values, 0).astype(np.float32), "rgb")
