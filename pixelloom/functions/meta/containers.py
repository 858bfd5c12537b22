"""Metadata inside JPEG, PNG, WebP, TIFF and ISO base media files: find, replace, strip."""

from __future__ import annotations

import struct
import zlib

from ..codecs import sniff
from ..codecs.base import CodecError
from ..codecs.png import SIGNATURE, chunk
from . import exif

XMP_JPEG = b"http://ns.adobe.com/xap/1.0/\0"
XMP_PNG = b"XML:com.adobe.xmp"
PHOTOSHOP = b"Photoshop 3.0\0"
MAX_TEXT = 1 << 24


def kind_of(data: bytes) -> str | None:
    try:
        found = sniff(data)
    except CodecError:
        return None
    return "isobmff" if data[4:8] == b"ftyp" else found


def jpeg_segments(data: bytes):
    """(marker, start, end) of the segments before the scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark in (0xDA, 0xD9):
            return
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if end > len(data):
            return
        yield mark, at, end
        at = end


def png_chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        end = at + 12 + int.from_bytes(data[at : at + 4], "big")
        if end > len(data):
            return
        yield data[at + 4 : at + 8], at, end
        at = end


def riff_chunks(data: bytes):
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + 8 + size + (size & 1)
        if at + 8 + size > len(data):
            return
        yield data[at : at + 4], at, min(end, len(data))
        at = end


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0, path: str = ""):
    """(path, body start, body end, depth) of ISO base media boxes, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end and depth < 16:
        size, kind = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8]
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = int.from_bytes(data[start + 8 : start + 16], "big"), start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, stop, depth
        if kind in (b"moov", b"trak", b"mdia", b"udta", b"iprp", b"ipco", b"dinf", b"minf", b"stbl"):
            yield from boxes(data, body, stop, depth + 1, name)
        elif kind == b"meta":
            yield from boxes(data, body + 4, stop, depth + 1, name)
        start = stop


def exif_item(data: bytes) -> tuple[int, int, int, int] | None:
    """(start, length, offset field's place, its size) of the single extent of the Exif item."""
    found = {name.rsplit("/", 1)[1]: (a, b) for name, a, b, _ in boxes(data) if name.startswith("/meta/")}
    if "iinf" not in found or "iloc" not in found:
        return None
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    at, end = found["iinf"]
    item = None
    for name, a, b, _ in boxes(data, at + (6 if data[at] == 0 else 8), end):
        if name == "/infe" and data[a] >= 2:
            wide = 4 if data[a] >= 3 else 2
            if data[a + 4 + wide + 2 : a + 8 + wide + 2] == b"Exif":
                item = number(a + 4, wide)
    at, end = found["iloc"]
    version = data[at]
    if item is None or version > 2:
        return None
    offset_n, length_n, base_n, index_n = data[at + 4] >> 4, data[at + 4] & 15, data[at + 5] >> 4, data[at + 5] & 15
    id_n = 4 if version == 2 else 2
    count, at = number(at + 6, id_n), at + 6 + id_n
    for _ in range(count):
        me, at = number(at, id_n), at + id_n
        method = 0
        if version:
            method, at = number(at, 2) & 15, at + 2
        at += 2
        base, at = number(at, base_n), at + base_n
        extents, at = number(at, 2), at + 2
        for k in range(extents):
            if version and index_n:
                at += index_n
            place = at
            start, length = number(at, offset_n), number(at + offset_n, length_n)
            at += offset_n + length_n
            if me == item and extents == 1 and method == 0 and k == 0:
                return base + start, length, place, offset_n
        if at > end:
            return None
    return None


def locate(data: bytes) -> tuple[int, int] | None:
    """(start, end) of the TIFF stream with the EXIF data."""
    kind = kind_of(data)
    if kind == "tiff":
        return 0, len(data)
    if kind == "jpeg":
        for mark, a, b in jpeg_segments(data):
            if mark == 0xE1 and data[a + 4 : a + 10] == b"Exif\0\0":
                return a + 10, b
    elif kind == "png":
        for name, a, b in png_chunks(data):
            if name == b"IDAT":
                break
            if name == b"eXIf":
                return a + 8, b - 4
    elif kind == "webp":
        for name, a, b in riff_chunks(data):
            if name == b"EXIF":
                start = a + 8 + (6 if data[a + 8 : a + 14] == b"Exif\0\0" else 0)
                return start, a + 8 + int.from_bytes(data[a + 4 : a + 8], "little")
    elif kind == "isobmff":
        item = exif_item(data)
        if item and item[0] + item[1] <= len(data) and item[1] > 8:
            start = item[0] + 4 + int.from_bytes(data[item[0] : item[0] + 4], "big")
            return (start, item[0] + item[1]) if start < item[0] + item[1] else None
    return None


def tiff_of(data: bytes) -> bytes | None:
    found = locate(data)
    return data[slice(*found)] if found and exif.byte_order(data[found[0] : found[0] + 4]) else None


def png_texts(data: bytes) -> list[tuple[str, str]]:
    """(keyword, text) of tEXt, zTXt and iTXt chunks; broken ones are passed over."""
    out = []
    for name, a, b in png_chunks(data):
        body = data[a + 8 : b - 4]
        key, _, rest = body.partition(b"\0")
        try:
            if name == b"tEXt":
                out.append((key.decode("latin-1"), rest.decode("latin-1")))
            elif name == b"zTXt" and rest[:1] == b"\0":
                out.append((key.decode("latin-1"), zlib.decompressobj().decompress(rest[1:], MAX_TEXT).decode("latin-1")))
            elif name == b"iTXt" and len(rest) > 2:
                text = rest[2:].split(b"\0", 2)[2]
                out.append((key.decode("latin-1"), (zlib.decompressobj().decompress(text, MAX_TEXT) if rest[0] else text).decode()))
        except (zlib.error, UnicodeDecodeError, IndexError):
            continue
    return out


def xmp_packet(data: bytes) -> str | None:
    kind = kind_of(data)
    if kind == "jpeg":
        for mark, a, b in jpeg_segments(data):
            if mark == 0xE1 and data[a + 4 : a + 4 + len(XMP_JPEG)] == XMP_JPEG:
                return data[a + 4 + len(XMP_JPEG) : b].decode("utf-8", "replace")
    elif kind == "png":
        return dict(png_texts(data)).get(XMP_PNG.decode())
    elif kind == "webp":
        for name, a, _ in riff_chunks(data):
            if name == b"XMP ":
                return data[a + 8 : a + 8 + int.from_bytes(data[a + 4 : a + 8], "little")].decode("utf-8", "replace")
    return None


def _segment(mark: int, body: bytes) -> bytes:
    if len(body) > 65533:
        raise ValueError("JPEG: over 64 KiB in a segment")
    return bytes((0xFF, mark)) + (len(body) + 2).to_bytes(2, "big") + body


def _in_jpeg(data: bytes, mine, new: bytes) -> bytes:
    """``data`` without the segments that ``mine`` picks, and with ``new`` after the JFIF header."""
    out, at, placed = bytearray(data[:2]), 2, False
    for mark, a, b in jpeg_segments(data):
        if not placed and mark != 0xE0:
            out += new
            placed = True
        if not mine(mark, data[a + 4 : b]):
            out += data[a:b]
        at = b
    return bytes(out + (b"" if placed else new) + data[at:])


def write_exif(data: bytes, tiff: bytes) -> bytes:
    """The file with its EXIF data replaced; ValueError where that can't be done."""
    kind = kind_of(data)
    if kind == "jpeg":
        return _in_jpeg(data, lambda m, b: m == 0xE1 and b[:6] == b"Exif\0\0", _segment(0xE1, b"Exif\0\0" + tiff))
    if kind == "tiff":
        if any(t.id in (0x0111, 0x0144) for t in exif.entries(data)):
            raise ValueError("TIFF: it holds pixels")
        return tiff
    if kind == "png":
        out = bytearray(SIGNATURE)
        for name, a, b in png_chunks(data):
            if name != b"eXIf":
                out += data[a:b]
            if name == b"IHDR":
                out += chunk(b"eXIf", tiff)
        return bytes(out)
    if kind == "webp":
        return _rebuilt_webp(data, b"EXIF", tiff)
    if kind == "isobmff":
        item = exif_item(data)
        if item is None:
            raise ValueError("no Exif item")
        start, length, place, width = item
        body = (6).to_bytes(4, "big") + b"Exif\0\0" + tiff
        out = bytearray(data)
        if len(body) <= length:
            out[start : start + length] = body.ljust(length, b"\0")
            return bytes(out)
        at = len(data) + 8
        if width not in (4, 8) or start != int.from_bytes(data[place : place + width], "big"):
            raise ValueError("the item can't be moved")
        out[place : place + width] = at.to_bytes(width, "big")
        out[place + width : place + 2 * width] = len(body).to_bytes(width, "big")
        return bytes(out) + (len(body) + 8).to_bytes(4, "big") + b"mdat" + body
    raise ValueError("EXIF data can't be written to this format")


def _rebuilt_webp(data: bytes, name: bytes, body: bytes | None) -> bytes:
    """With one EXIF chunk, or (``body`` None) without EXIF and XMP; the flags of VP8X follow."""
    parts, extended = [], False
    for kind, a, b in riff_chunks(data):
        part = bytearray(data[a:b])
        if kind == b"VP8X":
            extended = True
            part[8] = part[8] | 8 if body is not None else part[8] & ~(8 | 4)
        if kind == name or body is None and kind == b"XMP ":
            continue
        parts.append(bytes(part))
    if body is not None:
        if not extended:
            raise ValueError("WebP: not an extended file")
        parts.append(name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1))
    out = b"WEBP" + b"".join(parts)
    return b"RIFF" + len(out).to_bytes(4, "little") + out


def strip(data: bytes) -> bytes:
    """The file without EXIF, XMP, IPTC, comments and text; ValueError for other formats."""
    kind = kind_of(data)
    if kind == "jpeg":
        return _in_jpeg(data, lambda m, b: m in (0xE1, 0xED, 0xFE), b"")
    if kind == "png":
        return SIGNATURE + b"".join(data[a:b] for name, a, b in png_chunks(data) if name not in (b"eXIf", b"tEXt", b"iTXt", b"zTXt"))
    if kind == "webp":
        return _rebuilt_webp(data, b"EXIF", None)
    if kind == "isobmff":
        out, item = bytearray(data), exif_item(data)
        if item and item[0] + item[1] <= len(data):
            out[item[0] : item[0] + item[1]] = bytes(item[1])
        for name, a, b, _ in boxes(data):
            if name.endswith("/udta"):
                out[a - 4 : a] = b"free"
                out[a:b] = bytes(b - a)
        return bytes(out)
    raise ValueError("metadata can't be stripped from this format")


def write_xmp(data: bytes, packet: str) -> bytes:
    if kind_of(data) != "jpeg":
        raise ValueError("XMP can be written to JPEG only")
    return _in_jpeg(data, lambda m, b: m == 0xE1 and b.startswith(XMP_JPEG), _segment(0xE1, XMP_JPEG + packet.encode()))


def iptc_datasets(data: bytes) -> list[tuple[int, str]]:
    """(dataset, value) of record 2 of a JPEG, in order."""
    if kind_of(data) != "jpeg":
        return []
    for mark, a, b in jpeg_segments(data):
        body = data[a + 4 : b]
        if mark != 0xED or not body.startswith(PHOTOSHOP):
            continue
        at = len(PHOTOSHOP)
        while body[at : at + 4] == b"8BIM" and at + 12 <= len(body):
            name = body[at + 6]
            place = at + 6 + (name + 2) // 2 * 2
            size = int.from_bytes(body[place : place + 4], "big")
            if body[at + 4 : at + 6] == b"\x04\x04":
                return _records(body[place + 4 : place + 4 + size])
            at = place + 4 + size + (size & 1)
    return []


def _records(body: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    while at + 5 <= len(body) and body[at] == 0x1C:
        size = int.from_bytes(body[at + 3 : at + 5], "big")
        if size & 0x8000 or at + 5 + size > len(body):
            break
        if body[at + 1] == 2:
            out.append((body[at + 2], body[at + 5 : at + 5 + size].decode("utf-8", "replace")))
        at += 5 + size
    return out


def write_iptc(data: bytes, items: list[tuple[int, str]]) -> bytes:
    """A JPEG whose IPTC data is ``items``, in order."""
    if kind_of(data) != "jpeg":
        raise ValueError("IPTC can be written to JPEG only")
    records = b"".join(struct.pack(">BBBH", 0x1C, 2, n, len(v.encode())) + v.encode() for n, v in items)
    block = b"8BIM\x04\x04\0\0" + len(records).to_bytes(4, "big") + records + b"\0" * (len(records) & 1)
    return _in_jpeg(data, lambda m, b: m == 0xED and b.startswith(PHOTOSHOP), _segment(0xED, PHOTOSHOP + block))
