"""Small files as bytes, made from numbers: TIFF streams with maker notes, movies."""

from __future__ import annotations

import struct

_ORDERS = {"little": "<", "big": ">"}


def ifd(entries: list[tuple[int, int, int, bytes]], at: int, order: str = "little") -> bytes:
    """A directory that stands at ``at``: (tag, type, count, value) each; long values follow it."""
    mark, body, tail = _ORDERS[order], b"", b""
    start = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in sorted(entries):
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(mark + "I", start + len(tail))
        tail += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
        body += struct.pack(mark + "HHI", tag, kind, count) + value
    return struct.pack(mark + "H", len(entries)) + body + b"\0\0\0\0" + tail


def tiff_with_note(make: str, head: bytes, entries: list[tuple[int, int, int, bytes]], order: str = "little") -> bytes:
    """A TIFF stream of a camera whose maker note is ``head`` and a directory, offsets from the stream's start."""
    note_at, name = 256, make.encode() + b"\0"
    note = head + ifd(entries, note_at + len(head), order)
    mark = _ORDERS[order]
    first = ifd([(0x010F, 2, len(name), name), (0x8769, 4, 1, struct.pack(mark + "I", 160))], 8, order)
    inner = struct.pack(mark + "HHHII", 1, 0x927C, 7, len(note), note_at) + b"\0\0\0\0"
    out = {"little": b"II*\0", "big": b"MM\0*"}[order] + struct.pack(mark + "I", 8) + first
    return out.ljust(160, b"\0") + inner.ljust(96, b"\0") + note


def box(kind: str, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind.encode("latin-1") + body


def movie(seconds: int, width: int, height: int, make: str, model: str, by_keys: bool) -> bytes:
    """An MP4 file without samples; ``by_keys``: items numbered into a list of keys. Times beyond 32 bits take a header of version 1."""
    times = b"\1\0\0\0" + struct.pack(">QQIQ", seconds, seconds, 600, 0) if seconds >> 32 else b"\0" * 4 + struct.pack(">IIII", seconds, seconds, 600, 0)
    mvhd = box("mvhd", times + b"\0" * 80)
    tkhd = box("tkhd", b"\0" * 76 + struct.pack(">II", width << 16, height << 16))
    text = lambda value: box("data", struct.pack(">II", 1, 0) + value.encode())
    if by_keys:
        names = ["com.apple.quicktime.make", "com.apple.quicktime.model"]
        keys = box("keys", struct.pack(">II", 0, len(names)) + b"".join(struct.pack(">I", 8 + len(n)) + b"mdta" + n.encode() for n in names))
        items = keys + box("ilst", box("\0\0\0\1", text(make)) + box("\0\0\0\2", text(model)))
    else:
        items = box("ilst", box("\xa9mak", text(make)) + box("\xa9mod", text(model)))
    moov = box("moov", mvhd + box("trak", tkhd) + box("udta", box("meta", b"\0" * 4 + items)))
    return box("ftyp", b"isom" + b"\0" * 4) + moov + box("mdat", b"\0" * 8)
