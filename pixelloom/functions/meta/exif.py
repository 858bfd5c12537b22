"""EXIF directories: reading, rendering, editing and serializing."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from math import gcd

from .tables import EXIF_TAGS, GPS_TAGS, LABELS, WRITABLE

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMATS = {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}
EXIF_POINTER, GPS_POINTER, INTEROP_POINTER, SUB_POINTER = 0x8769, 0x8825, 0xA005, 0x014A
THUMBNAIL_OFFSET, THUMBNAIL_SIZE = 0x0201, 0x0202


@dataclass
class Tag:
    """An entry of a directory; ``at`` is where its value stands, from the TIFF header."""

    ifd: str
    id: int
    type: int
    count: int
    at: int
    raw: bytes
    order: str

    def numbers(self) -> list:
        """Values of the numeric types; pairs (numerator, denominator) of the rationals."""
        mark = "<" if self.order == "little" else ">"
        if self.type in (1, 6, 7):
            return list(self.raw)
        if self.type in (5, 10):
            flat = struct.unpack(f"{mark}{2 * self.count}{'I' if self.type == 5 else 'i'}", self.raw)
            return list(zip(flat[::2], flat[1::2], strict=True))
        return list(struct.unpack(f"{mark}{self.count}{_FORMATS[self.type]}", self.raw))

    def text(self) -> str:
        """Rationals in lowest terms; bytes as text if printable, else in hexadecimal."""
        if self.type == 2:
            return self.raw.split(b"\0")[0].decode("utf-8", "replace").rstrip()
        if self.type in (1, 6, 7):
            body = self.raw.rstrip(b"\0")
            if body and all(32 <= b < 127 for b in body):
                return body.decode()
            return " ".join(f"{b:02X}" for b in self.raw)
        if self.type in (5, 10):
            return " ".join(ratio_text(n, d) for n, d in self.numbers())
        return " ".join(f"{v:g}" if isinstance(v, float) else str(v) for v in self.numbers())


def ratio_text(n: int, d: int) -> str:
    if not d:
        return f"{n}/0"
    g = gcd(n, d) or 1
    n, d = n // g, d // g
    if d < 0:
        n, d = -n, -d
    return str(n) if d == 1 else f"{n}/{d}"


def directory(tiff: bytes, at: int, ifd: str, order: str) -> tuple[list[Tag], int]:
    """(entries that are wholly there, offset of the next directory or 0)."""
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    if at < 8 or at + 2 > len(tiff):
        return [], 0
    out = []
    count = number(at, 2)
    for i in range(count):
        place = at + 2 + 12 * i
        if place + 12 > len(tiff):
            return out, 0
        tag, kind, n = number(place, 2), number(place + 2, 2), number(place + 4, 4)
        kind = kind if kind in SIZES else 7
        size = SIZES[kind] * n
        value_at = place + 8 if size <= 4 else number(place + 8, 4)
        if value_at + size <= len(tiff):
            out.append(Tag(ifd, tag, kind, n, value_at, tiff[value_at : value_at + size], order))
    return out, number(at + 2 + 12 * count, 4)


def byte_order(tiff: bytes) -> str | None:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    return order if order and int.from_bytes(tiff[2:4], order) == 42 else None


def entries(tiff: bytes) -> list[Tag]:
    """All directories' entries: ifd0, ifd1, exif, gps, interop and sub; loops are cut."""
    order = byte_order(tiff)
    if order is None:
        return []
    seen, out = set(), []
    todo = [("ifd0", int.from_bytes(tiff[4:8], order))]
    while todo:
        ifd, at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        tags, following = directory(tiff, at, ifd, order)
        out += tags
        if ifd == "ifd0" and following:
            todo.append(("ifd1", following))
        for tag in tags:
            inner = {EXIF_POINTER: "exif", GPS_POINTER: "gps", INTEROP_POINTER: "interop", SUB_POINTER: "sub"}.get(tag.id)
            if inner and tag.type in (3, 4):
                todo += [(inner, v) for v in tag.numbers()]
    return out


def tag_name(tag: Tag) -> str:
    table = GPS_TAGS if tag.ifd == "gps" else EXIF_TAGS
    return table.get(tag.id, f"Unknown:0x{tag.id:04X}")


def _decimal(v: float, places: int = 2) -> str:
    text = f"{v:.{places}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _ratio(text: str) -> float:
    n, _, d = text.split(" ")[0].partition("/")
    return float(n) / float(d or 1)


def _degrees(text: str) -> float:
    return sum(_ratio(part) / 60**i for i, part in enumerate(text.split(" ")[:3]))


def render(name: str, text: str, tags: dict[str, str]) -> str:
    """A tag's value as people read it; the plain text where it can't be read so."""
    try:
        if name in LABELS:
            head = text.split(" ")[0]
            code = int(head) if name != "GPSAltitudeRef" else int(head, 16) if head else 0
            return LABELS[name].get(code, f"Unknown ({code})" if name == "Flash" else str(code))
        if name in ("FNumber", "ApertureValue", "MaxApertureValue"):
            v = _ratio(text)
            return "f/" + _decimal(v if name == "FNumber" else 2 ** (v / 2))
        if name in ("DNGVersion", "DNGBackwardVersion", "TIFF-EPStandardID"):
            return ".".join(str(int(t, 16)) for t in text.split())
        if name in ("ColorMatrix1", "ColorMatrix2", "CameraCalibration1", "CameraCalibration2", "AnalogBalance", "AsShotNeutral"):
            return " ".join(_decimal(_ratio(t), 6) if "/" in t else t for t in text.split())
        if name == "ShutterSpeedValue":
            v = 2 ** -_ratio(text)
            return f"1/{round(1 / v)}" if v < 1 else _decimal(v)
        if name == "ExposureTime":
            v = _ratio(text)
            return f"1/{round(1 / v)}" if 0 < v < 0.25001 else _decimal(v, 1)
        if name in ("FocalLength", "FocalLengthIn35mmFormat"):
            return _decimal(_ratio(text)) + " mm"
        if name in ("ExposureCompensation", "BrightnessValue", "DigitalZoomRatio", "GPSSpeed"):
            return _decimal(_ratio(text))
        if name == "GPSAltitude":
            return f"{_decimal(_ratio(text), 1)} m {tags.get('GPSAltitudeRef', '')}".rstrip()
        if name in ("GPSLatitude", "GPSLongitude"):
            d, m, s = (_ratio(t) for t in (text.split(" ") + ["0", "0"])[:3])
            side = tags.get(f"{name}Ref", "N" if name == "GPSLatitude" else "W")
            return f"{int(d)} deg {int(m)}' {s:.2f}\" {side}"
    except (ValueError, ZeroDivisionError, OverflowError):
        pass
    return text


def named(tiff: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """(rendered, plain text) of every tag by name; pointers and the thumbnail's are left out."""
    plain: dict[str, str] = {}
    for tag in entries(tiff):
        if tag.ifd != "ifd1" and tag.id not in (EXIF_POINTER, GPS_POINTER, INTEROP_POINTER, SUB_POINTER):
            plain.setdefault(tag_name(tag), tag.text())
    out: dict[str, str] = {}
    for name in sorted(plain, key=lambda n: (not n.endswith("Ref"), n)):
        out[name] = render(name, plain[name], out)
    return out, plain


def gps(plain: dict[str, str]) -> tuple[float | None, float | None, float | None]:
    """Signed degrees and metres; None where there is none."""

    def axis(name: str, negative: str) -> float | None:
        try:
            return _degrees(plain[name]) * (-1 if plain.get(f"{name}Ref", "") == negative else 1)
        except (KeyError, ValueError, ZeroDivisionError):
            return None

    try:
        altitude = _ratio(plain["GPSAltitude"]) * (-1 if plain.get("GPSAltitudeRef") in ("01", "1") else 1)
    except (KeyError, ValueError, ZeroDivisionError):
        altitude = None
    return axis("GPSLatitude", "S"), axis("GPSLongitude", "W"), altitude


def thumbnail(tiff: bytes) -> bytes | None:
    """The JPEG that the second directory points to."""
    at = {tag.id: tag.numbers()[0] for tag in entries(tiff) if tag.ifd == "ifd1" and tag.id in (THUMBNAIL_OFFSET, THUMBNAIL_SIZE)}
    if len(at) < 2 or not at[THUMBNAIL_SIZE] or at[THUMBNAIL_OFFSET] + at[THUMBNAIL_SIZE] > len(tiff):
        return None
    return tiff[at[THUMBNAIL_OFFSET] : at[THUMBNAIL_OFFSET] + at[THUMBNAIL_SIZE]]


@dataclass
class ExifData:
    """An editable tree: tag number to (type, value bytes, little endian) in each directory."""

    ifd0: dict[int, tuple[int, bytes]] = field(default_factory=dict)
    exif: dict[int, tuple[int, bytes]] = field(default_factory=dict)
    gps: dict[int, tuple[int, bytes]] = field(default_factory=dict)

    @classmethod
    def parse(cls, tiff: bytes | None) -> ExifData:
        out = cls()
        for tag in entries(tiff or b""):
            if tag.ifd in ("ifd0", "exif", "gps") and tag.id not in (EXIF_POINTER, GPS_POINTER, INTEROP_POINTER, SUB_POINTER):
                getattr(out, tag.ifd)[tag.id] = (tag.type, pack(tag.type, tag.numbers() if tag.type != 2 else tag.raw))
        return out

    def set(self, name: str, value: str) -> None:
        """Set a tag by its name; ValueError for an unknown name or a value it can't hold."""
        if name not in WRITABLE:
            raise ValueError(f"{name} can't be written")
        ifd, tag, kind = WRITABLE[name]
        getattr(self, ifd)[tag] = (kind, b"ASCII\0\0\0" + value.encode() if name == "UserComment" else typed(kind, value))

    def set_date(self, value: str) -> None:
        for name in ("DateTime", "DateTimeOriginal", "CreateDate"):
            self.set(name, value)

    def set_gps(self, latitude: float, longitude: float, altitude: float | None = None) -> None:
        def parts(v: float) -> bytes:
            v = abs(v)
            d = int(v)
            m = int((v - d) * 60)
            s = round(((v - d) * 60 - m) * 60 * 10000)
            return pack(5, [(d, 1), (m, 1), (s, 10000)])

        if not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
            raise ValueError("GPS: outside the globe")
        self.gps |= {0: (1, bytes((2, 3, 0, 0))), 1: (2, b"S\0" if latitude < 0 else b"N\0"), 2: (5, parts(latitude)), 3: (2, b"W\0" if longitude < 0 else b"E\0"), 4: (5, parts(longitude))}
        if altitude is not None:
            self.gps |= {5: (1, bytes((altitude < 0,))), 6: (5, pack(5, [(round(abs(altitude) * 100), 100)]))}

    def delete(self, ifd: str, tag: int) -> None:
        getattr(self, ifd).pop(tag, None)

    def strip(self) -> None:
        self.ifd0.clear()
        self.exif.clear()
        self.gps.clear()

    def serialize(self) -> bytes:
        """A little-endian TIFF stream: directories by ascending tag, values on even offsets."""
        ifd0 = dict(self.ifd0)
        groups = [("ifd0", ifd0)]
        for pointer, group in ((EXIF_POINTER, self.exif), (GPS_POINTER, self.gps)):
            if group:
                ifd0[pointer] = (4, bytes(4))
                groups.append((pointer, group))
        starts, at = {}, 8
        for name, group in groups:
            starts[name] = at
            at += 6 + 12 * len(group) + sum((len(v) + 1) // 2 * 2 for _, v in group.values() if len(v) > 4)
        out = bytearray(b"II*\0" + (8).to_bytes(4, "little"))
        for name, group in groups:
            pool_at = starts[name] + 6 + 12 * len(group)
            head, pool = struct.pack("<H", len(group)), b""
            for tag in sorted(group):
                kind, value = group[tag]
                if tag in (EXIF_POINTER, GPS_POINTER):
                    value = struct.pack("<I", starts[tag])
                head += struct.pack("<HHI", tag, kind, len(value) // SIZES[kind])
                if len(value) <= 4:
                    head += value.ljust(4, b"\0")
                else:
                    head += struct.pack("<I", pool_at + len(pool))
                    pool += value + b"\0" * (len(value) & 1)
            out += head + bytes(4) + pool
        return bytes(out)


def pack(kind: int, values) -> bytes:
    """Values of a TIFF type, little endian."""
    if kind in (1, 2, 6, 7):
        return bytes(values)
    if kind in (5, 10):
        return b"".join(struct.pack("<II" if kind == 5 else "<ii", *pair) for pair in values)
    return struct.pack(f"<{len(values)}{_FORMATS[kind]}", *values)


def typed(kind: int, text: str) -> bytes:
    """``text`` as values of a TIFF type, in range; ValueError else."""
    if kind == 2:
        return text.encode() + b"\0"
    if kind in (11, 12):
        raise ValueError("floating point can't be written")
    try:
        if kind in (5, 10):
            pairs = []
            for part in text.split():
                n, _, d = part.partition("/")
                if not d and "." in n:
                    whole = len(n.partition(".")[2])
                    n, d = n.replace(".", ""), str(10**whole)
                pairs.append((int(n), int(d or 1)))
            if not pairs or any(d == 0 for _, d in pairs):
                raise ValueError("no rational")
            return pack(kind, pairs)
        values = [int(v) for v in text.split()]
        if not values:
            raise ValueError("no number")
        return pack(kind, values)
    except struct.error as error:
        raise ValueError(str(error)) from None
