"""Values overwritten where they stand: no byte beside them moves or changes."""

from __future__ import annotations

import re

from . import containers, exif

ORIENTATION, DATE_TIME, DATE_TIME_ORIGINAL = 0x0112, 0x0132, 0x9003
_DATE = re.compile(r"(\d{4})[:-](\d\d)[:-](\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d))?)?")


def _tags(data: bytes) -> tuple[int, list[exif.Tag]]:
    found = containers.locate(data)
    if not found or not exif.byte_order(data[found[0] : found[0] + 4]):
        raise ValueError("no EXIF data")
    return found[0], exif.entries(data[slice(*found)])


def orientation(data: bytes, value: int) -> bytes:
    """A JPEG file with another orientation; ValueError where it has no such tag, or ``value`` isn't from 1 to 8."""
    if value is None or not 1 <= value <= 8:
        raise ValueError("an orientation is from 1 to 8")
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("not a JPEG file")
    start, tags = _tags(data)
    tag = next((t for t in tags if t.id == ORIENTATION and t.ifd not in ("exif", "gps")), None)
    if tag is None or tag.type != 3:
        raise ValueError("no orientation to overwrite")
    at = start + tag.at
    return data[:at] + value.to_bytes(2, tag.order) + data[at + 2 :]


def date_time(data: bytes, text: str) -> bytes:
    """A JPEG, TIFF or ISO media file with other times (of taking, of change); ValueError where it has neither."""
    parts = _DATE.fullmatch((text or "").strip())
    if not parts:
        raise ValueError("not a date")
    year, month, day, hour, minute, second = (x or "00" for x in parts.groups())
    if not ("01" <= month <= "12" and "01" <= day <= "31" and hour < "24" and minute < "60" and second < "60"):
        raise ValueError("not a date")
    new = f"{year}:{month}:{day} {hour}:{minute}:{second}".encode() + b"\0"
    start, tags = _tags(data)
    places = [start + t.at for t in tags if t.id in (DATE_TIME, DATE_TIME_ORIGINAL) and t.type == 2 and t.count == len(new)]
    if not places:
        raise ValueError("no time to overwrite")
    for at in places:
        data = data[:at] + new + data[at + len(new) :]
    return data
