"""What MP4 and QuickTime files say of themselves: maker, size, creation time."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .containers import boxes

VIDEO = "struct<make string, model string, software string, width int, height int, created string>"
_PA_VIDEO = pa.struct([("make", pa.string()), ("model", pa.string()), ("software", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("created", pa.string())])
# Names of items, and of keys that items refer to by number.
ITEMS = {"\xa9mak": "make", "\xa9mod": "model", "\xa9swr": "software", "\xa9day": "created"}
KEYS = {"com.apple.quicktime.make": "make", "com.apple.quicktime.model": "model", "com.apple.quicktime.software": "software", "com.apple.quicktime.creationdate": "created"}
_EPOCH = datetime.datetime(1904, 1, 1)


def _number(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "big")


def movie_time(seconds: int) -> str | None:
    """Seconds since 1904 as EXIF writes a time; 0 stands for none."""
    try:
        return (_EPOCH + datetime.timedelta(seconds=seconds)).strftime("%Y:%m:%d %H:%M:%S") if seconds else None
    except OverflowError:
        return None


def _key_names(data: bytes, start: int, end: int) -> list[str]:
    names, at = [], start + 8
    for _ in range(min(_number(data, start + 4, 4), 4096)):
        size = _number(data, at, 4)
        if size < 8 or at + size > end:
            break
        names.append(data[at + 8 : at + size].decode("utf-8", "replace"))
        at += size
    return names


def facts(data: bytes) -> dict | None:
    """The fields of :data:`VIDEO`; None where there is no movie box. The largest track gives the size.

    A time in the movie's header goes before one in an item. Items are named, or numbered
    from 1 into the list of keys, in binary or in digits.
    """
    out: dict = dict.fromkeys(("make", "model", "software", "width", "height", "created"))
    keys: list[str] = []
    texts: dict[str, str] = {}
    seen = False
    for path, a, b, _ in boxes(data):
        kind = path.rsplit("/", 1)[1]
        if not path.startswith("/moov"):
            continue
        seen = True
        if kind == "mvhd" and b - a >= 20:
            out["created"] = out["created"] or movie_time(_number(data, a + 4, 8 if data[a] else 4))
        elif kind == "tkhd" and b - a >= 84:
            at = a + (84 if data[a] else 76)
            if at + 8 <= b:
                for name, size in (("width", _number(data, at, 4) >> 16), ("height", _number(data, at + 4, 4) >> 16)):
                    out[name] = max(out[name] or 0, size) or None
        elif kind == "keys" and b - a >= 8:
            keys = _key_names(data, a, b)
        elif kind == "ilst":
            for item, c, d, _ in boxes(data, a, b):
                name = item[1:]
                value = next((data[e + 8 : f].decode("utf-8", "replace") for inner, e, f, _ in boxes(data, c, d) if inner == "/data" and _number(data, e + 1, 3) == 1), None)
                number = int(name) if name.isdigit() and name.isascii() else int.from_bytes(name.encode("latin-1"), "big")
                field = ITEMS.get(name) or (KEYS.get(keys[number - 1]) if 0 < number <= len(keys) else None)
                if field and value:
                    texts[field] = value
    for field, value in texts.items():
        out[field] = out[field] or value
    return out if seen else None


def read(content: Column) -> Column:
    """The :data:`VIDEO` struct of a binary column; null where there is no movie."""

    @F.arrow_udf(VIDEO)
    def parsed(values: pa.Array) -> pa.Array:
        return pa.array([facts(v.as_py()) if v.is_valid else None for v in values], _PA_VIDEO)

    return parsed(content)
