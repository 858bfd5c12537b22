"""What a HEIF container says of its primary image; its pixels aren't decoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import HEIF_BRANDS
from .meta.containers import boxes

HEIF = "struct<width int, height int, coded_width int, coded_height int, rotation int, mirrored boolean, codec string, item_id long>"


def is_heif(data: bytes) -> bool:
    return data[4:8] == b"ftyp" and data[8:12] in HEIF_BRANDS


def facts(data: bytes) -> dict | None:
    """Size after cropping and before, turn (degrees counter-clockwise), mirroring, codec; None without a size."""
    if not is_heif(data):
        return None
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    found, properties = {}, []
    for path, a, b, _ in boxes(data):
        found.setdefault(path, (a, b))
        if path.startswith("/meta/iprp/ipco/"):
            properties.append((path.rsplit("/", 1)[1], a, b))
    if "/meta/pitm" not in found or "/meta/iprp/ipco" not in found:
        return None
    a, _ = found["/meta/pitm"]
    item = number(a + 4, 4 if data[a] else 2)
    codec = None
    if "/meta/iinf" in found:
        a, end = found["/meta/iinf"]
        for path, x, _, _ in boxes(data, a + (6 if data[a] == 0 else 8), end):
            if path == "/infe" and data[x] >= 2:
                wide = 4 if data[x] >= 3 else 2
                if number(x + 4, wide) == item:
                    codec = data[x + 6 + wide : x + 10 + wide].decode("latin-1")
    mine = []
    if "/meta/iprp/ipma" in found:
        a, _ = found["/meta/iprp/ipma"]
        wide, large, at = (4 if data[a] else 2), data[a + 3] & 1, a + 8
        for _ in range(min(number(a + 4, 4), 4096)):
            me, n = number(at, wide), data[at + wide] if at + wide < len(data) else 0
            at += wide + 1
            for _ in range(n):
                index = number(at, 2) & 0x7FFF if large else number(at, 1) & 0x7F
                at += 2 if large else 1
                if me == item and 0 < index <= len(properties):
                    mine.append(properties[index - 1])
    out = {"width": None, "height": None, "coded_width": None, "coded_height": None, "rotation": 0, "mirrored": False, "codec": codec, "item_id": item}
    for kind, a, _ in mine:
        if kind == "ispe":
            out |= {"coded_width": number(a + 4, 4), "coded_height": number(a + 8, 4)}
            out |= {"width": out["coded_width"], "height": out["coded_height"]}
    for kind, a, _ in mine:
        if kind == "clap" and number(a + 4, 4) and number(a + 12, 4):
            out |= {"width": number(a, 4) // number(a + 4, 4), "height": number(a + 8, 4) // number(a + 12, 4)}
        elif kind == "irot":
            out["rotation"] = (data[a] & 3) * 90
        elif kind == "imir":
            out["mirrored"] = True
    return out if out["width"] else None


def read(content: Column) -> Column:
    """The :data:`HEIF` struct of a binary column, null where there is no HEIF image."""
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("coded_width", pa.int32()), ("coded_height", pa.int32()), ("rotation", pa.int32()), ("mirrored", pa.bool_()), ("codec", pa.string()), ("item_id", pa.int64())])

    @F.arrow_udf(HEIF)
    def parsed(values: pa.Array) -> pa.Array:
        return pa.array([facts(v.as_py()) if v.is_valid else None for v in values], kind)

    return parsed(content)
