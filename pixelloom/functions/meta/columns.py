"""Metadata as columns: structs and maps from binary content, and files from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, exif, makernotes, patch, video, xmp
from .tables import EXIF_TAGS, GPS_TAGS, IPTC_NAMES, LABELS, WRITABLE

_MAP, _PA_MAP = "map<string,string>", pa.map_(pa.string(), pa.string())
META = f"struct<is_valid boolean, camera_model string, software string, orientation int, latitude double, longitude double, altitude double, tags {_MAP}, iptc {_MAP}, xmp {_MAP}, thumbnail binary>"
_PA_META = pa.struct([("is_valid", pa.bool_()), ("camera_model", pa.string()), ("software", pa.string()), ("orientation", pa.int32()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("altitude", pa.float64()), ("tags", _PA_MAP), ("iptc", _PA_MAP), ("xmp", _PA_MAP), ("thumbnail", pa.binary())])
FILE = "struct<data binary, error string>"
_PA_FILE = pa.struct([("data", pa.binary()), ("error", pa.string())])


def metadata_of(data: bytes) -> dict:
    """All that :data:`META` holds, of one file."""
    tiff = containers.tiff_of(data)
    tags, plain = exif.named(tiff) if tiff else ({}, {})
    if tiff:
        tags |= makernotes.parse(tiff, plain.get("Make", ""), plain.get("Model", ""))
    movie = video.facts(data) if data[4:8] in (b"ftyp", b"moov", b"wide", b"mdat") else None
    if movie:
        named = {"Make": movie["make"], "Model": movie["model"], "Software": movie["software"]}
        tags |= {k: str(v) for k, v in (named | {"ImageWidth": movie["width"], "ImageHeight": movie["height"], "CreateDate": movie["created"]}).items() if v}
        plain |= {k: v for k, v in named.items() if v}
    latitude, longitude, altitude = exif.gps(plain)
    iptc: dict[str, list[str]] = {}
    for number, value in containers.iptc_datasets(data):
        iptc.setdefault(IPTC_NAMES.get(number, f"Dataset{number}"), []).append(value)
    packet = containers.xmp_packet(data)
    camera = " ".join(plain[k] for k in ("Make", "Model") if plain.get(k))
    return {
        "is_valid": bool(tags),
        "camera_model": camera or None,
        "software": plain.get("Software"),
        "orientation": int(plain["Orientation"]) if plain.get("Orientation", "").isdigit() else None,
        "latitude": latitude,
        "longitude": longitude,
        "altitude": altitude,
        "tags": sorted(tags.items()),
        "iptc": [(k, ", ".join(v)) for k, v in sorted(iptc.items())],
        "xmp": [(k, ", ".join(v)) for k, v in sorted(xmp.properties(packet).items())] if packet else [],
        "thumbnail": exif.thumbnail(tiff) if tiff else None,
    }


def read(content: Column) -> Column:
    """The :data:`META` struct of a binary column; null of null, ``is_valid`` false without EXIF."""

    @F.arrow_udf(META)
    def parsed(values: pa.Array) -> pa.Array:
        return pa.array([metadata_of(v.as_py()) if v.is_valid else None for v in values], _PA_META)

    return parsed(content)


def _file(one, content: Column, *more: Column) -> Column:
    @F.arrow_udf(FILE)
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for values in zip(*columns, strict=True):
            data, *rest = [v.as_py() for v in values]
            if data is None:
                out.append(None)
                continue
            try:
                out.append({"data": one(data, *rest), "error": None})
            except ValueError as error:
                out.append({"data": None, "error": str(error)})
        return pa.array(out, _PA_FILE)

    return run(content, *more)


def strip(content: Column) -> Column:
    """``struct<data, error>``: the file without its metadata."""
    return _file(containers.strip, content)


def set_tags(content: Column, tags: Column) -> Column:
    """The file with EXIF tags of a name-to-text map set; ``gps`` takes "lat,lon[,alt]", ``date`` sets three tags."""

    def one(data: bytes, pairs) -> bytes:
        tree = exif.ExifData.parse(containers.tiff_of(data))
        for name, value in dict(pairs or {}).items():
            if name == "gps":
                tree.set_gps(*map(float, value.split(",")))
            elif name == "date":
                tree.set_date(value)
            else:
                tree.set(name, value)
        return containers.write_exif(data, tree.serialize())

    return _file(one, content, tags)


def patch_orientation(content: Column, value: Column) -> Column:
    """The JPEG file with its orientation overwritten where it stands."""
    return _file(patch.orientation, content, value)


def patch_date(content: Column, text: Column) -> Column:
    """The file with its times overwritten where they stand."""
    return _file(patch.date_time, content, text)


def delete_exif(content: Column) -> Column:
    return _file(lambda data: containers.write_exif(data, exif.ExifData().serialize()), content)


def merge_xmp(content: Column, patch: Column) -> Column:
    """The JPEG with an XMP patch: ``map<string, array<string>>``, an empty array removes."""
    return _file(lambda data, pairs: containers.write_xmp(data, xmp.merge(containers.xmp_packet(data), dict(pairs or {}))), content, patch)


def write_iptc(content: Column, items: Column) -> Column:
    """The JPEG with IPTC data from ``array<struct<name, value>>``, in order."""
    numbers = {name: n for n, name in IPTC_NAMES.items()}

    def one(data: bytes, rows) -> bytes:
        if unknown := [r["name"] for r in rows if r["name"] not in numbers]:
            raise ValueError(f"unknown IPTC name {unknown[0]}")
        return containers.write_iptc(data, [(numbers[r["name"]], r["value"]) for r in rows])

    return _file(one, content, items)


def to_json(meta: Column) -> Column:
    return F.to_json(meta, {"pretty": "true"})


def exif_entries(df: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """``(id, ifd, tag, type, count, data_offset, raw, endian)``: a row for each directory entry."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, ifd string, tag int, type int, count long, data_offset long, raw binary, endian string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tag in exif.entries(containers.tiff_of(data) or b"") if data else []:
                    for column, value in zip(out, (key, tag.ifd, tag.id, tag.type, tag.count, tag.at, tag.raw, tag.order), strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return df.select(id_col, content_col).mapInArrow(run, schema)


def dictionary(spark: SparkSession) -> DataFrame:
    """``(ifd, id, name)`` of all known tags: a fixed table."""
    rows = [("exif", k, v) for k, v in EXIF_TAGS.items()] + [("gps", k, v) for k, v in GPS_TAGS.items()]
    return spark.createDataFrame(rows, "ifd string, id int, name string")


def labels(spark: SparkSession) -> DataFrame:
    """``(tag, code, label)``: a fixed table."""
    return spark.createDataFrame([(t, c, label) for t, m in LABELS.items() for c, label in m.items()], "tag string, code int, label string")


def writable(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in WRITABLE.items()], "name string, ifd string, id int, type int")


def parse_date(text: Column) -> Column:
    """An EXIF date in one of five forms; null where it is none or before 1900."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd")
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]).cast("timestamp_ntz")
    return F.when(F.year(found) >= 1900, found)


def mp4_time(seconds: Column) -> Column:
    """Seconds since 1904 as a timestamp without a zone."""
    return F.timestamp_add("SECOND", seconds, F.lit("1904-01-01 00:00:00").cast("timestamp_ntz"))


def gps_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    return (d + m / 60 + s / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def audit(meta: Column) -> Column:
    """``struct`` of the six privacy flags and their number."""
    flags = {
        "has_gps": meta["latitude"].isNotNull() & meta["longitude"].isNotNull(),
        "has_camera": meta["camera_model"].isNotNull(),
        "has_artist": F.try_element_at(meta["tags"], F.lit("Artist")).isNotNull(),
        "has_byline": F.try_element_at(meta["iptc"], F.lit("By-line")).isNotNull(),
        "has_creator": F.try_element_at(meta["xmp"], F.lit("dc:creator")).isNotNull(),
        "has_thumbnail": meta["thumbnail"].isNotNull(),
    }
    total = None
    for flag in flags.values():
        total = flag.cast("int") if total is None else total + flag.cast("int")
    return F.struct(*[flag.alias(name) for name, flag in flags.items()], total.alias("flags"))
