"""Metadata queries over JPEG files made from ``part``, with their DuckDB counterparts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions.meta import columns as M
from ..functions.meta import vendors, video
from ..functions.meta.tables import EXIF_TAGS, GPS_TAGS, LABELS
from ..operators import pixels as P
from . import binaries
from .synthetic import pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _files(spark, sf_dir) -> DataFrame:
    """A small JPEG of each part, with EXIF, IPTC and XMP written into it."""
    packed = P.pack(pixels(spark, sf_dir), 1)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), "p_name", "p_brand", "p_size")
    coded = packed.select("image_id", I.encode(I.as_image(packed), "jpeg", 60)["data"].alias("plain")).join(part, "image_id")
    tags = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("Make", "Model", "Orientation", "ISO", "FNumber", "ExposureTime", "date", "gps", "Artist")]),
        F.array(F.lit("Loom"), "p_brand", (F.col("p_size") % 8 + 1).cast("string"), (F.col("image_id") * 100 % 65536).cast("string"), F.concat((F.col("p_size") + 10).cast("string"), F.lit("/10")), F.concat(F.lit("1/"), (F.col("p_size") * 10).cast("string")), F.lit("2024:05:06 07:08:09"), F.concat((F.col("image_id") % 90).cast("string"), F.lit(".5,-"), (F.col("image_id") % 180).cast("string"), F.lit(".25,12")), "p_name"),
    )
    with_exif = coded.select("image_id", "p_name", "p_brand", "p_size", "plain", M.set_tags(F.col("plain"), tags)["data"].alias("content"))
    items = F.array(F.struct(F.lit("Keywords").alias("name"), F.col("p_name").alias("value")), F.struct(F.lit("Keywords").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("By-line").alias("name"), F.lit("Ann").alias("value")))
    with_iptc = with_exif.withColumn("content", M.write_iptc(F.col("content"), items)["data"])
    patch = F.create_map(F.lit("dc:creator"), F.array(F.lit("Bo"), F.col("p_name")), F.lit("xmp:Label"), F.array("p_brand"))
    return with_iptc.withColumn("content", M.merge_xmp(F.col("content"), patch)["data"])


def _round_trip(spark, sf_dir):
    read = _files(spark, sf_dir).select("image_id", M.read(F.col("content")).alias("m"))
    tag = lambda name: F.try_element_at("m.tags", F.lit(name))
    return read.select("image_id", "m.camera_model", "m.orientation", tag("ISO").alias("iso"), tag("FNumber").alias("f_number"), tag("DateTimeOriginal").alias("taken"), tag("Orientation").alias("label"), F.round(F.col("m.latitude") * 100).cast("long").alias("latitude"), F.round(F.col("m.longitude") * 100).cast("long").alias("longitude"), F.col("m.is_valid").alias("is_valid"))


_labels = "CASE p_size % 8 + 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS["Orientation"].items()) + " END"
_add("meta_roundtrip", _round_trip, f"SELECT p_partkey AS image_id, 'Loom ' || p_brand AS camera_model, CAST(p_size % 8 + 1 AS INTEGER) AS orientation, CAST((p_partkey * 100) % 65536 AS VARCHAR) AS iso, 'f/' || CASE WHEN p_size % 10 = 0 THEN CAST((p_size + 10) // 10 AS VARCHAR) ELSE CAST((p_size + 10) // 10 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR) END AS f_number, '2024:05:06 07:08:09' AS taken, {_labels} AS label, CAST(p_partkey % 90 * 100 + 50 AS BIGINT) AS latitude, CAST(-(p_partkey % 180 * 100 + 25) AS BIGINT) AS longitude, true AS is_valid FROM part")


def _stripped(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("bare", M.strip(F.col("content"))["data"])
    read = files.select("image_id", "plain", "bare", M.read(F.col("bare")).alias("m"))
    return read.select("image_id", F.size("m.tags").alias("tags"), F.size("m.iptc").alias("iptc"), F.size("m.xmp").alias("xmp"), (F.col("plain") == F.col("bare")).alias("same_pixels"))


_add("meta_strip_counts", _stripped, "SELECT p_partkey AS image_id, 0 AS tags, 0 AS iptc, 0 AS xmp, true AS same_pixels FROM part")


def _iptc(spark, sf_dir):
    read = _files(spark, sf_dir).select("image_id", M.read(F.col("content")).alias("m"))
    return read.select("image_id", F.try_element_at("m.iptc", F.lit("Keywords")).alias("keywords"), F.try_element_at("m.iptc", F.lit("By-line")).alias("byline"))


_add("iptc_roundtrip", _iptc, "SELECT p_partkey AS image_id, p_name || ', ' || p_brand AS keywords, 'Ann' AS byline FROM part")


def _xmp(spark, sf_dir):
    patch = F.create_map(F.lit("xmp:Label"), F.array().cast("array<string>"), F.lit("dc:title"), F.array(F.lit("T & <t>")))
    merged = _files(spark, sf_dir).select("image_id", M.read(M.merge_xmp(F.col("content"), patch)["data"]).alias("m"))
    one = lambda name: F.try_element_at("m.xmp", F.lit(name))
    return merged.select("image_id", one("dc:creator").alias("creator"), one("dc:title").alias("title"), one("xmp:Label").alias("label"))


_add("xmp_merge", _xmp, "SELECT p_partkey AS image_id, 'Bo, ' || p_name AS creator, 'T & <t>' AS title, CAST(NULL AS VARCHAR) AS label FROM part")
_add("audit_flags", lambda s, d: _files(s, d).select("image_id", F.explode(F.array("plain", "content")).alias("c"), (F.col("plain") == F.col("content")).alias("_")).select("image_id", M.audit(M.read(F.col("c"))).alias("a")).groupBy("a.flags", "a.has_gps", "a.has_thumbnail").agg(F.count("*").alias("n")), "SELECT CAST(flags AS INTEGER) AS flags, flags > 0 AS has_gps, false AS has_thumbnail, count(*) AS n FROM part, (VALUES (0), (5)) t(flags) GROUP BY flags")

_rows = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
_add("exif_tag_dictionary", lambda s, d: M.dictionary(s), f"SELECT ifd, CAST(id AS INTEGER) AS id, name FROM (VALUES {_rows([('exif', k, v) for k, v in EXIF_TAGS.items()] + [('gps', k, v) for k, v in GPS_TAGS.items()])}) t(ifd, id, name)")


def _enum_join(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit("Flash").alias("tag"), (F.col("p_size") % 32).alias("code"))
    joined = rows.join(M.labels(spark), ["tag", "code"], "left")
    return joined.select("p_partkey", F.coalesce("label", F.concat(F.lit("Unknown ("), F.col("code").cast("string"), F.lit(")"))).alias("label"))


_add("exif_enum_join", _enum_join, f"SELECT p_partkey, coalesce(label, 'Unknown (' || CAST(p_size % 32 AS VARCHAR) || ')') AS label FROM part LEFT JOIN (VALUES {_rows(list(LABELS['Flash'].items()))}) t(code, label) ON p_size % 32 = code")
_add("exif_dates", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", M.parse_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("1700:01:01"))).alias("taken")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('second', o_orderdate) WHEN o_orderkey % 3 = 1 THEN CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) END AS taken FROM orders")
_add("exif_gps_decimal", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(1000000 * M.gps_decimal(F.col("p_size"), F.col("p_partkey") % 60, F.lit(30), F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("N"))).cast("long").alias("degrees_e6")), "SELECT p_partkey, CAST(round(1000000 * (p_size + (p_partkey % 60) / 60.0 + 30 / 3600.0) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS degrees_e6 FROM part")


def _entries(spark, sf_dir):
    named = M.exif_entries(_files(spark, sf_dir).select("image_id", "content"), "image_id")
    return named.groupBy("ifd", "tag", "type").agg(F.count("*").alias("n"), F.sum("count").alias("values"))


#: The tags that _files() writes, with their types and numbers of values; texts have one for each byte and the closing zero.
_ENTRIES_SQL = """
WITH n AS (SELECT count(*) AS n, sum(octet_length(encode(p_name)) + 1) AS names, sum(octet_length(encode(p_brand)) + 1) AS brands FROM part),
tags(ifd, tag, type, per, kind) AS (VALUES
  ('ifd0', 271, 2, 5, ''), ('ifd0', 272, 2, 0, 'brand'), ('ifd0', 274, 3, 1, ''), ('ifd0', 306, 2, 20, ''), ('ifd0', 315, 2, 0, 'name'), ('ifd0', 34665, 4, 1, ''), ('ifd0', 34853, 4, 1, ''),
  ('exif', 33434, 5, 1, ''), ('exif', 33437, 5, 1, ''), ('exif', 34855, 3, 1, ''), ('exif', 36867, 2, 20, ''), ('exif', 36868, 2, 20, ''),
  ('gps', 0, 1, 4, ''), ('gps', 1, 2, 2, ''), ('gps', 2, 5, 3, ''), ('gps', 3, 2, 2, ''), ('gps', 4, 5, 3, ''), ('gps', 5, 1, 1, ''), ('gps', 6, 5, 1, ''))
SELECT ifd, CAST(tag AS INTEGER) AS tag, CAST(type AS INTEGER) AS type, n, CAST(CASE kind WHEN 'name' THEN names WHEN 'brand' THEN brands ELSE per * n END AS BIGINT) AS values FROM tags, n
"""
_add("exif_entries", _entries, _ENTRIES_SQL)


def _made(schema: str, kind: pa.DataType):
    """An Arrow function of one column for each argument of a builder of bytes."""

    def of(build):
        @F.arrow_udf(schema)
        def run(*columns: pa.Array) -> pa.Array:
            return pa.array([build(*[v.as_py() for v in row]) for row in zip(*columns, strict=True)], kind)

        return run

    return of


def _video(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = _made("binary", pa.binary())(binaries.movie)
    files = part.select("p_partkey", made(F.col("p_partkey") * 86400 + 3000000000, (F.col("p_size") + 320).cast("long"), F.col("p_size").cast("long"), F.lit("Loom"), F.col("p_brand"), F.col("p_partkey") % 2 == 0).alias("content"))
    return files.select("p_partkey", video.read(F.col("content")).alias("v")).select("p_partkey", "v.make", "v.model", "v.width", "v.height", "v.created")


_add("video_meta", _video, "SELECT p_partkey, 'Loom' AS make, p_brand AS model, CAST(p_size + 320 AS INTEGER) AS width, CAST(p_size AS INTEGER) AS height, strftime(TIMESTAMP '1904-01-01 00:00:00' + to_seconds(p_partkey * 86400 + 3000000000), '%Y:%m:%d %H:%M:%S') AS created FROM part")


def _patched(spark, sf_dir):
    files = _files(spark, sf_dir)
    turned = M.patch_orientation(F.col("content"), (F.col("image_id") % 9).cast("int"))
    dated = M.patch_date(F.col("content"), F.concat((2000 + F.col("image_id") % 30).cast("string"), F.when(F.col("image_id") % 5 == 0, F.lit("-13-01")).otherwise(F.lit("-02-03 04:05:06"))))
    both = files.select("image_id", F.octet_length("content").alias("size"), turned.alias("o"), dated.alias("d"))
    read = both.select("image_id", "size", F.col("o.error").alias("o_error"), F.octet_length("o.data").alias("o_size"), M.read(F.col("o.data")).alias("om"), F.col("d.error").alias("d_error"), M.read(F.col("d.data")).alias("dm"))
    return read.select("image_id", "om.orientation", "o_error", (F.col("o_size") == F.col("size")).alias("same_size"), F.try_element_at("dm.tags", F.lit("DateTimeOriginal")).alias("taken"), F.try_element_at("dm.tags", F.lit("ModifyDate")).alias("changed"), "d_error")


_add("exif_patch_in_place", _patched, "SELECT image_id, CASE WHEN o > 0 THEN o END AS orientation, CASE WHEN o = 0 THEN 'an orientation is from 1 to 8' END AS o_error, CASE WHEN o > 0 THEN true END AS same_size, d AS taken, d AS changed, CASE WHEN d IS NULL THEN 'not a date' END AS d_error FROM (SELECT p_partkey AS image_id, CAST(p_partkey % 9 AS INTEGER) AS o, CASE WHEN p_partkey % 5 <> 0 THEN CAST(2000 + p_partkey % 30 AS VARCHAR) || ':02:03 04:05:06' END AS d FROM part)")


def _note(key: int, size: int) -> bytes:
    """A file of the vendor that the key chooses, one setting of which the size chooses."""
    number = lambda v, n, order="little": v.to_bytes(n, order)
    kinds = (
        ("PENTAX", b"AOC\0II", [(0x0008, 3, 1, number(size % 6, 2)), (0x0047, 6, 1, number(size, 1))]),
        ("OLYMPUS OPTICAL", b"OLYMP\0\1\0", [(0x0202, 3, 1, number(size % 3, 2)), (0x0209, 2, 8, b"CAMERA1\0")]),
        ("CASIO", b"", [(0x0004, 3, 1, number(size % 4 + 1, 2)), (0x0006, 4, 1, number(size * 250, 4))]),
        ("Minolta Co.", b"", [(0x0003, 7, 100, b"\0" * 8 + number(size % 5, 4) + b"\0" * 72 + number((2000 + size) << 16 | 5 << 8 | 6, 4) + b"\0" * 12)]),
        ("SIGMA", b"SIGMA\0\0\0\1\0", [(0x000D, 2, 9, f"Cont:+{size:02d}\0".encode()), (0x0009, 2, 2, b"A\0")]),
    )
    return binaries.tiff_with_note(*kinds[key % 5])


def _notes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    files = part.select("p_partkey", _made("binary", pa.binary())(_note)(F.col("p_partkey"), F.col("p_size")).alias("content"))
    tags = files.select("p_partkey", F.explode(M.read(F.col("content"))["tags"]).alias("name", "value"))
    return tags.where(F.col("name").contains(":"))


_pick = lambda rule, by: "CASE " + by + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rule[1].items()) + " END"
_add("makernote_vendors", _notes, " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS name, {value} AS value FROM part WHERE p_partkey % 5 = {k}" for k, name, value in (
    (0, "Pentax:Quality", _pick(vendors.PENTAX[0x0008], "p_size % 6")), (0, "Pentax:CameraTemperature", "CAST(p_size AS VARCHAR) || ' C'"),
    (1, "Olympus:Macro", _pick(vendors.OLYMPUS[0x0202], "p_size % 3")), (1, "Olympus:CameraID", "'CAMERA1'"),
    (2, "Casio:FlashMode", _pick(vendors.CASIO[0x0004], "p_size % 4 + 1")), (2, "Casio:ObjectDistance", "CAST(p_size // 4 AS VARCHAR) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END || ' m'"),
    (3, "Minolta:FlashMode", _pick(vendors.MINOLTA_SETTINGS[2], "p_size % 5")), (3, "Minolta:WhiteBalance", "'Auto'"), (3, "Minolta:MinoltaImageSize", "'Full'"), (3, "Minolta:MinoltaQuality", "'Raw'"), (3, "Minolta:DriveMode", "'Single'"), (3, "Minolta:MacroMode", "'Off'"), (3, "Minolta:DigitalZoom", "'Off'"), (3, "Minolta:FlashFired", "'No'"), (3, "Minolta:MinoltaDate", "CAST(2000 + p_size AS VARCHAR) || ':05:06'"),
    (4, "Sigma:Contrast", "'+' || lpad(CAST(p_size AS VARCHAR), 2, '0')"), (4, "Sigma:MeteringMode", "'Average'"),
)))


def _palettes(algorithm):
    def query(spark, sf_dir):
        from ..functions.palette import extract_palettes

        found = extract_palettes(pixels(spark, sf_dir), 5, algorithm, seed=3)
        return found.select("image_id", (F.size("colors") > 0).alias("some"), (F.size("colors") <= 5).alias("bounded"), "tag")

    return query


for _name in ("wu", "kmeans", "kmeans_pp", "median_cut", "octree", "neuquant"):
    _add(f"palette_bounds_{_name}", _palettes(_name), "SELECT p_partkey AS image_id, true AS some, true AS bounded, 15 AS tag FROM part")
