"""Codec, packed-image and byte queries, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import images as I
from ..operators import pixels as P
from . import pixel_queries
from .synthetic import IMAGES_SQL, PIXELS_SQL, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _packed(spark, sf_dir, channels: int = 4) -> DataFrame:
    packed = P.pack(pixels(spark, sf_dir), channels)
    return packed.select("image_id", I.as_image(packed).alias("img"))


def _exploded(df: DataFrame) -> DataFrame:
    return P.explode_pixels(df.select("image_id", "img.*"))


def _round_trip(kind: str, channels: int):
    def query(spark, sf_dir):
        coded = _packed(spark, sf_dir, channels).select("image_id", I.encode(F.col("img"), kind)["data"].alias("content"))
        return _exploded(coded.select("image_id", I.decode(F.col("content"), "tga" if kind == "tga" else None).alias("img")))

    return query


_SPACES = {1: "r, r AS g, r AS b, 255 AS a", 3: "r, g, b, 255 AS a", 4: "r, g, b, a"}
for _kind, _spaces in (("png", (1, 3, 4)), ("bmp", (3, 4)), ("qoi", (3, 4)), ("pnm", (1, 3, 4)), ("tga", (1, 3, 4))):
    for _n in _spaces:
        _columns = _SPACES[3] if _kind == "bmp" else _SPACES[_n]
        _add(f"codec_roundtrip_{_kind}_{('gray', 'rgb', 'rgba')[(1, 3, 4).index(_n)]}", _round_trip(_kind, _n), f"SELECT image_id, w, h, y, x, {_columns} FROM ({PIXELS_SQL})")


def _jpeg(spark, sf_dir):
    coded = _packed(spark, sf_dir, 3).select("image_id", I.encode(F.col("img"), "jpeg", 90)["data"].alias("content"))
    full, small = I.decode(F.col("content")), I.decode_scaled(F.col("content"), 1)
    both = coded.select("image_id", full.alias("f"), small.alias("s"))
    return both.select("image_id", F.col("f.width").alias("w"), F.col("f.height").alias("h"), F.col("s.width").alias("w8"), F.col("s.height").alias("h8"), F.col("f.colorspace").alias("colorspace"))


_add("jpeg_roundtrip_dims", _jpeg, f"SELECT image_id, w, h, CAST(ceil(w / 8.0) AS INTEGER) AS w8, CAST(ceil(h / 8.0) AS INTEGER) AS h8, 'rgb' AS colorspace FROM ({IMAGES_SQL})")


def _pnm(spark, sf_dir):
    packed = P.pack(pixels(spark, sf_dir), 3)
    return packed.select("image_id", F.hex(I.encode_pnm_sql(packed)).alias("pnm"))


_add("pnm_encode_hex", _pnm, f"SELECT image_id, hex(encode('P6' || chr(10) || CAST(w AS VARCHAR) || ' ' || CAST(h AS VARCHAR) || chr(10) || '255' || chr(10))) || string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x) AS pnm FROM ({PIXELS_SQL}) GROUP BY image_id, w, h")

for _name, _op, _args, _like in (
    ("crop", "crop", (1, 1, 3, 2), "px_crop"),
    ("rot90", "dihedral", ("rot90",), "px_rot90"),
    ("orient_7", "orient", (7,), "px_orient_7"),
    ("resize_nearest", "resize", (7, 5, "nearest"), "px_resize_nearest"),
    ("resize_bilinear", "resize", (7, 5, "bilinear"), "px_resize_bilinear_rgba"),
    ("resize_box", "resize", (7, 5, "box"), "px_resize_box_rgba"),
):
    _add(f"packed_{_name}", lambda s, d, op=_op, args=_args: _exploded(_packed(s, d).select("image_id", I.transform(F.col("img"), op, *args).alias("img")).where("img.error IS NULL")), pixel_queries.ORACLE_SQL[_like])


def _packed_composite(spark, sf_dir):
    below = _packed(spark, sf_dir)
    above = P.pack(pixel_queries._source(pixels(spark, sf_dir), "alpha"), 4)
    above = above.select("image_id", I.as_image(above).alias("over"))
    return _exploded(below.join(above, "image_id").select("image_id", I.composite_over(F.col("img"), F.col("over"), 1, 1, 192).alias("img")))


_add("packed_composite", _packed_composite, pixel_queries.ORACLE_SQL["px_composite_opacity192"])

# One broken input for each way to fail, and what is said of it.
_BROKEN = (("424D", "truncated"), ("89504E470D0A1A0A", "truncated"), ("0001020304", "unsupported"), ("00", "truncated"), ("FFD8FFD9FFFF", "truncated"), ("716F696600000001000000010300", "truncated"), ("50360A310A", "truncated"), ("474946383961", "truncated"), ("524946460000000057454250", "truncated"), ("49492A00FF000000", "truncated"), ("000000186674797068656963", "unsupported"))


def _errors(spark, sf_dir):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(_BROKEN)], "id int, hexed string")
    return rows.select("id", I.decode(F.unhex("hexed"))["error"]["code"].alias("code"))


_add("codec_error_codes", _errors, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(_BROKEN)) + ") t(id, code)")

_MAGIC = (("424D0000", "bmp"), ("716F6966", "qoi"), ("5037", "pnm"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("0000001866747970686569630000", "heif"), ("47494638", "gif"), ("524946460000000057454250", "webp"), ("4D4D002A", "tiff"), ("0A05", "pcx"), ("1234", None), ("42", None))


def _sniffed(spark, sf_dir):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(_MAGIC)], "id int, hexed string")
    return rows.select("id", I.sniff(F.unhex("hexed")).alias("format"))


_add("sniff_format", _sniffed, "SELECT * FROM (VALUES " + ", ".join(f"({i}, {repr(f) if f else 'NULL'})" for i, (_, f) in enumerate(_MAGIC)) + ") t(id, format)")


def _reads(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.encode("p_name", "UTF-8").alias("d"))
    return rows.select("p_partkey", B.u16le(F.col("d"), 1).alias("u16le"), B.u16be(F.col("d"), 1).alias("u16be"), B.u32le(F.col("d"), 2).alias("u32le"), B.u32be(F.col("d"), 2).alias("u32be"), B.u32be(F.col("d"), 1000).alias("outside"), F.hex(B.put(F.col("p_partkey"), 4, True)).alias("put32le"))


_byte = lambda i: f"CAST(('0x' || substr(hex(encode(p_name)), {2 * i + 1}, 2)) AS BIGINT)"
_add("bytes_read", _reads, f"SELECT p_partkey, {_byte(1)} + 256 * {_byte(2)} AS u16le, 256 * {_byte(1)} + {_byte(2)} AS u16be, {_byte(2)} + 256 * {_byte(3)} + 65536 * {_byte(4)} + 16777216 * {_byte(5)} AS u32le, 16777216 * {_byte(2)} + 65536 * {_byte(3)} + 256 * {_byte(4)} + {_byte(5)} AS u32be, CAST(0 AS BIGINT) AS outside, printf('%02X%02X%02X%02X', p_partkey % 256, p_partkey // 256 % 256, p_partkey // 65536 % 256, p_partkey // 16777216 % 256) AS put32le FROM part")
_add("bytes_crc32", lambda s, d: s.createDataFrame([("IEND",), ("123456789",), ("",)], "t string").select("t", B.crc32(F.encode("t", "UTF-8")).alias("crc")), "SELECT * FROM (VALUES ('IEND', CAST(2923585666 AS BIGINT)), ('123456789', CAST(3421780262 AS BIGINT)), ('', CAST(0 AS BIGINT))) t(t, crc)")


def _zlib(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.encode("p_name", "UTF-8").alias("d"))
    return rows.select("p_partkey", B.inflate(B.deflate(F.col("d"))).cast("string").alias("raw"), B.zlib_inflate(B.zlib_deflate(F.col("d"))).cast("string").alias("zlib"), B.zlib_inflate(F.col("d")).isNull().alias("broken"))


_add("bytes_deflate_roundtrip", _zlib, "SELECT p_partkey, p_name AS raw, p_name AS zlib, true AS broken FROM part")
