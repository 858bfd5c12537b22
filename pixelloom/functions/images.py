"""Packed images as columns: sniffing in SQL, decoding, transforms and encoding by Arrow.

An image is ``struct<width, height, channels, colorspace, data, error struct<code, msg>>``.
With ``mode="permissive"``, the default, a bad input has null fields and an error; with
``failfast`` it fails the query. A null input gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codecs, kernels

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("msg", T.StringType())])
IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("colorspace", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("error", ERROR)])
BLOB = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", ERROR)])
_ERROR = pa.struct([("code", pa.string()), ("msg", pa.string())])
_IMAGE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("colorspace", pa.string()), ("data", pa.binary()), ("error", _ERROR)])
_BLOB = pa.struct([("data", pa.binary()), ("error", _ERROR)])


def sniff(content: Column) -> Column:
    """The format of a binary column by its first bytes, null if unknown: all in SQL."""
    starts = lambda hexed: F.startswith(content, F.unhex(F.lit(hexed)))
    brand = F.substring(content, 9, 4).isin([F.unhex(F.lit(b.hex())) for b in codecs.HEIF_BRANDS])
    rules = [("bmp", starts("424D")), ("qoi", starts("716F6966"))]
    rules += [("pnm", F.substring(content, 1, 2).isin([F.unhex(F.lit(f"503{d}")) for d in range(1, 8)]))]
    rules += [("png", starts("89504E470D0A1A0A")), ("jpeg", starts("FFD8")), ("heif", (F.substring(content, 5, 4) == F.unhex(F.lit("66747970"))) & brand), ("gif", starts("47494638"))]
    rules += [("webp", starts("52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))), ("tiff", starts("49492A00") | starts("4D4D002A")), ("pcx", starts("0A"))]
    case = None
    for name, rule in rules:
        case = F.when(rule, name) if case is None else case.when(rule, name)
    return F.when(F.octet_length(content) >= 2, case)


def _guarded(mode: str, one: Callable):
    """``one`` of some values, or an error's (code, message); null of a null first value."""
    if mode not in ("permissive", "failfast"):
        raise ValueError("mode: permissive or failfast")

    def run(*values):
        if values[0] is None:
            return None
        try:
            return one(*values)
        except codecs.CodecError as error:
            if mode == "failfast":
                raise
            return error.code, str(error)

    return run


def _binary(parts: list[np.ndarray | bytes | None]) -> pa.Array:
    """A binary array from buffers, each copied once."""
    sizes = np.array([0 if p is None else p.nbytes if isinstance(p, np.ndarray) else len(p) for p in parts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of images has to be under 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    data = np.empty(int(ends[-1]), np.uint8)
    for p, start, end in zip(parts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end > start:
            data[start:end] = p.reshape(-1) if isinstance(p, np.ndarray) else np.frombuffer(p, np.uint8)
    there = np.array([p is not None for p in parts], bool)
    return pa.Array.from_buffers(pa.binary(), len(parts), [_bits(there), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)], int((~there).sum()))


def _bits(there: np.ndarray) -> pa.Buffer | None:
    return None if there.all() else pa.py_buffer(np.packbits(there, bitorder="little"))


def _struct(kind: pa.StructType, columns: list[pa.Array], there: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(columns, fields=[kind.field(i) for i in range(kind.num_fields)], mask=None if there.all() else pa.array(~there))


def _errors(found: list) -> pa.Array:
    failed = [x if isinstance(x, tuple) else (None, None) for x in found]
    return _struct(_ERROR, [pa.array([x[i] for x in failed], pa.string()) for i in range(2)], np.array([isinstance(x, tuple) for x in found], bool))


def _images(found: list) -> pa.Array:
    """Images, errors' (code, message) and nulls as an array; pixels are copied once, from their own buffers."""
    good = [x if isinstance(x, codecs.Image) else None for x in found]
    columns = [pa.array([None if x is None else getattr(x, name) for x in good], kind) for name, kind in (("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("colorspace", pa.string()))]
    columns += [_binary([None if x is None else np.ascontiguousarray(x.data).reshape(-1).view(np.uint8) for x in good]), _errors(found)]
    return _struct(_IMAGE, columns, np.array([x is not None for x in found], bool))


def _blobs(found: list) -> pa.Array:
    return _struct(_BLOB, [_binary([x if isinstance(x, bytes | bytearray) else None for x in found]), _errors(found)], np.array([x is not None for x in found], bool))


def _views(values: pa.Array) -> list[memoryview | None]:
    """The bytes of a binary array, in place."""
    return [memoryview(v.as_buffer()) if v.is_valid else None for v in values]


def _whole(values: pa.Array) -> list[Callable[[], codecs.Image] | None]:
    """Of each image struct a function that gives the image, or raises its error; pixels stay where they are."""
    fields = {name: values.field(name) for name in ("width", "height", "colorspace", "error")}
    plain = {name: field.to_pylist() for name, field in fields.items()}
    data, there = _views(values.field("data")), values.is_valid().to_pylist()

    def of(i: int) -> codecs.Image:
        error = plain["error"][i]
        if error is not None or data[i] is None:
            raise codecs.CodecError((error or {}).get("code") or "invalid_arg", (error or {}).get("msg") or "no image")
        return codecs.from_pixels(plain["width"][i], plain["height"][i], plain["colorspace"][i], data[i])

    return [(lambda i=i: of(i)) if there[i] else None for i in range(len(values))]


def decode(content: Column, hint: str | None = None, mode: str = "permissive") -> Column:
    one = _guarded(mode, lambda data: codecs.decode(bytes(data), hint))

    @F.arrow_udf(IMAGE)
    def decoded(values: pa.Array) -> pa.Array:
        return _images([one(v) for v in _views(values)])

    return decoded(content)


def decode_scaled(content: Column, max_edge: int, mode: str = "permissive") -> Column:
    """Like :func:`decode`; JPEG an eighth as large where both sides keep ``max_edge`` pixels."""
    one = _guarded(mode, lambda data: codecs.decode_scaled(bytes(data), max_edge)[0])

    @F.arrow_udf(IMAGE)
    def decoded(values: pa.Array) -> pa.Array:
        return _images([one(v) for v in _views(values)])

    return decoded(content)


def transform(img: Column, op: str, *args, mode: str = "permissive") -> Column:
    """``crop``, ``dihedral``, ``orient``, ``resize`` of an image column."""
    kernel = {"crop": kernels.crop, "dihedral": kernels.dihedral, "orient": kernels.orient, "resize": kernels.resize}[op]
    one = _guarded(mode, lambda x: kernel(x(), *args))

    @F.arrow_udf(IMAGE)
    def changed(values: pa.Array) -> pa.Array:
        return _images([one(x) for x in _whole(values)])

    return changed(img)


def composite_over(dst: Column, src: Column, x: int = 0, y: int = 0, opacity: int = 255, mode: str = "permissive") -> Column:
    one = _guarded(mode, lambda a, b: kernels.composite_over(a(), b(), x, y, opacity))

    @F.arrow_udf(IMAGE)
    def over(below: pa.Array, above: pa.Array) -> pa.Array:
        return _images([one(a, b) if b is not None else None for a, b in zip(_whole(below), _whole(above), strict=True)])

    return over(dst, src)


def encode(img: Column, kind: str, quality: int = 90, mode: str = "permissive") -> Column:
    """``struct<data, error>`` of an image column as png, jpeg, bmp, qoi, pnm or tga."""
    one = _guarded(mode, lambda x: codecs.encode(x(), kind, quality))

    @F.arrow_udf(BLOB)
    def encoded(values: pa.Array) -> pa.Array:
        return _blobs([one(x) for x in _whole(values)])

    return encoded(img)


def as_image(df: DataFrame) -> Column:
    """The image struct of packed columns, as :func:`pixelloom.operators.pixels.pack` makes them."""
    return F.struct("width", "height", "channels", "colorspace", "data", F.lit(None).cast(ERROR).alias("error"))


def encode_pnm_sql(df: DataFrame) -> Column:
    """P5, P6 or P7 of packed columns without Python: a header and the bytes."""
    plain = F.concat(F.when(F.col("channels") == 1, "P5\n").otherwise("P6\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n"))
    pam = F.concat(F.lit("P7\nWIDTH "), F.col("width").cast("string"), F.lit("\nHEIGHT "), F.col("height").cast("string"), F.lit("\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"))
    return F.concat(F.encode(F.when(F.col("channels") == 4, pam).otherwise(plain), "US-ASCII"), F.col("data"))
