"""Byte readers, writers and checksums as SQL expressions; inflate and deflate by Arrow.

Offsets count from 0. A read that isn't wholly inside the value gives 0.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _read(data: Column, at: Column | int, n: int, little: bool) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.lpad(F.hex(F.substring(data, at + i + 1, F.lit(1))), 2, "0") for i in range(n)]
    value = F.conv(F.concat(*(parts[::-1] if little else parts)), 16, 10).cast("long")
    return F.when((at >= 0) & (at + n <= F.octet_length(data)), value).otherwise(F.lit(0).cast("long"))


def u16le(data: Column, at) -> Column:
    return _read(data, at, 2, True)


def u16be(data: Column, at) -> Column:
    return _read(data, at, 2, False)


def u32le(data: Column, at) -> Column:
    return _read(data, at, 4, True)


def u32be(data: Column, at) -> Column:
    return _read(data, at, 4, False)


def i32le(data: Column, at) -> Column:
    v = u32le(data, at)
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def put(value: Column, n: int, little: bool) -> Column:
    """``value`` as ``n`` bytes."""
    hexed = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 8 * n))), 2 * n, "0")
    if little:
        hexed = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    return F.unhex(hexed)


def crc32(data: Column) -> Column:
    return F.crc32(data)


def png_chunk(kind: str, body: Column) -> Column:
    tagged = F.concat(F.lit(kind.encode()), body)
    return F.concat(put(F.octet_length(body), 4, False), tagged, put(F.crc32(tagged), 4, False))


def _codec(one):
    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v.as_py() is None else one(v.as_py()) for v in values], pa.binary())

    return run


def _bounded(data: bytes, wbits: int, limit: int) -> bytes | None:
    stream = zlib.decompressobj(wbits)
    try:
        out = stream.decompress(data, limit + 1)
    except zlib.error:
        return None
    return out if stream.eof and len(out) <= limit else None


def inflate(data: Column, limit: int = 1 << 24) -> Column:
    """Raw DEFLATE; null where the stream is broken, not ended or longer than ``limit``."""
    return _codec(lambda b: _bounded(b, -15, limit))(data)


def zlib_inflate(data: Column, limit: int = 1 << 24) -> Column:
    return _codec(lambda b: _bounded(b, 15, limit))(data)


def inflate_consumed(data: bytes, at: int = 0, limit: int = 1 << 24) -> tuple[bytes, int]:
    """(output, offset after the stream) of raw DEFLATE from ``at``."""
    stream = zlib.decompressobj(-15)
    out = stream.decompress(data[at:], limit)
    if not stream.eof:
        raise ValueError("the stream isn't ended or its output is too long")
    return out, len(data) - len(stream.unused_data)


def deflate(data: Column) -> Column:
    """Raw DEFLATE with fixed codes: the same bytes for the same input."""

    def one(b: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15, 8, zlib.Z_FIXED)
        return c.compress(b) + c.flush()

    return _codec(one)(data)


def zlib_deflate(data: Column) -> Column:
    return _codec(zlib.compress)(data)


def register(spark: SparkSession) -> None:
    """Make the readers callable from SQL as ``u16le(bin, at)`` and so on."""
    for name, n, little in (("u16le", 2, True), ("u16be", 2, False), ("u32le", 4, True), ("u32be", 4, False)):
        order = range(n - 1, -1, -1) if little else range(n)
        hexed = ", ".join(f"lpad(hex(substr(bin, at + {i + 1}, 1)), 2, '0')" for i in order)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(bin BINARY, at INT) RETURNS BIGINT RETURN IF(at >= 0 AND at + {n} <= octet_length(bin), CAST(conv(concat({hexed}), 16, 10) AS BIGINT), 0L)")
