"""Round trips, goldens and typed errors of the codecs."""

import struct
import zlib

import numpy as np
import pytest

from pixelloom.functions import codecs
from pixelloom.functions.codecs import gif, jpeg, png, simple, tiff, webp
from pixelloom.functions.codecs.base import CodecError, image

SPACES = {"gray": 1, "rgb": 3, "rgba": 4}


def pictures():
    rng = np.random.default_rng(1)
    for w, h in ((1, 1), (5, 3), (17, 9)):
        for space, n in SPACES.items():
            ramp = np.add.outer(np.arange(h) * 7, np.arange(w) * 3)[:, :, None] + np.arange(n) * 40
            for data in (rng.integers(0, 256, (h, w, n)), ramp, np.full((h, w, n), 9)):
                yield image(data.astype(np.uint8), space)


@pytest.mark.parametrize("kind", ["png", "bmp", "qoi", "pnm", "tga"])
def test_lossless_round_trip_and_prefixes(kind):
    for img in pictures():
        try:
            data = codecs.encode(img, kind)
        except CodecError as error:
            assert error.code == "unsupported" and img.colorspace == "gray"
            continue
        back = codecs.decode(data, "tga" if kind == "tga" else None)
        expected = img.data.copy()
        if kind == "bmp" and img.channels == 4:
            expected[:, :, 3] = 255
        assert (back.data == expected).all() and back.colorspace == img.colorspace
        for cut in range(0, len(data) - 1, max(1, len(data) // 17)):
            try:
                codecs.decode(data[:cut], "tga" if kind == "tga" else None)
            except CodecError as error:
                assert error.code in ("truncated", "unsupported", "encoding", "invalid_arg")


def test_jpeg():
    ramp = image(np.add.outer(np.arange(20), np.arange(33)).astype(np.uint8)[:, :, None].repeat(3, 2), "rgb")
    data = jpeg.encode(ramp, 95)
    assert jpeg.size(data) == (33, 20)
    assert np.abs(jpeg.decode(data).data.astype(int) - ramp.data).mean() < 2
    small, w, h = codecs.decode_scaled(data, 2)
    assert (small.width, small.height, w, h) == (5, 3, 33, 20)
    assert codecs.decode_scaled(data, 30)[0].width == 33
    flat = jpeg.decode(jpeg.encode(image(np.full((8, 8, 1), 200, np.uint8), "gray"), 100), True)
    assert flat.data.tolist() == [[[200]]]
    for quality in (0, 101):
        with pytest.raises(CodecError):
            jpeg.encode(ramp, quality)
    with pytest.raises(CodecError) as error:
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc2"))
    assert error.value.code == "unsupported"


def _png(w, h, depth, kind, rows, *extra):
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + b"".join(extra) + png.chunk(b"IDAT", zlib.compress(rows)) + png.chunk(b"IEND", b"")


def test_png_filters_depths_and_palettes():
    raw = bytes((1, 5, 5, 5, 2, 1, 1, 1, 3, 1, 1, 1, 4, 1, 1, 1, 0, 9, 9, 9))
    assert png.decode(_png(3, 5, 8, 0, raw)).data[:, :, 0].tolist() == [[5, 10, 15], [6, 11, 16], [4, 8, 13], [5, 9, 14], [9, 9, 9]]
    assert png.decode(_png(4, 1, 2, 0, bytes((0, 0b00011011)))).data[:, :, 0].tolist() == [[0, 85, 170, 255]]
    assert png.decode(_png(1, 1, 16, 2, bytes((0, 1, 99, 2, 99, 3, 99)))).data.tolist() == [[[1, 2, 3]]]
    palette, alpha = png.chunk(b"PLTE", bytes(range(6))), png.chunk(b"tRNS", b"\x07")
    assert png.decode(_png(2, 1, 1, 3, bytes((0, 0b01000000)), palette, alpha)).data.tolist() == [[[0, 1, 2, 7], [3, 4, 5, 255]]]
    broken = bytearray(_png(1, 1, 8, 0, b"\0\0"))
    broken[-1] ^= 1
    with pytest.raises(CodecError):
        png.decode(bytes(broken))


def test_pnm_kinds():
    assert simple.decode_pnm(b"P1\n# c\n3 1\n1 0 1\n").data[:, :, 0].tolist() == [[0, 255, 0]]
    assert simple.decode_pnm(b"P2 2 1 15\n0 15\n").data[:, :, 0].tolist() == [[0, 255]]
    assert simple.decode_pnm(b"P3 1 1 255\n1 2 3\n").data.tolist() == [[[1, 2, 3]]]
    assert simple.decode_pnm(b"P4 3 1\n\xa0").data[:, :, 0].tolist() == [[0, 255, 0]]
    assert simple.decode_pnm(b"P5 1 1 65535\n\xff\xff").data.tolist() == [[[255]]]
    with pytest.raises(CodecError):
        simple.decode_pnm(b"P5 2 2 255\n\0")


def test_gif_pcx_hdr():
    palette = bytes((0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255))
    # codes 4 (clear), 1, 2, 3, 5 (end) of three bits
    body = (4 | 1 << 3 | 2 << 6 | 3 << 9 | 5 << 12).to_bytes(2, "little")
    data = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0x81, 0, 0) + palette + b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 1, 0) + b"\x02\x02" + body + b"\0;"
    assert gif.decode(data).data.tolist() == [[[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]]]
    head = bytearray(128)
    head[:4], head[4:12], head[65], head[66:68] = b"\x0a\x05\x01\x08", struct.pack("<4H", 0, 0, 1, 0), 3, struct.pack("<H", 2)
    assert simple.decode_pcx(bytes(head) + bytes((0xC2, 7, 1, 2, 0xC1, 0xC5, 3))).data.tolist() == [[[7, 1, 0xC5], [7, 2, 3]]]
    hdr = simple.decode_hdr(b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + bytes((128, 64, 32, 129, 5, 5, 5, 0)))
    assert hdr.data.tolist() == [[[128.5 / 128, 64.5 / 128, 32.5 / 128], [0, 0, 0]]]


def _tiff(entries, body, order="<"):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    out = struct.pack(order + "H", len(entries))
    for tag, kind, n, value in sorted(entries):
        out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return mark + struct.pack(order + "I", 8) + out + bytes(4) + body


def test_tiff_compressions_and_tiles():
    def build(compression, body, order="<", **more):
        tags = {256: (4, 4), 257: (4, 1), 258: (3, 8), 259: (3, compression), 262: (3, 1), 273: (4, 0), 277: (3, 1), 278: (4, 1), 279: (4, len(body))} | more.get("tags", {})
        start = 8 + 2 + 12 * len(tags) + 4
        for offset in (273, 324):
            if offset in tags:
                tags[offset] = (4, start)
        return _tiff([(t, k, 1, v) for t, (k, v) in tags.items()], body, order)

    plain = bytes((1, 2, 3, 4))
    for order in "<>":
        assert tiff.decode(build(1, plain, order)).data[0, :, 0].tolist() == [1, 2, 3, 4]
    assert tiff.decode(build(8, zlib.compress(plain))).data[0, :, 0].tolist() == [1, 2, 3, 4]
    assert tiff.decode(build(32773, bytes((0xFD, 9)))).data[0, :, 0].tolist() == [9] * 4
    assert tiff.decode(build(1, bytes((1, 1, 1, 1)), tags={317: (3, 2)})).data[0, :, 0].tolist() == [1, 2, 3, 4]
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 7, 257))
    packed = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    assert tiff.decode(build(5, packed)).data[0, :, 0].tolist() == [7, 7, 7, 7]
    with pytest.raises(CodecError) as error:
        tiff.decode(build(7, plain))
    assert error.value.code == "unsupported"


def test_webp_solid_colour():
    """A VP8L image of one colour, all five codes with a single symbol."""
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n))
    put(1, 14), put(0, 14), put(0, 1), put(0, 3)
    put(0, 1), put(0, 1), put(0, 1)
    for symbol in (50, 10, 90, 255, 0):
        put(1, 1), put(0, 1), put(1, 1), put(symbol, 8)
    raw = b"\x2f" + bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8)) + b"\0"
    raw += b"\0" * (len(raw) & 1)
    data = b"RIFF" + (len(raw) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw
    assert webp.decode(data).data.tolist() == [[[10, 50, 90], [10, 50, 90]]]
    with pytest.raises(CodecError) as error:
        webp.decode(data.replace(b"VP8L", b"VP8 "))
    assert error.value.code == "unsupported"
    near = webp._near()
    assert len(near) == 120 and near[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and near[-1] == (8, 7)


def test_dispatch():
    for data, code in ((b"", "truncated"), (b"\0\1\2\3", "unsupported"), (b"\0\0\0\x18ftypheic", "unsupported")):
        with pytest.raises(CodecError) as error:
            codecs.decode(data)
        assert error.value.code == code
    assert codecs.format_of_path("a/B.JPG") == "jpeg"
    with pytest.raises(CodecError):
        codecs.format_of_path("a.pbm")
    with pytest.raises(CodecError):
        codecs.decode(b"BM" + bytes(60), "png")


def test_image_columns(spark):
    from pyspark.sql import functions as F

    from pixelloom.functions import images as I

    good = codecs.encode(image(np.arange(12, dtype=np.uint8).reshape(2, 2, 3), "rgb"), "png")
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"BM")), (3, None)], "id int, content binary")
    out = {r.id: r for r in rows.select("id", I.sniff(F.col("content")).alias("f"), I.decode(F.col("content")).alias("img")).collect()}
    assert out[1].f == "png" and out[1].img.width == 2 and out[1].img.error is None
    assert out[2].img.error.code == "truncated" and out[2].img.data is None
    assert out[3].img is None and out[3].f is None
    small = rows.where("id = 1").select(I.encode(I.transform(I.decode(F.col("content")), "crop", 5, 0, 1, 1), "png").alias("e")).first().e
    assert small.error.code == "invalid_arg"
