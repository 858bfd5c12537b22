"""Format dispatch over the codecs."""

from __future__ import annotations

from . import gif, jpeg, png, simple, tiff, webp
from .base import CHANNELS, CodecError, Image, fail, from_pixels, image

HEIF_BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"hevm", b"hevs", b"mif1", b"msf1")
DECODERS = {
    "bmp": simple.decode_bmp,
    "qoi": simple.decode_qoi,
    "pnm": simple.decode_pnm,
    "png": png.decode,
    "jpeg": jpeg.decode,
    "gif": gif.decode,
    "webp": webp.decode,
    "tiff": tiff.decode,
    "pcx": simple.decode_pcx,
    "tga": simple.decode_tga,
    "hdr": simple.decode_hdr,
}
ENCODERS = {"png": png.encode, "jpeg": jpeg.encode, "bmp": simple.encode_bmp, "qoi": simple.encode_qoi, "pnm": simple.encode_pnm, "tga": simple.encode_tga}
#: File extensions that name an output format.
EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "qoi": "qoi", "pnm": "pnm", "ppm": "pnm", "pgm": "pnm", "pam": "pnm", "tga": "tga", "targa": "tga"}


def sniff(data: bytes) -> str | None:
    """The format that the first bytes tell. TGA has none to tell it by, HDR has to be asked for."""
    if len(data) < 2:
        fail("truncated", "too short for any format")
    if data[:2] == b"BM":
        return "bmp"
    if data[:4] == b"qoif":
        return "qoi"
    if data[:1] == b"P" and data[1:2] in b"1234567":
        return "pnm"
    if data[:8] == png.SIGNATURE:
        return "png"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    if data[4:8] == b"ftyp" and data[8:12] in HEIF_BRANDS:
        return "heif"
    if data[:4] == b"GIF8":
        return "gif"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "pcx" if data[0] == 10 else None


def decode(data: bytes, hint: str | None = None) -> Image:
    """Decode by the first bytes; ``hint`` is needed for TGA and HDR and has to agree elsewhere."""
    kind = hint if hint in ("tga", "hdr") else sniff(data)
    if hint and kind != hint:
        fail("unsupported", f"the data isn't {hint}")
    if kind not in DECODERS:
        fail("unsupported", "HEIF pixels can't be decoded here" if kind == "heif" else "unknown format")
    return DECODERS[kind](data)


def decode_scaled(data: bytes, max_edge: int) -> tuple[Image, int, int]:
    """(image, source width, source height); JPEG alone is reduced, and only to an eighth."""
    if max_edge < 1:
        fail("invalid_arg", "max_edge: at least 1")
    if sniff(data) == "jpeg":
        return jpeg.decode_scaled(data, max_edge)
    found = decode(data)
    return found, found.width, found.height


def encode(img: Image, kind: str, quality: int = 90) -> bytes:
    if kind not in ENCODERS:
        fail("unsupported", f"no encoder for {kind}")
    return jpeg.encode(img, quality) if kind == "jpeg" else ENCODERS[kind](img)


def format_of_path(path: str) -> str:
    name = path.rpartition(".")[2].lower() if "." in path else ""
    if name not in EXTENSIONS:
        fail("unsupported", "no output format has this extension")
    return EXTENSIONS[name]


__all__ = ["CHANNELS", "CodecError", "Image", "decode", "decode_scaled", "encode", "format_of_path", "from_pixels", "image", "sniff"]
