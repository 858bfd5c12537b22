"""What all codecs share: the image, typed errors, size limits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHANNELS = {"gray": 1, "rgb": 3, "rgba": 4, "cmyk": 4, "yuv": 3, "indexed": 1}
#: Largest width or height that a header may state, and pixels that a worker will hold.
MAX_DIM = 1 << 30
MAX_PIXELS = 1 << 26


class CodecError(ValueError):
    """``code``: unsupported, truncated, invalid_arg, encoding or io."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def fail(code: str, message: str):
    raise CodecError(code, message)


@dataclass
class Image:
    """Interleaved rows; ``data`` is uint8 (float32 for HDR), height by width by channels."""

    data: np.ndarray
    colorspace: str

    @property
    def height(self) -> int:
        return self.data.shape[0]

    @property
    def width(self) -> int:
        return self.data.shape[1]

    @property
    def channels(self) -> int:
        return self.data.shape[2]


def image(data: np.ndarray, colorspace: str) -> Image:
    if data.ndim == 2:
        data = data[:, :, None]
    return Image(np.ascontiguousarray(data), colorspace)


def from_pixels(width: int, height: int, colorspace: str, data: bytes) -> Image:
    """The image of raw interleaved bytes; their number has to be right."""
    if colorspace not in CHANNELS:
        fail("invalid_arg", f"unknown colorspace {colorspace}")
    check_size(width, height)
    n = CHANNELS[colorspace]
    if len(data) != width * height * n:
        fail("invalid_arg", "pixels: the size doesn't match")
    return Image(np.frombuffer(data, np.uint8).reshape(height, width, n), colorspace)


def check_size(width: int, height: int) -> None:
    if not (0 < width <= MAX_DIM and 0 < height <= MAX_DIM):
        fail("invalid_arg", "the size isn't positive or too large")
    if width * height > MAX_PIXELS:
        fail("invalid_arg", "too many pixels")


def need(data, n: int) -> None:
    if len(data) < n:
        fail("truncated", f"{n} bytes are needed, {len(data)} are there")


def rgba(palette: np.ndarray, alpha: int | np.ndarray = 255) -> np.ndarray:
    out = np.empty((*palette.shape[:-1], 4), np.uint8)
    out[..., :3], out[..., 3] = palette, alpha
    return out


def unpack_bits(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, the highest first, from rows of bytes."""
    if bits == 8:
        return rows[:, :width]
    per, mask = 8 // bits, (1 << bits) - 1
    shifts = np.arange(8 - bits, -1, -bits)
    return ((rows[:, :, None] >> shifts) & mask).reshape(len(rows), -1)[:, :width].astype(np.uint8) if per else rows
