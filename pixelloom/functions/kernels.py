"""Pixel operators on packed images, for what never leaves the packed form."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .codecs.base import Image, fail, image

_f = np.float32


@lru_cache(256)
def _matrix(m: int, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights), n by taps, of ``n`` samples of ``m`` pixels; unused taps weigh 0."""
    d = np.arange(n, dtype=_f)
    if kind == "bilinear":
        s = np.clip((d + _f(0.5)) * _f(m) / _f(n) - _f(0.5), _f(0), _f(m - 1)).astype(_f)
        j = s.astype(np.int64)
        frac = s - j.astype(_f)
        return np.stack([j, np.minimum(j + 1, m - 1)], 1), np.stack([_f(1) - frac, np.where(j + 1 < m, frac, _f(0))], 1)
    low, high = d * _f(m) / _f(n), (d + _f(1)) * _f(m) / _f(n)
    first = np.floor(low).astype(np.int64)
    width = int((np.ceil(high).astype(np.int64) - first).max()) + 1
    at = first[:, None] + np.arange(width)
    part = np.maximum(np.minimum(high[:, None], (at + 1).astype(_f)) - np.maximum(low[:, None], at.astype(_f)), _f(0))
    part = np.where(at < m, part, _f(0)).astype(_f)
    total = np.zeros(n, _f)
    for k in range(width):
        total += part[:, k]
    return np.minimum(at, m - 1), part / total[:, None]


def _along_rows(values: np.ndarray, n: int, kind: str) -> np.ndarray:
    """Second axis resampled, taps added in order in single precision."""
    at, weight = _matrix(values.shape[1], n, kind)
    out = np.zeros((values.shape[0], n, values.shape[2]), _f)
    for k in range(at.shape[1]):
        taken = np.take(values, at[:, k], axis=1)
        taken *= weight[None, :, k, None]
        out += taken
    return out


def _along_columns(values: np.ndarray, n: int, kind: str) -> np.ndarray:
    """First axis resampled alike."""
    at, weight = _matrix(values.shape[0], n, kind)
    out = np.zeros((n, *values.shape[1:]), _f)
    for k in range(at.shape[1]):
        taken = values[at[:, k]]
        taken *= weight[:, k, None, None]
        out += taken
    return out


def _byte(v: np.ndarray) -> np.ndarray:
    return np.minimum(np.clip(v, 0, 255) + _f(0.5), _f(255)).astype(np.uint8)


def resize(img: Image, w: int, h: int, kind: str = "bilinear") -> Image:
    if w <= 0 or h <= 0 or w * h > 1 << 30 or w * img.height > 1 << 30:
        fail("invalid_arg", "resize: the size has to be positive and not too large")
    if kind == "nearest":
        place = lambda m, n: np.minimum(m - 1, ((np.arange(n, dtype=_f) + _f(0.5)) * _f(m) / _f(n)).astype(np.int64))
        return image(img.data[place(img.height, h)][:, place(img.width, w)], img.colorspace)
    if kind not in ("bilinear", "box"):
        fail("invalid_arg", f"unknown filter {kind}")
    if img.colorspace != "rgba":
        return image(_byte(_along_columns(_along_rows(img.data.astype(_f), w, kind), h, kind)), img.colorspace)
    at, weight = _matrix(img.width, w, kind)
    wide = np.zeros((img.height, w, 4), _f)
    source = img.data.astype(_f)
    for k in range(at.shape[1]):
        taken = np.take(source, at[:, k], axis=1)
        alpha = weight[None, :, k] * taken[:, :, 3]
        taken[:, :, :3] *= (alpha / _f(255))[:, :, None]
        taken[:, :, 3] = alpha
        wide += taken
    tall = _along_columns(wide, h, kind)
    alpha = _byte(tall[:, :, 3])
    with np.errstate(divide="ignore", invalid="ignore"):
        freed = tall[:, :, :3] * _f(255) / tall[:, :, 3:]
    colour = np.where(alpha[:, :, None] == 255, tall[:, :, :3], np.nan_to_num(freed))
    return image(np.concatenate([np.where(alpha[:, :, None] > 0, _byte(colour), 0), alpha[:, :, None]], 2).astype(np.uint8), "rgba")


def crop(img: Image, x: int, y: int, w: int, h: int) -> Image:
    if x < 0 or y < 0 or w <= 0 or h <= 0 or x + w > img.width or y + h > img.height:
        fail("invalid_arg", "crop: the rectangle has to be inside the image and not empty")
    return image(img.data[y : y + h, x : x + w], img.colorspace)


def dihedral(img: Image, op: str) -> Image:
    from ..operators.pixels import DIHEDRAL

    if op not in DIHEDRAL:
        fail("invalid_arg", f"unknown operator {op}")
    swap, mirror_x, mirror_y = DIHEDRAL[op]
    data = img.data.transpose(1, 0, 2) if swap else img.data
    return image(data[:: -1 if mirror_y else 1, :: -1 if mirror_x else 1], img.colorspace)


def orient(img: Image, code: int) -> Image:
    from ..operators.pixels import ORIENTATIONS

    if not 1 <= code <= 8:
        fail("invalid_arg", "orientation: expected 1 to 8")
    return dihedral(img, ORIENTATIONS[code - 1])


def composite_over(dst: Image, src: Image, x: int = 0, y: int = 0, opacity: int = 255) -> Image:
    """A new image: ``src`` over the RGBA image ``dst``, clipped, in integers."""
    if dst.colorspace != "rgba" or src.colorspace not in ("gray", "rgb", "rgba") or not 0 <= opacity <= 255:
        fail("invalid_arg", "composite: RGBA below; gray, RGB or RGBA above; opacity from 0 to 255")
    out = dst.data.copy()
    x0, y0, x1, y1 = max(0, x), max(0, y), min(dst.width, x + src.width), min(dst.height, y + src.height)
    if x0 >= x1 or y0 >= y1 or not opacity:
        return image(out, "rgba")
    top, below = src.data[y0 - y : y1 - y, x0 - x : x1 - x], out[y0:y1, x0:x1]
    colour = top[:, :, :1] if src.channels == 1 else top[:, :, :3]
    share = ((np.arange(256) * opacity + 127) // 255).astype(np.uint8)
    own = share[top[:, :, 3]] if src.channels == 4 else share[255]
    if np.all(own == 255):
        below[:, :, :3], below[:, :, 3] = colour, 255
        return image(out, "rgba")
    alpha, under = np.broadcast_to(own, below.shape[:2]).astype(np.int32), below[:, :, 3].astype(np.int32)
    upper, lower = alpha * 255, under * (255 - alpha)
    weight = upper + lower
    # exact in double precision: both numbers are whole and small
    half, size = (weight // 2).astype(np.float64), np.maximum(weight, 1).astype(np.float64)
    copied, kept = (alpha == 255) | (under == 0), alpha == 0
    for c in range(3):
        above = colour[:, :, c if colour.shape[2] > 1 else 0]
        mixed = ((above * upper + below[:, :, c] * lower + half) / size).astype(np.uint8)
        below[:, :, c] = np.where(kept, below[:, :, c], np.where(copied, above, mixed))
    below[:, :, 3] = np.where(kept, under, np.where(copied, alpha, (weight + 127) // 255))
    return image(out, "rgba")
