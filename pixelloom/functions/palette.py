"""Palettes of an image's colour histogram by six quantizers, in OKLab or sRGB.

Every quantizer takes distinct colours (n by 3, 0 to 1) with their counts and gives at most
``k`` centres. All are deterministic for a seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs.base import fail

SPACES = {"srgb": 0, "oklab": 15}
# The matrices of Ottosson's OKLab (2020).
_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
_LAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])


def to_oklab(srgb: np.ndarray) -> np.ndarray:
    linear = np.where(srgb <= 0.04045, srgb / 12.92, ((srgb + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ _LMS.T) @ _LAB.T


def from_oklab(lab: np.ndarray) -> np.ndarray:
    linear = (lab @ np.linalg.inv(_LAB).T) ** 3 @ np.linalg.inv(_LMS).T
    linear = np.clip(linear, 0, 1)
    return np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for a in range(0, len(points), 4096):
        part = points[a : a + 4096]
        out[a : a + 4096] = ((part[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def _means(points: np.ndarray, counts: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    weight = np.bincount(owner, counts, k)
    kept = weight > 0
    return np.stack([np.bincount(owner, counts * points[:, c], k)[kept] / weight[kept] for c in range(3)], 1)


def lloyd(points, counts, centres, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        moved = _means(points, counts, _nearest(points, centres), len(centres))
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-7):
            break
        centres = moved
    return centres


def kmeans(points, counts, k, seed, rounds=50):
    first = np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)
    return lloyd(points, counts, points[np.sort(first)], rounds)


def kmeans_pp(points, counts, k, seed, rounds=50):
    rng = np.random.default_rng(seed)
    centres = [points[rng.choice(len(points), p=counts / counts.sum())]]
    far = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and (weight := far * counts).sum() > 0:
        centres.append(points[rng.choice(len(points), p=weight / weight.sum())])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
    return lloyd(points, counts, np.array(centres), rounds)


def _boxes(points, counts, k, worth, split) -> np.ndarray:
    """Cut the most worthy box in two until there are ``k``."""
    boxes = [np.arange(len(points))]
    while len(boxes) < k:
        score = [worth(points[b], counts[b]) if len(b) > 1 else -1.0 for b in boxes]
        best = int(np.argmax(score))
        if score[best] <= 0:
            break
        box = boxes.pop(best)
        low = split(points[box], counts[box])
        boxes += [box[low], box[~low]]
    return np.array([np.average(points[b], axis=0, weights=counts[b]) for b in boxes])


def _cut(points, counts, axis: int, position) -> np.ndarray:
    """Where the colours, sorted along ``axis``, are cut: never all on one side."""
    order = np.lexsort((points[:, (axis + 2) % 3], points[:, (axis + 1) % 3], points[:, axis]))
    at = min(max(1, position(points[order], counts[order])), len(points) - 1)
    low = np.zeros(len(points), bool)
    low[order[:at]] = True
    return low


def median_cut(points, counts, k, seed):
    def split(p, c):
        return _cut(p, c, int(np.ptp(p, axis=0).argmax()), lambda _, w: int(np.searchsorted(np.cumsum(w), w.sum() / 2)) + 1)

    return _boxes(points, counts, k, lambda p, c: float(np.ptp(p, axis=0).max()) * float(c.sum()), split)


def wu(points, counts, k, seed):
    """Least variance: the box of most variance is cut where the sum of both parts' is least."""

    def variance(p, c):
        return float((c[:, None] * (p - np.average(p, axis=0, weights=c)) ** 2).sum())

    def split(p, c):
        best, cut_at, cut_axis = -1.0, 1, 0
        for axis in range(3):
            order = np.lexsort((p[:, (axis + 2) % 3], p[:, (axis + 1) % 3], p[:, axis]))
            weight, sums = np.cumsum(c[order]), np.cumsum(c[order, None] * p[order], axis=0)
            gain = (sums[:-1] ** 2).sum(axis=1) / weight[:-1] + ((sums[-1] - sums[:-1]) ** 2).sum(axis=1) / (weight[-1] - weight[:-1])
            at = int(gain.argmax())
            if gain[at] > best:
                best, cut_at, cut_axis = float(gain[at]), at + 1, axis
        return _cut(p, c, cut_axis, lambda *_: cut_at)

    return _boxes(points, counts, k, variance, split)


def octree(points, counts, k, seed):
    """Leaves of an octree over the colours' range, the least used merged into parents first."""
    low, span = points.min(axis=0), np.maximum(np.ptp(points, axis=0), 1e-9)
    grid = np.minimum(((points - low) / span * 256).astype(np.int64), 255)
    owner = np.unique(grid, axis=0, return_inverse=True)[1].reshape(-1)
    for depth in range(7, -1, -1):
        if owner.max() + 1 <= k:
            break
        parent = np.unique(grid >> 8 - depth, axis=0, return_inverse=True)[1].reshape(-1)
        used = np.bincount(parent, counts)
        for p in np.lexsort((np.arange(len(used)), used)):
            inside = parent == p
            owner[inside] = owner[inside].min()
            if len(np.unique(owner)) <= k:
                break
        owner = np.unique(owner, return_inverse=True)[1]
    return _means(points, counts, owner, int(owner.max()) + 1)


def neuquant(points, counts, k, seed, steps=1024):
    """A one-dimensional self-organising map whose rate and radius fall."""
    rng = np.random.default_rng(seed)
    net = points.min(axis=0) + np.linspace(0, 1, k)[:, None] * np.ptp(points, axis=0)
    picks = rng.choice(len(points), steps, p=counts / counts.sum())
    place = np.arange(k)
    for step, i in enumerate(picks):
        left = 1 - step / steps
        winner = int(((net - points[i]) ** 2).sum(axis=1).argmin())
        radius = max(k / 8 * left, 0.5)
        pull = 0.5 * left * np.exp(-(((place - winner) / radius) ** 2))
        net += pull[:, None] * (points[i] - net)
    return _means(points, counts, _nearest(points, net), k)


ALGORITHMS = {"wu": wu, "kmeans": kmeans, "kmeans_pp": kmeans_pp, "median_cut": median_cut, "octree": octree, "neuquant": neuquant}


def quantize(colours: np.ndarray, counts: np.ndarray, n: int, algorithm: str = "wu", space: str = "oklab", seed: int = 0) -> np.ndarray:
    """At most ``n`` colours, in ``space``, of distinct sRGB ``colours`` (0 to 255) with counts."""
    if n < 1:
        fail("invalid_arg", "palette: at least one colour")
    if algorithm not in ALGORITHMS or space not in SPACES:
        fail("invalid_arg", "palette: unknown algorithm or space")
    order = np.lexsort(colours.T[::-1])
    points = colours[order].astype(np.float64) / 255
    points = to_oklab(points) if space == "oklab" else points
    return ALGORITHMS[algorithm](points, counts[order].astype(np.float64), n, seed)[:n]


def extract_palettes(px: DataFrame, n: int, algorithm: str = "wu", space: str = "oklab", seed: int = 0) -> DataFrame:
    """``(image_id, colors array<struct<c0, c1, c2, alpha, space>>, tag, intent, seed)``.

    Only the histogram of each image, not its pixels, is gathered; alpha is ignored.
    """
    quantize(np.zeros((1, 3)), np.ones(1), n, algorithm, space, seed)
    tag = SPACES[space]
    colour = pa.struct([("c0", pa.float32()), ("c1", pa.float32()), ("c2", pa.float32()), ("alpha", pa.float32()), ("space", pa.int32())])
    schema = "image_id long, colors array<struct<c0 float, c1 float, c2 float, alpha float, space int>>, tag int, intent int, seed long"

    def one(table: pa.Table) -> pa.Table:
        rgb = np.stack([table.column(c).to_numpy() for c in ("r", "g", "b")], 1)
        found = quantize(rgb, table.column("n").to_numpy(), n, algorithm, space, seed)
        colors = [[{"c0": a, "c1": b, "c2": c, "alpha": 1.0, "space": tag} for a, b, c in found.tolist()]]
        return pa.table({"image_id": table.column("image_id")[:1], "colors": pa.array(colors, pa.list_(colour)), "tag": pa.array([tag], pa.int32()), "intent": pa.array([0], pa.int32()), "seed": pa.array([seed], pa.int64())})

    histogram = px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    return histogram.groupBy("image_id").applyInArrow(one, schema)
