"""Goldens and laws of the pixel operators, on both representations."""

import numpy as np
import pytest

from pixelloom.functions import kernels
from pixelloom.functions.codecs.base import CodecError, image
from pixelloom.operators import pixels as P
from pixelloom.plans.pixel_queries import QUERIES

SCHEMA = "image_id long, w int, h int, y int, x int, r int, g int, b int, a int"


def frame(spark, rows, image_id=1):
    """Rows of pixels (gray numbers or RGBA tuples) as the exploded relation."""
    out = []
    for y, row in enumerate(rows):
        for x, p in enumerate(row):
            r, g, b, a = p if isinstance(p, tuple) else (p, p, p, 255)
            out.append((image_id, len(row), len(rows), y, x, r, g, b, a))
    return spark.createDataFrame(out, SCHEMA)


def grid(df):
    rows = df.collect()
    if not rows:
        return []
    out = [[None] * rows[0].w for _ in range(rows[0].h)]
    for p in rows:
        out[p.y][p.x] = (p.r, p.g, p.b, p.a)
    return out


def gray(df):
    return [[p[0] for p in row] for row in grid(df)]


ORIENTED = ([[1, 2, 3], [4, 5, 6]], [[3, 2, 1], [6, 5, 4]], [[6, 5, 4], [3, 2, 1]], [[4, 5, 6], [1, 2, 3]], [[1, 4], [2, 5], [3, 6]], [[4, 1], [5, 2], [6, 3]], [[6, 3], [5, 2], [4, 1]], [[3, 6], [2, 5], [1, 4]])


@pytest.mark.parametrize("code", range(1, 9))
def test_orientations(spark, code):
    assert gray(P.orient(frame(spark, [[1, 2, 3], [4, 5, 6]]), code)) == ORIENTED[code - 1]
    packed = kernels.orient(image(np.array([[1, 2, 3], [4, 5, 6]], np.uint8), "gray"), code)
    assert packed.data[:, :, 0].tolist() == ORIENTED[code - 1]


def test_orientation_outside():
    with pytest.raises(ValueError):
        P.orient(None, 9)
    with pytest.raises(CodecError):
        kernels.orient(image(np.zeros((1, 1), np.uint8), "gray"), 0)


def test_folding_equals_composition():
    picture = image(np.arange(6, dtype=np.uint8).reshape(2, 3), "gray")
    for a in P.DIHEDRAL:
        for b in P.DIHEDRAL:
            twice = kernels.dihedral(kernels.dihedral(picture, a), b)
            assert (twice.data == kernels.dihedral(picture, P.fold(a, b)).data).all()
    assert P.fold(P.fold("rot90", "rot90"), P.fold("rot90", "rot90")) == "id"


def test_composite_goldens(spark):
    cases = (((255, 0, 0, 128), (0, 0, 255, 255), (128, 0, 127, 255)), ((254, 254, 254, 8), (255, 255, 255, 15), (255, 255, 255, 23)), ((9, 8, 7, 0), (1, 2, 3, 4), (1, 2, 3, 4)), ((9, 8, 7, 60), (1, 2, 3, 0), (9, 8, 7, 60)))
    for above, below, expected in cases:
        assert grid(P.composite_over(frame(spark, [[below]]), frame(spark, [[above]]))) == [[expected]]
        one = lambda p: image(np.array([[p]], np.uint8), "rgba")
        assert tuple(kernels.composite_over(one(below), one(above)).data[0, 0].tolist()) == expected


def test_equal_channels_stay_equal():
    levels = (0, 1, 127, 254, 255)
    for channel in levels:
        for s in levels:
            for d in (0, 1, 7, 8, 15, 127, 254, 255):
                pixel = lambda a, c=channel: image(np.array([[(c, c, c, a)]], np.uint8), "rgba")
                out = kernels.composite_over(pixel(d), pixel(s)).data[0, 0]
                if out[3]:
                    assert (out[:3] == channel).all()


def test_composite_clips_and_checks(spark):
    below, above = frame(spark, [[(0, 0, 0, 255)] * 2]), frame(spark, [[(1, 1, 1, 255), (2, 2, 2, 255)]])
    assert grid(P.composite_over(below, above, -1, 0)) == [[(2, 2, 2, 255), (0, 0, 0, 255)]]
    assert grid(P.composite_over(below, above, 9, 9)) == grid(below)
    assert grid(P.composite_over(below, above, opacity=0)) == grid(below)
    with pytest.raises(ValueError):
        P.composite_over(below, above, opacity=256)


def test_composite_broadcasts_no_pixels(spark):
    images = spark.range(9).selectExpr("id AS image_id", "5 AS w", "4 AS h")  # an estimate far below the threshold of a broadcast
    plan = P.composite_over(P.new_image(images), P.new_image(images), 1, 1, 192)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["gray_src", "opaque", "clipped", "opacity192"])
def test_composite_queries_broadcast_no_pixels(spark, tmp_path, name):
    spark.range(9).selectExpr("id AS p_partkey", "CAST(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES[f"px_composite_{name}"](spark, str(tmp_path))
    assert len(df.collect()) == sum((4 + k) * (3 + k) for k in range(9))
    plan = df._jdf.queryExecution().executedPlan().toString()  # as it ran: sizes met on the way make no broadcast of it either
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bilinear_goldens(spark):
    source = [[(255, 0, 0, 0), (0, 0, 255, 255)]]
    expected = [[(0, 0, 0, 0), (0, 0, 255, 128), (0, 0, 255, 255)]]
    assert grid(P.resize(frame(spark, source), 3, 1, "bilinear")) == expected
    packed = kernels.resize(image(np.array(source, np.uint8), "rgba"), 3, 1)
    assert [[tuple(p) for p in row] for row in packed.data.tolist()] == expected


def test_box_goldens(spark):
    two = [[(255, 0, 0, 0), (0, 255, 0, 255)]]
    assert grid(P.resize(frame(spark, two), 1, 1, "box")) == [[(0, 255, 0, 128)]]
    assert kernels.resize(image(np.array(two, np.uint8), "rgba"), 1, 1, "box").data.tolist() == [[[0, 255, 0, 128]]]


def test_resize_keeps_flat_images():
    flat = image(np.full((7, 9, 3), 77, np.uint8), "rgb")
    for kind in ("nearest", "bilinear", "box"):
        for w, h in ((1, 1), (3, 20), (40, 2)):
            assert (kernels.resize(flat, w, h, kind).data == 77).all()


def test_sizes_are_checked(spark):
    px = frame(spark, [[1, 2], [3, 4]])
    for bad in ((0, 1), (1, -1), (1 << 20, 1 << 20)):
        with pytest.raises(ValueError):
            P.resize(px, *bad)
    with pytest.raises(ValueError):
        P.crop(px, -1, 0, 1, 1)
    assert P.crop(px, 1, 1, 2, 1).count() == 0
    assert gray(P.crop(px, 1, 0, 1, 2)) == [[2], [4]]


def test_pack_round_trip(spark):
    px = frame(spark, [[(1, 2, 3, 4), (250, 251, 252, 253)]])
    packed = P.pack(px)
    assert bytes(packed.first().data) == bytes((1, 2, 3, 4, 250, 251, 252, 253))
    assert grid(P.explode_pixels(packed)) == grid(px)
    assert packed.select(P.valid_packed(packed).alias("v")).first().v


def test_crop_moves_below_rotation(spark):
    plan = P.dihedral(P.crop(frame(spark, [[1, 2], [3, 4]]), 0, 0, 1, 1), "rot90")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1
