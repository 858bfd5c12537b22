"""The builder and the jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import cli
from pixelloom.frame import ImageFrame
from pixelloom.functions import codecs
from pixelloom.functions.codecs.base import image


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    picture = image(np.arange(6, dtype=np.uint8).reshape(2, 3, 1).repeat(3, 2), "rgb")
    (tmp_path / "in" / "a.png").write_bytes(codecs.encode(picture, "png"))
    (tmp_path / "in" / "b.jpg").write_bytes(codecs.encode(picture, "jpeg"))
    (tmp_path / "in" / "c.txt").write_bytes(b"not an image")
    return tmp_path


def test_steps_fold(spark, folder):
    frame = ImageFrame.read(spark, str(folder / "in"), "*.png")
    assert frame.rotate("rot90").rotate("rot270").steps == ()
    assert frame.rotate("rot90").orient(2).rotate("rot180").steps == (("dihedral", "transpose"),) or len(frame.rotate("rot90").orient(2).rotate("rot180").steps) == 1
    assert frame.composite_over(F.lit(None), opacity=0) is frame
    out = frame.rotate("rot90").crop(0, 0, 2, 1).df.first().image
    assert (out.width, out.height, bytes(out.data)) == (2, 1, bytes((3, 3, 3, 0, 0, 0)))
    for bad in (lambda: frame.rotate("rot45"), lambda: frame.orient(0), lambda: frame.resize(1, 1, "cubic")):
        with pytest.raises(ValueError):
            bad()


def test_reads_and_errors(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r.image for r in ImageFrame.read(spark, str(folder / "in")).df.collect()}
    assert rows["a.png"].width == 3 and rows["b.jpg"].width == 3 and rows["c.txt"].error.code == "unsupported"


def test_jobs(spark, folder):
    out = str(folder / "out")
    done = cli.run(spark, ["set", str(folder / "in"), out, "Artist=Ann", "gps=1.5,2.5"]).collect()
    assert {r.name: r.error for r in done} == {"a.png": None, "b.jpg": None, "c.txt": "no content"}
    audit = {r.path.rsplit("/", 1)[1]: r for r in cli.run(spark, ["audit", out]).collect()}
    assert audit["a.png"].flags == 2 and audit["b.jpg"].has_gps and audit["a.png"].verdict == "sensitive"
    shown = {r.key for r in cli.run(spark, ["show", out]).collect()}
    assert {"Artist", "GPSLatitude"} <= shown
    cli.run(spark, ["strip", out, str(folder / "clean")]).collect()
    assert (folder / "clean" / "a.png.clean").read_bytes() == (folder / "in" / "a.png").read_bytes()
    cli.run(spark, ["resize", str(folder / "in"), str(folder / "small"), "2x2", "--format", "bmp", "--filter", "box"]).collect()
    assert codecs.decode((folder / "small" / "a.bmp").read_bytes()).data.shape == (2, 2, 3)
    with pytest.raises(SystemExit):
        cli.run(spark, ["crop", "x", "y", "1x1"])
