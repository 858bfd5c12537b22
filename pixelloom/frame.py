"""A lazy builder over packed images: steps are folded before a DataFrame is made.

Neighbouring turns and flips become one, a composite that can't show is dropped, and a
decode followed by a resize may, if asked, read JPEG an eighth as large.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import images as I
from .functions.meta import columns as M
from .functions.palette import extract_palettes
from .operators import pixels as P
from .sources import read_files, write_files

COLORSPACES = ("gray", "rgb", "rgba", "cmyk", "yuv", "indexed")
FILTERS = ("nearest", "bilinear", "box")
FORMATS = ("png", "jpeg", "bmp", "qoi", "pnm", "tga")


@dataclass(frozen=True)
class ImageFrame:
    """Images of a DataFrame: ``id_col``, and ``content`` (files) or an image struct.

    Every method gives a new frame. ``df`` builds the plan; nothing runs before an action.
    """

    source: DataFrame
    id_col: str
    image: Column
    steps: tuple = ()
    content: Column | None = None

    @classmethod
    def decode(cls, df: DataFrame, id_col: str = "path", content_col: str = "content", hint: str | None = None, mode: str = "permissive") -> ImageFrame:
        return cls(df, id_col, I.decode(F.col(content_col), hint, mode), (), F.col(content_col))

    @classmethod
    def read(cls, spark: SparkSession, path: str, glob: str | None = None) -> ImageFrame:
        return cls.decode(read_files(spark, path, glob))

    @classmethod
    def from_pixels(cls, df: DataFrame, id_col: str = "image_id") -> ImageFrame:
        """Packed columns width, height, channels, colorspace and data."""
        return cls(df, id_col, I.as_image(df))

    @classmethod
    def thumbnails(cls, df: DataFrame, id_col: str = "path", content_col: str = "content") -> ImageFrame:
        """The images that the files' EXIF data embeds; rows without one have none."""
        found = df.withColumn("_thumbnail", M.read(F.col(content_col))["thumbnail"]).where("_thumbnail IS NOT NULL")
        return cls.decode(found, id_col, "_thumbnail")

    def _with(self, step: tuple) -> ImageFrame:
        steps = self.steps
        if step[0] == "dihedral":
            if steps and steps[-1][0] == "dihedral":
                step, steps = ("dihedral", P.fold(steps[-1][1], step[1])), steps[:-1]
            if step[1] == "id":
                return replace(self, steps=steps)
        return replace(self, steps=(*steps, step))

    def crop(self, x: int, y: int, w: int, h: int) -> ImageFrame:
        return self._with(("crop", x, y, w, h))

    def rotate(self, op: str) -> ImageFrame:
        """rot90, rot180, rot270 (clockwise), flip_h or flip_v."""
        if op not in P.DIHEDRAL:
            raise ValueError(f"unknown operator {op!r}")
        return self._with(("dihedral", op))

    def orient(self, orientation: int) -> ImageFrame:
        if not 1 <= orientation <= 8:
            raise ValueError("orientation: expected 1 to 8")
        return self._with(("dihedral", P.ORIENTATIONS[orientation - 1]))

    def resize(self, w: int, h: int, kind: str = "bilinear", reduced: bool = False) -> ImageFrame:
        """``reduced``: JPEG files may be decoded at an eighth first; other pixels, less work."""
        if kind not in FILTERS:
            raise ValueError(f"unknown filter {kind!r}")
        frame = self
        if reduced and not self.steps and self.content is not None:
            frame = replace(self, image=I.decode_scaled(self.content, max(w, h)))
        return frame._with(("resize", w, h, kind))

    def composite_over(self, above: Column, x: int = 0, y: int = 0, opacity: int = 255) -> ImageFrame:
        """An image column of the same rows drawn over; with opacity 0 nothing is done."""
        return self if opacity == 0 else self._with(("composite", above, x, y, opacity))

    def column(self) -> Column:
        """The image struct after all steps."""
        out = self.image
        for name, *args in self.steps:
            out = I.composite_over(out, *args) if name == "composite" else I.transform(out, name, *args)
        return out

    @property
    def df(self) -> DataFrame:
        return self.source.select(self.id_col, self.column().alias("image"))

    def encode(self, kind: str, quality: int = 90) -> DataFrame:
        """``(id, data, error)``."""
        coded = self.source.select(self.id_col, I.encode(self.column(), kind, quality).alias("e"))
        return coded.select(self.id_col, "e.data", "e.error")

    def write(self, folder: str, kind: str, quality: int = 90) -> DataFrame:
        """Encode and write a file for each row, named by the id; see :func:`pixelloom.sources.write_files`."""
        named = self.encode(kind, quality).withColumn("_name", F.concat(F.regexp_replace(F.element_at(F.split(F.col(self.id_col).cast("string"), "/"), -1), r"\.[^.]*$", ""), F.lit(f".{kind}")))
        return write_files(named, folder, "_name", "data")

    def pixels(self) -> DataFrame:
        """The exploded relation of the images without an error; the id has to be a number."""
        good = self.df.where("image.data IS NOT NULL")
        return P.explode_pixels(good.select(F.col(self.id_col).alias("image_id"), "image.*"))

    def extract_palette(self, n: int, algorithm: str = "wu", space: str = "oklab", seed: int = 0) -> DataFrame:
        return extract_palettes(self.pixels(), n, algorithm, space, seed)

    def sizes(self) -> DataFrame:
        image = self.df
        return image.select(self.id_col, "image.width", "image.height", "image.channels", "image.colorspace", F.octet_length("image.data").alias("size_bytes"))
