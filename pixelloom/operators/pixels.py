"""Pixel operators on the exploded relation, a row for each pixel.

Schema: ``image_id BIGINT, w INT, h INT, y INT, x INT, r INT, g INT, b INT, a INT``. Grey has
r = g = b, an image without alpha a = 255. Everything here is a projection, a filter, or
an equi-join on image and position; no row is ever handed to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["image_id", "w", "h", "y", "x", "r", "g", "b", "a"]
CHANNELS = ["r", "g", "b", "a"]
#: Most pixels of a result and of a resampling's intermediate image.
MAX_RESIZE_PIXELS = 1 << 30

#: Dihedral operators as (source to target) maps: swaps axes first, then mirrors x, y.
DIHEDRAL = {
    "id": (False, False, False),
    "rot90": (True, True, False),
    "rot180": (False, True, True),
    "rot270": (True, False, True),
    "flip_h": (False, True, False),
    "flip_v": (False, False, True),
    "transpose": (True, False, False),
    "anti_transpose": (True, True, True),
}
#: What each EXIF orientation asks for.
ORIENTATIONS = ("id", "flip_h", "rot180", "flip_v", "transpose", "rot90", "anti_transpose", "rot270")


def fold(first: str, second: str) -> str:
    """The one operator that equals ``first`` and then ``second``."""
    swap1, mx1, my1 = DIHEDRAL[first]
    swap2, mx2, my2 = DIHEDRAL[second]
    if swap2:
        mx1, my1 = my1, mx1
    found = (swap1 != swap2, mx1 != mx2, my1 != my2)
    return next(name for name, op in DIHEDRAL.items() if op == found)


def dihedral(px: DataFrame, op: str) -> DataFrame:
    """Quarter turns (clockwise), half turn, flips and transpositions: a projection."""
    if op not in DIHEDRAL:
        raise ValueError(f"unknown operator {op!r}")
    swap, mirror_x, mirror_y = DIHEDRAL[op]
    w, h, x, y = ("h", "w", "y", "x") if swap else ("w", "h", "x", "y")
    new_x = F.col(w) - 1 - F.col(x) if mirror_x else F.col(x)
    new_y = F.col(h) - 1 - F.col(y) if mirror_y else F.col(y)
    return px.select("image_id", F.col(w).alias("w"), F.col(h).alias("h"), new_y.alias("y"), new_x.alias("x"), *CHANNELS)


def orient(px: DataFrame, orientation: int | Column) -> DataFrame:
    """Pixels as an EXIF orientation of 1 to 8, a number or a column, asks for.

    A number outside raises ValueError; rows whose column is outside or null are an error
    when they are read.
    """
    if isinstance(orientation, int):
        if not 1 <= orientation <= 8:
            raise ValueError("orientation: expected 1 to 8")
        return dihedral(px, ORIENTATIONS[orientation - 1])
    cases: dict[str, Column] = {}
    for code, name in enumerate(ORIENTATIONS, 1):
        swap, mirror_x, mirror_y = DIHEDRAL[name]
        w, h, x, y = ("h", "w", "y", "x") if swap else ("w", "h", "x", "y")
        one = {"w": F.col(w), "h": F.col(h), "x": F.col(w) - 1 - F.col(x) if mirror_x else F.col(x), "y": F.col(h) - 1 - F.col(y) if mirror_y else F.col(y)}
        for c, value in one.items():
            cases[c] = F.when(orientation == code, value) if c not in cases else cases[c].when(orientation == code, value)
    checked = {c: case.otherwise(F.raise_error(F.lit("orientation: expected 1 to 8")).cast("int")) for c, case in cases.items()}
    return px.select("image_id", *[checked[c].alias(c) for c in ("w", "h", "y", "x")], *CHANNELS)


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The ``w`` by ``h`` pixels from (x, y) of each image that holds them all."""
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("crop: the rectangle has to be inside the image and not empty")
    inside = (F.col("w") >= x + w) & (F.col("h") >= y + h)
    kept = px.where(inside & F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return kept.select("image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), (F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), *CHANNELS)


def crop_errors(images: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """``(image_id, code)`` of the images that a crop would refuse."""
    bad = (F.lit(x) < 0) | (F.lit(y) < 0) | (F.lit(w) <= 0) | (F.lit(h) <= 0) | (F.col("w").cast("long") < F.lit(x + w)) | (F.col("h").cast("long") < F.lit(y + h))
    return images.where(bad).select("image_id", F.lit("invalid_arg").alias("code"))


def _rounded(numerator: Column, denominator: Column | int) -> Column:
    """Integer division, halves up."""
    d = F.lit(denominator) if isinstance(denominator, int) else denominator
    return F.call_function("div", numerator + F.call_function("div", d, F.lit(2)), d)


def composite_over(dst: DataFrame, src: DataFrame, x: int = 0, y: int = 0, opacity: int = 255) -> DataFrame:
    """Straight-alpha source-over of ``src``, moved by (x, y), on ``dst`` of the same image id.

    Integers throughout, halves rounded up. Pixels of ``dst`` that no pixel of ``src``
    meets stay. With opacity 0 nothing is joined.
    """
    if not 0 <= opacity <= 255:
        raise ValueError("opacity: expected 0 to 255")
    if opacity == 0:
        return dst.select(*PIXEL)
    over = src.select(F.col("image_id").alias("s_id"), (F.col("x") + x).alias("s_x"), (F.col("y") + y).alias("s_y"), *[F.col(c).cast("long").alias(f"s_{c}") for c in CHANNELS])
    over = over.where("s_x >= 0 AND s_y >= 0")
    # merge join: pixels come of exploded sizes, whose estimate is that of the images; as a broadcast they'd fill the driver
    joined = dst.join(over.hint("merge"), (F.col("image_id") == F.col("s_id")) & (F.col("x") == F.col("s_x")) & (F.col("y") == F.col("s_y")), "left")
    alpha = _rounded(F.col("s_a") * opacity, 255)
    below = F.col("a").cast("long")
    numerator = F.col("_alpha") * 255 + below * (255 - F.col("_alpha"))
    keep = F.col("_alpha").isNull() | (F.col("_alpha") == 0)
    copy = (F.col("_alpha") == 255) | (below == 0)
    shaded = joined.withColumn("_alpha", alpha).withColumn("_den", numerator)

    def channel(c: str) -> Column:
        mixed = _rounded(F.col(f"s_{c}") * F.col("_alpha") * 255 + F.col(c).cast("long") * below * (255 - F.col("_alpha")), F.col("_den"))
        return F.when(keep, F.col(c)).when(copy, F.col(f"s_{c}")).otherwise(mixed).cast("int").alias(c)

    new_a = F.when(keep, F.col("a")).when(copy, F.col("_alpha")).otherwise(_rounded(F.col("_den"), 255)).cast("int").alias("a")
    return shaded.select("image_id", "w", "h", "y", "x", channel("r"), channel("g"), channel("b"), new_a)


def _f(x) -> Column:
    """As FLOAT: Spark divides floats as DOUBLE, so every quotient is cast back."""
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def taps(sizes: DataFrame, n: int, kind: str) -> DataFrame:
    """``(m, d, i, wt)``: what each of ``n`` samples takes of ``m`` pixels, for each ``m`` of ``sizes``."""
    grid = sizes.select(F.col("m")).distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    m, d = _f(F.col("m")), _f(F.col("d"))
    if kind == "nearest":
        at = F.floor(_f(_f((d + _f(0.5)) * m) / _f(n))).cast("int")
        return grid.select("m", "d", F.least(F.col("m") - 1, at).alias("i"), _f(1).alias("wt"))
    if kind == "bilinear":
        centre = _f(_f((d + _f(0.5)) * m) / _f(n)) - _f(0.5)
        placed = grid.withColumn("s", F.least(F.greatest(centre, _f(0)), m - _f(1))).withColumn("j", F.floor("s").cast("int"))
        rest = placed.withColumn("frac", F.col("s") - _f(F.col("j")))
        pair = F.array(F.struct(F.col("j").alias("i"), (_f(1) - F.col("frac")).alias("wt")), F.struct((F.col("j") + 1).alias("i"), F.col("frac").alias("wt")))
        return rest.select("m", "d", F.explode(F.when(F.col("j") + 1 < F.col("m"), pair).otherwise(F.slice(pair, 1, 1))).alias("t")).select("m", "d", "t.i", "t.wt")
    if kind != "box":
        raise ValueError(f"unknown filter {kind!r}")
    low, high = _f(_f(d * m) / _f(n)), _f(_f(_f(F.col("d") + 1) * m) / _f(n))
    spread = grid.select("m", "d", low.alias("lo"), high.alias("hi")).withColumn("i", F.explode(F.sequence(F.floor("lo").cast("int"), F.least(F.col("m") - 1, F.ceil("hi").cast("int")))))
    part = spread.withColumn("part", F.least("hi", _f(F.col("i") + 1)) - F.greatest("lo", _f(F.col("i")))).where("part > 0")
    lists = part.groupBy("m", "d").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("all"))
    total = lists.withColumn("total", F.aggregate("all", _f(0), lambda acc, v: acc + v["part"]))
    return total.select("m", "d", "total", F.explode("all").alias("t")).select("m", "d", "t.i", _f(F.col("t.part") / F.col("total")).alias("wt"))


def _fold(values: Column) -> Column:
    """Sum of FLOATs in order of their index: a plain sum has another order and other bits."""
    return F.aggregate(F.transform(F.array_sort(values), lambda s: s["v"]), _f(0), lambda acc, v: acc + v)


def _byte(v: Column) -> Column:
    return F.when(v <= 0, 0).when(v >= 255, 255).otherwise(F.floor(v + _f(0.5))).cast("int")


def resize(px: DataFrame, w: int, h: int, kind: str = "bilinear", alpha: bool = True) -> DataFrame:
    """Every image at ``w`` by ``h``: ``nearest``, ``bilinear`` (default) or ``box``.

    Two passes, rows and then columns, in single precision in a fixed order. With ``alpha``
    colours are weighed by their opacity; without, alpha is 255 in and out. Sizes whose
    result or intermediate image is over 2**30 pixels are refused.
    """
    if w <= 0 or h <= 0 or w * h > MAX_RESIZE_PIXELS:
        raise ValueError("resize: the size has to be positive and at most 2**30 pixels")
    row_taps = taps(px.select(F.col("w").alias("m")), w, kind).select(F.col("m").alias("w"), F.col("d").alias("dx"), F.col("i").alias("x"), F.col("wt").alias("wx"))
    column_taps = taps(px.select(F.col("h").alias("m")), h, kind).select(F.col("m").alias("h"), F.col("d").alias("dy"), F.col("i").alias("y"), F.col("wt").alias("wy"))
    if kind == "nearest":
        sized = px.join(row_taps, ["w", "x"]).join(column_taps, ["h", "y"])
        return sized.select("image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), F.col("dy").alias("y"), F.col("dx").alias("x"), *CHANNELS)
    channels = CHANNELS if alpha else CHANNELS[:3]
    weight = _f(F.col("wx") * _f(F.col("a"))) if alpha else F.col("wx")
    wide = px.join(row_taps, ["w", "x"])
    terms = {c: (_f(weight / _f(255)) if alpha else weight) * _f(F.col(c)) for c in CHANNELS[:3]}
    if alpha:
        terms["a"] = weight
    first = wide.groupBy("image_id", "h", "y", "dx").agg(*[F.collect_list(F.struct(F.col("x").alias("i"), terms[c].alias("v"))).alias(c) for c in channels])
    first = first.select("image_id", "h", "y", "dx", *[_fold(F.col(c)).alias(c) for c in channels])
    tall = first.join(column_taps, ["h", "y"])
    second = tall.groupBy("image_id", "dy", "dx").agg(*[F.collect_list(F.struct(F.col("y").alias("i"), (F.col("wy") * F.col(c)).alias("v"))).alias(c) for c in channels])
    second = second.select("image_id", "dy", "dx", *[_fold(F.col(c)).alias(c) for c in channels])
    place = ["image_id", F.lit(w).alias("w"), F.lit(h).alias("h"), F.col("dy").alias("y"), F.col("dx").alias("x")]
    if not alpha:
        return second.select(*place, *[_byte(F.col(c)).alias(c) for c in channels], F.lit(255).alias("a"))
    opaque = second.withColumn("_a", _byte(F.col("a")))
    colour = lambda c: F.when(F.col("_a") == 0, 0).when(F.col("_a") == 255, _byte(F.col(c))).otherwise(_byte(_f(F.col(c) * _f(255) / F.col("a")))).cast("int")
    return opaque.select(*place, *[colour(c).alias(c) for c in CHANNELS[:3]], F.col("_a").alias("a"))


def new_image(images: DataFrame) -> DataFrame:
    """All-zero pixels for every (image_id, w, h) of positive size."""
    grid = images.where("w > 0 AND h > 0").select("image_id", "w", "h", F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
    return grid.select("*", F.explode(F.expr("sequence(0, w - 1)")).alias("x")).select("image_id", "w", "h", "y", "x", *[F.lit(0).alias(c) for c in CHANNELS])


def channel_stats(px: DataFrame) -> DataFrame:
    """``(image_id, n, <channel>_min, <channel>_max, <channel>_sum)``."""
    parts = [f(c).cast(kind).alias(f"{c}_{name}") for c in CHANNELS for name, f, kind in (("min", F.min, "int"), ("max", F.max, "int"), ("sum", F.sum, "long"))]
    return px.groupBy("image_id").agg(F.count("*").alias("n"), *parts)


def histogram(px: DataFrame) -> DataFrame:
    """``(channel, value, n)`` over all images."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS]))
    return px.select(pairs.alias("p")).groupBy("p.channel", "p.value").agg(F.count("*").alias("n"))


def pack(px: DataFrame, channels: int = 4) -> DataFrame:
    """``(image_id, width, height, channels, colorspace, data)``: pixels as interleaved bytes.

    Built by SQL functions from the ordered pixels of each image; ``channels`` is 1 (takes
    r), 3 or 4.
    """
    names = {1: ["r"], 3: ["r", "g", "b"], 4: CHANNELS}[channels]
    hexed = F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in names])
    grouped = px.groupBy("image_id", "w", "h").agg(F.sort_array(F.collect_list(F.struct((F.col("y").cast("long") * F.col("w") + F.col("x")).alias("i"), hexed.alias("v")))).alias("all"))
    data = F.unhex(F.array_join(F.transform("all", lambda s: s["v"]), ""))
    return grouped.select("image_id", F.col("w").alias("width"), F.col("h").alias("height"), F.lit(channels).alias("channels"), F.lit({1: "gray", 3: "rgb", 4: "rgba"}[channels]).alias("colorspace"), data.alias("data"))


def explode_pixels(images: DataFrame) -> DataFrame:
    """The exploded relation of packed gray, rgb and rgba images."""
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("_i") * F.col("channels") + k + 1, F.lit(1))), 16, 10).cast("int")
    grid = images.select("image_id", "width", "height", "channels", "data", F.explode(F.expr("sequence(0, width * height - 1)")).alias("_i"))
    colour = [F.when(F.col("channels") == 1, byte(0)).otherwise(byte(k)).alias(c) for k, c in enumerate(CHANNELS[:3])]
    return grid.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), F.expr("CAST(_i div width AS int)").alias("y"), F.expr("CAST(_i % width AS int)").alias("x"), *colour, F.when(F.col("channels") == 4, byte(3)).otherwise(255).alias("a"))


def valid_packed(images: DataFrame) -> Column:
    """Whether size, channels, colorspace and data of a packed image agree."""
    counts = F.create_map(*[F.lit(x) for pair in (("gray", 1), ("rgb", 3), ("rgba", 4), ("cmyk", 4), ("yuv", 3), ("indexed", 1)) for x in pair])
    fits = F.octet_length("data").cast("long") == F.col("width").cast("long") * F.col("height") * F.col("channels")
    return F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.try_element_at(counts, F.col("colorspace")) == F.col("channels")) & fits, F.lit(False))
