"""Pixel queries over the synthetic images, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from .synthetic import IMAGES_SQL, PIXELS_SQL, images, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_PX = f"WITH px AS ({PIXELS_SQL})"


def _add(name, query, sql):
    QUERIES[name], ORACLE_SQL[name] = query, sql


_add("px_generate", pixels, PIXELS_SQL)
_add("px_crop", lambda s, d: P.crop(pixels(s, d), 1, 1, 3, 2), f"{_PX} SELECT image_id, 3 AS w, 2 AS h, y - 1 AS y, x - 1 AS x, r, g, b, a FROM px WHERE w >= 4 AND h >= 3 AND x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2")
_add("px_crop_oob_errors", lambda s, d: P.crop_errors(images(s, d), 5, 2, 4, 3), f"SELECT image_id, 'invalid_arg' AS code FROM ({IMAGES_SQL}) WHERE w < 9 OR h < 5")
_MAPS = {
    "id": "w, h, y, x",
    "flip_h": "w, h, y, w - 1 - x AS x",
    "rot180": "w, h, h - 1 - y AS y, w - 1 - x AS x",
    "flip_v": "w, h, h - 1 - y AS y, x",
    "transpose": "h AS w, w AS h, x AS y, y AS x",
    "rot90": "h AS w, w AS h, x AS y, h - 1 - y AS x",
    "anti_transpose": "h AS w, w AS h, w - 1 - x AS y, h - 1 - y AS x",
    "rot270": "h AS w, w AS h, w - 1 - x AS y, y AS x",
}
for _op in ("rot90", "rot180", "rot270", "flip_h", "flip_v"):
    _add(f"px_{_op}", lambda s, d, op=_op: P.dihedral(pixels(s, d), op), f"{_PX} SELECT image_id, {_MAPS[_op]}, r, g, b, a FROM px")
for _code, _op in enumerate(_MAPS, 1):
    _add(f"px_orient_{_code}", lambda s, d, code=_code: P.orient(pixels(s, d), code), f"{_PX} SELECT image_id, {_MAPS[_op]}, r, g, b, a FROM px")
_add("px_orient_column", lambda s, d: P.orient(pixels(s, d), F.col("image_id") % 8 + 1), " UNION ALL ".join([f"{_PX} SELECT image_id, {m}, r, g, b, a FROM px WHERE image_id % 8 = {k}" if k == 0 else f"SELECT image_id, {m}, r, g, b, a FROM px WHERE image_id % 8 = {k}" for k, m in enumerate(_MAPS.values())]))
_add("px_dihedral_fold", lambda s, d: P.dihedral(pixels(s, d), P.fold(P.fold("rot90", "flip_h"), "rot270")), f"{_PX}, one AS (SELECT image_id, {_MAPS['rot90']}, r, g, b, a FROM px), two AS (SELECT image_id, {_MAPS['flip_h']}, r, g, b, a FROM one) SELECT image_id, {_MAPS['rot270']}, r, g, b, a FROM two")
_add("px_crop_rot90", lambda s, d: P.dihedral(P.crop(pixels(s, d), 1, 1, 3, 2), "rot90"), f"{_PX} SELECT image_id, 2 AS w, 3 AS h, x - 1 AS y, 2 - 1 - (y - 1) AS x, r, g, b, a FROM px WHERE w >= 4 AND h >= 3 AND x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2")


def _composite_sql(source: str, x: int, y: int, opacity: int, below: str = "px") -> str:
    mix = lambda c: f"CAST(CASE WHEN al IS NULL OR al = 0 THEN {c} WHEN al = 255 OR a = 0 THEN s{c} ELSE (CAST(s{c} AS BIGINT) * al * 255 + CAST({c} AS BIGINT) * a * (255 - al) + den // 2) // den END AS INTEGER) AS {c}"
    return f"""WITH px AS MATERIALIZED ({PIXELS_SQL}),
below AS MATERIALIZED (SELECT * FROM {below}),
over AS MATERIALIZED (SELECT image_id, y + ({y}) AS y, x + ({x}) AS x, r AS sr, g AS sg, b AS sb, (CAST(a AS BIGINT) * {opacity} + 127) // 255 AS al FROM ({source})),
joined AS (SELECT *, al * 255 + a * (255 - al) AS den FROM below LEFT JOIN over USING (image_id, y, x))
SELECT image_id, w, h, y, x, {mix('r')}, {mix('g')}, {mix('b')},
  CAST(CASE WHEN al IS NULL OR al = 0 THEN a WHEN al = 255 OR a = 0 THEN al ELSE (den + 127) // 255 END AS INTEGER) AS a FROM joined"""


_SHIFTED = "SELECT image_id, w, h, y, x, 255 - r AS r, (g + 90) % 256 AS g, b, (a + 77) % 256 AS a FROM px"
_OPAQUE = "SELECT image_id, w, h, y, x, 255 - r AS r, (g + 90) % 256 AS g, b, 255 AS a FROM px"
_GRAY = "SELECT image_id, w, h, y, x, r, r AS g, r AS b, 255 AS a FROM px"


def _source(px, kind):
    if kind == "gray":
        return px.select("image_id", "w", "h", "y", "x", "r", F.col("r").alias("g"), F.col("r").alias("b"), F.lit(255).alias("a"))
    alpha = F.lit(255) if kind == "opaque" else (F.col("a") + 77) % 256
    return px.select("image_id", "w", "h", "y", "x", (255 - F.col("r")).alias("r"), ((F.col("g") + 90) % 256).alias("g"), "b", alpha.alias("a"))


for _name, _kind, _sql, _x, _y, _o in (
    ("opaque", "opaque", _OPAQUE, 0, 0, 255),
    ("alpha", "alpha", _SHIFTED, 0, 0, 255),
    ("opacity192", "alpha", _SHIFTED, 1, 1, 192),
    ("clipped", "alpha", _SHIFTED, -3, 2, 192),
    ("gray_src", "gray", _GRAY, 0, 0, 128),
):
    _add(f"px_composite_{_name}", lambda s, d, k=_kind, x=_x, y=_y, o=_o: P.composite_over(pixels(s, d), _source(pixels(s, d), k), x, y, o), _composite_sql(_sql, _x, _y, _o))
_add("px_composite_self", lambda s, d: P.composite_over(pixels(s, d), pixels(s, d), 1, 0, 200), _composite_sql("SELECT * FROM px", 1, 0, 200))

_W, _H = 7, 5


def _taps_sql(kind: str, n: int, size: str, out: str, at: str, wt: str) -> str:
    f = lambda x: f"CAST({x} AS FLOAT)"
    grid = f"SELECT DISTINCT {size} AS m, CAST(unnest(range({n})) AS INTEGER) AS d FROM (SELECT DISTINCT {size} FROM px)"
    if kind == "nearest":
        return f"SELECT m AS {size}, d AS {out}, least(m - 1, CAST(floor(({f('d')} + {f(0.5)}) * {f('m')} / {f(n)}) AS INTEGER)) AS {at}, {f(1)} AS {wt} FROM ({grid})"
    if kind == "bilinear":
        s = f"least(greatest(({f('d')} + {f(0.5)}) * {f('m')} / {f(n)} - {f(0.5)}, {f(0)}), {f('m')} - {f(1)})"
        placed = f"SELECT m, d, s, CAST(floor(s) AS INTEGER) AS j FROM (SELECT m, d, {s} AS s FROM ({grid}))"
        return f"SELECT m AS {size}, d AS {out}, j AS {at}, {f(1)} - (s - {f('j')}) AS {wt} FROM ({placed}) UNION ALL SELECT m, d, j + 1, s - {f('j')} FROM ({placed}) WHERE j + 1 < m"
    spread = f"SELECT m, d, lo, hi, CAST(unnest(range(CAST(floor(lo) AS BIGINT), least(m, CAST(ceil(hi) AS BIGINT) + 1))) AS INTEGER) AS i FROM (SELECT m, d, {f('d')} * {f('m')} / {f(n)} AS lo, {f('d + 1')} * {f('m')} / {f(n)} AS hi FROM ({grid}))"
    part = f"SELECT * FROM (SELECT m, d, i, least(hi, {f('i + 1')}) - greatest(lo, {f('i')}) AS part FROM ({spread})) WHERE part > 0"
    total = f"SELECT m, d, list_reduce(list_prepend({f(0)}, list(part ORDER BY i)), lambda acc, v: CAST(acc + v AS FLOAT)) AS total FROM ({part}) GROUP BY m, d"
    return f"SELECT p.m AS {size}, p.d AS {out}, p.i AS {at}, p.part / t.total AS {wt} FROM ({part}) p JOIN ({total}) t USING (m, d)"


def _resize_sql(kind: str, alpha: bool) -> str:
    head = f"{_PX}, tx AS ({_taps_sql(kind, _W, 'w', 'dx', 'x', 'wx')}), ty AS ({_taps_sql(kind, _H, 'h', 'dy', 'y', 'wy')})"
    if kind == "nearest":
        return f"{head} SELECT image_id, {_W} AS w, {_H} AS h, dy AS y, dx AS x, r, g, b, a FROM px JOIN tx USING (w, x) JOIN ty USING (h, y)"
    f = lambda x: f"CAST({x} AS FLOAT)"
    folded = lambda v, i: f"list_reduce(list_prepend({f(0)}, list({v} ORDER BY {i})), lambda acc, v: CAST(acc + v AS FLOAT))"
    byte = lambda v: f"CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= 255 THEN 255 ELSE CAST(floor({v} + {f(0.5)}) AS INTEGER) END"
    names = "rgba" if alpha else "rgb"
    term = lambda c: (f"wx * {f('a')}" if c == "a" else f"wx * {f('a')} / {f(255)} * {f(c)}") if alpha else f"wx * {f(c)}"
    one = f"SELECT image_id, h, y, dx, {', '.join(f'{folded(term(c), 'x')} AS {c}' for c in names)} FROM px JOIN tx USING (w, x) GROUP BY image_id, h, y, dx"
    two = f"SELECT image_id, dy, dx, {', '.join(f'{folded(f'wy * {c}', 'y')} AS {c}' for c in names)} FROM one JOIN ty USING (h, y) GROUP BY image_id, dy, dx"
    place = f"image_id, {_W} AS w, {_H} AS h, dy AS y, dx AS x"
    if not alpha:
        return f"{head}, one AS ({one}), two AS ({two}) SELECT {place}, {', '.join(f'{byte(c)} AS {c}' for c in names)}, 255 AS a FROM two"
    colour = lambda c: f"CASE WHEN oa = 0 THEN 0 WHEN oa = 255 THEN {byte(c)} ELSE {byte(f'({c} * {f(255)} / a)')} END AS {c}"
    return f"{head}, one AS ({one}), two AS ({two}), three AS (SELECT *, {byte('a')} AS oa FROM two) SELECT {place}, {', '.join(map(colour, 'rgb'))}, oa AS a FROM three"


_add("px_resize_nearest", lambda s, d: P.resize(pixels(s, d), _W, _H, "nearest"), _resize_sql("nearest", True))
for _kind in ("bilinear", "box"):
    _add(f"px_resize_{_kind}_rgb", lambda s, d, k=_kind: P.resize(pixels(s, d), _W, _H, k, alpha=False), _resize_sql(_kind, False))
    _add(f"px_resize_{_kind}_rgba", lambda s, d, k=_kind: P.resize(pixels(s, d), _W, _H, k), _resize_sql(_kind, True))

_add("px_new_image", lambda s, d: P.new_image(images(s, d)), f"{_PX} SELECT image_id, w, h, y, x, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM px")
_add("img_channel_stats", lambda s, d: P.channel_stats(pixels(s, d)), f"{_PX} SELECT image_id, count(*) AS n, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, CAST(sum({c}) AS BIGINT) AS {c}_sum" for c in "rgba") + " FROM px GROUP BY image_id")
_add("img_histogram", lambda s, d: P.histogram(pixels(s, d)), f"{_PX} SELECT channel, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS value FROM px" for c in "rgba") + ") GROUP BY channel, value")
_add("img_size_bytes", lambda s, d: P.pack(pixels(s, d)).select("image_id", F.octet_length("data").cast("long").alias("size_bytes")), f"SELECT image_id, CAST(w AS BIGINT) * h * 4 AS size_bytes FROM ({IMAGES_SQL})")
_add("img_dims_valid", lambda s, d: P.pack(pixels(s, d)).withColumn("width", F.expr("width + IF(image_id % 5 = 0, 1, 0)")).transform(lambda df: df.select("image_id", P.valid_packed(df).alias("valid"))), "SELECT p_partkey AS image_id, p_partkey % 5 <> 0 AS valid FROM part")
_add("pack_roundtrip", lambda s, d: P.explode_pixels(P.pack(pixels(s, d))), PIXELS_SQL)
