"""Functions that SQL can call."""

import numpy as np

from pixelloom import sql
from pixelloom.functions import codecs
from pixelloom.functions.codecs.base import image
from pixelloom.functions.meta import containers, exif
from pixelloom.plans import binaries


def test_functions_from_sql(spark):
    sql.register(spark)
    plain = codecs.encode(image(np.arange(60, dtype=np.uint8).reshape(4, 5, 3), "rgb"), "png")
    tree = exif.ExifData()
    tree.set("Make", "Loom")
    tree.set("Orientation", "6")
    jpeg = containers.write_exif(codecs.encode(image(np.full((8, 8, 1), 99, np.uint8), "gray"), "jpeg"), tree.serialize())
    movie = binaries.movie(3_600_000_000, 64, 36, "Loom", "Two", True)
    spark.createDataFrame([(1, plain), (2, jpeg), (3, movie), (4, b"\0\1"), (5, None)], "id int, content binary").createOrReplaceTempView("sql_files")
    small = spark.sql("SELECT id, image_format(content) AS f, image_crop(image_decode(content), 1, 1, 2, 3) AS i, image_crop(image_decode(content), 9, 9, 2, 3).error.code AS e FROM sql_files ORDER BY id").collect()
    assert [r.f for r in small[:3]] == ["png", "jpeg", "isobmff"] and small[0].i.width == 2 and small[0].i.height == 3
    assert bytes(small[0].i.data) == np.arange(60, dtype=np.uint8).reshape(4, 5, 3)[1:4, 1:3].tobytes()
    assert [r.e for r in small] == ["invalid_arg", "invalid_arg", "unsupported", "unsupported", None] and small[4].i is None
    sizes = spark.sql("SELECT image_resize(image_decode(content), 10, 2, 'box').width AS w, image_decode(image_encode(image_orient(image_decode(content), 6), 'png', 90).data).height AS h FROM sql_files WHERE id = 1").first()
    assert (sizes.w, sizes.h) == (10, 5)
    meta = spark.sql("SELECT metadata_read(content).orientation AS o, metadata_read(metadata_set_orientation(content, 3).data).orientation AS p, metadata_set_date(content, '2020-01-01').error AS e, size(metadata_read(metadata_strip(content).data).tags) AS n, xmp_packet(content) AS x FROM sql_files WHERE id = 2").first()
    assert (meta.o, meta.p, meta.e, meta.n, meta.x) == (6, 3, "no time to overwrite", 0, None)
    assert spark.sql("SELECT video_read(content).model AS m FROM sql_files WHERE id = 3").first().m == "Two"
    entries = spark.sql("SELECT f.id, e.name, e.value FROM sql_files f, LATERAL exif_entries(f.content) e ORDER BY e.tag").collect()
    assert [tuple(r) for r in entries] == [(2, "Make", "Loom"), (2, "Orientation", "6")]
    assert {r.path for r in spark.sql("SELECT b.path FROM sql_files f, LATERAL media_boxes(f.content) b").collect()} >= {"/moov/mvhd", "/moov/trak/tkhd"}
    chunks = spark.sql("SELECT f.id, c.name FROM sql_files f, LATERAL file_chunks(f.content) c").collect()
    assert {(1, "IHDR"), (1, "IEND"), (2, "E1")} <= {tuple(r) for r in chunks}
    assert spark.sql("SELECT u16be(X'0102', 0) AS v").first().v == 258
