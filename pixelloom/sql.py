"""Codecs, metadata and container readers as SQL functions: scalar ones, and table functions for LATERAL joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import bytes as B
from .functions import codecs, kernels
from .functions import images as I
from .functions.meta import columns as M
from .functions.meta import containers, exif, patch, video


def _image(one):
    """Arrow function (image, arguments...) to an image; errors go into the row."""
    guarded = I._guarded("permissive", lambda x, *args: one(x(), *args))

    def run(img: pa.Array, *args: pa.Array) -> pa.Array:
        return I._images([guarded(x, *[a.as_py() for a in rest]) for x, *rest in zip(I._whole(img), *args, strict=True)])

    return run


def _file(one):
    """Arrow function (content, arguments...) to ``struct<data, error>``."""

    def run(content: pa.Array, *args: pa.Array) -> pa.Array:
        out = []
        for data, *rest in zip(content, *args, strict=True):
            try:
                out.append({"data": one(data.as_py(), *[a.as_py() for a in rest]), "error": None} if data.is_valid else None)
            except ValueError as error:
                out.append({"data": None, "error": str(error)})
        return pa.array(out, M._PA_FILE)

    return run


def _facts(one, kind: pa.DataType):
    return lambda content: pa.array([one(v.as_py()) if v.is_valid else None for v in content], kind)


def _decode(content: pa.Array) -> pa.Array:
    one = I._guarded("permissive", lambda data: codecs.decode(bytes(data)))
    return I._images([one(v) for v in I._views(content)])


def _encode(img: pa.Array, kind: pa.Array, quality: pa.Array) -> pa.Array:
    one = I._guarded("permissive", lambda x, kind, quality: codecs.encode(x(), kind, quality))
    return I._blobs([one(x, k.as_py(), q.as_py()) for x, k, q in zip(I._whole(img), kind, quality, strict=True)])


def _video(content: pa.Array) -> pa.Array:
    return pa.array([video.facts(v.as_py()) if v.is_valid else None for v in content], video._PA_VIDEO)


#: Name to (result type, Arrow function).
FUNCTIONS = {
    "image_decode": (I.IMAGE, _decode),
    "image_encode": (I.BLOB, _encode),
    "image_crop": (I.IMAGE, _image(kernels.crop)),
    "image_dihedral": (I.IMAGE, _image(kernels.dihedral)),
    "image_orient": (I.IMAGE, _image(kernels.orient)),
    "image_resize": (I.IMAGE, _image(kernels.resize)),
    "image_format": ("string", _facts(containers.kind_of, pa.string())),
    "metadata_read": (M.META, _facts(M.metadata_of, M._PA_META)),
    "metadata_strip": (M.FILE, _file(containers.strip)),
    "metadata_set_orientation": (M.FILE, _file(patch.orientation)),
    "metadata_set_date": (M.FILE, _file(patch.date_time)),
    "xmp_packet": ("string", _facts(containers.xmp_packet, pa.string())),
    "video_read": (video.VIDEO, _video),
}


class ExifEntries:
    """A row for each entry of the EXIF directories of a file."""

    def eval(self, content: bytes):
        tiff = containers.tiff_of(bytes(content)) if content is not None else None
        for tag in exif.entries(tiff) if tiff else []:
            yield tag.ifd, tag.id, exif.tag_name(tag), tag.type, tag.count, tag.text()


class Boxes:
    """A row for each box of an ISO base media file."""

    def eval(self, content: bytes):
        yield from containers.boxes(bytes(content)) if content is not None else ()


class Chunks:
    """A row for each segment of a JPEG, chunk of a PNG or of a RIFF file."""

    def eval(self, content: bytes):
        data = bytes(content or b"")
        kind = containers.kind_of(data)
        if kind == "jpeg":
            yield from ((f"{mark:02X}", start, end) for mark, start, end in containers.jpeg_segments(data))
        elif kind in ("png", "webp"):
            read = containers.png_chunks if kind == "png" else containers.riff_chunks
            yield from ((name.decode("latin-1"), start, end) for name, start, end in read(data))


#: Name to (row type, handler).
TABLE_FUNCTIONS = {
    "exif_entries": ("ifd string, tag int, name string, type int, count long, value string", ExifEntries),
    "media_boxes": ("path string, body_start long, body_end long, depth int", Boxes),
    "file_chunks": ("name string, start long, end long", Chunks),
}


def register(spark: SparkSession) -> None:
    """Make all of them callable from this session's SQL, and the byte readers too."""
    from .session import ship

    ship(spark)
    B.register(spark)
    for name, (kind, function) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(function, kind))
    for name, (schema, handler) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))
