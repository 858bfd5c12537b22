"""Files as rows of (path, modificationTime, length, content), and rows as files."""

from __future__ import annotations

import os
import posixpath
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Bytes that hold the metadata of nearly every file.
HEADER_BYTES = 1 << 24


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """One row for each file, with its ``format`` by the first bytes.

    ``content`` isn't read where no later column needs it; filters on path, time and
    length are pushed into the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.withColumn("format", images.sniff(F.col("content")))


def _is_mounted(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"


def read_headers(spark: SparkSession, path: str, header_bytes: int = HEADER_BYTES, glob: str | None = None) -> DataFrame:
    """Like :func:`read_files`, but only the first ``header_bytes`` of each file.

    In a mounted folder no more than those are read: the scan only lists the files. In
    another store the scan reads files whole and cuts them in its task. A file that goes
    away meanwhile has a null content.
    """
    files = read_files(spark, path, glob)
    if not _is_mounted(spark, path):
        return files.withColumn("content", F.substring("content", 1, header_bytes))

    def heads(batches):
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                try:
                    with open(unquote(urlparse(uri).path), "rb") as file:
                        found.append(file.read(header_bytes))
                except FileNotFoundError:
                    found.append(None)
            yield pa.record_batch([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "content"])

    listed = files.select("path", "modificationTime", "length").mapInArrow(heads, FILES)
    return listed.withColumn("format", images.sniff(F.col("content")))


def stream_files(spark: SparkSession, path: str, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream, at most ``max_files`` in a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def write_files(df: DataFrame, folder: str, name_col: str = "path", content_col: str = "content", overwrite: bool = False) -> DataFrame:
    """Write each row's bytes to ``folder`` (a mounted path) and give ``(name, bytes, error)``.

    A file appears whole or not at all: it is written under another name, synced and
    renamed, so a task may be tried again. A name must stay inside the folder; one that
    exists is refused unless ``overwrite``. Null contents write nothing. Lazy like any
    transformation: nothing is written until the result is read.
    """

    def put(name: str, data: bytes | None) -> tuple[int, str | None]:
        clean = posixpath.normpath(name or "")
        if not name or clean.startswith(("..", "/")) or clean == ".":
            return 0, "the name leads out of the folder"
        if data is None:
            return 0, "no content"
        target = os.path.join(folder, clean)
        if os.path.exists(target) and not overwrite:
            with open(target, "rb") as have:
                same = have.read() == data
            return (len(data), None) if same else (0, "the file exists")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{target}.{os.getpid()}-{os.urandom(4).hex()}.tmp"
        with open(own, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(own, target)
        return len(data), None

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            done = [put(n, d.as_py()) for n, d in zip(names, batch.column(1), strict=True)]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["name", "bytes", "error"])

    return df.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, "name string, bytes long, error string")
