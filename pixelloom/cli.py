"""Jobs over folders of files: ``python -m pixelloom.cli COMMAND PATH ...``."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import FILTERS, FORMATS, ImageFrame
from .functions.meta import columns as M
from .session import ship
from .sources import read_files, write_files

TURNS = {"90": "rot90", "180": "rot180", "270": "rot270", "fliph": "flip_h", "flipv": "flip_v"}


def _dims(text: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d+)x(\d+)", text)
    if not found:
        raise argparse.ArgumentTypeError("WxH")
    return int(found[1]), int(found[2])


def _rect(text: str) -> tuple[int, int, int, int]:
    found = re.fullmatch(r"(\d+),(\d+),(\d+)x(\d+)", text)
    if not found:
        raise argparse.ArgumentTypeError("X,Y,WxH")
    return tuple(map(int, found.groups()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pixelloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("show", "audit", "xmp"):
        commands.add_parser(name).add_argument("path")
    for name in ("strip", "thumb", "set", "convert", "resize", "crop", "rotate"):
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("out")
        if name == "set":
            one.add_argument("tags", nargs="+", metavar="NAME=VALUE")
        if name in ("convert", "resize", "crop", "rotate"):
            one.add_argument("--format", choices=FORMATS, default="png")
            one.add_argument("--quality", type=int, default=90, choices=range(1, 101), metavar="1-100")
        if name == "resize":
            one.add_argument("size", type=_dims)
            one.add_argument("--filter", choices=FILTERS, default="bilinear")
        if name == "crop":
            one.add_argument("rect", type=_rect)
        if name == "rotate":
            one.add_argument("turn", choices=TURNS)
    return top


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The command's result: rows to show, or a report of the files written."""
    args = parser().parse_args(argv)
    files = read_files(ship(spark), args.path)
    name = F.element_at(F.split("path", "/"), -1)
    if args.command == "show":
        read = files.select("path", M.read(F.col("content")).alias("m"))
        return read.select("path", F.explode(F.array_sort(F.map_entries("m.tags"))).alias("t")).select("path", "t.key", "t.value").orderBy("path", "key")
    if args.command == "audit":
        return files.select("path", M.audit(M.read(F.col("content"))).alias("a")).select("path", "a.*", F.when(F.col("a.flags") == 0, "clean").otherwise("sensitive").alias("verdict"))
    if args.command == "xmp":
        read = files.select("path", M.read(F.col("content"))["xmp"].alias("x"))
        return read.select("path", *[F.try_element_at("x", F.lit(f"dc:{n}")).alias(n) for n in ("title", "description", "creator", "rights", "subject")])
    if args.command == "strip":
        done = files.select(F.concat(name, F.lit(".clean")).alias("path"), M.strip(F.col("content"))["data"].alias("content"))
        return write_files(done, args.out)
    if args.command == "thumb":
        done = files.select(F.concat(name, F.lit(".thumb.jpg")).alias("path"), M.read(F.col("content"))["thumbnail"].alias("content")).where("content IS NOT NULL")
        return write_files(done, args.out)
    if args.command == "set":
        pairs = [t.split("=", 1) for t in args.tags]
        exif = [p for p in pairs if not p[0].startswith("IPTC:")]
        content = F.col("content")
        if exif:
            content = M.set_tags(content, F.create_map(*[F.lit(x) for p in exif for x in p]))["data"]
        if iptc := [p for p in pairs if p[0].startswith("IPTC:")]:
            content = M.write_iptc(content, F.array(*[F.struct(F.lit(n[5:]).alias("name"), F.lit(v).alias("value")) for n, v in iptc]))["data"]
        return write_files(files.select(name.alias("path"), content.alias("content")), args.out)
    frame = ImageFrame.decode(files)
    if args.command == "resize":
        frame = frame.resize(*args.size, args.filter)
    elif args.command == "crop":
        frame = frame.crop(*args.rect)
    elif args.command == "rotate":
        frame = frame.rotate(TURNS[args.turn])
    return frame.write(args.out, args.format, args.quality)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("pixelloom").getOrCreate()
    run(spark, sys.argv[1:]).show(1000, truncate=False)


if __name__ == "__main__":
    main()
