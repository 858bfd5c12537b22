"""EXIF, IPTC, XMP and containers."""

import struct

import numpy as np
import pytest

from pixelloom.functions import codecs, heif
from pixelloom.functions.codecs.base import image
from pixelloom.functions.meta import columns, containers, exif, makernotes, patch, vendors, video, xmp
from pixelloom.plans import binaries

JPEG = codecs.encode(image(np.full((8, 8, 1), 99, np.uint8), "gray"), "jpeg")
PNG = codecs.encode(image(np.full((8, 8, 1), 99, np.uint8), "gray"), "png")


def tree():
    out = exif.ExifData()
    for name, value in (("Make", "Loom"), ("Model", "One"), ("Orientation", "6"), ("FNumber", "28/10"), ("ExposureTime", "1/250"), ("Flash", "25"), ("UserComment", "hi"), ("ExposureCompensation", "-1/3")):
        out.set(name, value)
    out.set_gps(-33.5, 151.25, 12.5)
    return out


@pytest.mark.parametrize("data", [JPEG, PNG, exif.ExifData().serialize()])
def test_round_trip_in_containers(data):
    written = containers.write_exif(data, tree().serialize())
    meta = columns.metadata_of(written)
    tags = dict(meta["tags"])
    assert meta["is_valid"] and meta["camera_model"] == "Loom One" and meta["orientation"] == 6
    assert tags["Orientation"] == "Rotate 90 CW" and tags["FNumber"] == "f/2.8" and tags["ExposureTime"] == "1/250" and tags["Flash"] == "Auto, Fired"
    assert meta["latitude"] == -33.5 and meta["longitude"] == 151.25 and meta["altitude"] == 12.5
    assert tags["GPSLatitude"] == "33 deg 30' 0.00\" S"
    again = exif.ExifData.parse(containers.tiff_of(written))
    assert again.serialize() == tree().serialize()


def test_big_endian_and_broken_directories():
    entry = struct.pack(">HHIHH", 0x0112, 3, 1, 8, 0)
    tiff = b"MM\0*" + struct.pack(">IH", 8, 1) + entry + struct.pack(">I", 8)  # points to itself
    assert dict(exif.named(tiff)[0]) == {"Orientation": "Rotate 270 CW"}
    for cut in range(len(tiff)):
        exif.entries(tiff[:cut])
    assert exif.entries(b"nothing at all") == []


def test_values_are_checked():
    out = exif.ExifData()
    for name, value in (("Orientation", "x"), ("Orientation", "70000"), ("FNumber", "1/0"), ("Nothing", "1"), ("ISO", "")):
        with pytest.raises(ValueError):
            out.set(name, value)
    with pytest.raises(ValueError):
        out.set_gps(91, 0)


def test_strip_restores_the_file():
    for data in (JPEG, PNG):
        assert containers.strip(containers.write_exif(data, tree().serialize())) == data
    with pytest.raises(ValueError):
        containers.strip(b"BM" + bytes(60))


def test_iptc_and_xmp():
    with_iptc = containers.write_iptc(JPEG, [(25, "a"), (25, "b"), (80, "Ann")])
    assert containers.iptc_datasets(with_iptc) == [(25, "a"), (25, "b"), (80, "Ann")]
    packet = xmp.build({"dc:creator": ["Ann", "Bo"], "dc:title": ["T & t"]})
    vendor = packet.replace("<rdf:Description ", '<rdf:Description xmlns:v="http://v.example/" v:keep="yes" ', 1)
    merged = xmp.merge(vendor, {"dc:title": [], "xmp:Label": ["red"]})
    assert xmp.properties(merged) == {"v:keep": ["yes"], "dc:creator": ["Ann", "Bo"], "xmp:Label": ["red"]}
    both = containers.write_xmp(with_iptc, merged)
    assert dict(columns.metadata_of(both)["xmp"])["dc:creator"] == "Ann, Bo"
    with pytest.raises(ValueError):
        xmp.build({"unknown:x": ["1"]})
    assert xmp.properties("<broken") == {}


def test_thumbnail():
    tiff = bytearray(b"II*\0" + struct.pack("<IH", 8, 0) + struct.pack("<I", 14))
    tiff += struct.pack("<H", 2) + struct.pack("<HHII", 0x0201, 4, 1, 44) + struct.pack("<HHII", 0x0202, 4, 1, len(JPEG)) + bytes(4)
    assert exif.thumbnail(bytes(tiff) + JPEG) == JPEG
    assert exif.thumbnail(bytes(tiff)) is None


def _box(kind, body, full=False):
    body = (bytes(4) if full else b"") + body
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def heic(exif_body=b""):
    infe = _box(b"infe", b"\x02\0\0\0" + struct.pack(">HH", 1, 0) + b"hvc1\0") + _box(b"infe", b"\x02\0\0\0" + struct.pack(">HH", 2, 0) + b"Exif\0")
    ipco = _box(b"ispe", struct.pack(">II", 64, 48), True) + _box(b"irot", b"\x01") + _box(b"clap", struct.pack(">8I", 60, 1, 40, 1, 0, 1, 0, 1))
    ipma = _box(b"ipma", struct.pack(">IHB3B", 1, 1, 3, 1, 2, 3), True)
    head = _box(b"ftyp", b"heic\0\0\0\0heic")

    def meta(offset):
        iloc = _box(b"iloc", b"\x44\0" + struct.pack(">HHHHII", 1, 2, 0, 1, offset, len(exif_body)), True)
        return _box(b"meta", _box(b"pitm", b"\0\1", True) + _box(b"iinf", b"\0\2" + infe, True) + iloc + _box(b"iprp", _box(b"ipco", ipco) + ipma), True)

    offset = len(head) + len(meta(0)) + 8
    return head + meta(offset) + _box(b"mdat", exif_body)


def test_heif_facts_and_exif():
    body = (6).to_bytes(4, "big") + b"Exif\0\0" + tree().serialize()
    data = heic(body)
    assert heif.facts(data) == {"width": 60, "height": 40, "coded_width": 64, "coded_height": 48, "rotation": 90, "mirrored": False, "codec": "hvc1", "item_id": 1}
    assert columns.metadata_of(data)["camera_model"] == "Loom One"
    longer = tree()
    longer.set("Artist", "x" * 500)
    moved = containers.write_exif(data, longer.serialize())
    assert dict(columns.metadata_of(moved)["tags"])["Artist"] == "x" * 500
    assert not columns.metadata_of(containers.strip(data))["is_valid"]
    for cut in range(0, len(data), 7):
        heif.facts(data[:cut])
        columns.metadata_of(data[:cut])


def test_files_and_dates(spark, tmp_path):
    from pyspark.sql import functions as F

    from pixelloom.sources import read_files, read_headers, write_files

    rows = spark.createDataFrame([("a.jpg", bytearray(JPEG)), ("../b.jpg", bytearray(JPEG)), ("c.jpg", None)], "path string, content binary")
    done = {r.name: r for r in write_files(rows, str(tmp_path)).collect()}
    assert done["a.jpg"].error is None and done["../b.jpg"].error and done["c.jpg"].error
    assert [r.format for r in read_files(spark, str(tmp_path)).select("format").collect()] == ["jpeg"]
    assert len(read_headers(spark, str(tmp_path), 10).first().content) == 10
    dates = spark.createDataFrame([("2024:01:02 03:04:05",), ("2024-01-02",), ("1700:01:01",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in dates.select(columns.parse_date(F.col("d"))).collect()] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "None", "None", "None"]


def _directory(entries, at, order):
    """A directory at offset ``at`` of (tag, type, values or bytes)."""
    mark = "<" if order == "little" else ">"
    kinds = {2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 7: (1, "s"), 10: (8, "i")}
    head, pool, place = struct.pack(mark + "H", len(entries)), b"", at + 6 + 12 * len(entries)
    for tag, kind, values in entries:
        size, code = kinds[kind]
        raw = values if isinstance(values, bytes) else struct.pack(f"{mark}{len(values)}{code}", *values)
        head += struct.pack(mark + "HHI", tag, kind, len(raw) // size)
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack(mark + "I", place + len(pool))
            pool += raw
    return head + bytes(4) + pool


def with_note(make, note):
    """A little-endian TIFF stream whose maker note is ``note(its offset)``."""
    exif_at = 8 + 2 + 2 * 12 + 4 + len(make) + 1
    note_at = exif_at + 2 + 12 + 4
    ifd0 = _directory([(0x010F, 2, make.encode() + b"\0"), (0x8769, 4, [exif_at])], 8, "little")
    body = note(note_at)
    entry = struct.pack("<HHHII", 1, 0x927C, 7, len(body), note_at) + bytes(4)
    return b"II*\0" + struct.pack("<I", 8) + ifd0 + entry + body


def test_maker_notes():
    settings = [0] * 21
    settings[3], settings[7], settings[17] = 3, 2, 5
    canon = with_note("Canon Inc", lambda at: _directory([(0x0001, 3, settings), (0x0008, 4, [1234567]), (0x0095, 2, b"EF 50mm\0")], at, "little"))
    found = dict(columns.metadata_of(canon)["tags"])
    assert found["Canon:Quality"] == "Fine" and found["Canon:FocusMode"] == "AI Focus AF" and found["Canon:FileNumber"] == "123-4567" and found["Canon:LensModel"] == "EF 50mm"
    nikon = with_note("NIKON CORP", lambda at: b"Nikon\0\2\0\0\0MM\0*\0\0\0\x08" + _directory([(0x0004, 2, b"FINE\0\0"), (0x0007, 2, b"AF-S  \0")], 8, "big"))
    assert makernotes.parse(nikon, "Nikon") == {"Nikon:Quality": "Fine", "Nikon:FocusMode": "AF-S"}
    panasonic = with_note("Panasonic", lambda at: b"Panasonic\0\0\0" + _directory([(0x0001, 3, [2]), (0x0002, 7, bytes((0, 1, 0, 6))), (0x0029, 4, [366101])], at + 12, "little"))
    assert makernotes.parse(panasonic, "Panasonic") == {"Panasonic:ImageQuality": "High", "Panasonic:FirmwareVersion": "0.1.0.6", "Panasonic:TimeSincePowerOn": "01:01:01.01"}
    fuji = with_note("FUJIFILM", lambda at: b"FUJIFILM\x0c\0\0\0" + _directory([(0x1000, 2, b"NORMAL \0"), (0x1031, 3, [512])], 12, "little"))
    assert makernotes.parse(fuji, "Fujifilm") == {"FujiFilm:Quality": "NORMAL", "FujiFilm:PictureMode": "Shutter speed priority AE"}
    apple = with_note("Apple", lambda at: b"Apple iOS\0\0\1MM" + _directory([(0x0014, 4, [10]), (0x0008, 10, [1, 2, -1, 4]), (0x0099, 4, [7])], 14, "big"))
    assert makernotes.parse(apple, "Apple") == {"Apple:ImageCaptureType": "Photo", "Apple:AccelerationVector": "0.5 -0.25", "Apple:0x0099": "7"}
    for tiff in (canon, nikon, panasonic, fuji, apple):
        for cut in range(8, len(tiff), 5):
            columns.metadata_of(tiff[:cut])


def test_files_of_large_ids(spark, tmp_path):
    from pixelloom.plans import meta_queries

    rows = [(i, f"part {i}", "Brand#12", 7) for i in (655, 656, 20000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = {r.image_id: r for r in meta_queries._round_trip(spark, str(tmp_path)).collect()}
    assert {i: (r.iso, r.is_valid) for i, r in found.items()} == {i: (str(i * 100 % 65536), True) for i in (655, 656, 20000)}


@pytest.mark.parametrize("data", [JPEG, PNG, exif.ExifData().serialize()])
def test_values_are_overwritten_in_place(data):
    full = tree()
    full.set_date("2020:01:02 03:04:05")
    written = containers.write_exif(data, full.serialize())
    later = patch.date_time(written, "2021-02-03T04:05")
    tags = dict(columns.metadata_of(later)["tags"])
    assert len(later) == len(written) and tags["DateTimeOriginal"] == tags["ModifyDate"] == "2021:02:03 04:05:00"
    for broken in ("", None, "2021-13-01", "yesterday"):
        with pytest.raises(ValueError, match="not a date"):
            patch.date_time(written, broken)
    if data is JPEG:
        turned = patch.orientation(written, 3)
        assert columns.metadata_of(turned)["orientation"] == 3 and sum(a != b for a, b in zip(turned, written, strict=True)) == 1
    else:
        with pytest.raises(ValueError, match="not a JPEG"):
            patch.orientation(written, 3)
    for value in (0, 9, None):
        with pytest.raises(ValueError, match="from 1 to 8"):
            patch.orientation(written, value)
    with pytest.raises(ValueError, match="no EXIF"):
        patch.orientation(JPEG, 1)


def test_movies():
    for by_keys in (False, True):
        data = binaries.movie(3_600_000_000, 640, 360, "Loom", "Two", by_keys)
        assert video.facts(data) == {"make": "Loom", "model": "Two", "software": None, "width": 640, "height": 360, "created": "2018:01:28 16:00:00"}
        assert columns.metadata_of(data)["camera_model"] == "Loom Two" and dict(columns.metadata_of(data)["tags"])["CreateDate"] == "2018:01:28 16:00:00"
        for cut in range(0, len(data), 7):
            video.facts(data[:cut])
    assert video.facts(binaries.movie(0, 0, 0, "", "", False)) == dict.fromkeys(("make", "model", "software", "width", "height", "created")) and video.facts(JPEG) is None


def test_movies_of_late_times():
    for seconds, created in (((1 << 32) - 1, "2040:02:06 06:28:15"), (1 << 32, "2040:02:06 06:28:16"), (106_680_000_000, "5284:07:20 05:20:00")):
        assert video.facts(binaries.movie(seconds, 640, 360, "Loom", "Two", True)) | {"software": None} == {"make": "Loom", "model": "Two", "software": None, "width": 640, "height": 360, "created": created}


def test_vendor_notes():
    block = bytes([2, 0x41, 0x11, 0x21, 0, 0x21, 56, 0x41, 5, 0, 0x31, 0, 0, 9, 1, 0, 0x20, 0xA4, 68 + 8 * 5 + 3, 68 + 32, 40, 66])
    found = vendors.pentax_settings(block, True)
    assert (found["PictureMode2"], found["E-DialInProgram"], found["FlashOptions"], found["FocusMode2"], found["WhiteBalanceSet"]) == ("Program AE", "P Shift", "Red-eye reduction", "AF-S", "Cloudy")
    assert (found["AFPointSelected2"], found["DriveMode2"], found["ISOFloor"], found["RawAndJpgRecording"], found["JpgRecordedPixels"]) == ("Upper-left, Center", "Continuous, Exposure Bracket", "800", "RAW+JPEG (DNG, Best)", "6 MP")
    assert (found["SRActive"], found["Rotation"], found["ISOSetting"], found["TvExposureTimeSetting"], found["AvApertureSetting"], found["SvISOSetting"], found["BaseExposureCompensation"]) == ("Yes", "Rotate 180", "Auto", "1/40", "4.0", "200", "-0.2")
    exposure = vendors.pentax_exposure(bytes([104, 100, 40, 72, 0xF8, 104, 35, 0, 6, 84, 84, 148, 0x10]))
    assert exposure == {"AEExposureTime": "1/21", "AEAperture": "4.0", "AE_ISO": "200", "AEXv": "1", "AEBXv": "-1", "AEMinExposureTime": "1/21", "AEApertureSteps": "6", "AEMaxAperture": "2.0", "AEMaxAperture2": "2.0", "AEMinAperture": "32", "AEMeteringMode": "Center-weighted average", "AEProgramMode": "Standard"}
    assert vendors.pentax_settings(block[:5], True) == {} == vendors.pentax_exposure(b"")
    for order, mark in (("little", b"II"), ("big", b"MM")):
        tiff = binaries.tiff_with_note("PENTAX", b"AOC\0" + mark, [(0x0006, 7, 4, (2007).to_bytes(2, order) + b"\3\4"), (0x0007, 7, 3, b"\5\6\7"), (0x005C, 1, 2, b"\1\1"), (0x0002, 3, 2, (640).to_bytes(2, order) + (480).to_bytes(2, order))], order)
        assert makernotes.parse(tiff, "PENTAX") == {"Pentax:Date": "2007:03:04", "Pentax:Time": "05:06:07", "Pentax:SRResult": "Stabilized", "Pentax:ShakeReduction": "On", "Pentax:PreviewImageSize": "640x480"}
    tiff = binaries.tiff_with_note("OLYMPUS", b"OLYMP\0\1\0", [(0x0200, 4, 3, b"".join(v.to_bytes(4, "little") for v in (3, 2, 1))), (0x0204, 5, 1, b"\3\0\0\0\2\0\0\0"), (0x0205, 5, 1, b"\x27\0\0\0\5\0\0\0"), (0x0207, 2, 6, b"SR951\0"), (0x0208, 7, 20, b"[x] Resolution=2 Y=1")])
    assert makernotes.parse(tiff, "Olympus") == {"Olympus:SpecialMode": "Panorama, Sequence: 2, Panorama: Left to right", "Olympus:DigitalZoom": "1.5", "Olympus:FocalPlaneDiagonal": "7.8 mm", "Olympus:CameraType": "C2000Z", "Olympus:Resolution": "2"}
    for make, head in (("PENTAX", b"AOC"), ("Olympus", b"OLYMPUS\0"), ("Casio", b"QVC\0"), ("Sigma", b"SIGMA")):
        assert makernotes.parse(binaries.tiff_with_note(make, head, []), make) == {}
