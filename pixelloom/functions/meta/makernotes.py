"""Maker notes as tables of rules: ``Vendor:Name`` to text; five vendors here, five in :mod:`vendors`.

A rule reads one tag, or one number of a tag's array. Numbers without a label give nothing.
"""

from __future__ import annotations

from . import exif, vendors

# What the vendors' numbers stand for, as metadata tools name it.
APPLE_NAMES = {
    0x0001: "MakerNoteVersion", 0x0004: "AEStable", 0x0005: "AETarget", 0x0006: "AEAverage", 0x0007: "AFStable", 0x0008: "AccelerationVector",
    0x000A: "HDRImageType", 0x000C: "FocusDistanceRange", 0x0014: "ImageCaptureType", 0x001F: "PhotosAppFeatureFlags", 0x0021: "HDRHeadroom",
    0x0023: "AFPerformance", 0x0027: "SignalToNoiseRatio", 0x002B: "PhotoIdentifier", 0x002D: "ColorTemperature", 0x002E: "CameraType",
    0x002F: "FocusPosition", 0x0030: "HDRGain", 0x0038: "AFMeasuredDepth", 0x003D: "AFConfidence",
}
APPLE_LABELS = {"ImageCaptureType": {"1": "ProRAW", "2": "Portrait", "10": "Photo", "12": "Scene"}, "CameraType": {"0": "Back Wide Angle", "1": "Back Normal", "6": "Front"}}
APPLE_DECIMALS = ("AccelerationVector", "FocusDistanceRange", "HDRHeadroom", "SignalToNoiseRatio", "HDRGain")
ON_OFF = {0: "Off", 1: "On"}
#: (tag, place in its array, name, labels)
CANON_ARRAYS = (
    (0x0001, 3, "Quality", {1: "Economy", 2: "Normal", 3: "Fine", 4: "RAW", 5: "Superfine"}),
    (0x0001, 4, "CanonFlashMode", {0: "Off", 1: "Auto", 2: "On", 3: "Red-eye reduction", 4: "Slow-sync", 5: "Red-eye reduction (Auto)", 6: "Red-eye reduction (On)", 16: "External flash"}),
    (0x0001, 5, "ContinuousDrive", {0: "Single", 1: "Continuous"}),
    (0x0001, 7, "FocusMode", {0: "One-shot AF", 1: "AI Servo AF", 2: "AI Focus AF", 3: "Manual Focus (3)", 6: "Manual Focus (6)"}),
    (0x0001, 9, "RecordMode", {1: "JPEG", 2: "CRW+THM", 3: "AVI+THM", 4: "TIF", 5: "TIF+JPEG", 6: "CR2", 7: "CR2+JPEG", 9: "MOV", 10: "MP4"}),
    (0x0001, 10, "CanonImageSize", {0: "Large", 1: "Medium", 2: "Small"}),
    (0x0001, 11, "EasyMode", {0: "Full auto", 1: "Manual"}),
    (0x0001, 17, "MeteringMode", {0: "Default", 1: "Spot", 2: "Average", 3: "Evaluative", 4: "Partial", 5: "Center-weighted average"}),
    (0x0001, 20, "CanonExposureMode", {0: "Easy", 1: "Program AE", 2: "Shutter speed priority AE", 3: "Aperture-priority AE", 4: "Manual", 5: "Depth-of-field AE", 6: "M-Dep", 7: "Bulb", 8: "Flexible-priority AE"}),
    (0x0004, 7, "WhiteBalance", {0: "Auto", 1: "Daylight", 2: "Cloudy", 3: "Tungsten", 4: "Fluorescent", 5: "Flash", 6: "Custom", 7: "Black & White", 8: "Shade"}),
    (0x0004, 8, "SlowShutter", {0: "Off", 1: "Night Scene", 2: "On", 3: "None"}),
    (0x0004, 16, "AutoExposureBracketing", {0: "Off", 1: "On (shot 1)", 2: "On (shot 2)", 3: "On (shot 3)"}),
    (0x0004, 18, "ControlMode", {1: "Camera Local Control", 3: "Computer Remote Control"}),
    (0x0004, 26, "CameraType", {248: "EOS High-end", 250: "Compact", 252: "EOS Mid-range", 255: "DV Camera"}),
    (0x0004, 27, "AutoRotate", {0: "None", 1: "Rotate 90 CW", 2: "Rotate 180", 3: "Rotate 270 CW"}),
)
CANON_NAMES = {0x0006: "ImageType", 0x0007: "FirmwareVersion", 0x0008: "FileNumber", 0x0009: "OwnerName", 0x000C: "SerialNumber", 0x0010: "CanonModelID", 0x0095: "LensModel", 0x0096: "InternalSerialNumber"}
NIKON_NAMES = {0x0003: "ColorMode", 0x0004: "Quality", 0x0005: "WhiteBalance", 0x0006: "Sharpness", 0x0007: "FocusMode", 0x000F: "ISOSelection", 0x0080: "ImageAdjustment", 0x0082: "AuxiliaryLens", 0x0084: "Lens"}
#: tag to (name, labels), None for text.
PANASONIC = {
    0x0001: ("ImageQuality", {1: "TIFF", 2: "High", 3: "Normal", 6: "Very High", 7: "RAW", 9: "Motion Picture"}),
    0x0003: ("WhiteBalance", {1: "Auto", 2: "Daylight", 3: "Cloudy", 4: "Incandescent", 5: "Manual", 8: "Flash", 10: "Black & White", 11: "Manual", 12: "Shade"}),
    0x0007: ("FocusMode", {1: "Auto", 2: "Manual", 4: "Auto, Focus button", 5: "Auto, Continuous"}),
    0x001A: ("ImageStabilization", {2: "On, Mode 1", 3: "Off", 4: "On, Mode 2", 5: "Panning", 6: "On, Mode 3"}),
    0x001C: ("MacroMode", {1: "On", 2: "Off", 0x101: "Tele-macro", 0x201: "Macro Zoom"}),
    0x001F: ("ShootingMode", {1: "Normal", 2: "Portrait", 3: "Scenery", 4: "Sports", 5: "Night Portrait", 6: "Program", 7: "Aperture Priority", 8: "Shutter Priority", 9: "Macro", 10: "Spot", 11: "Manual", 12: "Movie Preview", 13: "Panning"}),
    0x0020: ("Audio", {1: "Yes", 2: "No", 3: "Stereo"}),
    0x0026: ("PanasonicExifVersion", None),
    0x0028: ("ColorEffect", {1: "Off", 2: "Warm", 3: "Cool", 4: "Black & White", 5: "Sepia"}),
    0x002A: ("BurstMode", {0: "Off", 1: "On", 2: "Infinite", 4: "Unlimited"}),
    0x002C: ("ContrastMode", {0: "Normal", 1: "Low", 2: "High"}),
    0x002D: ("NoiseReduction", {0: "Standard", 1: "Low (-1)", 2: "High (+1)", 3: "Lowest (-2)", 4: "Highest (+2)"}),
    0x002E: ("SelfTimer", {1: "Off", 2: "10 s", 3: "2 s"}),
}
FUJI = {
    0x0000: ("Version", None),
    0x1000: ("Quality", None),
    0x1002: ("WhiteBalance", {0: "Auto", 256: "Daylight", 512: "Cloudy", 768: "Daylight Fluorescent", 769: "Day White Fluorescent", 770: "White Fluorescent", 1024: "Incandescent", 3840: "Custom"}),
    0x1010: ("FujiFlashMode", {0: "Auto", 1: "On", 2: "Off", 3: "Red-eye reduction", 4: "External"}),
    0x1020: ("Macro", ON_OFF),
    0x1021: ("FocusMode", {0: "Auto", 1: "Manual"}),
    0x1030: ("SlowSync", ON_OFF),
    0x1031: ("PictureMode", {0: "Auto", 1: "Portrait", 2: "Landscape", 4: "Sports", 5: "Night", 6: "Program AE", 256: "Aperture-priority AE", 512: "Shutter speed priority AE", 768: "Manual"}),
    0x1100: ("AutoBracketing", {0: "Off", 1: "On", 2: "No flash & flash"}),
    0x1300: ("BlurWarning", {0: "None", 1: "Blur Warning"}),
    0x1301: ("FocusWarning", {0: "Good", 1: "Out of focus"}),
    0x1302: ("ExposureWarning", {0: "Good", 1: "Bad exposure"}),
}


def _first(tag: exif.Tag) -> int | None:
    values = tag.numbers() if tag.type != 2 else []
    return values[0] if values and isinstance(values[0], int) else None


def _labelled(tags: list[exif.Tag], rules: dict) -> dict[str, str]:
    out = {}
    for tag in tags:
        if tag.id in rules:
            name, labels = rules[tag.id]
            value = tag.text().strip() if labels is None else labels.get(_first(tag))
            if value:
                out[name] = value
    return out


def apple(note: bytes) -> dict[str, str]:
    """A big-endian directory at byte 14, with offsets from the note."""
    if len(note) < 16 or not note.startswith(b"Apple iOS"):
        return {}
    out = {}
    for tag in exif.directory(note, 14, "note", "big")[0]:
        name = APPLE_NAMES.get(tag.id)
        if name is None and (tag.type == 7 or tag.type in (1, 6) and tag.count > 8):
            continue
        text = tag.text()
        if name in APPLE_DECIMALS:
            text = " ".join(t if "/" not in t else exif._decimal(exif._ratio(t), 4) if not t.endswith("/0") else "0" for t in text.split())
        out[name or f"0x{tag.id:04X}"] = APPLE_LABELS.get(name, {}).get(text, text)
    return out


def canon(tiff: bytes, at: int, order: str) -> dict[str, str]:
    """A bare directory with offsets from the TIFF header; two of its tags are arrays of settings."""
    tags = exif.directory(tiff, at, "note", order)[0]
    out, arrays = {}, {}
    for tag in tags:
        text = tag.text()
        if tag.id in (0x0001, 0x0004) and tag.type == 3:
            arrays[tag.id] = [v - 65536 if v > 32767 else v for v in tag.numbers()]
        elif tag.id in CANON_NAMES and text:
            number = _first(tag) or 0
            shaped = {0x0008: f"{number // 10000}-{number % 10000:04d}", 0x000C: f"{number:010d}", 0x0010: f"0x{number:08x}"}
            out[CANON_NAMES[tag.id]] = shaped.get(tag.id, text)
    for tag_id, place, name, labels in CANON_ARRAYS:
        values = arrays.get(tag_id, [])
        if place < len(values) and values[place] in labels:
            out[name] = labels[values[place]]
    return out


def nikon(tiff: bytes, at: int, order: str) -> dict[str, str]:
    """Bare, after an eight-byte header, or with a TIFF header of its own at byte 10."""
    body, place = tiff, at
    if tiff[at : at + 6] == b"Nikon\0":
        inner = exif.byte_order(tiff[at + 10 : at + 14])
        if inner:
            body, order = tiff[at + 10 :], inner
            place = int.from_bytes(body[4:8], order)
        else:
            body, place = tiff[at:], 8
    out = {}
    for tag in exif.directory(body, place, "note", order)[0]:
        text = tag.text().strip()
        if tag.id in NIKON_NAMES and text:
            out[NIKON_NAMES[tag.id]] = text.capitalize() if text.isalpha() and text.isascii() and text.isupper() else text
    return out


def panasonic(tiff: bytes, at: int, order: str) -> dict[str, str]:
    """A directory after twelve bytes, with offsets from the TIFF header."""
    if not tiff[at:].startswith(b"Panasonic"):
        return {}
    tags = exif.directory(tiff, at + 12, "note", order)[0]
    out = _labelled(tags, PANASONIC)
    for tag in tags:
        number = _first(tag)
        if tag.id == 0x0002 and len(tag.raw) >= 4:
            out["FirmwareVersion"] = ".".join(str(b) for b in tag.raw[:4])
        elif tag.id == 0x002B and number is not None:
            out["SequenceNumber"] = str(number)
        elif tag.id == 0x0029 and number is not None:
            hundredths = number % 100
            seconds = number // 100
            out["TimeSincePowerOn"] = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{hundredths:02d}"
        elif tag.id == 0x0025:
            text = tag.text().strip()
            if len(text) >= 13 and text[3:9].isdigit():
                out["InternalSerialNumber"] = f"({text[:3]}) 20{text[3:5]}:{text[5:7]}:{text[7:9]} no. {text[9:]}"
    return out


def fuji(note: bytes) -> dict[str, str]:
    """Little endian, with offsets from the note; the directory's place is at byte 8."""
    if len(note) < 12 or not note.startswith(b"FUJIFILM"):
        return {}
    return _labelled(exif.directory(note, int.from_bytes(note[8:12], "little"), "note", "little")[0], FUJI)


def parse(tiff: bytes, make: str, model: str = "") -> dict[str, str]:
    """``Vendor:Name`` to text of the maker note in a TIFF stream, by the camera's make."""
    note = next((t for t in exif.entries(tiff) if t.ifd == "exif" and t.id == 0x927C), None)
    if note is None:
        return {}
    make = make.lower()
    if note.raw.startswith(b"Apple iOS"):
        found, vendor = apple(note.raw), "Apple"
    elif "canon" in make:
        found, vendor = canon(tiff, note.at, note.order), "Canon"
    elif "nikon" in make:
        found, vendor = nikon(tiff, note.at, note.order), "Nikon"
    elif "panasonic" in make:
        found, vendor = panasonic(tiff, note.at, note.order), "Panasonic"
    elif "fuji" in make:
        found, vendor = fuji(tiff[note.at :]), "FujiFilm"
    else:
        vendor, reader = next((found for part, found in vendors.VENDORS.items() if part in make), (None, None))
        if reader is None:
            return {}
        found = reader(tiff, note.at, note.order, model)
    return {f"{vendor}:{name}": value for name, value in found.items()}
