"""Maker notes of Pentax, Olympus, Casio, Minolta and Sigma, as tables of rules.

A field that a table doesn't know gives nothing: a wrong reading is worse than none.
"""

from __future__ import annotations

import re

from . import exif

# What the vendors' numbers stand for, as metadata tools name it.
OFF_ON, NO_YES = {0: "Off", 1: "On"}, {0: "No", 1: "Yes"}
#: tag to (name, labels of its first number).
PENTAX = {
    0x0005: ("PentaxModelID", {0x12C1E: "K10D"}),
    0x0008: ("Quality", {0: "Good", 1: "Better", 2: "Best", 3: "TIFF", 4: "RAW", 5: "Premium"}),
    0x000E: ("AFPointSelected", {6: "Center"}),
    0x0017: ("MeteringMode", {0: "Multi-segment", 1: "Center-weighted average", 2: "Spot"}),
    0x0019: ("WhiteBalance", {0: "Auto", 1: "Daylight", 2: "Shade", 3: "Fluorescent", 4: "Tungsten", 5: "Manual", 6: "Daylight Fluorescent", 7: "Day White Fluorescent", 8: "White Fluorescent", 9: "Flash", 10: "Cloudy"}),
    0x0022: ("WorldTimeLocation", {0: "Hometown", 1: "Destination"}),
    0x0025: ("HometownDST", NO_YES),
    0x0026: ("DestinationDST", NO_YES),
    0x0048: ("AELock", OFF_ON),
    0x0049: ("NoiseReduction", OFF_ON),
    0x004F: ("ImageTone", {0: "Natural", 1: "Bright", 2: "Portrait", 3: "Landscape", 4: "Vibrant", 5: "Monochrome"}),
    0x0062: ("RawDevelopmentProcess", {1: "1 (K10D,K200D,K2000,K-m)"}),
}
PENTAX_PLAIN = {0x0001: "PentaxModelType", 0x0003: "PreviewImageLength", 0x003D: "DataScaling", 0x0041: "ImageEditCount"}
_FLASH_OPTIONS = {0: "Normal", 1: "Red-eye reduction", 2: "Auto", 3: "Auto, Red-eye reduction", 5: "Wireless (Master)", 6: "Wireless (Control)", 8: "Slow-sync", 9: "Slow-sync, Red-eye reduction", 10: "Trailing-curtain Sync"}
_METERING = {0: "Center-weighted average", 1: "Spot"}
#: (byte, mask, name, labels) of the settings block.
PENTAX_SETTINGS = (
    (0, 0xFF, "PictureMode2", {0: "Scene Mode", 1: "Auto PICT", 2: "Program AE", 3: "Green Mode", 4: "Shutter Speed Priority", 5: "Aperture Priority", 6: "Program Tv Shift", 7: "Program Av Shift", 8: "Manual", 9: "Bulb", 10: "Aperture Priority, Off-Auto-Aperture", 11: "Manual, Off-Auto-Aperture", 12: "Bulb, Off-Auto-Aperture", 13: "Shutter & Aperture Priority AE", 15: "Sensitivity Priority AE", 16: "Flash X-Sync Speed AE"}),
    (1, 0x03, "ProgramLine", {0: "Normal", 1: "Hi Speed", 2: "Depth", 3: "MTF"}),
    (1, 0x20, "EVSteps", {0: "1/2 EV Steps", 1: "1/3 EV Steps"}),
    (1, 0x40, "E-DialInProgram", {0: "Tv or Av", 1: "P Shift"}),
    (1, 0x80, "ApertureRingUse", {0: "Prohibited", 1: "Permitted"}),
    (2, 0xF0, "FlashOptions", _FLASH_OPTIONS),
    (3, 0x0F, "FocusMode2", {0: "Manual", 1: "AF-S", 2: "AF-C", 3: "AF-A"}),
    (8, 0xFF, "ExposureBracketStepSize", {3: "0.3", 4: "0.5", 5: "0.7", 8: "1.0", 11: "1.3", 12: "1.5", 13: "1.7", 16: "2.0"}),
    (9, 0xFF, "BracketShotNumber", {0: "n/a"}),
    (10, 0xF0, "WhiteBalanceSet", {0: "Auto", 1: "Daylight", 2: "Shade", 3: "Cloudy", 4: "Daylight Fluorescent", 5: "Day White Fluorescent", 6: "White Fluorescent", 7: "Tungsten", 8: "Flash", 9: "Manual", 12: "Set Color Temperature 1", 13: "Set Color Temperature 2", 14: "Set Color Temperature 3"}),
    (10, 0x0F, "MultipleExposureSet", OFF_ON),
)
#: The same where the model is a K10D or its sister.
PENTAX_K10D_SETTINGS = (
    (13, 0xFF, "RawAndJpgRecording", {0x01: "JPEG (Best)", 0x04: "RAW (PEF, Best)", 0x05: "RAW+JPEG (PEF, Best)", 0x08: "RAW (DNG, Best)", 0x09: "RAW+JPEG (DNG, Best)", 0x21: "JPEG (Better)", 0x24: "RAW (PEF, Better)", 0x25: "RAW+JPEG (PEF, Better)", 0x28: "RAW (DNG, Better)", 0x29: "RAW+JPEG (DNG, Better)", 0x41: "JPEG (Good)", 0x44: "RAW (PEF, Good)", 0x45: "RAW+JPEG (PEF, Good)", 0x48: "RAW (DNG, Good)", 0x49: "RAW+JPEG (DNG, Good)"}),
    (14, 0x03, "JpgRecordedPixels", {0: "10 MP", 1: "6 MP", 2: "2 MP"}),
    (16, 0xF0, "FlashOptions2", _FLASH_OPTIONS),
    (17, 0x80, "SRActive", NO_YES),
    (17, 0x60, "Rotation", {0: "Horizontal (normal)", 1: "Rotate 180", 2: "Rotate 90 CW", 3: "Rotate 270 CW"}),
    (17, 0x04, "ISOSetting", {0: "Manual", 1: "Auto"}),
    (17, 0x02, "SensitivitySteps", {0: "1 EV Steps", 1: "As EV Steps"}),
)
#: (first byte, bytes, mask, name, text of no bit, names of bits).
PENTAX_BITS = (
    (2, 1, 0x0F, "MeteringMode2", "Multi-segment", _METERING),
    (3, 1, 0xF0, "AFPointMode", "Auto", {0: "Select", 1: "Fixed Center"}),
    (4, 2, 0xFFFF, "AFPointSelected2", "Auto", {0: "Upper-left", 1: "Top", 2: "Upper-right", 3: "Left", 4: "Mid-left", 5: "Center", 6: "Mid-right", 7: "Right", 8: "Lower-left", 9: "Bottom", 10: "Lower-right"}),
    (7, 1, 0xFF, "DriveMode2", "Single-frame", {0: "Continuous", 1: "Continuous (Lo)", 2: "Self-timer (12 s)", 3: "Self-timer (2 s)", 4: "Remote Control (3 s delay)", 5: "Remote Control", 6: "Exposure Bracket", 7: "Multiple Exposure"}),
)
PENTAX_K10D_BITS = ((16, 1, 0x0F, "MeteringMode3", "Multi-segment", _METERING),)
PENTAX_PROGRAMS = {
    0: "M, P or TAv", 1: "Av, B or X", 2: "Tv", 3: "Sv or Green Mode", 8: "Hi-speed Program", 11: "Hi-speed Program (P-Shift)", 16: "DOF Program", 19: "DOF Program (P-Shift)",
    24: "MTF Program", 27: "MTF Program (P-Shift)", 35: "Standard", 43: "Portrait", 51: "Landscape", 59: "Macro", 67: "Sport", 75: "Night Scene Portrait", 83: "No Flash",
    91: "Night Scene", 99: "Surf & Snow", 104: "Night Snap", 107: "Text", 115: "Sunset", 123: "Kids", 131: "Pet", 139: "Candlelight", 144: "SCN", 147: "Museum", 160: "Program",
    184: "Shallow DOF Program", 216: "HDR",
}
OLYMPUS = {
    0x0201: ("Quality", {1: "SQ (Low)", 2: "HQ (Normal)", 3: "SHQ (Fine)", 4: "RAW"}),
    0x0202: ("Macro", {0: "Off", 1: "On", 2: "Super Macro"}),
    0x0203: ("BWMode", OFF_ON),
}
OLYMPUS_MODES = {0: "Normal", 1: "Unknown", 2: "Fast", 3: "Panorama"}
OLYMPUS_PANORAMA = {0: "(none)", 1: "Left to right", 2: "Right to left", 3: "Bottom to top", 4: "Top to bottom"}
OLYMPUS_CAMERAS = {"SR951": "C2000Z"}
_LOW_HIGH = {0: "Normal", 1: "Low", 2: "High"}
CASIO = {
    0x0001: ("RecordingMode", {1: "Single Shutter", 2: "Panorama", 3: "Night Scene", 4: "Portrait", 5: "Landscape"}),
    0x0002: ("Quality", {1: "Economy", 2: "Normal", 3: "Fine"}),
    0x0003: ("FocusMode", {2: "Macro", 3: "Auto", 4: "Manual", 5: "Infinity", 7: "Sport AF"}),
    0x0004: ("FlashMode", {1: "Auto", 2: "On", 3: "Off", 4: "Red-eye Reduction"}),
    0x0005: ("FlashIntensity", {11: "Weak", 13: "Normal", 15: "Strong"}),
    0x0007: ("WhiteBalance", {1: "Auto", 2: "Tungsten", 3: "Daylight", 4: "Fluorescent", 5: "Shade", 129: "Manual"}),
    0x000A: ("DigitalZoom", {0x10000: "Off"}),
    0x000B: ("Sharpness", {0: "Normal", 1: "Soft", 2: "Hard"}),
    0x000C: ("Contrast", _LOW_HIGH),
    0x000D: ("Saturation", _LOW_HIGH),
}
MINOLTA_PLAIN = {0x0000: "MakerNoteVersion", 0x0040: "CompressedImageSize", 0x0089: "PreviewImageLength"}
#: place in the settings array to (name, labels).
MINOLTA_SETTINGS = {
    2: ("FlashMode", {0: "Fill flash", 1: "Red-eye reduction", 2: "Rear flash sync", 3: "Wireless", 4: "Off"}),
    3: ("WhiteBalance", {0: "Auto", 1: "Daylight", 2: "Cloudy", 3: "Tungsten", 5: "Custom", 7: "Fluorescent", 8: "Fluorescent 2", 11: "Custom 2", 12: "Custom 3"}),
    4: ("MinoltaImageSize", {0: "Full", 1: "1600x1200", 2: "1280x960", 3: "640x480", 5: "2560x1920", 6: "2272x1704", 7: "2048x1536"}),
    5: ("MinoltaQuality", {0: "Raw", 1: "Super Fine", 2: "Fine", 3: "Standard", 4: "Economy", 5: "Extra Fine"}),
    6: ("DriveMode", {0: "Single", 1: "Continuous", 2: "Self-timer", 4: "Bracketing", 5: "Interval", 6: "UHS continuous", 7: "HS continuous"}),
    11: ("MacroMode", OFF_ON),
    12: ("DigitalZoom", {0: "Off", 1: "Electronic magnification", 2: "2x"}),
    20: ("FlashFired", NO_YES),
    26: ("FileNumberMemory", OFF_ON),
    34: ("SubjectProgram", {0: "None", 1: "Portrait", 2: "Text", 3: "Night portrait", 4: "Sports action", 5: "Landscape"}),
    37: ("MinoltaModelID", {0: "DiMAGE 7/X/Z", 1: "DiMAGE 5", 2: "DiMAGE S304", 3: "DiMAGE S404", 4: "DiMAGE 7i", 5: "DiMAGE 7Hi", 6: "DiMAGE A1", 7: "DiMAGE A2/S414"}),
    38: ("IntervalMode", {0: "Still Image", 1: "Time-lapse Movie"}),
    39: ("FolderName", {0: "Standard Form", 1: "Data Form"}),
    40: ("ColorMode", {0: "Natural color", 1: "Black & White", 2: "Vivid color", 3: "Solarization", 4: "Adobe RGB"}),
    43: ("InternalFlash", {0: "No", 1: "Fired"}),
    47: ("WideFocusZone", {0: "No zone", 1: "Center zone (horizontal orientation)", 2: "Center zone (vertical orientation)", 3: "Left zone", 4: "Right zone"}),
    48: ("FocusMode", {0: "AF", 1: "MF"}),
    49: ("FocusArea", {0: "Wide Focus (normal)", 1: "Spot Focus"}),
    50: ("DECPosition", {0: "Exposure", 1: "Contrast", 2: "Saturation", 3: "Filter"}),
}
#: tag to (name, labels); no labels: the text as it is; () : what follows a colon.
SIGMA = {
    0x0002: ("SerialNumber", None), 0x0003: ("DriveMode", None), 0x0004: ("ResolutionMode", None), 0x0005: ("AFMode", None), 0x0006: ("FocusSetting", None), 0x0007: ("WhiteBalance", None),
    0x0008: ("ExposureMode", {"P": "Program", "A": "Aperture Priority", "S": "Shutter Speed Priority", "M": "Manual"}),
    0x0009: ("MeteringMode", {"8": "Multi-segment", "A": "Average", "C": "Center-weighted average"}),
    0x000A: ("LensFocalRange", None), 0x000B: ("ColorSpace", None), 0x000C: ("ExposureCompensation", ()), 0x000D: ("Contrast", ()), 0x000E: ("Shadow", ()), 0x000F: ("Highlight", ()),
    0x0010: ("Saturation", ()), 0x0011: ("Sharpness", ()), 0x0012: ("X3FillLight", ()), 0x0014: ("ColorAdjustment", ()), 0x0015: ("AdjustmentMode", None), 0x0016: ("Quality", ()), 0x0017: ("Firmware", None),
}


def _first(tag: exif.Tag) -> int | None:
    values = tag.numbers() if tag.type != 2 else []
    return values[0] if values and isinstance(values[0], int) else None


def _labels(tags: dict[int, exif.Tag], rules: dict) -> dict[str, str]:
    return {name: labels[_first(tags[i])] for i, (name, labels) in rules.items() if i in tags and _first(tags[i]) in labels}


def _plain(tags: dict[int, exif.Tag], names: dict[int, str]) -> dict[str, str]:
    return {name: text for i, name in names.items() if i in tags and (text := tags[i].text().strip())}


def _apex(v: int) -> float:
    """Eighths of a step, in which 3 and 5 stand for a third and two."""
    whole, part = divmod(abs(v), 8)
    steps = whole + {3: 1 / 3, 5: 2 / 3}.get(part, part / 8)
    return -steps if v < 0 else steps


def _seconds(s: float) -> str:
    return f"1/{int(1 / s + 0.5)}" if 0 < s < 0.25001 else f"{s:.1f}"


def _masked(block: bytes, rules: tuple) -> dict[str, str]:
    found = {}
    for at, mask, name, labels in rules:
        value = (block[at] & mask) // (mask & -mask) if at < len(block) else None
        if value in labels:
            found[name] = labels[value]
    return found


def _bits(block: bytes, rules: tuple) -> dict[str, str]:
    found = {}
    for at, n, mask, name, none, names in rules:
        if at + n <= len(block):
            value = (int.from_bytes(block[at : at + n], "big") & mask) // (mask & -mask)
            text = ", ".join(label for bit, label in names.items() if value >> bit & 1) if value else none
            if text:
                found[name] = text
    return found


def pentax_settings(block: bytes, k10d: bool) -> dict[str, str]:
    """The block of camera settings; some of it only of a K10D."""
    if len(block) < 11:
        return {}
    iso = lambda v: str(int(100 * 2 ** _apex(v - 32) + 0.5))
    found = _masked(block, PENTAX_SETTINGS) | _bits(block, PENTAX_BITS) | {"ISOFloor": iso(block[6])}
    if k10d:
        found |= _masked(block, PENTAX_K10D_SETTINGS) | _bits(block, PENTAX_K10D_BITS)
        last = {18: ("TvExposureTimeSetting", lambda v: _seconds(2 ** -_apex(v - 68))), 19: ("AvApertureSetting", lambda v: f"{2 ** (_apex(v - 68) / 2):.1f}"), 20: ("SvISOSetting", iso), 21: ("BaseExposureCompensation", lambda v: f"{_apex(64 - v):+.1f}" if v != 64 else "0")}
        found |= {name: shape(block[at]) for at, (name, shape) in last.items() if at < len(block)}
    return found


def pentax_exposure(block: bytes) -> dict[str, str]:
    """The block of exposure facts, in eighths and sixteenths of a step."""
    time = lambda v: _seconds(24 * 2 ** (-(v - 32) / 8))
    stop = lambda v: f"{2 ** ((v - 68) / 16):.1f}"
    step = lambda v: f"{v / 8:.4f}".rstrip("0").rstrip(".")
    if len(block) < 5:
        return {}
    found = {"AEExposureTime": time(block[0]), "AEAperture": stop(block[1]), "AE_ISO": str(int(100 * 2 ** ((block[2] - 32) / 8) + 0.5)), "AEXv": step(block[3] - 64), "AEBXv": step((block[4] ^ 0x80) - 0x80)}
    if len(block) >= 13:
        found |= {"AEMinExposureTime": time(block[5]), "AEApertureSteps": "n/a" if block[8] == 255 else str(block[8]), "AEMaxAperture": stop(block[9]), "AEMaxAperture2": stop(block[10]), "AEMinAperture": f"{2 ** ((block[11] - 68) / 16):.0f}"}
        found |= _bits(block, ((12, 1, 0xFF, "AEMeteringMode", "Multi-segment", {4: "Center-weighted average", 5: "Spot"}),))
        if block[6] in PENTAX_PROGRAMS:
            found["AEProgramMode"] = PENTAX_PROGRAMS[block[6]]
    return found


def pentax(tiff: bytes, at: int, order: str, model: str) -> dict[str, str]:
    """After four letters and a byte order of its own; offsets from the TIFF header."""
    if tiff[at : at + 4] != b"AOC\0":
        return {}
    order = "little" if tiff[at + 4 : at + 5] == b"I" else "big"
    tags = {t.id: t for t in exif.directory(tiff, at + 6, "note", order)[0]}
    found = _labels(tags, PENTAX) | _plain(tags, PENTAX_PLAIN)
    raw = lambda i, n: tags[i].raw if i in tags and len(tags[i].raw) >= n else None
    if version := raw(0x0000, 4):
        found["PentaxVersion"] = ".".join(map(str, version[:4]))
    if 0x0002 in tags and len(size := tags[0x0002].numbers()) == 2:
        found["PreviewImageSize"] = f"{size[0]}x{size[1]}"
    if date := raw(0x0006, 4):
        found["Date"] = f"{int.from_bytes(date[:2], order):04d}:{date[2]:02d}:{date[3]:02d}"
    if time := raw(0x0007, 3):
        found["Time"] = f"{time[0]:02d}:{time[1]:02d}:{time[2]:02d}"
    if borders := raw(0x003E, 4):
        found["PreviewImageBorders"] = " ".join(map(str, borders[:4]))
    if heat := raw(0x0047, 1):
        found["CameraTemperature"] = f"{(heat[0] ^ 0x80) - 0x80} C"
    if shake := raw(0x005C, 2):
        found |= {k: v for k, v in (("SRResult", {0: "Not stabilized", 1: "Stabilized"}.get(shake[0])), ("ShakeReduction", OFF_ON.get(shake[1]))) if v}
    if settings := raw(0x0205, 1):
        found |= pentax_settings(settings, "K10D" in model or "GX10" in model)
    if exposure := raw(0x0206, 1):
        found |= pentax_exposure(exposure)
    return found


def olympus(tiff: bytes, at: int, order: str, model: str) -> dict[str, str]:
    """After eight bytes; offsets from the TIFF header."""
    if tiff[at : at + 6] != b"OLYMP\0":
        return {}
    tags = {t.id: t for t in exif.directory(tiff, at + 8, "note", order)[0]}
    found = _labels(tags, OLYMPUS) | _plain(tags, {0x0209: "CameraID"})
    mode = tags[0x0200].numbers() if 0x0200 in tags and tags[0x0200].type != 2 else []
    if len(mode) >= 3 and mode[0] in OLYMPUS_MODES and mode[2] in OLYMPUS_PANORAMA:
        found["SpecialMode"] = f"{OLYMPUS_MODES[mode[0]]}, Sequence: {mode[1]}, Panorama: {OLYMPUS_PANORAMA[mode[2]]}"
    ratios = {i: tags[i].numbers()[0] for i in (0x0204, 0x0205) if i in tags and tags[i].type == 5 and tags[i].count and tags[i].numbers()[0][1]}
    if 0x0204 in ratios:
        found["DigitalZoom"] = f"{ratios[0x0204][0] / ratios[0x0204][1]:.1f}"
    if 0x0205 in ratios:
        found["FocalPlaneDiagonal"] = f"{ratios[0x0205][0] / ratios[0x0205][1]:.6f}".rstrip("0").rstrip(".") + " mm"
    if 0x0206 in tags and re.match(r"-?\d", lens := tags[0x0206].text().strip()):
        found["LensDistortionParams"] = lens
    if 0x0207 in tags and (camera := OLYMPUS_CAMERAS.get(tags[0x0207].text().strip())):
        found["CameraType"] = camera
    if 0x0208 in tags and (resolution := re.search(r"Resolution=(\d+)", tags[0x0208].raw.decode("latin-1"))):
        found["Resolution"] = resolution[1]
    return found


def casio(tiff: bytes, at: int, order: str, model: str) -> dict[str, str]:
    """A bare directory; the later kind, with letters before it, isn't read."""
    if tiff[at : at + 4] == b"QVC\0":
        return {}
    tags = {t.id: t for t in exif.directory(tiff, at, "note", order)[0]}
    found = _labels(tags, CASIO)
    if 0x0006 in tags and (distance := _first(tags[0x0006])) is not None:
        found["ObjectDistance"] = f"{distance / 1000:.3f}".rstrip("0").rstrip(".") + " m"
    return found


def minolta(tiff: bytes, at: int, order: str, model: str) -> dict[str, str]:
    """A bare directory; one of its tags is an array of settings."""
    tags = {t.id: t for t in exif.directory(tiff, at, "note", order)[0]}
    found = _plain(tags, MINOLTA_PLAIN)
    if 0x0003 in tags:
        raw = tags[0x0003].raw
        values = [int.from_bytes(raw[i : i + 4], tags[0x0003].order) for i in range(0, len(raw) - 3, 4)]
        found |= {name: labels[values[i]] for i, (name, labels) in MINOLTA_SETTINGS.items() if i < len(values) and values[i] in labels}
        if len(values) > 21 and (day := values[21]):
            found["MinoltaDate"] = f"{day >> 16:04d}:{day >> 8 & 255:02d}:{day & 255:02d}"
        if len(values) > 22 and (time := values[22]):
            found["MinoltaTime"] = f"{time >> 16 & 255:02d}:{time >> 8 & 255:02d}:{time & 255:02d}"
    return found


def sigma(tiff: bytes, at: int, order: str, model: str) -> dict[str, str]:
    """After ten bytes, nearly all as text; offsets from the TIFF header."""
    if tiff[at : at + 8] != b"SIGMA\0\0\0":
        return {}
    found = {}
    for tag in exif.directory(tiff, at + 10, "note", order)[0]:
        if tag.id in SIGMA:
            name, labels = SIGMA[tag.id]
            text = tag.text().strip()
            value = text if labels is None else text[text.find(":") + 1 :].strip() if labels == () else labels.get(text)
            if value:
                found[name] = value
    return found


#: Part of the camera's make to (vendor, reader).
VENDORS = {"pentax": ("Pentax", pentax), "olympus": ("Olympus", olympus), "casio": ("Casio", casio), "minolta": ("Minolta", minolta), "sigma": ("Sigma", sigma)}
