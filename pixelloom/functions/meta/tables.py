"""Tables of EXIF, GPS and IPTC names and labels.

All values here are fixed by the EXIF, DNG and IPTC-IIM standards and by the names that
metadata tools agree on.
"""

# Tag number to name.
EXIF_TAGS = {
    0x000B: "ProcessingSoftware", 0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageHeight",
    0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts",
    0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "ModifyDate",
    0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo", 0x829A: "ExposureTime",
    0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8827: "ISO", 0x8828: "OECF", 0x8830: "SensitivityType",
    0x8831: "StandardOutputSensitivity", 0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal",
    0x9004: "CreateDate", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue",
    0x9203: "BrightnessValue", 0x9204: "ExposureCompensation", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode",
    0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote", 0x9286: "UserComment",
    0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace",
    0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA004: "RelatedSoundFile", 0xA005: "InteropOffset", 0xA20B: "FlashEnergy",
    0xA20C: "SpatialFrequencyResponse", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern",
    0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFormat",
    0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness",
    0xA40B: "DeviceSettingDescription", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "OwnerName", 0xA431: "SerialNumber",
    0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0x0142: "TileWidth", 0x0143: "TileLength",
    0x0144: "TileOffsets", 0x0145: "TileByteCounts", 0x014A: "SubIFDs", 0x9216: "TIFF-EPStandardID", 0xC612: "DNGVersion",
    0xC613: "DNGBackwardVersion", 0xC614: "UniqueCameraModel", 0xC615: "LocalizedCameraModel", 0xC62F: "CameraSerialNumber",
    0xC68B: "OriginalRawFileName", 0xC621: "ColorMatrix1", 0xC622: "ColorMatrix2", 0xC623: "CameraCalibration1", 0xC624: "CameraCalibration2",
    0xC627: "AnalogBalance", 0xC628: "AsShotNeutral",
}
GPS_TAGS = {
    0x0000: "GPSVersionID", 0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude",
    0x0005: "GPSAltitudeRef", 0x0006: "GPSAltitude", 0x0007: "GPSTimeStamp", 0x0008: "GPSSatellites", 0x0009: "GPSStatus", 0x000A: "GPSMeasureMode",
    0x000B: "GPSDOP", 0x000C: "GPSSpeedRef", 0x000D: "GPSSpeed", 0x000E: "GPSTrackRef", 0x000F: "GPSTrack", 0x0010: "GPSImgDirectionRef",
    0x0011: "GPSImgDirection", 0x0012: "GPSMapDatum", 0x0013: "GPSDestLatitudeRef", 0x0014: "GPSDestLatitude", 0x0015: "GPSDestLongitudeRef",
    0x0016: "GPSDestLongitude", 0x0017: "GPSDestBearingRef", 0x0018: "GPSDestBearing", 0x0019: "GPSDestDistanceRef", 0x001A: "GPSDestDistance",
    0x001B: "GPSProcessingMethod", 0x001C: "GPSAreaInformation", 0x001D: "GPSDateStamp", 0x001E: "GPSDifferential", 0x001F: "GPSHPositioningError",
}

# Label of each number of a tag.
LABELS = {
    "Orientation": {1: "Horizontal (normal)", 2: "Mirror horizontal", 3: "Rotate 180", 4: "Mirror vertical", 5: "Mirror horizontal and rotate 270 CW", 6: "Rotate 90 CW", 7: "Mirror horizontal and rotate 90 CW", 8: "Rotate 270 CW"},
    "ResolutionUnit": {1: "None", 2: "inches", 3: "cm"},
    "ExposureProgram": {0: "Not Defined", 1: "Manual", 2: "Program AE", 3: "Aperture-priority AE", 4: "Shutter speed priority AE", 5: "Creative (Slow speed)", 6: "Action (High speed)", 7: "Portrait", 8: "Landscape"},
    "MeteringMode": {0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial", 255: "Other"},
    "LightSource": {0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten (Incandescent)", 4: "Flash", 9: "Fine weather", 10: "Cloudy", 11: "Shade", 12: "Daylight fluorescent (D 5700 - 7100K)", 13: "Day white fluorescent (N 4600 - 5500K)", 14: "Cool white fluorescent (W 3800 - 4500K)", 15: "White fluorescent (WW 3200 - 3700K)", 16: "Warm white fluorescent (L 2600 - 3200K)", 17: "Standard light A", 18: "Standard light B", 19: "Standard light C", 20: "D55", 21: "D65", 22: "D75", 23: "D50", 24: "ISO studio tungsten", 255: "Other"},
    "WhiteBalance": {0: "Auto", 1: "Manual"},
    "ColorSpace": {1: "sRGB", 2: "Adobe RGB", 65533: "Wide Gamut RGB", 65534: "ICC Profile", 65535: "Uncalibrated"},
    "ExposureMode": {0: "Auto", 1: "Manual", 2: "Auto bracket"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night", 4: "Other"},
    "SensingMethod": {1: "Not defined", 2: "One-chip color area", 3: "Two-chip color area", 4: "Three-chip color area", 5: "Color sequential area", 7: "Trilinear", 8: "Color sequential linear"},
    "GPSAltitudeRef": {0: "Above Sea Level", 1: "Below Sea Level"},
    "Flash": {0: "No Flash", 1: "Fired", 5: "Fired, Return not detected", 7: "Fired, Return detected", 8: "On, Did not fire", 9: "On, Fired", 13: "On, Return not detected", 15: "On, Return detected", 16: "Off, Did not fire", 20: "Off, Did not fire, Return not detected", 24: "Auto, Did not fire", 25: "Auto, Fired", 29: "Auto, Fired, Return not detected", 31: "Auto, Fired, Return detected", 32: "No flash function", 48: "Off, No flash function", 65: "Fired, Red-eye reduction", 69: "Fired, Red-eye reduction, Return not detected", 71: "Fired, Red-eye reduction, Return detected", 73: "On, Red-eye reduction", 77: "On, Red-eye reduction, Return not detected", 79: "On, Red-eye reduction, Return detected", 80: "Off, Red-eye reduction", 88: "Auto, Did not fire, Red-eye reduction", 89: "Auto, Fired, Red-eye reduction", 93: "Auto, Fired, Red-eye reduction, Return not detected", 95: "Auto, Fired, Red-eye reduction, Return detected"},
}

# Dataset number of IPTC record 2 to name.
IPTC_NAMES = {
    0: "ApplicationRecordVersion", 5: "ObjectName", 7: "EditStatus", 10: "Urgency", 12: "SubjectReference", 15: "Category", 20: "SupplementalCategories", 22: "FixtureIdentifier", 25: "Keywords", 26: "ContentLocationCode", 27: "ContentLocationName", 30: "ReleaseDate", 35: "ReleaseTime", 37: "ExpirationDate", 38: "ExpirationTime", 40: "SpecialInstructions", 42: "ActionAdvised", 45: "ReferenceService", 47: "ReferenceDate", 50: "ReferenceNumber", 55: "DateCreated", 60: "TimeCreated", 62: "DigitalCreationDate", 63: "DigitalCreationTime", 65: "OriginatingProgram", 70: "ProgramVersion", 75: "ObjectCycle", 80: "By-line", 85: "By-lineTitle", 90: "City", 92: "Sub-location", 95: "Province-State", 100: "Country-PrimaryLocationCode", 101: "Country-PrimaryLocationName", 103: "OriginalTransmissionReference", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 118: "Contact", 120: "Caption-Abstract", 122: "Writer-Editor", 130: "ImageType", 131: "ImageOrientation", 135: "LanguageIdentifier",
}

# Names that may be written: (directory, tag, TIFF type).
WRITABLE = {
    "ImageDescription": ("ifd0", 0x010E, 2), "Make": ("ifd0", 0x010F, 2), "Model": ("ifd0", 0x0110, 2), "Orientation": ("ifd0", 0x0112, 3),
    "Software": ("ifd0", 0x0131, 2), "DateTime": ("ifd0", 0x0132, 2), "HostComputer": ("ifd0", 0x013C, 2), "Artist": ("ifd0", 0x013B, 2),
    "Copyright": ("ifd0", 0x8298, 2), "Rating": ("ifd0", 0x4746, 3), "ExposureTime": ("exif", 0x829A, 5), "FNumber": ("exif", 0x829D, 5),
    "ISO": ("exif", 0x8827, 3), "ExposureProgram": ("exif", 0x8822, 3), "DateTimeOriginal": ("exif", 0x9003, 2), "CreateDate": ("exif", 0x9004, 2),
    "ExposureCompensation": ("exif", 0x9204, 10), "MeteringMode": ("exif", 0x9207, 3), "Flash": ("exif", 0x9209, 3), "FocalLength": ("exif", 0x920A, 5),
    "UserComment": ("exif", 0x9286, 7), "LensModel": ("exif", 0xA434, 2),
}
