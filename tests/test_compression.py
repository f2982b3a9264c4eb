import struct

import pytest

from tessera.sources import compression as C


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def webp(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def exr(*parts, several=False):
    out = b"\x76\x2f\x31\x01" + struct.pack("<I", 2 | (512 if several else 0))
    for kind in parts:
        out += b"a\0int\0" + struct.pack("<I", 4) + bytes(4) + b"compression\0compression\0" + struct.pack("<I", 1) + bytes([kind]) + b"\0"
    return out + b"\0"


def jp2(default=None, *own, boxed=False):
    out = b"\xff\x4f\xff\x51" + struct.pack(">H", 4) + b"\0\0"
    if default is not None:
        out += b"\xff\x52" + struct.pack(">H", 12) + bytes(9) + bytes([default])
    for wavelet in own:
        out += b"\xff\x53" + struct.pack(">H", 9) + bytes(6) + bytes([wavelet])
    out += b"\xff\x93data"
    return b"\0\0\0\x0cjP  \r\n\x87\n" + struct.pack(">I", 8 + len(out)) + b"jp2c" + out if boxed else out


def tiff(*kinds, order="<"):
    out, at = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8), 8
    for i, kind in enumerate(kinds):
        end = at + 2 + 12 + 4
        out += struct.pack(order + "HHHIHHI", 1, 259, 3, 1, kind, 0, end if i + 1 < len(kinds) else 0)
        at = end
    return out


@pytest.mark.parametrize(("kind", "data", "expected"), [
    ("WebP", webp(chunk(b"VP8L", b"x")), True), ("WebP", webp(chunk(b"VP8 ", b"xy")), False),
    ("WebP", webp(chunk(b"ANMF", bytes(16) + chunk(b"VP8L", b"a")), chunk(b"ANMF", bytes(16) + chunk(b"VP8 ", b"a"))), False),
    ("WebP", webp(chunk(b"ANMF", bytes(16) + chunk(b"ALPH", b"a") + chunk(b"VP8L", b"a"))), True),
    ("EXR", exr(4), True), ("EXR", exr(6), False), ("EXR", exr(0, 9, several=True), False), ("EXR", exr(0, 3, several=True), True), ("EXR", b"\x76\x2f\x31\x01", True),
    ("JP2", jp2(1), True), ("JP2", jp2(0), False), ("JP2", jp2(None), False), ("JP2", jp2(0, 1), True), ("JP2", jp2(1, 1, 0), False), ("JP2", jp2(1, boxed=True), True),
    ("TIFF", tiff(1), True), ("TIFF", tiff(7), False), ("TIFF", tiff(5, 6, order=">"), False), ("TIFF", tiff(8, 32946, order=">"), True), ("TIFF", b"II", True),
    ("JPEG", b"", False), ("GIF", b"", True), ("PNG", b"", None), ("HEIC", b"", None),
])
def test_headers_tell(kind, data, expected):
    assert C.is_lossless(kind, data) is expected


def test_frames_and_icons(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 8) + b"acTL" + struct.pack(">II", 7, 0) + bytes(4)
    assert C.apng_frames(png) == 7 and C.apng_frames(png[:8]) == 1 and C.apng_frames(b"") == 1
    icon = b"\0\0\1\0\2\0" + bytes(12) + struct.pack("<I", 38) + bytes(12) + struct.pack("<I", 46) + b"\x89PNG\r\n\x1a\n" + b"BM000000"
    assert C.ico_images(icon) == ["PNG", "BMP"] and C.ico_images(b"") == []
    rows = [("a", "WebP", bytearray(webp(chunk(b"VP8L", b"x")))), ("b", "PNG", bytearray(png)), ("c", "JPEG", None)]
    got = C.with_compression(spark.createDataFrame(rows, "path string, format string, content binary")).collect()
    assert [tuple(r) for r in got] == [("a", True, 1), ("b", None, 7), ("c", False, 1)]


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def hvcc(profile, chroma, extended=False):
    return box(b"hvcC", bytes([1, profile, 8 if extended else 0]) + bytes(13) + bytes([chroma]) + bytes(6))


def nested(*inner):
    return box(b"ftyp", b"heic" + bytes(4)) + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", b"".join(inner))))


def low_bits(*fields):
    """Bytes of (value, width) fields from the lowest bit on."""
    value = at = 0
    for number, width in fields:
        value, at = value | number << at, at + width
    return b"\xff\x0a" + value.to_bytes((at + 7) // 8, "little")


RGB, DEEP = box(b"colr", b"nclx" + bytes([0, 1, 0, 13, 0, 0, 128])), box(b"pixi", bytes([3, 12, 12, 12]))
SMALL, BIG = ((1, 1), (3, 5), (1, 3)), ((0, 1), (1, 2), (900, 13), (0, 3), (0, 2), (300, 9))
MOVING = ((0, 1), (1, 1), (5, 3), (1, 1), *SMALL, (0, 1), (1, 1), (0, 2), (2, 2), (9, 10), (1, 2), (3, 3), (0, 1))


@pytest.mark.parametrize(("kind", "data", "expected"), [
    ("HEIC", nested(hvcc(1, 3)), False), ("HEIC", nested(hvcc(4, 1), RGB), False), ("HEIC", nested(hvcc(4, 3)), True), ("HEIF", nested(hvcc(9, 0), RGB), True), ("HEIC", nested(hvcc(9, 0), DEEP), True),
    ("HEIC", nested(hvcc(4, 0)), None), ("HEIC", nested(hvcc(7, 3, True)), True), ("HEIC", nested(hvcc(7, 0, True)), None), ("HEIC", nested(hvcc(7, 3)), False), ("HEIC", nested(b""), False),
    ("HEIC", b"damaged!" + hvcc(4, 3), True),
    ("AVIF", nested(box(b"av1C", bytes([129, 0, 0b1000, 0]))), False), ("AVIF", nested(box(b"av1C", bytes([129, 32, 0b100, 0])), RGB), True), ("AVIF", nested(box(b"av1C", bytes([129, 0, 0b100, 0]))), None),
    ("AVIF", nested(box(b"av1C", bytes([129, 0, 0, 0]))), True), ("AVIF", nested(box(b"av1C", bytes([129, 32, 0, 0]))), None), ("AVIF", nested(box(b"av1C", bytes([129, 32, 0, 0])), DEEP), True), ("AVIF", nested(), None),
    ("JXL", low_bits(*SMALL, (1, 1), (0, 8)), False), ("JXL", low_bits(*BIG, (0, 1), (0, 1), (0, 1), (0, 2), (0, 2), (0, 1), (0, 8)), True), ("JXL", low_bits(*SMALL, (0, 1), (0, 1), (1, 1), (3, 2), (9, 6), (4, 4), (0, 2), (1, 1)), False),
    ("JXL", low_bits(*SMALL, *MOVING, (0, 1), (0, 2), (0, 2), (0, 1), (0, 8)), True), ("JXL", low_bits(*SMALL, (0, 1), (0, 1), (0, 1), (0, 2), (1, 2), (0, 1), (0, 8)), None), ("JXL", b"\xff\x0a\x00\x00", None),
    ("JXL", box(b"JXL ", bytes(4)) + box(b"jbrd", b""), True), ("JXL", box(b"JXL ", bytes(4)) + box(b"jxlc", low_bits(*SMALL, (1, 1), (0, 8))), False), ("JXL", b"\xff", None),
])
def test_coded_streams_tell(kind, data, expected):
    assert C.is_lossless(kind, data) is expected


def test_jxl_as_specified():
    plain = low_bits(*SMALL, (0, 1), (0, 1), (0, 1), (0, 2), (1, 1), (0, 2), (0, 1), (0, 8))
    assert C.jxl_is_lossless(plain) is None and C.jxl_is_lossless(plain, strict=False) is True
    part = box(b"JXL ", bytes(4)) + box(b"jxlp", bytes(4) + plain)
    assert C.jxl_is_lossless(part, strict=False) is True
