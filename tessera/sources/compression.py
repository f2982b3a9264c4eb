"""Whether an image file is stored without loss, by its own headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.sources.magic import boxes

# Formats that always, or never, lose; TIFF compressions that lose; the first OpenEXR compression that does.
ALWAYS_LOSSLESS = {"BMP", "GIF", "QOI", "FLIF", "PNM", "TGA", "PSD", "DDS"}
LOSSY_TIFF, FIRST_LOSSY_EXR = {6, 7, 34892}, 5


def riff_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of each chunk of a RIFF body."""
    at = 0
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def webp_is_lossless(data: bytes) -> bool:
    """Still images by their own chunk; animations only if every frame is."""
    found = list(riff_chunks(data[12:]))
    frames = [body[16:] for name, body in found if name == "ANMF"]
    if frames:
        return all(any(n == "VP8L" for n, _ in riff_chunks(f)) for f in frames)
    return any(name == "VP8L" for name, _ in found)


def exr_attributes(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, value) of the attributes of all parts; an empty name ends a part, two end a file of several."""
    several, at, ended = bool(len(data) >= 8 and data[5] & 2), 8, False
    while at < len(data):
        stop = data.find(b"\0", at)
        if stop < 0:
            return
        name, at = data[at:stop].decode("latin-1"), stop + 1
        if not name:
            if ended or not several:
                return
            ended = True
            continue
        ended = False
        stop = data.find(b"\0", at)
        if stop < 0 or stop + 5 > len(data):
            return
        size = int.from_bytes(data[stop + 1 : stop + 5], "little")
        yield name, data[stop + 5 : stop + 5 + size]
        at = stop + 5 + size


def exr_is_lossless(data: bytes) -> bool:
    return all(not value or value[0] < FIRST_LOSSY_EXR for name, value in exr_attributes(data) if name == "compression")


def jp2_is_lossless(data: bytes) -> bool:
    """By the wavelet of the default and of each component: any irreversible one loses; without any it is taken to lose."""
    stream = data if data.startswith(b"\xff\x4f\xff\x51") else next(iter(boxes(data, "jp2c")), b"")
    default, own, at = None, [], 2
    while at + 4 <= len(stream) and stream[at] == 0xFF and stream[at + 1] not in (0x90, 0x93):
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        if marker == 0x52 and len(body) >= 10 and body[9] <= 1:
            default = body[9]
        elif marker == 0x53 and len(body) >= 7 and body[6] <= 1:
            own.append(body[6])
        at += 2 + size
    return all(own) if own else default == 1


def tiff_is_lossless(data: bytes) -> bool:
    """By the compression of every directory, in either byte order, classic or big."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return True
    big = struct.unpack(order + "H", data[2:4])[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    width, counted = struct.calcsize(word), struct.calcsize(count)
    at, seen = struct.unpack_from(order + word, data, 8 if big else 4)[0] if len(data) >= 16 or not big else 0, set()
    while 0 < at and at + counted <= len(data) and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        for k in range(n):
            place = at + counted + k * entry
            if place + entry > len(data):
                return True
            tag = struct.unpack_from(order + "H", data, place)[0]
            if tag == 259 and struct.unpack_from(order + "H", data, place + entry - width)[0] in LOSSY_TIFF:
                return False
        end = at + counted + n * entry
        at = struct.unpack_from(order + word, data, end)[0] if end + width <= len(data) else 0
    return True


def apng_frames(data: bytes) -> int:
    """Frames that a PNG announces; 1 for a still."""
    at = 8
    while data.startswith(b"\x89PNG\r\n\x1a\n") and at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"acTL":
            return max(int.from_bytes(data[at + 8 : at + 12], "big"), 1)
        at += 12 + size
    return 1


def ico_images(data: bytes) -> list[str]:
    """PNG or BMP for each image of an icon file."""
    n = int.from_bytes(data[4:6], "little")
    starts = [int.from_bytes(data[6 + 16 * k + 12 : 6 + 16 * k + 16], "little") for k in range(n) if 22 + 16 * k <= len(data)]
    return ["PNG" if data[s : s + 8] == b"\x89PNG\r\n\x1a\n" else "BMP" for s in starts]


def first_box(data: bytes, name: str) -> bytes | None:
    """The first box of that name in the tree, else one whose name stands anywhere behind a fitting size."""
    found = boxes(data, name)
    if found:
        return found[0]
    at = data.find(name.encode())
    while at >= 4:
        size = int.from_bytes(data[at - 4 : at], "big")
        if 8 <= size <= len(data) - at + 4:
            return data[at + 4 : at - 4 + size]
        at = data.find(name.encode(), at + 1)
    return None


def _rgb_identity(data: bytes) -> bool:
    """Whether the colour box says that samples are RGB itself, which only lossless encoders write."""
    colr = first_box(data, "colr") or b""
    return len(colr) >= 11 and colr[:4] == b"nclx" and colr[8:10] == b"\0\0"


def _deep(data: bytes) -> bool:
    """Whether the pixel box starts with a number of channels and one of them has 12 bits or more."""
    pixi = first_box(data, "pixi") or b""
    return len(pixi) > 1 and 0 < pixi[0] < len(pixi) and max(pixi[1 : 1 + pixi[0]]) >= 12


def heic_is_lossless(data: bytes) -> bool | None:
    """By the profile and chroma of the decoder's configuration: range extensions and screen content can be, with full chroma; None if they leave it open or there are no bytes."""
    if not data:
        return None
    config = first_box(data, "hvcC")
    if config is None or len(config) < 20:
        return False
    profile, chroma, extended = config[1] & 31, config[16] & 3, bool(config[2] & 8)
    if chroma in (1, 2) or profile in (1, 2, 3):
        return False
    if profile in (4, 9):
        return True if chroma == 3 or _rgb_identity(data) or _deep(data) else None
    return (True if chroma == 3 else None) if extended else False


def avif_is_lossless(data: bytes) -> bool | None:
    """By the codec configuration: subsampled chroma loses; full chroma is lossless where profile, depth or colour say so, else open."""
    config = first_box(data, "av1C")
    if config is None or len(config) < 4:
        return None
    profile, flags = config[1] >> 5, config[2]
    high, twelve, mono, half_x, half_y = (bool(flags >> k & 1) for k in (6, 5, 4, 3, 2))
    if half_x or (mono and half_y):
        return False
    if _rgb_identity(data):
        return True
    return None if half_y else True if profile == 0 or high or twelve or mono or _deep(data) else None


class LowBits:
    """Reads fields of bits from the lowest on; past the end it raises EOFError."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        found, self.value, self.left = self.value & ((1 << n) - 1), self.value >> n, self.left - n
        return found

    def choose(self, *widths: int) -> int:
        """Two bits select a width, and so many bits follow; gives the selector where the width is 0."""
        selector = self.take(2)
        return self.take(widths[selector]) if widths[selector] else selector

    def size_header(self) -> None:
        small = self.take(1)
        side = (lambda: self.take(5)) if small else (lambda: self.choose(9, 13, 18, 30))
        side()
        if self.take(3) == 0:
            side()


def jxl_is_lossless(data: bytes, strict: bool = True) -> bool | None:
    """A wrapped JPEG is lossless; else whether samples are in their own colour space, which lossy encoders give up.

    As observed, the flag of 16-bit buffers before the extra channels isn't read and a partial
    stream is read from its index on, unless ``strict`` is off. None where the header ends early, has a preview or extra channels of other than plain kind.
    """
    bare = data[:2] == b"\xff\x0a"
    if len(data) < 4:
        return None
    if not bare and boxes(data, "jbrd"):
        return True
    part = boxes(data, "jxlp")
    whole = [data] if bare else boxes(data, "jxlc") or [p if strict else p[4:] for p in part]
    if not whole:
        return None
    bits = LowBits(whole[0][2 if whole[0][:2] == b"\xff\x0a" else 0 :][:64])
    try:
        bits.size_header()
        if bits.take(1):  # all default: the lossy colour space
            return False
        if bits.take(1):
            bits.take(3)  # orientation
            if bits.take(1):
                bits.size_header()
            if bits.take(1):  # a preview
                return None
            if bits.take(1):  # an animation
                bits.choose(0, 0, 10, 30), bits.choose(0, 0, 10, 30), bits.choose(0, 3, 16, 32), bits.take(1)
        floats = bits.take(1)
        bits.choose(0, 0, 0, 6)
        if floats:
            bits.take(4)
        if not strict:
            bits.take(1)
        extra = bits.take(2)
        extra = bits.take(12) + 3 if extra == 3 else extra
        return None if any(not bits.take(1) for _ in range(extra)) else not bits.take(1)
    except EOFError:
        return None


READERS = {
    "WebP": webp_is_lossless, "EXR": exr_is_lossless, "JP2": jp2_is_lossless, "TIFF": tiff_is_lossless, "HEIC": heic_is_lossless, "HEIF": heic_is_lossless,
    "AVIF": avif_is_lossless, "JXL": jxl_is_lossless,
}


def is_lossless(image_format: str, data: bytes) -> bool | None:
    """Null where headers don't tell (PNG and ICO need their pixels' statistics) or leave it open."""
    if image_format in ALWAYS_LOSSLESS:
        return True
    if image_format == "JPEG":
        return False
    return READERS[image_format](data) if image_format in READERS else None


def with_compression(files: DataFrame) -> DataFrame:
    """path, lossless, frames of files (path, format, content); each is read inside its task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, is_lossless(f, bytes(c or b"")), apng_frames(bytes(c or b""))) for p, f, c in zip(batch["path"], batch["format"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "lossless", "frames"]).astype({"lossless": "boolean"})

    return files.select("path", "format", "content").mapInPandas(read, "path string, lossless boolean, frames long")
