"""What a file's first bytes say."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import values as V


def image_format(content: Column) -> Column:
    """The format by magic number or brand, else Unknown; null for fewer than 32 bytes."""
    head = F.hex(F.substring(content, 1, 32))
    at = lambda start, length: F.substring(head, 2 * start + 1, 2 * length)
    hexed = lambda s: s.encode().hex().upper()
    brand = F.lit("Unknown")
    for name, brands in V.BRANDS.items():
        brand = F.when(at(8, 4).isin([hexed(b) for b in brands.split()]), name).otherwise(brand)
    compatible = F.when(F.contains(head, F.lit(hexed("avif"))) | F.contains(head, F.lit(hexed("avis"))), "AVIF").otherwise("HEIC")
    brand = F.when(at(8, 4).isin([hexed("mif1"), hexed("msf1")]), compatible).otherwise(brand)
    out = F.when(at(4, 4) == hexed("ftyp"), brand).when((at(0, 4) == hexed("RIFF")) & (at(8, 4) == hexed("WEBP")), "WebP")
    for magic, name in V.rows(V.MAGIC, " "):
        out = out.when(F.startswith(head, F.lit(magic)), name)
    return F.when(F.octet_length(content) >= 32, out.otherwise("Unknown"))


def chunk_counts(data: bytes) -> dict[str, int]:
    """How often the marks of frames and of data occur in a PNG or WebP file, by walking its chunks."""
    found = dict.fromkeys(("IDAT", "acTL", "fcTL", "ANIM", "ANMF", "VP8L"), 0)
    png = data.startswith(b"\x89PNG\r\n\x1a\n")
    at = 8 if png else 12 if data.startswith(b"RIFF") and data[8:12] == b"WEBP" else len(data)
    while at + 8 <= len(data):
        name, size = (data[at + 4 : at + 8], int.from_bytes(data[at : at + 4], "big")) if png else (data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little"))
        key = name.decode("latin-1")
        if key in found:
            found[key] += 1
        at += 12 + size if png else 8 + size + size % 2
    return found


def gif_figures(data: bytes) -> dict[str, object]:
    """Palette, frames, vendors and length in seconds of a GIF, by walking its blocks; a damaged end keeps what came before."""
    out: dict[str, object] = {"palette": None, "frames": 0, "vendors": [], "duration": 0.0}
    if not data.startswith((b"GIF87a", b"GIF89a")) or len(data) < 13:
        return out
    flags, at = data[10], 13
    if flags & 0x80:
        out["palette"] = 2 << (flags & 7)
        at += 3 * (2 << (flags & 7))

    def skip(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    while at < len(data):
        if data[at] == 0x2C and at + 10 <= len(data):
            out["frames"] += 1
            local = data[at + 9]
            at = skip(at + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
        elif data[at] == 0x21 and at + 2 < len(data):
            if data[at + 1] == 0xF9:
                out["duration"] += int.from_bytes(data[at + 4 : at + 6], "little") / 100
            elif data[at + 1] == 0xFF:
                out["vendors"].append(data[at + 3 : at + 3 + data[at + 2]].decode("latin-1"))
            at = skip(at + 2)
        else:
            break
    return out


def boxes(data: bytes, wanted: str, inside: tuple[str, ...] = ("meta", "moov", "trak", "mdia", "minf", "stbl", "iprp", "ipco")) -> list[bytes]:
    """Contents of the boxes named ``wanted`` in an ISO base media file, also within the containers ``inside``."""
    found, todo = [], [data]
    while todo:
        part, at = todo.pop(), 0
        while at + 8 <= len(part):
            size, name, head = int.from_bytes(part[at : at + 4], "big"), part[at + 4 : at + 8].decode("latin-1"), 8
            if size == 1:
                size, head = int.from_bytes(part[at + 8 : at + 16], "big"), 16
            size = size or len(part) - at
            if size < head:
                break
            body = part[at + head : at + size]
            if name == wanted:
                found.append(body)
            if name in inside:
                todo.append(body[4:] if name == "meta" else body)
            at += size
    return found


def jpeg_tables(data: bytes) -> list[list[int]]:
    """The quantisation tables of a JPEG in natural order."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    tables, at = [], 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        while data[at + 1] == 0xDB and part:
            wide, part = part[0] >> 4, part[1:]
            values = [int.from_bytes(part[i * (1 + wide) : (i + 1) * (1 + wide)], "big") for i in range(64)]
            table = [0] * 64
            for value, place in zip(values, order):
                table[place] = value
            tables.append(table)
            part = part[64 * (1 + wide) :]
        at += 2 + size
    return tables


def byte_figures(files: DataFrame) -> DataFrame:
    """path, chunks (map of counts), gif figures and the first quantisation table of files with content, each read inside its task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                data = bytes(data or b"")
                gif = gif_figures(data)
                tables = jpeg_tables(data)
                out.append((path, chunk_counts(data), gif["palette"], gif["frames"], gif["vendors"], gif["duration"], tables[0] if tables else None))
            yield pd.DataFrame(out, columns=["path", "chunks", "palette", "frames", "vendors", "duration", "quant_table"]).astype({"palette": "Int64"})

    schema = "path string, chunks map<string,long>, palette long, frames long, vendors array<string>, duration double, quant_table array<long>"
    return files.select("path", "content").mapInPandas(read, schema)
