"""Media columns: what a blob really is, and what is embedded in it.

An Aho-Corasick automaton over the magic bytes of all formats finds candidate
starts in one pass; a validator for each format then walks the structure and
gives the length, or rejects the candidate. The valid candidate at the start
corrects the declared type; valid ones further on are carved.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import wave
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import slices

# Magic bytes by type; for wav the form type stands 8 bytes after them.
MAGIC = {
    "bmp": [b"BM"],
    "gif": [b"GIF87a", b"GIF89a"],
    "gzip": [b"\x1f\x8b\x08"],
    "jpeg": [b"\xff\xd8\xff"],
    "pdf": [b"%PDF-"],
    "png": [b"\x89PNG\r\n\x1a\n"],
    "wav": [b"RIFF"],
    "zip": [b"PK\x03\x04"],
}


def png_length(b: memoryview, at: int) -> int | None:
    """Walks the chunks and checks each CRC; IHDR comes first, IEND last, with IDAT between."""
    i, seen = at + 8, []
    while i + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, i)
        kind = bytes(b[i + 4 : i + 8])
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        if not seen and (kind != b"IHDR" or n != 13):
            return None
        seen.append(kind)
        i += 12 + n
        if kind == b"IEND":
            return i - at if b"IDAT" in seen else None
    return None


def gif_length(b: memoryview, at: int) -> int | None:
    """Walks colour tables, extensions and images up to the trailer."""
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while i < len(b):
        mark = b[i]
        if mark == 0x3B:
            return i + 1 - at if images else None
        if mark == 0x2C:
            if i + 10 > len(b):
                return None
            flags = b[i + 9]
            i += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
            images += 1
        elif mark == 0x21:
            i += 2
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def bmp_length(b: memoryview, at: int) -> int | None:
    """Header sizes, planes, depth and the size of uncompressed rows must agree with the stated file size."""
    if at + 54 > len(b):
        return None
    size, reserved, data, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packing or width <= 0 or not height:
        return None
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    return size if data >= 14 + header and data + rows == size and at + size <= len(b) else None


def wav_length(b: memoryview, at: int) -> int | None:
    """The RIFF size holds whole chunks, among them fmt and after it data."""
    if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    (size,) = struct.unpack_from("<I", b, at + 4)
    end, i, seen = at + 8 + size, at + 12, []
    if end > len(b):
        return None
    while i + 8 <= end:
        (n,) = struct.unpack_from("<I", b, i + 4)
        seen.append(bytes(b[i : i + 4]))
        i += 8 + n + n % 2
    return 8 + size if i == end and b"fmt " in seen and b"data" in seen[seen.index(b"fmt ") :] else None


def jpeg_length(b: memoryview, at: int) -> int | None:
    """Walks marker segments, then entropy-coded data, up to the end marker."""
    i, scans, raw = at + 2, 0, b.obj
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if 0xD0 <= mark <= 0xD8 or mark == 1:
            return None
        (n,) = struct.unpack_from(">H", b, i + 2)
        if n < 2:
            return None
        i += 2 + n
        if mark == 0xDA:
            scans += 1
            while True:
                i = raw.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0xD9:
                    return i + 2 - at
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
    return None


def gzip_length(b: memoryview, at: int) -> int | None:
    """Inflates one member and lets zlib check its CRC and size."""
    d = zlib.decompressobj(31)
    i = at
    try:
        while not d.eof and i < len(b):
            d.decompress(b[i : i + 65536])
            i += 65536
    except zlib.error:
        return None
    return min(i, len(b)) - len(d.unused_data) - at if d.eof else None


def zip_ends(raw: bytes) -> dict[int, int]:
    """Length of the archive by its start, for every end record with a central directory just before it: one pass over a blob."""
    out: dict[int, int] = {}
    i = -1
    while (i := raw.find(b"PK\x05\x06", i + 1)) >= 0 and i + 22 <= len(raw):
        size, offset, comment = struct.unpack_from("<IIH", raw, i + 12)
        at, stop = i - size - offset, i + 22 + comment
        if at >= 0 and raw[i - size : i - size + 4] == b"PK\x01\x02" and stop <= len(raw):
            out.setdefault(at, stop - at)
    return out


XREF = re.compile(rb"startxref\s{1,4}([0-9]{1,12})\s{1,4}%%EOF")
TABLE = re.compile(rb"\s{0,4}(?:xref\s|[0-9]{1,10}\s{1,4}[0-9]{1,10}\s{1,4}obj)")


def pdf_length(b: memoryview, at: int) -> int | None:
    """A version, and an end mark whose offset leads to a cross-reference table or an object; the last such mark before another start counts."""
    raw = b.obj
    if at + 8 > len(b) or not raw[at + 5 : at + 6].isdigit() or raw[at + 6 : at + 7] != b".":
        return None
    stop = raw.find(b"%PDF-", at + 5)
    length = None
    for end in XREF.finditer(raw, at, stop if stop >= 0 else len(b)):
        table = at + int(end[1])
        if at + 8 <= table < end.start() and TABLE.match(raw, table):
            length = end.end() - at
    return length


LENGTH = {"bmp": bmp_length, "gif": gif_length, "gzip": gzip_length, "jpeg": jpeg_length, "pdf": pdf_length, "png": png_length, "wav": wav_length}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, marks in MAGIC.items():
        for m in marks:
            a.add_word(m.decode("latin-1"), (kind, len(m)))
    a.make_automaton()
    return a


def parts(blob: bytes, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """``type, offset, length`` of the outermost valid media in a blob, in order; what lies inside one isn't looked at again."""
    out: list[tuple[str, int, int]] = []
    view, end, archives = memoryview(blob), 0, None
    for last, (kind, n) in a.iter(blob.decode("latin-1")):
        at = last + 1 - n
        if at < end:
            continue
        if kind == "zip" and archives is None:
            archives = zip_ends(blob)
        if length := archives.get(at) if kind == "zip" else LENGTH[kind](view, at):
            out.append((kind, at, length))
            end = at + length
    return out


SNIFFED = "detected string, declared string, mismatch boolean, parts array<struct<type: string, offset: long, length: long, sha256: string>>"


def sniff(media: DataFrame, id_col: str = "id", blob_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``id, detected, declared, mismatch, parts`` of every row.

    ``detected`` is the type of valid media at the start of the blob, else null;
    ``declared`` is the corrected type: what was detected, else what was
    declared. ``parts`` has all valid media, embedded ones too. Null and empty
    blobs have no parts. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in slices(batches, 16 << 20):
            found = [parts(x, a) for x in b.column(1).to_pylist()]
            first = [p[0][0] if p and p[0][1] == 0 else None for p in found]
            said = b.column(2).to_pylist()
            rows = [
                [{"type": k, "offset": at, "length": n, "sha256": hashlib.sha256(x[at : at + n]).hexdigest()} for k, at, n in p]
                for p, x in zip(found, b.column(1).to_pylist(), strict=True)
            ]
            part = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
            columns = {
                "id": b.column(0), "detected": pa.array(first, pa.string()),
                "declared": pa.array([f or s for f, s in zip(first, said, strict=True)], pa.string()),
                "mismatch": pa.array([f is not None and f != s for f, s in zip(first, said, strict=True)]),
                "parts": pa.array(rows, pa.list_(part)), "media": b.column(1),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    blob = F.coalesce(media[blob_col].cast("binary"), F.lit(b""))
    rows = media.select(media[id_col].alias("id"), blob.alias("text"), media[declared_col].cast("string").alias("declared"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {SNIFFED}, media binary")


#: Samples in a row of the images.
WIDTH = 64


def store(payload: bytes, kind: str) -> bytes:
    """8-bit samples, a positive multiple of 64, as a mono sound or a grey image."""
    if kind == "wav":
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        return out.getvalue()
    height = len(payload) // WIDTH
    if kind == "bmp":
        palette = np.arange(256, dtype=np.uint8).repeat(4).reshape(256, 4)
        palette[:, 3] = 0
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, WIDTH, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette.tobytes() + payload
    if kind == "png":
        rows = np.zeros((height, WIDTH + 1), np.uint8)
        rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return MAGIC["png"][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def samples(media: bytes, kind: str) -> bytes:
    """The 8-bit samples of what ``store`` wrote."""
    if kind == "wav":
        with wave.open(io.BytesIO(media)) as w:
            return w.readframes(w.getnframes())
    if kind == "bmp":
        (data,) = struct.unpack_from("<I", media, 10)
        return media[data:]
    if kind == "png":
        packed, i = [], 8
        while i < len(media):
            (n,) = struct.unpack_from(">I", media, i)
            if media[i + 4 : i + 8] == b"IDAT":
                packed.append(media[i + 8 : i + 8 + n])
            i += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()
    raise ValueError(kind)


KINDS = ("wav", "bmp", "png")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media, declared``: each text (null: empty) as media, its bytes padded with 0 to a positive multiple of 64.

    The CRC of the text picks the format, and a declared type that is wrong
    for some texts. Equal texts give equal media.
    """

    def run(batches):
        for b in slices(batches, 16 << 20):
            media, declared, sizes = [], [], []
            for t in b.column(1).to_pylist():
                crc = zlib.crc32(t)
                media.append(store(t + bytes(-len(t) % 64 or 64 * (not t)), KINDS[crc % 3]))
                declared.append(KINDS[(crc // 3) % 3])
                sizes.append(len(t))
            columns = [b.column(0), pa.array(media, pa.binary()), pa.array(declared, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "media", "declared"])

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, media binary, declared string")


def digests(sniffed: DataFrame) -> DataFrame:
    """Reads back the samples of the first part of each row of ``sniff``: their digests and features.

    A row without parts, or whose first part is of a format that ``store``
    doesn't write, has nulls.
    """

    def run(batches):
        for b in slices(batches, 16 << 20, "media"):
            out = []
            for part, media, wrong in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p = part[0] if part else None
                if p is None or p["type"] not in KINDS:
                    out.append((None,) * 6)
                    continue
                data = samples(media[p["offset"] : p["offset"] + p["length"]], p["type"])
                x = np.frombuffer(data, np.uint8)
                feature = f"{p['type']}{'!' if wrong else ''};samples={len(x)};mean={x.mean():.6f};spread={x.std():.6f};peak={x.max()};parts={len(part)}"
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), p["length"], p["sha256"], feature))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]], ["id", *names])

    kind = sniffed.schema["id"].dataType.simpleString()
    schema = f"id {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniffed.select("id", "parts", "media", "mismatch").mapInArrow(run, schema)
