"""Media columns typed by signature sniffing.

An Aho-Corasick automaton finds every magic byte string of the known formats in
one pass; a validator per format then confirms structure and length, so that a
chance "BM" or "PK" in a text is not taken for an image or an archive.  What is
confirmed at offset 0 corrects the declared type; what is confirmed further in
is an embedded item and can be carved.  ``wrap_wav`` stores arbitrary bytes
losslessly as 8-bit samples.

Null and empty blobs have no type; a truncated container is not confirmed;
nested items inside a confirmed one are not reported again.  Very long blobs are
read whole.  Of formats confirmed at one place the first in the list counts.
Repeated rows get the same result each; an empty table gives an empty one.
Extra columns pass unchanged; a column named as a result is replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kerbline.llm.arrow import bound_batches

# Magic byte strings as the formats' public specifications give them.
MAGIC = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "png"),
    (b"GIF87a", "gif"),
    (b"GIF89a", "gif"),
    (b"\xff\xd8\xff", "jpeg"),
    (b"BM", "bmp"),
    (b"%PDF-", "pdf"),
    (b"fLaC", "flac"),
    (b"OggS", "ogg"),
    (b"PK\x03\x04", "zip"),
    (b"\x1f\x8b\x08", "gzip"),
)
RATE = 8000
HEADER = 44


def wrap_wav(payload: bytes) -> bytes:
    """Mono 8-bit PCM: one sample a byte; an odd length gets the pad byte that RIFF asks for."""
    pad = len(payload) & 1
    return (
        struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
        + payload
        + b"\0" * pad
    )


def _riff(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if len(b) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if end > len(b):
        return None
    if form == b"WEBP":
        return ("image/webp", end, at + 12, end) if b[at + 12 : at + 15] == b"VP8" else None
    if form != b"WAVE":
        return None
    pos, known = at + 12, False
    while pos + 8 <= end:
        name, length = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + length > end:
            return None
        if name == b"fmt ":
            known = length >= 16
        if name == b"data":
            return ("audio/wav", end, pos + 8, pos + 8 + length) if known else None
        pos += 8 + length + (length & 1)
    return None


def _png(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    pos = at + 8
    while pos + 12 <= len(b):
        length = int.from_bytes(b[pos : pos + 4], "big")
        end = pos + 12 + length
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if (kind := b[pos + 4 : pos + 8]) == b"IEND":
            return ("image/png", end, at, end)
        if pos == at + 8 and kind != b"IHDR":
            return None
        pos = end
    return None


def _gif(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return ("image/gif", pos + 1, at, pos + 1)
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark in (0x00, 0xFF, 0xD8):
            return None
        pos += 2 + int.from_bytes(b[pos + 2 : pos + 4], "big")
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return ("image/jpeg", end + 2, at, end + 2) if end >= 0 else None
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if len(b) < at + 54:
        return None
    size, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    known = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return ("image/bmp", at + size, at, at + size) if known and not reserved and 54 <= offset <= size <= len(b) - at else None


def _pdf(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end = b.find(b"%%EOF", at)
    return ("application/pdf", end + 5, at, end + 5) if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _flac(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    known = len(b) >= at + 42 and b[at + 4] & 0x7F == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34
    return ("audio/flac", len(b), at, len(b)) if known else None


def _ogg(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        table = b[pos + 27 : pos + 27 + b[pos + 26]]
        end = pos + 27 + len(table) + sum(table)
        if len(table) < b[pos + 26] or end > len(b):
            return None
        if b[pos + 5] & 4:
            return ("audio/ogg", end, at, end)
        pos = end
    return None


def _zip(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    tail = b.find(b"PK\x05\x06", at)
    if tail < 0 or tail + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, tail + 12)
    end = tail + 22 + comment
    known = at + offset + size == tail and end <= len(b) and b[at + offset : at + offset + 4] == b"PK\x01\x02"
    return ("application/zip", end, at, end) if known else None


def _gzip(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    reader = zlib.decompressobj(31)
    try:
        view = memoryview(b)[at:]
        for i in range(0, len(view), 65536):
            reader.decompress(view[i : i + 65536])
            if reader.eof:
                end = at + min(i + 65536, len(view)) - len(reader.unused_data)
                return ("application/gzip", end, at, end)
    except zlib.error:
        pass
    return None


VALIDATORS = {
    "riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf,
    "flac": _flac, "ogg": _ogg, "zip": _zip, "gzip": _gzip,
}


def scanner():
    """A function bytes -> list of confirmed (type, start, end, body start, body end), outermost only, in order."""
    automaton = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
    automaton.make_automaton()

    def scan(blob: bytes) -> list[tuple[str, int, int, int, int]]:
        found, free = [], 0
        for last, (length, kind) in automaton.iter(blob.decode("latin-1")):
            start = last - length + 1
            if start >= free and (hit := VALIDATORS[kind](blob, start)):
                mime, end, body, body_end = hit
                found.append((mime, start, end, body, body_end))
                free = end
        return found

    return scan


ITEM = "type string, start long, length long, body_start long, body_length long"
SNIFFED = f"type string, corrected boolean, items array<struct<{ITEM}>>"


def sniff(blobs: DataFrame, blob_col: str = "media", declared_col: str = "declared_type", out: str = "sniffed") -> DataFrame:
    """Every row with a struct ``out``: the confirmed type at offset 0 (else null), whether it differs from the declared one, and all confirmed items."""
    item = pa.struct([("type", pa.string()), *((n, pa.int64()) for n in ("start", "length", "body_start", "body_length"))])

    @F.arrow_udf(SNIFFED)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scan = scanner()
        for media, declared in batches:
            kinds, fixed, items = [], [], []
            for blob, said in zip(media, declared.to_pylist(), strict=True):
                found = scan(blob.as_py() or b"")
                kind = found[0][0] if found and found[0][1] == 0 else None
                kinds.append(kind)
                fixed.append(kind is not None and kind != said)
                items.append([dict(zip(("type", "start", "length", "body_start", "body_length"), (m, s, e - s, p, q - p), strict=True)) for m, s, e, p, q in found])
            yield pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(items, pa.list_(item))], names=["type", "corrected", "items"])

    bound_batches(blobs.sparkSession)
    return blobs.withColumn(out, apply(F.col(blob_col), F.col(declared_col).cast("string")))


def carve(sniffed: DataFrame, blob_col: str = "media", out: str = "sniffed") -> DataFrame:
    """One row for each confirmed item: all columns, its number, type and bytes."""
    rows = sniffed.select("*", F.posexplode(f"{out}.items").alias("item_no", "item"))
    # binary substring counts from 1
    piece = F.expr(f"substring(`{blob_col}`, int(item.start) + 1, int(item.length))")
    return rows.select(*sniffed.columns, "item_no", F.col("item.type").alias("item_type"), piece.alias("item_bytes"))


def body_of_first(blob_col: str = "media", out: str = "sniffed") -> Column:
    """The samples of the container confirmed first, read from the stored bytes by the span that its validator found."""
    return F.expr(f"substring(`{blob_col}`, int({out}.items[0].body_start) + 1, int({out}.items[0].body_length))")


def pad_payload(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: empty) with zeros up to a positive multiple of 64."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = F.length(data)
    goal = F.greatest(F.lit(64), F.ceil(size / 64).cast("int") * 64)
    return F.concat(data, F.substring(F.lit(bytes(64)), F.lit(1), goal - size))


@F.arrow_udf(T.BinaryType())
def to_wav(payload: pa.Array) -> pa.Array:
    """Bytes stored as 8-bit samples of a WAV file."""
    return pa.array([None if p is None else wrap_wav(p) for p in payload.to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def sample_features(body: pa.Array) -> pa.Array:
    """Mean, root mean square and zero crossings of 8-bit samples, as text; null for null, and all zero without samples."""
    out = []
    for b in body.to_pylist():
        if b is None:
            out.append(None)
            continue
        x = np.frombuffer(b, np.uint8).astype(np.int64) - 128
        n = max(1, len(x))
        crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
        out.append(f"n={len(x)};mean={x.sum() / n:.4f};rms={(float((x * x).sum()) / n) ** 0.5:.4f};zc={crossings}")
    return pa.array(out, pa.string())
