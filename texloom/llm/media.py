"""Media columns: signature sniffing, type correction and carving.

One Aho-Corasick automaton over all magic bytes scans each value once. Each
place it finds goes to that format's validator, which confirms the structure
and computes the exact length; a signature alone counts for nothing. A value
whose first bytes validate has that type, whatever was declared; what
validates further in is carved as embedded media.

Scale: rows are mapped one by one; nothing is shuffled or broadcast.

Defined cases: a null value is an empty one, of type ``application/octet-stream``
with nothing carved. Bytes that no validator accepts keep that type too. Of
embedded places that overlap, the earlier stays. Other columns pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "application/octet-stream"
#: Samples a second that text_to_wav writes.
RATE = 8000


class Found(NamedTuple):
    """A validated value at some offset: its length, and where its raw samples are (0, 0 if they aren't stored raw)."""

    kind: str
    length: int
    body: int = 0
    body_length: int = 0
    detail: str = ""


def _u(fmt: str, b: bytes, at: int) -> int:
    size = struct.calcsize(fmt)
    if at < 0 or at + size > len(b):
        raise ValueError("short")
    return struct.unpack_from(fmt, b, at)[0]


def _riff(b: bytes, at: int) -> Found | None:
    size, form = 8 + _u("<I", b, at + 4), b[at + 8 : at + 12]
    if at + size > len(b) or size < 12:
        return None
    if form == b"WEBP":
        return Found("image/webp", size)
    if form != b"WAVE":
        return None
    p, end, fmt = at + 12, at + size, None
    while p + 8 <= end:
        n = _u("<I", b, p + 4)
        if p + 8 + n > end:
            return None
        if b[p : p + 4] == b"fmt " and n >= 16:
            code, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", b, p + 8)
            if not channels or align != channels * ((bits + 7) // 8) or speed != rate * align:
                return None
            fmt = f"pcm={code == 1:d},channels={channels},rate={rate},bits={bits}"
        elif b[p : p + 4] == b"data":
            return Found("audio/wav", size, p + 8, n, fmt) if fmt else None
        p += 8 + n + n % 2
    return None


def _png(b: bytes, at: int) -> Found | None:
    p, first, detail = at + 8, True, ""
    while True:
        n, kind = _u(">I", b, p), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != _u(">I", b, p + 8 + n) or first != (kind == b"IHDR"):
            return None
        if first:
            detail = "width={},height={}".format(*struct.unpack_from(">II", b, p + 8))
        first, p = False, p + 12 + n
        if kind == b"IEND":
            return Found("image/png", p - at, detail=detail)


def _jpeg(b: bytes, at: int) -> Found | None:
    p, scans = at + 2, 0
    while True:
        if _u("B", b, p) != 0xFF:
            return None
        while _u("B", b, p + 1) == 0xFF:
            p += 1
        marker = b[p + 1]
        p += 2
        if marker == 0xD9:
            return Found("image/jpeg", p - at) if scans else None
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        n = _u(">H", b, p)
        if n < 2 or p + n > len(b):
            return None
        p += n
        if marker == 0xDA:
            scans += 1
            while True:  # entropy-coded bytes: 0xFF is stuffed with 0 or starts a restart marker
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2


def _gif(b: bytes, at: int) -> Found | None:
    flags, p = _u("B", b, at + 10), at + 13
    p += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while n := _u("B", b, p):
            p += 1 + n
        return p + 1

    images = 0
    while True:
        kind = _u("B", b, p)
        if kind == 0x3B:
            return Found("image/gif", p + 1 - at) if images else None
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C:
            own = _u("B", b, p + 9)
            p = blocks(p + 11 + (3 << ((own & 7) + 1) if own & 0x80 else 0))
            images += 1
        else:
            return None


def _bmp(b: bytes, at: int) -> Found | None:
    size, reserved, start, head = struct.unpack_from("<IIII", b, at + 2) if at + 18 <= len(b) else (0, 1, 0, 0)
    if reserved or at + size > len(b) or head not in (12, 40, 52, 56, 64, 108, 124) or not 14 + head <= start < size:
        return None
    return Found("image/bmp", size, at + start, size - start)


def _zip(b: bytes, at: int) -> Found | None:
    end = b.find(b"PK\x05\x06", at)
    if end < 0:
        return None
    size, start, note = _u("<I", b, end + 12), _u("<I", b, end + 16), _u("<H", b, end + 20)
    if at + start + size != end or end + 22 + note > len(b):
        return None
    return Found("application/zip", end + 22 + note - at)


def _gzip(b: bytes, at: int) -> Found | None:
    if _u("B", b, at + 3) & 0xE0:
        return None
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and p < len(b):  # by pieces: what it unpacks to isn't kept
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return Found("application/gzip", min(p, len(b)) - len(d.unused_data) - at) if d.eof else None


def _pdf(b: bytes, at: int) -> Found | None:
    end = b.find(b"%%EOF", at)
    if end < 0 or b.find(b"startxref", at, end) < 0 or not b[at + 5 : at + 6].isdigit():
        return None
    return Found("application/pdf", end + 5 - at)


def _flac(b: bytes, at: int) -> Found | None:
    p = at + 4
    if _u("B", b, p) & 0x7F or _u(">I", b, p) & 0xFFFFFF != 34:
        return None
    while True:
        head = _u(">I", b, p)
        p += 4 + (head & 0xFFFFFF)
        if p > len(b):
            return None
        if head >> 31:
            break
    return Found("audio/flac", len(b) - at) if _u(">H", b, p) >> 2 == 0x3FFE else None


def _ogg(b: bytes, at: int) -> Found | None:
    p = at
    while b[p : p + 4] == b"OggS":
        if _u("B", b, p + 4):
            return None
        n = _u("B", b, p + 26)
        body = sum(b[p + 27 : p + 27 + n])
        if p + 27 + n + body > len(b):
            return None
        last = b[p + 5] & 4
        p += 27 + n + body
        if last:
            return Found("application/ogg", p - at)
    return None


#: The formats' magic bytes.
MAGIC: dict[bytes, Callable[[bytes, int], Found | None]] = {
    b"\x89PNG\r\n\x1a\n": _png,
    b"\xff\xd8\xff": _jpeg,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"BM": _bmp,
    b"RIFF": _riff,
    b"PK\x03\x04": _zip,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
    b"fLaC": _flac,
    b"OggS": _ogg,
}
_automaton: ahocorasick.Automaton | None = None


def _signatures() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for magic, check in MAGIC.items():
            made.add_word(magic.decode("latin-1"), (len(magic), check))
        made.make_automaton()
        _automaton = made
    return _automaton


def sniff_bytes(b: bytes) -> tuple[Found, list[tuple[int, Found]]]:
    """What b is, and what valid media it holds further in, with offsets."""
    whole, embedded, free = Found(UNKNOWN, 0), [], 0
    for end, (n, check) in _signatures().iter(b.decode("latin-1")):
        at = end - n + 1
        if at and at < free:
            continue
        try:
            found = check(b, at)
        except ValueError:
            continue
        if found and at == 0:
            whole = found
        elif found:
            embedded.append((at, found))
            free = at + found.length
    return whole, embedded


_CARVED = "array<struct<type: string, offset: bigint, length: bigint>>"
SNIFFED = f"struct<type: string, length: bigint, body_offset: bigint, body_length: bigint, detail: string, carved: {_CARVED}, feature: string>"


def _feature(b: bytes, found: Found, carved: int) -> str:
    body = np.frombuffer(b, np.uint8, found.body_length, found.body) if found.body_length else np.empty(0, np.uint8)
    stats = f"samples={len(body)},sum={int(body.sum(dtype=np.int64))},peak={int(body.max())},changes={int((body[1:] != body[:-1]).sum())}" if len(body) else "samples=0"
    return f"{found.kind};{found.detail};{stats};embedded={carved}"


def _sniff_array(values: pa.Array) -> pa.Array:
    out = []
    for v in values:
        b = v.as_py() or b""
        whole, embedded = sniff_bytes(b)
        carved = [{"type": f.kind, "offset": at, "length": f.length} for at, f in embedded]
        out.append({"type": whole.kind, "length": whole.length, "body_offset": whole.body, "body_length": whole.body_length, "detail": whole.detail, "carved": carved, "feature": _feature(b, whole, len(carved))})
    one = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    kind = pa.struct([("type", pa.string()), ("length", pa.int64()), ("body_offset", pa.int64()), ("body_length", pa.int64()), ("detail", pa.string()), ("carved", pa.list_(one)), ("feature", pa.string())])
    return pa.array(out, kind)


def sniff(media: Column) -> Column:
    """A struct: type, length, body_offset, body_length (of raw samples), detail, carved, feature."""

    @F.arrow_udf(SNIFFED)
    def run(values: pa.Array) -> pa.Array:
        return _sniff_array(values)

    return run(media)


def correct_types(df: DataFrame, *, media_col: str = "media", declared_col: str = "declared", out_col: str = "sniffed") -> DataFrame:
    """df with ``out_col`` (see sniff) and ``declared_col`` set to the type found, where one was found."""
    s = F.col(out_col)
    return df.withColumn(out_col, sniff(F.col(media_col))).withColumn(declared_col, F.when(s["type"] != UNKNOWN, s["type"]).otherwise(F.coalesce(F.col(declared_col), F.lit(UNKNOWN))))


def _le(value: Column, size: int) -> Column:
    """value as ``size`` little-endian bytes."""
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k - 1, 2) for k in range(size, 0, -1))))


def _ascii(text: str) -> Column:
    return F.encode(F.lit(text), "UTF-8")


def to_wav(payload: Column, rate: int = RATE) -> Column:
    """payload as the samples of a WAV file: PCM, one channel, 8 bits. payload has an even length."""
    n = F.octet_length(payload)
    fmt = F.lit(struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8))
    return F.concat(_ascii("RIFF"), _le(n + 36, 4), _ascii("WAVEfmt "), fmt, _ascii("data"), _le(n, 4), payload)


def padded(text: Column, unit: int = 192) -> Column:
    """text in UTF-8 with bytes 32 up to a positive multiple of ``unit``; a null is an empty text."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.greatest(F.lit(1), F.ceil(n / F.lit(unit))).cast("int") * unit - n
    return F.concat(raw, F.encode(F.repeat(F.lit(" "), pad), "UTF-8"))


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: str = "image/png") -> DataFrame:
    """Texts stored as media columns: id, n_bytes, media (WAV) and the type that was (wrongly) declared for it."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), to_wav(padded(text)).alias("media"), F.lit(declared).alias("declared"))
