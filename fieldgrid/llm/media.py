"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. A validator of the
format then reads the structure behind each hit: chunk lengths, segment markers, and checksums of PNG chunks, gzip
streams and the last FLAC frame (not those of OGG pages and ZIP entries). Marks, chains and checksums that several hits share are
found once for each value, so a value full of signatures takes time in proportion to its length (and its logarithm), but for gzip: streams
are inflated at each hit with a sound header, and one crafted to fail late at many hits takes time with the square of its length.
A hit that passes gives a type and an exact length; the one at the start corrects the declared type, the others are
carved as embedded media. Hits that fail are text that looks like a signature.

``store`` keeps a text as the samples of a WAV file (8 bits, mono): its UTF-8 bytes, then zeros up to a positive
multiple of 64. ``load`` finds the samples again by sniffing.

Defined cases: a null text is stored like an empty one, as 64 zeros; null and empty values are ``unknown`` with length
0 and nothing embedded; a truncated value is ``unknown``; values of any length are read whole; overlapping embedded media are carved from the first one on,
inside each other only at the top level; repeated rows get equal results; extra columns stay, but for one of the name of the result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8000

# Magic bytes, and the type that they announce.
MAGIC = [
    (b"RIFF", "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"fLaC", "audio/flac"),
    (b"OggS", "audio/ogg"),
]


class Value:
    """A value's bytes, and what several hits in it share; each is found once."""

    def __init__(self, b: bytes) -> None:
        self.b = b
        self._marks: dict[bytes, list[int]] = {}
        self._blocks: dict[int, int] = {}
        self._pages: dict[int, int] = {}
        self._png: dict[int, int] = {}
        self._gif: dict[int, int] = {}
        self._jpeg: dict[int, tuple[int, bool]] = {}
        self._flac: dict[int, int] = {}
        self._riff: dict[int, tuple[int, int, int, int, int]] = {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, -1 if there is none."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        places = self._marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    @functools.cached_property
    def archives(self) -> dict[int, int]:
        """Ends of ZIP archives by the start that their end record gives."""
        found: dict[int, int] = {}
        p = 0
        while (p := self.after(b"PK\x05\x06", p)) >= 0 and p + 22 <= len(self.b):
            size, offset, note = struct.unpack_from("<IIH", self.b, p + 12)
            at = p - offset - size
            if at >= 0 and self.b[at + offset : at + offset + 4] == b"PK\x01\x02" and p + 22 + note <= len(self.b):
                found.setdefault(at, p + 22 + note)
            p += 4
        return found

    def sub_blocks(self, p: int) -> int:
        """The place behind a chain of counted GIF blocks."""
        return self._chain(self._blocks, p, lambda q: (q + 1 + self.b[q], False) if q < len(self.b) and self.b[q] else (q + 1, True))

    def pages_end(self, p: int) -> int:
        """The place behind the last of the OGG pages that start here, -1 if they are broken off."""

        def page(q: int) -> tuple[int, bool]:
            if self.b[q : q + 4] != b"OggS" or q + 27 > len(self.b) or self.b[q + 4]:
                return -1, True
            n = self.b[q + 26]
            end = q + 27 + n + sum(self.b[q + 27 : q + 27 + n])
            return (-1, True) if end > len(self.b) else (end, bool(self.b[q + 5] & 4))

        return self._chain(self._pages, p, page)

    def flac_ends(self, start: int) -> bool:
        """Whether the value's last FLAC frame, not before ``start``, ends with its checksum."""
        if self._last_frame is None:
            return False
        return self._last_frame >= start

    @functools.cached_property
    def _last_frame(self) -> int | None:
        p = len(self.b)
        while (p := max(self.b.rfind(b"\xff\xf8", 0, p), self.b.rfind(b"\xff\xf9", 0, p))) >= 0:
            if _flac_frame(self.b, p):
                return p if _crc(self.b[p:], 0x8005, 16) == 0 else None
        return None

    # Chains of chunks: every place on the way is kept with what the chain comes to, so hits that share a chain walk it once.

    def png_end(self, p: int) -> int:
        """The place behind the IEND of the PNG chunks that start here, -1 if one is broken."""

        def chunk(q: int) -> tuple[int, bool]:
            size = int.from_bytes(self.b[q : q + 4], "big")
            end = q + 12 + size
            if end > len(self.b) or not self.b[q + 4 : q + 8].isalpha() or self.crc(q + 4, end - 4) != int.from_bytes(self.b[end - 4 : end], "big"):
                return -1, True
            return end, self.b[q + 4 : q + 8] == b"IEND"

        return self._chain(self._png, p, chunk)

    def gif_end(self, p: int) -> int:
        """The place behind the trailer of the GIF blocks that start here, -1 if there is none."""

        def block(q: int) -> tuple[int, bool]:
            b = self.b
            if q < len(b) and b[q] == 0x3B:
                return q + 1, True
            if q < len(b) and b[q] == 0x21:
                return self.sub_blocks(q + 2), False
            if q + 10 < len(b) and b[q] == 0x2C:
                return self.sub_blocks(q + 10 + _colours(b[q + 9]) + 1), False
            return -1, True

        return self._chain(self._gif, p, block)

    def flac_frames(self, p: int) -> int:
        """The place behind the FLAC metadata blocks that start here, -1 if they are broken off."""

        def block(q: int) -> tuple[int, bool]:
            if q + 4 > len(self.b):
                return -1, True
            return q + 4 + int.from_bytes(self.b[q + 1 : q + 4], "big"), bool(self.b[q] & 0x80)

        return self._chain(self._flac, p, block)

    def jpeg_end(self, p: int) -> tuple[int, bool]:
        """The place behind the end marker of the JPEG segments that start here, -1 if there is none; whether one of them is a frame."""
        known, way = self._jpeg, []
        while p not in known:
            q, last, frame = self._segment(p)
            way.append((p, frame))
            if last:
                end, framed = q, False
                break
            p = q
        else:
            end, framed = known[p]
        for q, frame in reversed(way):
            framed |= frame
            known[q] = end, framed
        return end, framed

    def _segment(self, p: int) -> tuple[int, bool, bool]:
        """The place behind the segment here (and the data behind a scan header), whether the file ends there, whether it is a frame."""
        b = self.b
        if p + 4 > len(b) or b[p] != 0xFF:
            return -1, True, False
        kind = b[p + 1]
        if kind == 0xFF:
            return p + 1, False, False
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if kind < 0xC0 or size < 2:
            return -1, True, False
        frame, end = kind in (0xC0, 0xC1, 0xC2), p + 2 + size
        if kind == 0xDA:
            k = bisect_left(self._jpeg_marks, end)
            if k == len(self._jpeg_marks):
                return -1, True, frame
            end = self._jpeg_marks[k]
            if b[end + 1] == 0xD9:
                return end + 2, True, frame
        return end, False, frame

    @functools.cached_property
    def _jpeg_marks(self) -> list[int]:
        """Places of markers that end entropy-coded data."""
        return [m.start() for m in re.finditer(rb"\xff(?=[^\x00\xd0-\xd7])", self.b, re.DOTALL)]

    def riff_kinds(self, p: int, end: int) -> tuple[bool, bool] | None:
        """Whether there are format and data chunks among the RIFF chunks from ``p`` on that come to ``end`` exactly; None if they don't.

        A place is kept with the next one, a jump further along its chain, its number from the chain's end, and how many
        format and data chunks follow; jumps double, so an end is found in a logarithm of the chain's length.
        """
        known, way = self._riff, []
        q = p
        while q not in known:
            if q + 8 > len(self.b):
                known[q] = (q, q, 0, 0, 0)
                break
            way.append(q)
            size = int.from_bytes(self.b[q + 4 : q + 8], "little")
            q += 8 + size + size % 2
        for x in reversed(way):
            _, jump, depth, formats, datas = known[q]
            _, far, half, *_ = known[jump]
            leap = known[jump][1] if depth - half == half - known[far][2] else q
            kind = self.b[x : x + 4]
            known[x] = (q, leap, depth + 1, formats + (kind == b"fmt "), datas + (kind == b"data"))
            q = x
        at = p
        while at < end:
            next_, jump, depth, *_ = known[at]
            if not depth:
                return None
            at = jump if jump <= end else next_
        if at != end:
            return None
        return known[p][3] > known[end][3], known[p][4] > known[end][4]

    # Checksums of any part, from checksums of what comes before it.

    def crc(self, start: int, end: int) -> int:
        """CRC-32 of a part; of a long one by those of two beginnings of the value."""
        if end - start <= _PART:
            return zlib.crc32(self.b[start:end])
        return self._crc_to(end) ^ _shifted(self._crc_to(start), end - start)

    def _crc_to(self, end: int) -> int:
        k = end // _PART
        return zlib.crc32(self.b[k * _PART : end], self._crcs[k])

    @functools.cached_property
    def _crcs(self) -> list[int]:
        out = [0]
        for at in range(0, len(self.b), _PART):
            out.append(zlib.crc32(self.b[at : at + _PART], out[-1]))
        return out

    @staticmethod
    def _chain(known: dict[int, int], p: int, step: Callable[[int], tuple[int, bool]]) -> int:
        """Where a chain of steps ends; every place on the way is remembered with it."""
        way = []
        while p not in known:
            way.append(p)
            p, last = step(p)
            if last:
                break
        else:
            p = known[p]
        known.update(dict.fromkeys(way, p))
        return p


#: Bytes between places of a value whose checksum from its start is kept.
_PART = 4096


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@functools.cache
def _power(k: int) -> int:
    """x to the power 8 * 2 ** k."""
    return 1 << 23 if k == 0 else _times(_power(k - 1), _power(k - 1))


def _shifted(crc: int, n: int) -> int:
    """What a checksum becomes by ``n`` further zero bytes that are not complemented."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            crc = _times(_power(k), crc)
    return crc


def _colours(flags: int) -> int:
    """Bytes of a GIF colour table."""
    return 3 * (2 << (flags & 7)) if flags & 0x80 else 0


def _wav(v: Value, at: int) -> int:
    """RIFF chunks: each has its length; format and data must be there."""
    b = v.b
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    return end - at if end <= len(b) and v.riff_kinds(at + 12, end) == (True, True) else 0


def _png(v: Value, at: int) -> int:
    """Chunks with length and checksum, from IHDR to IEND."""
    if v.b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    return max(0, v.png_end(at + 8) - at)


def _gif(v: Value, at: int) -> int:
    """Screen descriptor and colour table, then extension and image blocks up to the trailer."""
    if len(v.b) < at + 14:
        return 0
    return max(0, v.gif_end(at + 13 + _colours(v.b[at + 10])) - at)


def _jpeg(v: Value, at: int) -> int:
    """Segments with length, entropy-coded data after a scan header, the end marker."""
    end, framed = v.jpeg_end(at + 2)
    return end - at if end >= 0 and framed else 0


def _bmp(v: Value, at: int) -> int:
    """File length, zero reserved fields, an info header of a known size, pixels inside the file."""
    b = v.b
    if len(b) < at + 26:
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    return size if not reserved and header in (12, 40, 108, 124) and 14 + header <= pixels <= size <= len(b) - at else 0


def _pdf(v: Value, at: int) -> int:
    """A cross-reference start and the end mark behind it."""
    b = v.b
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    ref = v.after(b"startxref", at)
    end = v.after(b"%%EOF", ref) if ref >= 0 else -1
    return end + 5 - at if end >= 0 else 0


def _zip(v: Value, at: int) -> int:
    """An end record whose directory lies where it says, counted from the first entry."""
    return v.archives.get(at, at) - at


def _gzip(v: Value, at: int) -> int:
    """A stream that inflates to its own checksum and length."""
    b = v.b
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        while len(rest) and not d.eof:
            d.decompress(rest[:65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            at_end, rest = len(d.unused_data), rest[65536:]
        return len(b) - at - len(rest) - at_end if d.eof else 0
    except zlib.error:
        return 0


def _flac(v: Value, at: int) -> int:
    """Metadata blocks with their lengths, the first a stream info, then frames up to the end of the value, the last one whole."""
    b = v.b
    if at + 8 > len(b) or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return 0
    p = v.flac_frames(at + 4)
    return len(b) - at if p >= 0 and _flac_frame(b, p) and v.flac_ends(p) else 0


def _flac_frame(b: bytes, p: int) -> bool:
    """Whether a frame starts here: sync code, defined fields, and the header's checksum."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or not b[p + 2] >> 4 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return False
    more = next((k for k in range(8) if not b[p + 4] << k & 0x80), 8)  # bytes of the frame's number
    size = 4 + max(1, more) + {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    return p + size < len(b) and _crc(b[p : p + size + 1], 0x07, 8) == 0


def _crc(data: bytes, poly: int, width: int) -> int:
    """Checksum of ``width`` bits, most significant first, from zero; zero for data that its checksum ends."""
    table, low, crc = _crc_table(poly, width), (1 << width) - 1, 0
    for x in data:
        crc = (crc << 8 & low) ^ table[(crc >> width - 8) ^ x]
    return crc


@functools.cache
def _crc_table(poly: int, width: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> width - 1 else 0)
            x &= (1 << width) - 1
        out.append(x)
    return out


def _ogg(v: Value, at: int) -> int:
    """Pages, each of the length that its segment table sums to, up to one that is marked as the last."""
    return max(0, v.pages_end(at) - at)


VALIDATORS: dict[str, Callable[[Value, int], int]] = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg,
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def find_media(value: bytes) -> tuple[list[tuple[int, int, str]], int]:
    """(start, length, type) of the valid media, none inside another but those inside the first one, and the number of signatures met."""
    found, hits, free, v = [], 0, 0, Value(value)
    for end, (n, kind) in _automaton().iter(value.decode("latin-1")):
        hits += 1
        at = end + 1 - n
        if at >= free and (size := VALIDATORS[kind](v, at)):
            found.append((at, size, kind))
            free = at + size if at else free  # what fills the value from its start may hold others
    return found, hits


def sniff(value: bytes | None) -> tuple[str, int, list[tuple[int, int, str]], int]:
    """Type and length of what starts at 0, what is embedded behind its start, and the number of signatures met."""
    found, hits = find_media(value) if value else ([], 0)
    own = next(((k, n) for at, n, k in found if not at), ("unknown", 0))
    return *own, [x for x in found if x[0]], hits


def store(text: str | None) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    raw = (text or "").encode("utf-8", "replace")
    payload = raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def load(value: bytes) -> bytes:
    """The samples of a stored value, whose chunks the sniffer has confirmed."""
    kind, size, *_ = sniff(value)
    return _samples(value, size) if kind == "audio/wav" else b""


def _samples(value: bytes, size: int) -> bytes:
    p = 12
    while p + 8 <= size:
        n = int.from_bytes(value[p + 4 : p + 8], "little")
        if value[p : p + 4] == b"data":
            return value[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    return b""


def with_media_type(values: DataFrame, content: str = "content", declared: str = "declared", column: str = "media") -> DataFrame:
    """``values`` and a struct for each binary value: its type by structure, whether the declared one was right, its
    length, and starts, lengths and types of embedded media. One pass, no shuffle."""

    @F.pandas_udf("type string, declared_right boolean, length long, starts array<long>, lengths array<long>, types array<string>")
    def media(contents: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = []
        for b, said in zip(contents, types, strict=True):
            kind, size, inside, _ = sniff(None if b is None else bytes(b))
            rows.append((kind, kind == said, size, [x[0] for x in inside], [x[1] for x in inside], [x[2] for x in inside]))
        return pd.DataFrame(rows, columns=["type", "declared_right", "length", "starts", "lengths", "types"])

    return values.withColumn(column, media(F.col(content), F.col(declared)))


def carved(values: DataFrame, content: str = "content", media: str = "media") -> DataFrame:
    """A row for each embedded medium of ``values`` with a ``with_media_type`` column: its type, and its bytes as ``content``."""
    parts = F.explode(F.arrays_zip(f"{media}.starts", f"{media}.lengths", f"{media}.types"))
    rest = [c for c in values.columns if c not in (content, media)]
    cut_out = F.substring(F.col(content), (F.col("_p.starts") + 1).cast("int"), F.col("_p.lengths").cast("int"))
    return values.withColumn("_p", parts).select(*rest, cut_out.alias(content), F.col("_p.types").alias("type"), F.col("_p.starts").alias("start"))


def with_stored(docs: DataFrame, column: str = "media") -> DataFrame:
    """``docs`` and what its texts, stored as media and read back, show: lengths, digests and a feature."""

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            value = store(t)
            kind, size, inside, hits = sniff(value)
            payload = _samples(value, size)
            levels = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            mean = round(float(levels @ np.arange(256)) / len(payload), 3)
            embedded = ",".join(f"{k}@{at}+{n}" for at, n, k in inside) or "none"
            feature = f"{kind}; samples={len(payload)}; mean={mean}; levels={np.count_nonzero(levels)}; signatures={hits}; embedded={embedded}"
            rows.append((len((t or "").encode("utf-8", "replace")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(value), hashlib.sha256(value).hexdigest(), feature))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.withColumn(column, stored(F.col("text")))
