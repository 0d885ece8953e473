"""Media columns by signature: find magic bytes, prove structure and length, correct types, carve what is embedded.

One Aho-Corasick automaton runs over a column's bytes and lists where any format's magic bytes stand; a validator
of that format then walks the structure from there and gives the length, or rejects the place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean, ship, schema_with

#: Payloads are padded with PAD to a positive multiple of so many bytes; also the width of stored images.
WIDTH, PAD = 576, 255

# Magic bytes of each format, and how far before them the file begins.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/gif": (b"GIF8", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/bmp": (b"BM", 0),
    "image/x-portable-graymap": (b"P5\n", 0),
    "audio/wav": (b"WAVEfmt ", 8),
    "audio/basic": (b".snd", 0),
}


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        p, first = end, False
    return None


def _blocks(b: bytes, p: int) -> int | None:
    while p < len(b):
        if not b[p]:
            return p + 1
        p += 1 + b[p]
    return None


def _gif(b: bytes, at: int) -> int | None:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return None
    flags = b[at + 10]
    p: int | None = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    images = 0
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 if images else None
        if b[p] == 0x21:
            p = _blocks(b, p + 2)
        elif b[p] == 0x2C and p + 11 <= len(b):
            flags = b[p + 9]
            p = _blocks(b, p + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
            images += 1
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, frames = at + 2, 0
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 if frames else None
        if kind in (0x00, 0x01, 0xFF, 0xD8) or 0xD0 <= kind <= 0xD7:
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or p + 2 + size > len(b):
            return None
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 if frames and b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, gap, offset, header, width, height, planes, bits, packing, body = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if gap or header != 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or packing or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if body in (0, rows) and size == offset + rows and offset >= 54 and at + size <= len(b) else None


def _pgm(b: bytes, at: int) -> int | None:
    parts, p = [], at + 3
    for _ in range(3):
        q = p
        while q < len(b) and 48 <= b[q] <= 57 and q - p < 10:
            q += 1
        if q == p or q >= len(b) or b[q] not in b" \n\t":
            return None
        parts.append(int(b[p:q]))
        p = q + 1
    width, height, top = parts
    end = p + width * height
    return end if width and height and 0 < top < 256 and end <= len(b) else None


def _wav(b: bytes, at: int) -> int | None:
    if at < 0 or b[at : at + 4] != b"RIFF":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    if end > len(b):
        return None
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, p)
        if kind == b"data" and b"fmt " not in seen:
            return None
        seen.add(kind)
        p += 8 + size + size % 2
    return end if p == end and b"data" in seen else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    offset, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    end = at + offset + size
    return end if offset >= 24 and 1 <= coding <= 27 and rate and 0 < channels < 256 and size != 0xFFFFFFFF and end <= len(b) else None


VALID = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/x-portable-graymap": _pgm, "audio/wav": _wav, "audio/basic": _au}

_automaton: list = []


def locate(blob: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every whole medium in blob, by start, then the longer first; media inside others too."""
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (magic, back) in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, kind))
        a.make_automaton()
        _automaton.append(a)
    found = []
    for end, (back, kind) in _automaton[0].iter(blob.decode("latin-1")):
        stop = VALID[kind](blob, end - back)
        if stop is not None:
            found.append((end - back, stop, kind))
    return sorted(found, key=lambda x: (x[0], -x[1], x[2]))


def outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("depth", pa.int64())])
    for b in batches:
        kinds, lists = [], []
        for value in b.column("media"):
            found = locate(value.as_buffer().to_pybytes()) if value.is_valid else []
            rows = []
            for i, (x, y, kind) in enumerate(found):
                rows.append({"start": x, "end": y, "type": kind, "depth": sum(1 for p, q, _ in found[:i] if p <= x and y <= q and (p, q) != (x, y))})
            kinds.append(found[0][2] if found and found[0][0] == 0 else None)
            lists.append(rows)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "media", "declared")), pa.array(kinds, pa.string()), pa.array(lists, pa.list_(part))], names=["row", "media", "declared", "sniffed", "found"])


#: The columns that sniff adds; the input's own of these names give way to them.
FOUND = ("sniffed", "corrected", "found")


def sniff(media: DataFrame) -> DataFrame:
    """media(media binary, declared string, ...) -> those columns, and sniffed, corrected, found.

    sniffed: the format that holds from the first byte, null if none does; corrected: sniffed, or
    'application/octet-stream'; found array<struct<start, end, type, depth>>: every whole medium at any place, by
    place, depth 0 for those in no other. Null or empty media have none. Repeated rows are kept. Media of any length are
    read whole, one at a time; an empty table gives an empty one. Columns named as the new ones are replaced by them.
    """
    ship(media.sparkSession)
    others = [c for c in media.columns if c not in ("media", "declared", *FOUND)]
    rows = media.select(F.struct(F.lit(True), *(F.col(f"`{c}`") for c in others)).alias("row"), "media", "declared")
    out = rows.mapInArrow(lean(_sniff), schema_with(rows, "row row, media binary, declared string, sniffed string, found array<struct<start:long,end:long,type:string,depth:long>>"))
    return out.select(*(F.col("row")[c].alias(c) for c in others), "media", "declared", "sniffed", F.coalesce("sniffed", F.lit("application/octet-stream")).alias("corrected"), "found")


def store(payload: bytes, kind: str) -> bytes:
    """payload (a multiple of WIDTH bytes) as the 8-bit samples of one medium."""
    rows = len(payload) // WIDTH
    if kind == "image/png":
        lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
        chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
    if kind == "image/bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        head = struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + len(payload), 0, 54 + 1024, 40, WIDTH, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 256)
        return b"BM" + head + palette + payload
    if kind == "image/x-portable-graymap":
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    if kind == "audio/basic":
        return b".snd" + struct.pack(">IIIII", 24, len(payload), 1, 8000, 1) + payload
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(medium: bytes, kind: str) -> bytes:
    """The 8-bit samples of one whole medium that store() can write."""
    if kind == "image/png":
        p, body = 8, []
        while True:
            size, name = struct.unpack_from(">I4s", medium, p)
            if name == b"IDAT":
                body.append(medium[p + 8 : p + 8 + size])
            if name == b"IEND":
                break
            p += 12 + size
        raw = zlib.decompress(b"".join(body))
        if any(raw[i] for i in range(0, len(raw), WIDTH + 1)):
            raise ValueError("a filtered PNG row")
        return b"".join(raw[i + 1 : i + 1 + WIDTH] for i in range(0, len(raw), WIDTH + 1))
    if kind == "image/bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    if kind == "image/x-portable-graymap":
        p = 3
        for _ in range(2):
            p = medium.index(b"\n", p) + 1
        return medium[p:]
    if kind == "audio/basic":
        return medium[struct.unpack_from(">I", medium, 4)[0] :]
    return medium[44:]


STORED = ("image/png", "image/bmp", "image/x-portable-graymap", "audio/wav", "audio/basic")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media, declared, sizes = [], [], []
        for text in b.column("text"):
            raw = text.as_buffer().to_pybytes()
            payload = raw + bytes([PAD]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))
            key = zlib.crc32(payload)
            media.append(store(payload, STORED[key % len(STORED)]))
            declared.append(STORED[key // 7 % len(STORED)])
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(declared)], names=["doc_id", "n_bytes", "media", "declared"])


def text_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, media, declared): texts stored as images and sounds.

    Format and declared type follow from the padded text's crc32; four of five declared types are wrong. A null text is
    empty; texts of any length are stored whole, repeated rows and null ids stay, an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_store), "doc_id long, n_bytes long, media binary, declared string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for value, found, declared, corrected in zip(b.column("media"), b.column("found").to_pylist(), b.column("declared").to_pylist(), b.column("corrected").to_pylist(), strict=True):
            blob = value.as_buffer().to_pybytes()
            top = next(x for x in found if x["depth"] == 0)
            payload = samples(blob[top["start"] : top["end"]], top["type"])
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(blob))
            out["media_sha256"].append(hashlib.sha256(blob).hexdigest())
            out["feature"].append(f"type={corrected};declared={declared};fixed={int(corrected != declared)};at={top['start']};end={top['end']};media={len(found)};rows={len(payload) // WIDTH}")
        kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names=["doc_id", "n_bytes", *out])


def digest(docs: DataFrame) -> DataFrame:
    """Texts stored as media, sniffed, carved and read back: sizes, digests and what was found."""
    return sniff(text_media(docs)).mapInArrow(lean(_read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
