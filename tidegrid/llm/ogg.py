"""Media columns: an Ogg container writer and reader, and the column operators over them.

A container holds logical streams, each a list of (packet, granule position).
Pages carry up to 255 lacing values; a packet that is longer goes on in the next
page. Reading verifies each page's checksum, looks for the next capture pattern
after a damaged page, joins packets from lacing values, keeps logical streams
apart by serial number and turns granule positions into seconds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

PATTERN = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: The identification packet: magic, version, sample rate, payload length.
_IDENT = struct.Struct("<8sBIQ")
MAGIC = b"\x7fU8PCM\x00\x00"
NOTES = b"\x7fNOTES\x00\x00"

def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, start 0.

    zlib's is the same polynomial with bits reversed, so bytes are reversed going
    in and the register coming out, and zlib's two inversions are undone.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")

def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(PATTERN, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]

def stream_pages(serial: int, packets: list[tuple[bytes, int]], first_alone: bool = True) -> list[bytes]:
    """Pages of one logical stream. The first packet has a page of its own (as players expect)."""
    pages, lacing, body, granule, flags = [], bytearray(), bytearray(), NO_GRANULE, FIRST

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal granule, flags
        pages.append(_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, flags = NO_GRANULE, CONTINUED if goes_on else 0

    for k, (packet, position) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = done = 0
        while at < len(values):
            if len(lacing) == 255:
                flush(False, at > 0)
            part = values[at : at + 255 - len(lacing)]
            n = sum(part) if part[-1] != 255 else 255 * len(part)
            lacing += part
            body += packet[done : done + n]
            at, done = at + len(part), done + n
        granule = position
        if k == len(packets) - 1:
            flush(True, False)
        elif not k and first_alone:
            flush(False, False)
    return pages

def interleave(streams: list[list[bytes]]) -> bytes:
    """All first pages lead; then pages of the streams take turns."""
    out = [s[0] for s in streams if s]
    for k in range(1, max((len(s) for s in streams), default=0)):
        out += [s[k] for s in streams if len(s) > k]
    return b"".join(out)

@dataclass
class Logical:
    """One logical stream as read: whole packets with the granule positions known for them."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    began: bool = False
    ended: bool = False
    _next: int | None = None
    _open: list[bytes] | None = None

@dataclass
class Container:
    streams: dict[int, Logical] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    skipped_bytes: int = 0

def read(data: bytes) -> Container:
    """Parse a container. Damaged pages count in bad_pages, and the packets they break are dropped."""
    out, at = Container(), 0
    while at < len(data):
        found = data.find(PATTERN, at)
        if found < 0:
            out.skipped_bytes += len(data) - at
            break
        out.skipped_bytes += found - at
        at = found
        if at + 27 > len(data):
            out.bad_pages += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        out.pages += 1
        _take(out.streams.setdefault(serial, Logical(serial)), flags, granule, number, lacing, page, 27 + n)
        at = end
    return out

def _take(s: Logical, flags: int, granule: int, number: int, lacing: bytes, page: bytes, at: int) -> None:
    s.pages += 1
    s.began |= bool(flags & FIRST)
    s.ended |= bool(flags & LAST)
    lost = number != (s._next if s._next is not None else 0)
    s.gaps += lost
    s._next = number + 1
    broken = bool(flags & CONTINUED) and (lost or s._open is None)  # its beginning is missing
    parts = s._open if flags & CONTINUED and not broken else []
    s._open, whole, size = None, 0, 0
    for v in lacing:
        size += v
        if v == 255:
            continue
        parts.append(page[at : at + size])
        if broken:
            broken = False
        else:
            s.packets.append(b"".join(parts))
            whole += 1
        at, size, parts = at + size, 0, []
    if lacing and lacing[-1] == 255:
        parts.append(page[at : at + size])
        s._open = None if broken else parts
    # A page's position is that of the last packet that ends in it.
    s.granules += [NO_GRANULE] * max(0, whole - 1) + [granule] * (whole > 0)

def seconds(stream: Logical, rate: int) -> list[float | None]:
    """End time of each packet, where its page states one."""
    return [g / rate if g >= 0 else None for g in stream.granules]

# --- text payloads as 8-bit samples ---------------------------------------------

def payload_of(text: bytes) -> bytes:
    """The text, then zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))

def write_media(payload: bytes, n_bytes: int, rate: int = 8000, packet: int = 4096) -> bytes:
    """Two logical streams: the samples, and notes that repeat each packet's size and checksum.

    Serial numbers come from the payload, so that equal payloads are stored alike.
    """
    serial = zlib.crc32(payload)
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    ends = [min((i + 1) * packet, len(payload)) for i in range(len(cut))]
    sound = [(_IDENT.pack(MAGIC, 1, rate, n_bytes), 0), *zip(cut, ends)]
    notes = [(NOTES, 0), *((struct.pack("<II", len(p), zlib.crc32(p)), e) for p, e in zip(cut, ends))]
    return interleave([stream_pages(serial, sound), stream_pages(serial ^ 0xFFFFFFFF, notes)])

def read_media(media: bytes | None) -> dict:
    """Payload and facts of a stored text; ``ok`` tells that every check held."""
    got = read(media or b"")
    sound = next((s for s in got.streams.values() if s.packets and s.packets[0].startswith(MAGIC)), None)
    notes = next((s for s in got.streams.values() if s.packets and s.packets[0] == NOTES), None)
    if sound is None or len(sound.packets[0]) != _IDENT.size:
        return {"payload": b"", "n_bytes": 0, "ok": False, "streams": len(got.streams), "pages": got.pages, "bad_pages": got.bad_pages, "packets": 0, "rate": 0, "duration": 0.0}
    _, _, rate, n_bytes = _IDENT.unpack(sound.packets[0])
    packets = sound.packets[1:]
    payload = b"".join(packets)
    stated = [struct.unpack("<II", p) for p in notes.packets[1:] if len(p) == 8] if notes else []
    last = max((g for g in sound.granules if g >= 0), default=0)
    ok = not got.bad_pages and not got.skipped_bytes and sound.began and sound.ended and not sound.gaps and last == len(payload) and stated == [(len(p), zlib.crc32(p)) for p in packets]
    return {"payload": payload, "n_bytes": n_bytes, "ok": ok, "streams": len(got.streams), "pages": got.pages, "bad_pages": got.bad_pages, "packets": len(packets), "rate": rate, "duration": last / rate if rate else 0.0}

def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 8000, packet: int = 4096) -> DataFrame:
    """(key, media): each text's UTF-8 bytes, padded, as an Ogg container.

    Null and empty texts become 64 zero samples; a null key stays null; repeated
    rows stay repeated. Only the two named columns are read, so other columns
    (of whatever name) are ignored. An empty table gives an empty result.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body"):
            media = [write_media(payload_of(t := x or b""), len(t), rate, packet) for x in b.column("body").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(media, pa.binary())], names=["key", "media"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(step, f"key {docs.schema[key].dataType.simpleString()}, media binary")

FEATURES = "key {0}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ok boolean"

def features(media: DataFrame, key: str = "key", column: str = "media") -> DataFrame:
    """Read stored containers back and describe them.

    ``feature`` gives streams, pages, packets, seconds from granule positions, and
    the mean absolute sample (0 where there is none). A null or unreadable
    container has an empty payload and ok = false.
    """
    import numpy as np

    kind = media.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body"):
            rows = []
            for stored in b.column("body").to_pylist():
                stored = stored or b""
                m = read_media(stored)
                p = m["payload"]
                level = float(np.frombuffer(p, np.uint8).mean()) if p else 0.0
                rows.append((m["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"streams={m['streams']};pages={m['pages']};packets={m['packets']};seconds={m['duration']:.6f};level={level:.6f};bad={m['bad_pages']}", m["ok"]))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "ok"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(list(c), t) for c, t in zip(zip(*rows), kinds))], names=["key", *names])

    return media.select(F.col(key).alias("key"), F.col(column).alias("body")).mapInArrow(step, FEATURES.format(kind))
