"""Media columns: Ogg.

One physical stream per row, of two multiplexed logical ones. The sound stream opens with a packet MAGIC, version, rate
and number of samples; each further packet holds up to PACKET unsigned 8-bit samples, and a page's granule position is the
number of samples that its packets complete, so that position / rate is a time. The notes stream opens with NOTES and
holds one packet, the number of bytes before padding. Reading verifies every page's checksum, reassembles packets from
the lacing values (over pages, too), parts the logical streams by serial number, and derives times from granules.

Edge cases: a null or empty text is one block of 64 zero bytes; equal texts give equal bytes; a page whose checksum, or
place in its stream, is wrong raises in read(), and in scan() is skipped and counted; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.common import map_arrow, table, texts

MAGIC, NOTES = b"HSPCM8\0\1", b"HSNOTE\0\1"
RATE, PACKET, PAD = 8000, 4096, 64
#: Flags of a page header.
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, highest bit first, from 0 and not inverted: zlib's, with bits reversed on both sides."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """A logical stream's pages: the first packet on one of its own, then as many lacing values as go on each."""
    number = 0

    def run(some: list[tuple[bytes, int]], flags: int, last: bool) -> Iterator[bytes]:
        nonlocal number
        lacing, body, granule, flags_now = bytearray(), bytearray(), -1, flags
        for k, (data, g) in enumerate(some):
            at, values = 0, bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
            while values:
                if len(lacing) == 255:
                    yield _page(flags_now, granule, serial, number, bytes(lacing), bytes(body))
                    number, lacing, body, granule = number + 1, bytearray(), bytearray(), -1
                    flags_now = CONTINUED if at else 0
                now = values[: 255 - len(lacing)]
                size = sum(now)
                lacing += now
                body += data[at : at + size]
                at, values = at + size, values[len(now) :]
            granule = g
            if k == len(some) - 1:
                yield _page(flags_now | (LAST if last else 0), granule, serial, number, bytes(lacing), bytes(body))
                number += 1

    yield from run(packets[:1], FIRST, len(packets) == 1)
    if packets[1:]:
        yield from run(packets[1:], 0, True)


def write(payload: bytes, n_bytes: int) -> bytes:
    serial = zlib.crc32(payload)
    sound = [(MAGIC + struct.pack("<IQ", RATE, len(payload)), 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    first, *rest = pages(serial, sound)
    opening, *more = pages((serial + 1) & 0xFFFFFFFF, [(NOTES, 0), (struct.pack("<Q", n_bytes), len(payload))])
    return b"".join([first, opening, *rest[:1], *more, *rest[1:]])


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # the granule position known after each packet; -1: none
    pages: int = 0
    closed: bool = False
    part: bytearray | None = None


def scan(data: bytes, strict: bool = False) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the number of damaged or missing pages passed over."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while at < len(data):
        good = data[at : at + 4] == b"OggS" and len(data) >= at + 27
        if good:
            _, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + segments]
            body_at = at + 27 + segments
            end = body_at + sum(lacing)
            page = data[at:end]
            good = version == 0 and len(lacing) == segments and end <= len(data) and checksum(page[:22] + b"\0\0\0\0" + page[26:]) == crc
        if not good:
            if strict:
                raise ValueError(f"damaged page at byte {at}")
            bad += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.get(serial)
        if s is None:
            s = streams[serial] = Stream(serial)
            if strict and not flags & FIRST:
                raise ValueError(f"stream {serial} lacks its first page")
        if number != s.pages:
            if strict:
                raise ValueError(f"stream {serial}: page {number} where {s.pages} is due")
            bad, s.part = bad + abs(number - s.pages), None
        s.pages, s.closed = number + 1, bool(flags & LAST)
        if not flags & CONTINUED:
            s.part = bytearray()
        where, done = body_at, len(s.packets)
        for value in lacing:
            if s.part is not None:
                s.part += data[where : where + value]
            where += value
            if value < 255:
                if s.part is not None:
                    s.packets.append(bytes(s.part))
                    s.ends.append(-1)
                s.part = bytearray()
        if len(s.packets) > done:
            s.ends[-1] = granule
        at = end
    if strict and any(not s.closed for s in streams.values()):
        raise ValueError("a stream lacks its last page")
    return streams, bad


def read(data: bytes) -> dict:
    """payload, n_bytes, rate, seconds, and counts of streams, pages and packets; raises on any damage."""
    streams, _ = scan(data, strict=True)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(MAGIC)), None)
    notes = next((s for s in streams.values() if s.packets and s.packets[0] == NOTES), None)
    if sound is None or notes is None:
        raise ValueError("a stream is missing")
    rate, samples = struct.unpack_from("<IQ", sound.packets[0], len(MAGIC))
    payload = b"".join(sound.packets[1:])
    if len(payload) != samples or sound.ends[-1] != samples:
        raise ValueError("the granule position and the samples differ")
    return {"payload": payload, "n_bytes": struct.unpack("<Q", notes.packets[1])[0], "rate": rate, "seconds": sound.ends[-1] / rate, "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values())}


def loudness(payload: bytes) -> tuple[float, float, float]:
    """Mean, root mean square around the middle, and crossings of the middle per sample."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    return float(x.mean()), float(np.sqrt(np.mean(x.astype(np.int32) ** 2))), float(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)) / len(x))


def encode(df: DataFrame) -> DataFrame:
    """doc_id, media: each row's text as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                out.append(write(raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "media"])

    return map_arrow(texts(df), run, "doc_id long, media binary")


def decode(df: DataFrame) -> DataFrame:
    """What read() gives for each row's media, and the sound's features."""
    kinds = "doc_id long, media binary, payload binary, n_bytes long, rate int, seconds double, streams int, pages int, packets int, mean double, rms double, crossings double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = read(media)
                rows.append({"doc_id": doc, "media": media, **got} | dict(zip(("mean", "rms", "crossings"), loudness(got["payload"]), strict=True)))
            types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64()}
            names = [x.split() for x in kinds.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in names], [n for n, _ in names])

    return map_arrow(df.select("doc_id", "media"), run, kinds)


def op4_ogg(spark, sf_dir: str) -> DataFrame:
    x = decode(encode(table(spark, sf_dir, "documents")))
    return x.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("streams=%d pages=%d packets=%d seconds=%.6f mean=%.6f rms=%.6f crossings=%.6f", "streams", "pages", "packets", "seconds", "mean", "rms", "crossings").alias("feature"),
    )
