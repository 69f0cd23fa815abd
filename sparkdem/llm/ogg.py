"""Media columns as Ogg: pages with checksums, packets from lacing values, logical streams and timestamps.

Fixed values of the container: the capture pattern, the 27-byte page header, at most 255 lacing values a page, lacing
value 255 for a packet that goes on, the flags 1 (continued), 2 (first page) and 4 (last page), granule position -1 for
a page on which no packet ends, and a CRC of polynomial 0x04C11DB7 that starts at zero and isn't inverted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdem.llm.common import arrow_map

HEADER = struct.Struct("<4sBBqIIIB")
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: The samples' stream and the notes' stream of each file; samples a second; samples in a packet.
SAMPLES, NOTES, RATE, PACKET = 1, 2, 8000, 4000
#: Fixed value: how the first packet of the samples' stream begins.
IDENT = struct.Struct("<8sIQQ")
SIGN = b"\x00rawpcm8"


def page_checksum(page: bytes) -> int:
    """The container's CRC, by way of the mirrored CRC that zlib has: mirror the bytes, start at zero, mirror the result."""
    mirrored = zlib.crc32(page.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRRORED), "big")


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule position up to which it belongs, page) of a logical stream of (packet, granule position at its end)."""
    lacing: list[tuple[int, int]] = []  # (lacing value, granule position if a packet ends here, else -1)
    for data, granule in packets:
        lacing += [(255, -1)] * (len(data) // 255) + [(len(data) % 255, granule)]
    body, pages, at = b"".join(p for p, _ in packets), [], 0
    # the first packet has a page of its own, as the container asks
    first = len(packets[0][0]) // 255 + 1 if packets else 0
    groups = [lacing[:first], *(lacing[i : i + 255] for i in range(first, len(lacing), 255))]
    reached, open_packet, groups = 0, False, [g for g in groups if g]
    for number, group in enumerate(groups):
        values = bytes(v for v, _ in group)
        ended = [g for _, g in group if g >= 0]
        flags = open_packet * 1 | (number == 0) * 2 | (number == len(groups) - 1) * 4
        size = sum(values)
        head = HEADER.pack(b"OggS", 0, flags, ended[-1] if ended else -1, serial, number, 0, len(values))
        page = head + values + body[at : at + size]
        page = page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]
        reached = ended[-1] if ended else reached
        pages.append((reached, page))
        at += size
        open_packet = values[-1] == 255
    return pages


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """A file of two logical streams: the payload as 8-bit samples, and a note for each second of them."""
    samples = [(IDENT.pack(SIGN, RATE, n_bytes, len(payload)), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    notes = [(b"\x00notes", 0)] + [(b"second %d" % (i // RATE), i) for i in range(0, len(payload), RATE)]
    a, b = pages_of(samples, SAMPLES), pages_of(notes, NOTES)
    merged = a[:1] + b[:1] + [x for _, x in sorted(enumerate(a[1:] + b[1:]), key=lambda x: (x[1][0], x[0]))]
    return b"".join(p for _, p in merged)


def read_ogg(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """{serial: [(packet, granule position of the page on which it ends)]}; ValueError where a page is damaged or missing."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    rest: dict[int, bytes] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        values = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(values)
        page = media[at:end]
        if version or len(values) < n or end > len(media) or page_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        if number != numbers.get(serial, -1) + 1 or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(rest.get(serial)) or serial in ended:
            raise ValueError(f"stream {serial}: a page is missing before byte {at}")
        numbers[serial] = number
        packets = streams.setdefault(serial, [])
        spot, piece = at + 27 + n, rest.pop(serial, b"")
        for v in values:
            piece += media[spot : spot + v]
            spot += v
            if v < 255:
                packets.append((piece, granule))
                piece = b""
        if values and values[-1] == 255:
            rest[serial] = piece
        if flags & 4:
            ended.add(serial)
        at = end
    if rest or ended != set(streams):
        raise ValueError("a stream doesn't end")
    return streams


def payload_of(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled up with zeros to a positive multiple of unit, and their number before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(1, -(-len(data) // unit)) * unit - len(data)), len(data)


def features(samples: np.ndarray, stamps: list[float]) -> str:
    """Mean, spread, share of zero crossings and seconds of the samples, and the largest time between packets."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    gap = max(b - a for a, b in zip([0.0, *stamps], stamps)) if stamps else 0.0
    return f"mean={x.mean():.6f} std={x.std():.6f} crossings={crossings} seconds={len(x) / RATE:.6f} packets={len(stamps)} gap={gap:.6f}"


def ends_of(packets: list[tuple[bytes, int]]) -> list[int]:
    """The granule position at the end of each packet of samples. A page tells it for the last packet that ends there; those
    before it on the page end earlier by the samples that follow. ValueError where a page doesn't begin where the last ended."""
    ends, at, page = [], 0, []
    for i, (data, granule) in enumerate(packets):
        page.append(len(data))
        if i + 1 == len(packets) or packets[i + 1][1] != granule:
            if granule - sum(page) != at:
                raise ValueError(f"a page of {sum(page)} samples goes from {at} to {granule}")
            back = granule - np.cumsum(page[::-1])[::-1]
            ends += [*back[1:].tolist(), granule]
            at, page = granule, []
    return ends


def check_notes(packets: list[tuple[bytes, int]]) -> None:
    """ValueError where the last note of a page isn't of the second that the page's granule position names."""
    for i, (data, granule) in enumerate(packets):
        if (i + 1 == len(packets) or packets[i + 1][1] != granule) and data != b"second %d" % (granule // RATE):
            raise ValueError(f"a note of {data!r} at {granule}")


def parsed(media: bytes | None) -> tuple:
    """n_bytes, payload, streams, seconds, stamps, feature and error of one medium."""
    try:
        streams = read_ogg(media or b"")
        packets = streams[SAMPLES]
        sign, rate, n, size = IDENT.unpack(packets[0][0])
        payload = b"".join(p for p, _ in packets[1:])
        if sign != SIGN or len(payload) != size or packets[-1][1] != size:
            raise ValueError("the samples aren't those that the head names")
        stamps = [end / rate for end in ends_of(packets[1:])]
        check_notes(streams[NOTES][1:])
        return n, payload, len(streams), size / rate, stamps, features(np.frombuffer(payload, np.uint8), stamps), None
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media (Ogg, binary) of every row. Null and empty texts are 64 zero samples; equal texts give equal bytes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.column(0), [write_ogg(*payload_of(t.as_py())) for t in part.column(1)]

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, media binary")


def from_media(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Reads a media column back: id, n_bytes, payload (binary), streams, seconds, stamps (end of each packet), feature,
    error, and the medium's own media_bytes and media_sha256.

    A null, damaged or foreign medium gives a row with error set and the other columns null; the job goes on.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [parsed(m.as_py()) for m in part.column(1)]
                media = [m.as_py() or b"" for m in part.column(1)]
                yield part.column(0), *([r[k] for r in rows] for k in range(7)), [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media]

    schema = "id long, n_bytes long, payload binary, streams int, seconds double, stamps array<double>, feature string, error string, media_bytes long, media_sha256 string"
    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), run, schema)
