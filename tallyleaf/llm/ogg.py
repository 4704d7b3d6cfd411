"""Media columns: 8-bit samples in Ogg.

The writer splits samples into packets, deals the packets to logical streams in turn and interleaves their pages; the
reader verifies the checksum of every page, resumes at the next capture pattern after damage, reassembles packets from
lacing values (also across pages), demultiplexes the logical streams, and derives each packet's time from the granule
positions. Page checksums (polynomial 0x04C11DB7, most significant bit first) are computed by the reflected CRC-32 of
the bit-reversed bytes.

Defined results: null and empty texts are one padded block; texts that are not a multiple of the block are padded with
bytes 255, and their length is kept beside; equal texts give equal files, as serial numbers come from the content;
a stream with a lost page gives the packets that are whole; bytes that are no Ogg give no streams. Each row is handled
alone, so repeated rows, ties and empty tables need no care. Input columns that bear a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import add_columns, read_table

BLOCK = 576
RATE = 8000
MAGIC = b"\x7fSAMPLE8"
PACKETS_PER_PAGE = 64
CONTINUED, FIRST, LAST = 1, 2, 4
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def write_pages(packets: list[tuple[bytes, int]], serial: int, per_page: int = PACKETS_PER_PAGE) -> Iterator[bytes]:
    """Pages of one logical stream from packets and the granule position at each one's end; the first packet has a page
    of its own. A packet may span pages."""
    lacing, body, granule, flags, number, held = bytearray(), [], -1, FIRST, 0, 0

    def page(last: bool, going_on: bool) -> bytes:
        nonlocal lacing, body, granule, flags, number, held
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags | (LAST if last else 0), granule, serial, number, 0, len(lacing))
        raw = head + bytes(lacing) + b"".join(body)
        raw = raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]
        lacing, body, granule, flags, number, held = bytearray(), [], -1, CONTINUED if going_on else 0, number + 1, 0
        return raw

    for k, (packet, end) in enumerate(packets):
        at, size = 0, len(packet)
        values = [255] * (size // 255) + [size % 255]
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            lacing += bytes(part)
            body.append(packet[at : at + sum(part)])
            at += sum(part)
            if values:
                yield page(False, True)
        granule, held = end, held + 1
        if k == len(packets) - 1:
            yield page(True, False)
        elif k == 0 or held == per_page or len(lacing) == 255:
            yield page(False, False)


def encode_samples(payload: bytes, tracks: int = 2) -> bytes:
    """A file of interleaved logical streams; packet i goes to stream i modulo ``tracks``."""
    base = zlib.crc32(payload)
    blocks = [payload[k : k + BLOCK] for k in range(0, len(payload), BLOCK)]
    streams = []
    for t in range(tracks):
        mine = range(t, len(blocks), tracks)
        header = MAGIC + struct.pack("<BBIQ", t, tracks, RATE, len(payload))
        packets = [(header, 0)] + [(blocks[i], (i + 1) * BLOCK) for i in mine]
        streams.append(list(write_pages(packets, (base + t) & 0xFFFFFFFF)))
    out = []
    for k in range(max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position at the packet's end, -1 unknown
    next_page: int = 0
    open: bytes | None = None


def read_streams(media: bytes) -> tuple[list[LogicalStream], int]:
    """The logical streams in order of their first pages, and the number of damaged pages."""
    streams: dict[int, LogicalStream] = {}
    at, damaged = 0, 0
    while True:
        at = media.find(b"OggS", at)
        if at < 0 or at + 27 > len(media):
            break
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        page = media[at : at + size]
        if version or len(page) < size or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged += 1
            at += 4
            continue
        at += size
        s = streams.setdefault(serial, LogicalStream(serial))
        if number != s.next_page or not flags & CONTINUED:
            s.open = None
        s.next_page = number + 1
        skip = bool(flags & CONTINUED) and s.open is None  # the packet's begin is lost
        done, start, here = [], 27 + count, 27 + count
        for value in lacing:
            here += value
            if value < 255:
                if not skip:
                    done.append((s.open or b"") + page[start:here])
                skip, s.open, start = False, None, here
        if here > start or (count and lacing[-1] == 255):
            if not skip:
                s.open = (s.open or b"") + page[start:here]
        # the granule position is that of the last packet that ends here; those before follow from their samples
        end = granule
        ends = []
        for packet in reversed(done):
            ends.append(end)
            if end >= 0:
                end -= len(packet)
        s.packets += done
        s.ends += reversed(ends)
    return list(streams.values()), damaged


@dataclass
class Samples:
    payload: bytes
    seconds: float
    tracks: int
    damaged: int
    complete: bool


def decode_samples(media: bytes) -> Samples:
    """The samples in order of their packets' times, over all logical streams."""
    streams, damaged = read_streams(media)
    pieces, total, tracks = [], 0, 0
    for s in streams:
        if not s.packets or not s.packets[0].startswith(MAGIC):
            continue
        track, tracks, _, total = struct.unpack_from("<BBIQ", s.packets[0], len(MAGIC))
        # a page holds every tracks-th block, so blocks before its last one lie further back than their own samples
        step = BLOCK * (tracks - 1)
        by_page = sorted(_times(s, step))
        pieces += by_page
    pieces.sort()
    payload = b"".join(p for _, p in pieces)
    return Samples(payload, pieces[-1][0] / RATE if pieces else 0.0, tracks, damaged, len(payload) == total and not damaged)


def _times(s: LogicalStream, step: int) -> Iterator[tuple[int, bytes]]:
    """Ends of the data packets on the common timeline, walking back from known granule positions."""
    ends = s.ends[1:]
    packets = s.packets[1:]
    known = None
    for k in range(len(packets) - 1, -1, -1):
        page_end = k == len(packets) - 1 or ends[k + 1] - len(packets[k + 1]) != ends[k]
        known = ends[k] if page_end or known is None else known - len(packets[k + 1]) - step
        yield known, packets[k]


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes (of the text) and media (the file) to every row."""

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [(v.as_py() or "").encode() for v in column]
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_samples(pad(t)) for t in texts], pa.binary())]

    return add_columns(docs, text, make, "n_bytes long, media binary")


def sample_feature(payload: bytes) -> str:
    """Mean, deviation and crossings of the middle over all samples, and the mean of each of eight sections."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return ""
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    sections = bytes(int(s.mean()) for s in np.array_split(x, 8))
    return f"mean={x.mean():.4f};dev={x.std():.4f};cross={crossings};shape={sections.hex()}"


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what is read back from the files: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    seconds, complete and feature."""

    def make(column: pa.Array) -> list[pa.Array]:
        out: list[list] = [[] for _ in range(8)]
        for v in column:
            raw = v.as_py() or b""
            s = decode_samples(raw)
            for k, value in enumerate((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), s.seconds, s.complete, sample_feature(s.payload))):
                out[k].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.string())
        return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]

    return add_columns(df, media, make, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, seconds double, complete boolean, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    return media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "complete")
