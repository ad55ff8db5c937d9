"""Media columns in the Ogg container: writing, checking, demultiplexing and timing.

A text's bytes, filled with blanks to a positive multiple of UNIT, are 8-bit samples of one logical stream; a second
stream describes it. The stored bytes are read back page by page: every checksum is verified, packets are put together
from lacing values (also across pages), pages are told apart by serial number, and times follow from granule positions.

Null text counts as empty and gives one unit of blanks; equal texts give equal bytes; a very long text becomes many
pages of at most 255 segments; rows repeat as they come; an empty table gives an empty result; other columns of the
input are not carried. Bytes that are no valid stream give a row whose `error` says why, and nulls; so do chained
streams, which begin again after their last pages. Times are those of page ends, as granule positions tell no others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

UNIT, PACKET_UNITS, RATE = 192, 20, 8000
SAMPLES, NOTES = 1, 2
#: Fixed values of the container: page header, and the flags of its type byte.
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
CHECKSUM_AT = 22
HEAD = struct.Struct("<8sIIQ")
MAGIC = b"MRPCM8\0\0"
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7, highest bit first, no inversion. It is zlib's CRC of the
    bit-reversed bytes, reversed, with zlib's inversions undone."""
    x = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(REVERSED), "big")


def pages(serial: int, packets: list[tuple[bytes, int]], sequence: int = 0, first: bool = False, last: bool = False) -> list[bytes]:
    """Pages that hold the packets; each packet comes with the granule position at its end."""
    segments = []  # (length, granule where a packet ends)
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        segments += [(255, None)] * full + [(rest, granule)]
    body, out, at, goes_on = b"".join(p for p, _ in packets), [], 0, False
    for i in range(0, len(segments), 255):
        part = segments[i : i + 255]
        ends = [g for _, g in part if g is not None]
        size = sum(n for n, _ in part)
        kind = CONTINUED * goes_on | FIRST * (first and not i) | LAST * (last and i + 255 >= len(segments))
        head = PAGE.pack(b"OggS", 0, kind, ends[-1] if ends else -1, serial, sequence, 0, len(part)) + bytes(n for n, _ in part)
        page = head + body[at : at + size]
        out.append(page[:CHECKSUM_AT] + checksum(page).to_bytes(4, "little") + page[CHECKSUM_AT + 4 :])
        at, sequence, goes_on = at + size, sequence + 1, part[-1][1] is None
    return out


def write_ogg(data: bytes) -> bytes:
    """The container of a text's bytes: both streams begin, the notes follow, then the samples."""
    payload = data + b" " * (-len(data) % UNIT or (0 if data else UNIT))
    size, packets = UNIT * PACKET_UNITS, []
    for i in range(0, len(payload), size):
        packets.append((payload[i : i + size], min(i + size, len(payload))))
    notes = json.dumps({"bits": 8, "unit": UNIT}, sort_keys=True).encode()
    begin = pages(SAMPLES, [(HEAD.pack(MAGIC, RATE, UNIT, len(data)), 0)], first=True) + pages(NOTES, [(b"MRNOTES\0", 0)], first=True)
    return b"".join(begin + pages(NOTES, [(notes, 0)], 1, last=True) + pages(SAMPLES, packets, 1, last=True))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets complete by then) of each page that ends a packet.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def read_ogg(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError where the bytes are damaged or incomplete."""
    streams: dict[int, Stream] = {}
    view, at = memoryview(media), 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise OggError("truncated page header")
        magic, version, kind, granule, serial, sequence, check, count = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one must begin")
        lacing = media[at + PAGE.size : at + PAGE.size + count]
        begin = at + PAGE.size + count
        end = begin + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("truncated page")
        if checksum(b"".join((view[at : at + CHECKSUM_AT], b"\0\0\0\0", view[at + CHECKSUM_AT + 4 : end]))) != check:
            raise OggError("wrong page checksum")
        if bool(kind & FIRST) != (serial not in streams):
            raise OggError("a stream begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if sequence != s.pages or s.ended or bool(kind & CONTINUED) != bool(s.open):
            raise OggError("a page is missing")
        s.pages, s.ended = s.pages + 1, bool(kind & LAST)
        start = begin
        for value in lacing:
            begin += value
            if value < 255:
                s.packets.append(b"".join((*s.open, view[start:begin])))
                s.open, start = [], begin
        if start < begin or (count and lacing[-1] == 255):
            s.open.append(bytes(view[start:begin]))
        if granule >= 0:
            s.marks.append((granule, len(s.packets)))
        at = end
    if not streams or any(not s.ended or s.open for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def packet_times(s: Stream, rate: int) -> list[float]:
    """Seconds at the end of each page that completes a packet."""
    return [granule / rate for granule, _ in s.marks]


@dataclass
class Samples:
    payload: bytes
    n_bytes: int
    feature: str


def read_samples(media: bytes) -> Samples:
    """Payload, unfilled length and features of the stored bytes."""
    streams = read_ogg(media)
    found = [s for s in streams.values() if s.packets[0][: len(MAGIC)] == MAGIC]
    if len(found) != 1:
        raise OggError("not one stream of samples")
    s = found[0]
    _, rate, unit, n_bytes = HEAD.unpack(s.packets[0])
    payload = b"".join(s.packets[1:])
    if s.marks[-1][0] != len(payload) or len(payload) % unit or not n_bytes <= len(payload):
        raise OggError("the last granule position is not the number of samples")
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    levels = np.arange(256)
    total, power = int(counts @ levels), int(counts @ (levels * levels))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    times = packet_times(s, rate)
    feature = f"streams={len(streams)};pages={sum(t.pages for t in streams.values())};packets={len(s.packets) - 1};ms={round(times[-1] * 1000)};mean={total // len(x)};power={power // len(x)};crossings={crossings};peak={int(x.max())}"
    return Samples(payload, n_bytes, feature)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id and the container of each whole text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _parts(batch):
                yield pa.RecordBatch.from_arrays([keys, pa.array([write_ogg(t.as_buffer().to_pybytes()) for t in texts], pa.binary())], ["doc_id", "media"])

    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")), write, "doc_id long, media binary")


def _parts(batch: pa.RecordBatch, size: int = 1 << 24) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of a batch's rows of about `size` bytes."""
    ends = np.cumsum([len(x.as_buffer()) for x in batch.column(1)]) if batch.num_rows else np.zeros(0)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
        start = stop


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_features(stored: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, for every row of (doc_id, media)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = value.as_buffer().to_pybytes() if value.is_valid else b""
                sizes = (len(media), hashlib.sha256(media).hexdigest())
                try:
                    s = read_samples(media)
                    rows.append((key, s.n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), *sizes, s.feature, None))
                except (OggError, IndexError, struct.error) as wrong:
                    rows.append((key, None, None, None, None, *sizes, None, str(wrong)))
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 3
            names = [c.split(" ")[0] for c in RESULT.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return common.map_batches(stored.select("doc_id", "media"), read, RESULT)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.saved(with_media(common.documents(spark, sf_dir)), "ogg-media", compression="zstd")
    return media_features(stored).drop("error")
