"""Ogg media columns: page checksums, packets from lacing values, logical streams, times from granule positions.

``demux`` reads the physical stream of one binary value: it verifies every page's checksum and sequence number,
joins packets that span pages, separates interleaved logical streams by serial number and gives each packet
the time of its granule position. ``mux`` writes streams of packets as pages dealt in turn. ``encode_column``
stores texts as 8-bit samples in a sound stream beside a comment stream; ``decode_column`` reads them back.

A null value decodes to null columns with an ``error`` of ``null``; a damaged value (bad capture pattern,
checksum, order or an unended packet) gives the error's name and null columns, and never fails the job. Empty
texts hold one frame of padding. Repeated rows and equal texts give equal media; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.textutil import documents, map_batches, raw_texts, small_batches

FRAME, FILL, RATE = 576, 255, 48000
SOUND, COMMENT = b"\x01MQU8", b"\x01MQCM"
FRAMES_IN_PACKET = 8
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    pass


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, unreflected, from 0: zlib's reflected one over bit-reversed bytes."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the packet's page if it ends there last, else -1
    pages: int = 0
    ended: bool = False


def pages_of(serial: int, packets: list[tuple[bytes, int]], page_segments: int = 255) -> list[bytes]:
    """The pages of one logical stream; packets are (bytes, granule position at their end)."""
    lacing: list[tuple[int, int]] = []  # (length, granule if a packet ends)
    for body, granule in packets:
        lacing += [(255, -1)] * (len(body) // 255) + [(len(body) % 255, granule)]
    data, at, out, open_packet = b"".join(b for b, _ in packets), 0, [], False
    # the first packet has a page of its own
    first = len(packets[0][0]) // 255 + 1
    cuts = [0, *range(first, len(lacing), page_segments), len(lacing)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = lacing[a:b]
        size = sum(x for x, _ in part)
        granule = next((g for _, g in reversed(part) if g >= 0), -1)
        flags = CONTINUED * open_packet | FIRST * (k == 0) | LAST * (b == len(lacing))
        open_packet = part[-1][0] == 255
        head = lambda crc: _HEADER.pack(b"OggS", 0, flags, granule, serial, k, crc, len(part)) + bytes([x for x, _ in part])
        body = data[at : at + size]
        at += size
        out.append(head(page_checksum(head(0) + body)) + body)
    return out


def mux(streams: list[list[bytes]]) -> bytes:
    """Pages of logical streams in one physical stream: all first pages, then the others in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def demux(media: bytes) -> dict[int, Stream]:
    streams: dict[int, Stream] = {}
    rest: dict[int, bytes] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise OggError("truncated")
        mark, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise OggError("capture")
        body = at + _HEADER.size + segments
        sizes = media[at + _HEADER.size : body]
        end = body + sum(sizes)
        if len(sizes) < segments or end > len(media):
            raise OggError("truncated")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError("checksum")
        if (flags & FIRST) != FIRST * (serial not in streams):
            raise OggError("order")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.ended or bool(flags & CONTINUED) != (serial in rest):
            raise OggError("order")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        start, before = body, len(s.packets)
        for k, size in enumerate(sizes):
            body += size
            if size < 255:
                s.packets.append(rest.pop(serial, b"") + media[start:body])
                s.granules.append(-1)
                start = body
        if start < end or (sizes and sizes[-1] == 255):
            rest[serial] = rest.get(serial, b"") + media[start:end]
        if len(s.packets) > before:
            s.granules[-1] = granule
        at = end
    if rest or not all(s.ended for s in streams.values()):
        raise OggError("unended")
    return streams


def times(granules: list[int], sizes: list[int], rate: int) -> list[float]:
    """End time in seconds of each packet: known granule positions, carried back over the packets (of ``sizes`` samples) that ended before on the same page."""
    out, known = [0.0] * len(granules), None
    for k in range(len(granules) - 1, -1, -1):
        if granules[k] >= 0 or known is None:
            known = max(granules[k], 0)
        out[k] = known / rate
        known -= sizes[k]
    return out


def encode_text(raw: bytes, rate: int = RATE) -> bytes:
    """The text, filled with bytes 255 to a positive multiple of 576, as unsigned 8-bit samples; a comment stream holds its length."""
    payload = raw + bytes([FILL]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))
    serial = zlib.crc32(payload) | 1
    size = FRAME * FRAMES_IN_PACKET
    sound = [(SOUND + struct.pack("<IHQ", rate, 1, len(payload)), 0)]
    sound += [(payload[a : a + size], min(a + size, len(payload))) for a in range(0, len(payload), size)]
    comment = [(COMMENT, 0), (b"bytes=%d" % len(raw), len(payload))]
    return mux([pages_of(serial, sound), pages_of(serial ^ 0x5A5A5A5B, comment)])


@dataclass
class Sound:
    rate: int
    payload: bytes
    n_bytes: int
    end_times: list[float]
    streams: int
    pages: int
    packets: int


def decode_media(media: bytes) -> Sound:
    streams = demux(media)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(SOUND)), None)
    comment = next((s for s in streams.values() if s.packets and s.packets[0].startswith(COMMENT)), None)
    if sound is None or comment is None:
        raise OggError("stream")
    rate, _, length = struct.unpack_from("<IHQ", sound.packets[0], len(SOUND))
    payload = b"".join(sound.packets[1:])
    if len(payload) != length or sound.granules[-1] != length:
        raise OggError("length")
    return Sound(rate, payload, int(comment.packets[1].split(b"=")[1]), times(sound.granules[1:], [len(p) for p in sound.packets[1:]], rate), len(streams), sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()))


def sound_feature(s: Sound) -> str:
    """Duration and packets from the container; level, spread and loudest packet from the samples."""
    x = np.frombuffer(s.payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    counts = np.bincount(x, minlength=256)
    square = int((counts * np.arange(256, dtype=np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    frames = x.reshape(-1, FRAME).sum(axis=1, dtype=np.int64)
    loud = int(frames.argmax())
    at = round((loud + 1) * FRAME * 1_000_000 / s.rate)
    return f"us={round(s.end_times[-1] * 1_000_000)};streams={s.streams};pages={s.pages};packets={s.packets};mean={total / n:.6f};var={square / n - (total / n) ** 2:.6f};crossings={crossings};loudest_us={at}"


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, media`` of every row."""
    small_batches(df.sparkSession, 500)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_text(x) for x in raw_texts(batch.column(1))], pa.binary())], ["id", "media"])

    return map_batches(source, encode, f"id {source.schema['id'].dataType.simpleString()}, media binary")


DECODED = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"


def decode_column(df: DataFrame, id_col: str = "id", media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """Digests and features of each row's media, and with ``with_payload`` the sound stream's bytes."""
    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"] + ["payload"] * with_payload

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (*[None] * 7, "null", *[None] * with_payload)
        try:
            s = decode_media(media)
        except (OggError, struct.error, ValueError, IndexError) as e:
            return (*[None] * 4, len(media), hashlib.sha256(media).hexdigest(), None, str(e) if isinstance(e, OggError) else "format", *[None] * with_payload)
        return (s.n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), sound_feature(s), None, *[s.payload] * with_payload)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(x) for x in batch.column(1).to_pylist()]
        cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *names])

    return map_batches(source, decode, f"id {source.schema['id'].dataType.simpleString()}, {DECODED}" + ", payload binary" * with_payload)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(encode_column(documents(spark, sf_dir))).drop("error").withColumnRenamed("id", "doc_id")
