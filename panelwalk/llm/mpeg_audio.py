"""MPEG audio columns: payloads kept in Layer III frames, and a reader of such streams.

to_mpeg() writes an ID3v2 tag, a frame with a variable-bitrate table, then frames whose side information
declares silence and whose main data, which decoders skip, carry the payload: two units of 576 bytes in a
frame of 320 kbit/s, an odd last unit in one of 160 kbit/s (MPEG-1, 32 kHz, mono, with checksums).

read_mpeg() takes any bytes: it steps over ID3v2, finds the first header that a second one follows,
goes on from frame to frame by their lengths, looks for the next header where that chain breaks, verifies
the checksums of protected frames, reads Xing, Info and VBRI tables and an ID3v1 tag, and adds up exact
durations in samples and the byte place of each frame.

Defined results: a null text counts as empty and is one unit of padding; equal texts give equal values;
rows that repeat give repeated rows, there being no order or choice between them; an empty table gives none;
texts are kept whole whatever their length;
bytes without a frame give no frames and no payload; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import kept, slices, utf8

UNIT = 576
#: Bytes of text, and of streams, that a task holds at once.
MADE_AT_ONCE = 1 << 20
RATE = 32_000

# kbit/s by the index in a Layer III header, and Hz by its index, for MPEG 1, 2 and 2.5.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE = {(3, False): 32, (3, True): 17, (2, False): 17, (2, True): 9, (0, False): 17, (0, True): 9}


def _crc_table() -> list[int]:
    """CRC-16 by the polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


def _head(kbits: int) -> bytes:
    """Header, checksum and silent side information of a frame of ours: MPEG-1 Layer III, protected, mono."""
    header = bytes([0xFF, 0xFA, BITRATES[1].index(kbits) << 4 | RATES[3].index(RATE) << 2, 0xC0])
    side = bytes(SIDE[3, True])
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


def _length(kbits: int) -> int:
    return 144_000 * kbits // RATE


FULL, HALF = _head(320), _head(160)
TAG_ROOM = 10


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def to_mpeg(payload: bytes) -> bytes:
    """A stream that carries the payload, whose length is a multiple of 576."""
    units = len(payload) // UNIT
    full, odd = divmod(units, 2)
    frames = np.zeros((full, _length(320)), np.uint8)
    frames[:, : len(FULL)] = np.frombuffer(FULL, np.uint8)
    frames[:, len(FULL) : len(FULL) + 2 * UNIT] = np.frombuffer(payload, np.uint8, full * 2 * UNIT).reshape(full, 2 * UNIT)
    body = frames.tobytes()
    if odd:
        body += (HALF + payload[full * 2 * UNIT :]).ljust(_length(160), b"\0")
    table = _length(160)
    count, size = full + odd, table + len(body)
    starts = table + np.minimum(np.arange(100) * count // 100, full) * _length(320)
    toc = np.minimum(255, starts * 256 // size).astype(np.uint8).tobytes()
    xing = b"Xing" + struct.pack(">III", 7, count, size) + toc
    tag = b"TLEN" + struct.pack(">IH", len(text := b"\0" + str(count * 1152 * 1000 // RATE).encode()), 0) + text
    id3 = b"ID3\x03\0\0" + bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0)) + tag
    return id3 + (HALF + xing).ljust(table, b"\0") + body


def header(raw: bytes, at: int) -> tuple[int, int, int, int, bool, bool] | None:
    """Length of the frame, kbit/s, Hz, samples, mono, protected; None if no Layer III header is there."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[at + 1] >> 3 & 3, raw[at + 1] >> 1 & 3
    kbits_at, rate_at = raw[at + 2] >> 4, raw[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or kbits_at in (0, 15) or rate_at == 3:
        return None
    kbits, rate = BITRATES[1 if version == 3 else 2][kbits_at], RATES[version][rate_at]
    size = (144_000 if version == 3 else 72_000) * kbits // rate + (raw[at + 2] >> 1 & 1)
    return size, kbits, rate, 1152 if version == 3 else 576, raw[at + 3] >> 6 == 3, not raw[at + 1] & 1


def _follows(raw: bytes, at: int, end: int) -> bool:
    """Whether a header stands here and the next one, or the end, where it says."""
    return bool(h := header(raw, at)) and at + h[0] <= end and (at + h[0] == end or bool(header(raw, at + h[0])))


def read_mpeg(raw: bytes) -> dict:
    """Frames, table, tags, checks and payload of a stream."""
    at, end, tags = 0, len(raw), []
    if raw[:3] == b"ID3" and len(raw) >= 10:
        size = sum((raw[6 + i] & 0x7F) << s for i, s in enumerate((21, 14, 7, 0)))
        at, tags = min(end, 10 + size + 10 * (raw[5] >> 4 & 1)), ["ID3v2." + str(raw[3])]
    if end - at >= 128 and raw[end - 128 : end - 125] == b"TAG":
        end, tags = end - 128, [*tags, "ID3v1"]
    places, payload, out = [], [], {"samples": 0, "bad": 0, "checked": 0, "skipped": 0, "table": None, "table_frames": None, "bits": 0, "rate": 0}
    while at < end:
        h = header(raw, at)
        if not h or at + h[0] > end or not (places or _follows(raw, at, end)):
            new = at + 1
            while (new := raw.find(b"\xff", new, end)) >= 0 and not _follows(raw, new, end):
                new += 1
            new = end if new < 0 else new
            out["skipped"] += new - at
            at = new
            continue
        size, kbits, rate, samples, mono, protected = h
        side = at + 4 + 2 * protected
        n_side = SIDE[raw[at + 1] >> 3 & 3, mono]
        main = side + n_side
        if protected:
            out["checked"] += 1
            out["bad"] += crc16(raw[at + 2 : at + 4] + raw[side:main]) != int.from_bytes(raw[at + 4 : at + 6], "big") if raw[at + 2 : main] != FULL[2:] else 0
        name = raw[main : main + 4]
        if not places and out["table"] is None and name in (b"Xing", b"Info"):
            flags = int.from_bytes(raw[main + 4 : main + 8], "big")
            out["table"], out["table_frames"] = name.decode(), int.from_bytes(raw[main + 8 : main + 12], "big") if flags & 1 else None
            out["toc"] = raw[main + 8 + 4 * (flags & 1) + 4 * (flags >> 1 & 1) :][:100] if flags & 4 else b""
        elif not places and out["table"] is None and raw[at + 36 : at + 40] == b"VBRI":
            out["table"], out["table_frames"] = "VBRI", int.from_bytes(raw[at + 50 : at + 54], "big")
        else:
            places.append(at)
            payload.append(raw[main : min(main + (2 * UNIT if size >= main - at + 2 * UNIT else UNIT), at + size)])
            out["samples"] += samples
            out["bits"] += kbits
            out["rate"] = rate
        at += size
    return out | {"tags": tags, "places": places, "payload": b"".join(payload)}


def feature(x: dict) -> str:
    """One line: frames, exact duration, mean bitrate, table, checksums, bytes stepped over, seek places."""
    n, places = len(x["places"]), np.array(x["places"], "<u8")
    quarter = [int(places[n * i // 4]) if n else -1 for i in range(4)]
    return f"frames={n};samples={x['samples']};rate={x['rate']};kbits={x['bits'] / n if n else 0:.3f};table={x['table']}:{x['table_frames']};tags={'+'.join(x['tags'])};crc={x['checked'] - x['bad']}/{x['checked']};skipped={x['skipped']};seek={','.join(map(str, quarter))};offsets={zlib.crc32(places.tobytes()):08x}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream of every text in a binary column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=MADE_AT_ONCE):
            data, offsets = utf8(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            streams = [to_mpeg(padded(raw[a:b])) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "frame_offsets"]
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, frame_offsets array<long>"


def _described(doc_ids: pa.Array, n_bytes: pa.Array, raws: list[bytes]) -> pa.RecordBatch:
    """The columns of DESCRIBED for streams as they were stored."""
    read = [read_mpeg(r) for r in raws]
    loads = [x["payload"] for x in read]
    columns = [doc_ids, n_bytes, pa.array(map(len, loads), pa.int64()), pa.array((hashlib.sha256(p).hexdigest() for p in loads), pa.string()), pa.array((zlib.crc32(p[-32:]) for p in loads), pa.int64()), pa.array(map(len, raws), pa.int64()), pa.array((hashlib.sha256(r).hexdigest() for r in raws), pa.string()), pa.array(map(feature, read), pa.string()), pa.array((x["samples"] / x["rate"] if x["rate"] else 0.0 for x in read), pa.float64()), pa.array((x["places"] for x in read), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def described(streams: DataFrame) -> DataFrame:
    """What the bytes of the media column hold, read back from them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", MADE_AT_ONCE):
            yield _described(batch.column(0), batch.column(1), batch.column(2).to_pylist())

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(work, DESCRIBED)


def round_trip(docs: DataFrame) -> DataFrame:
    """described() of media() that was written as a table and read again."""
    return described(kept(media(docs), "media", {"parquet.block.size": 8 << 20, "compression": "zstd"}))
