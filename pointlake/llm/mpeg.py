"""Media columns: MPEG audio streams that carry bytes, and their parser.

``pack`` stores a payload without loss as a Layer III stream: an ID3v2 tag, a
variable-bitrate table frame, data frames whose ancillary bytes are the payload, and
an ID3v1 tag. All side information is zero, so that a player renders silence; every
frame carries the 16-bit checksum of its header and side information. ``parse`` reads
such a stream, or any other Layer I-III one, as a player would: it skips tags,
resynchronises on frame headers (once out of step, a header counts if the next one, or
the end, follows where it says), checks checksums (Layer I: of header and bit allocation, II: of
these and the scale factor selection, III: of header and side information), reads the table, and gives the exact duration as
samples over rate and the byte offset of each frame.

Each row is on its own: no shuffle, no state. Defined cases: a null or empty text is
64 zero bytes of payload; equal texts give equal values; very long texts give more
frames; an empty table gives an empty table; input columns that clash with an output
column are replaced by it; bytes that hold no frame parse to zero frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import chunks, fresh, map_column, quoted, read_table, without

# Fixed values of the MPEG audio standard: kbit/s by version (1, or 2 and 2.5) and layer, and sample rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE, SIDE = 44100, 17  # what pack writes: MPEG-1, mono
HEADER_AND_SUM = 6


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        out.append(crc & 0xFFFF)
    return out


CRC_TABLE = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ byte]
    return crc


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    crc = crc16(data[: bits // 8], crc)
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    guarded: bool
    kbits: int
    rate: int
    padded: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 3 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbits // self.rate + self.padded) * 4
        return self.samples // 8 * 1000 * self.kbits // self.rate + self.padded

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def allocation(head: Header) -> list[int]:
    """Bits of the allocation of each subband and channel in Layers I and II."""
    if head.layer == 1:
        return [4] * 32
    each = head.kbits // (1 if head.mono else 2)
    if head.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    if head.rate == 48000 and each >= 56 or 56 <= each <= 80:
        return [4] * 11 + [3] * 12 + [2] * 4
    if head.rate != 48000 and each >= 96:
        return [4] * 11 + [3] * 12 + [2] * 7
    return [4] * 2 + [3] * (6 if head.rate != 32000 and each <= 48 else 10)


def guarded_bits(body: bytes, head: Header, mode: int) -> int | None:
    """How many bits of ``body``, what follows the checksum of Layer I or II, it covers; None if they are not all there. ``mode``: the header's last byte."""
    bound = 4 * ((mode >> 4 & 3) + 1) if mode >> 6 == 1 else 32  # joint stereo: one allocation for both from there on
    at, selections, value, size = 0, 0, int.from_bytes(body, "big"), 8 * len(body)
    for band, bits in enumerate(allocation(head)):
        for _ in range(1 if head.mono or band >= bound else 2):
            if at + bits > size:
                return None
            if value >> (size - at - bits) & ((1 << bits) - 1):
                selections += 1 if head.mono or band < bound else 2
            at += bits
    at += 2 * selections if head.layer == 2 else 0
    return at if at <= size else None


_HEADERS: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none."""
    if four not in _HEADERS:
        if len(_HEADERS) > 1 << 16:
            _HEADERS.clear()
        _HEADERS[four] = _header(four)
    return _HEADERS[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    kbits = BITRATES[1 if version == 3 else 2, layer][bitrate]
    return Header(version, layer, not four[1] & 1, kbits, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)


@dataclass
class Stream:
    """What a stream holds; the duration is exactly samples / rate seconds."""

    rate: int = 0
    samples: int = 0
    frames: list[tuple[int, int]] = field(default_factory=list)  # offset and size, table frame not counted
    kbits: list[int] = field(default_factory=list)
    bad_sums: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int | bytes | list[int]] = field(default_factory=dict)

    def seek(self, seconds: float) -> int:
        """Offset of the frame that plays at a time."""
        per = self.samples // len(self.frames)
        return self.frames[min(len(self.frames) - 1, max(0, int(seconds * self.rate / per)))][0]


def _frame_bytes(kbits_index: int, padded: int, body: bytes) -> bytes:
    head = bytes([0xFF, 0xFA, kbits_index << 4 | padded << 1, 0xC0])
    guard = struct.pack(">H", crc16(head[2:] + bytes(SIDE)))
    return head + guard + bytes(SIDE) + body


def _room(kbits_index: int) -> int:
    return 144_000 * BITRATES[1, 3][kbits_index] // RATE - HEADER_AND_SUM - SIDE


_ROOMS = {i: _room(i) for i in range(1, 15)}
_HEADS = {i: _frame_bytes(i, 0, b"") for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pack(payload: bytes) -> bytes:
    """``payload`` as a stream; the tag holds its length, so that the last frame's filling is known."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i, room in _ROOMS.items() if room >= left), 14)
        body = payload[at : at + _ROOMS[index]]
        frames.append(_HEADS[index] + body + bytes(_ROOMS[index] - len(body)))
        at += len(body)
    text = b"\x03payload-bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame
    total = sum(map(len, frames))
    room, starts, size = _ROOMS[9], [], 0
    whole = HEADER_AND_SUM + SIDE + room
    for f in frames:
        starts.append(whole + size)
        size += len(f)
    toc = bytes(min(255, 256 * (starts[len(frames) * i // 100] if frames else 0) // (whole + total)) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), whole + total) + toc
    first = _HEADS[9] + table + bytes(room - len(table))
    return tag + first + b"".join(frames) + b"TAG" + b"payload".ljust(125, b"\x00")


def _tag(data: bytes, at: int, out: Stream) -> int:
    """Past an ID3v2 tag at ``at``; its text frames go to ``out``."""
    size = sum(b << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
    end = min(len(data), at + 10 + size + (10 if data[at + 5] & 0x10 else 0))
    major, p = data[at + 3], at + 10
    while p + 10 <= end and data[p : p + 4].isalnum():
        raw = data[p + 4 : p + 8]
        n = sum(b << s for b, s in zip(raw, (21, 14, 7, 0))) if major >= 4 else int.from_bytes(raw, "big")
        if data[p : p + 1] == b"T" and n > 1:
            body = data[p + 11 : p + 10 + n]
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[p + 10], "utf-8")
            out.tags[data[p : p + 4].decode()] = body.decode(coding, "replace")
        p += 10 + n
    return end


def _table(frame: bytes, head: Header) -> dict[str, int | bytes | list[int]]:
    """The Xing, Info or VBRI table of a frame, if it has one."""
    for at in (4 + head.side, 4 + 2 * head.guarded + head.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out: dict[str, int | bytes | list[int]] = {"kind": 1 if frame[at : at + 4] == b"Xing" else 2}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw = frame[p : p + size]
                    out[name] = raw if name == "toc" else int.from_bytes(raw, "big")
                    p += size
            return out
    if frame[36:40] == b"VBRI":
        entries, scale, size, per = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58, 60))
        seeks = [scale * int.from_bytes(frame[i : i + size], "big") for i in range(62, min(62 + entries * size, len(frame) - size + 1), size)] if size else []
        return {"kind": 3, "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "per": per, "seeks": seeks}
    return {}


def parse(data: bytes) -> Stream:
    out, at, end, known = Stream(), 0, len(data), {}
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    first, synced = True, False
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3":
            at = _tag(data, at, out)
            continue
        head = header(data[at : at + 4])
        after = at + head.size if head else 0
        locked = head and after <= end and (synced or after == end or header(data[after : after + 4]) is not None or data[after : after + 3] in (b"ID3", b"TAG"))
        if not locked or head.size < 4 + 2 * head.guarded + head.side:
            found = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, found if found >= 0 else end)
            nxt = tag if tag >= 0 else found if found >= 0 else end
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        if head.guarded and head.layer != 3:
            body = data[at + 6 : min(after, at + 6 + 64)]  # more than allocation and selection take
            bits = guarded_bits(body, head, data[at + 3])
            right = bits is not None and crc16_bits(body, bits, crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.bad_sums += not right
        elif head.guarded:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
            if covered not in known:
                known[covered] = crc16(covered)
            out.bad_sums += known[covered] != int.from_bytes(data[at + 4 : at + 6], "big")
        if first and (table := _table(data[at:after], head)):
            out.table = table
        else:
            out.frames.append((at, head.size))
            out.kbits.append(head.kbits)
            out.samples += head.samples
        out.rate = out.rate or head.rate
        first, synced = False, True
        at = after
    out.skipped += max(0, end - at)
    return out


def unpack(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload that ``pack`` stored: the frames' ancillary bytes, as many as the tag says."""
    stream = stream or parse(data)
    own = HEADER_AND_SUM + SIDE
    length = int(stream.tags["TXXX"].split("\x00", 1)[1])
    return b"".join(data[at + own : at + size] for at, size in stream.frames)[:length]


def feature(s: Stream) -> str:
    """One line: exact duration, frames, bitrates, table agreement, checksums, seek offsets."""
    seeks = ",".join(str(s.frames[len(s.frames) * i // 4][0]) for i in range(4)) if s.frames else ""
    mean = sum(s.kbits) // len(s.kbits) if s.kbits else 0
    agree = s.table.get("frames") == len(s.frames)
    return f"duration={s.samples}/{s.rate};frames={len(s.frames)};kbits={min(s.kbits, default=0)}-{mean}-{max(s.kbits, default=0)};table={int(agree)};bad_sums={s.bad_sums};skipped={s.skipped};seek={seeks}"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def with_audio(df: DataFrame, text_col: str = "text", out: str = "audio") -> DataFrame:
    """``df`` with a binary column of streams that hold the texts' payloads."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            media = [pack(payload_of(t)[1]) for texts in chunks(batch) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(media, pa.binary())], ["media"])

    made = fresh(df, "media")
    rest = [quoted(c) for c in df.columns if c.lower() != out.lower()]
    return map_column(df, text_col, run, "media binary", made).select(*rest, F.col(made)["media"].alias(out))


PARSED = "rate int, samples long, frame_offsets array<long>, kbits array<int>, bad_sums int, skipped long, tags map<string,string>, payload binary"


def parsed(df: DataFrame, audio_col: str = "audio", out: str = "stream") -> DataFrame:
    """``df`` with a struct of what each stream holds; null for null."""

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        s = parse(data)
        own = unpack(data, s) if "payload-bytes" in s.tags.get("TXXX", "") else None
        return {"rate": s.rate, "samples": s.samples, "frame_offsets": [a for a, _ in s.frames], "kbits": s.kbits, "bad_sums": s.bad_sums, "skipped": s.skipped, "tags": list(s.tags.items()), "payload": own}

    kind = pa.struct([("rate", pa.int32()), ("samples", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("kbits", pa.list_(pa.int32())), ("bad_sums", pa.int32()), ("skipped", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([one(x.as_py()) for x in batch], kind)

    made = fresh(df, "stream")
    rest = [quoted(c) for c in df.columns if c.lower() != out.lower()]
    return map_column(df, audio_col, run, PARSED, made).select(*rest, F.col(made).alias(out))


DIGESTS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def digests(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with what is read back from each text's stream, hashed where it is made."""

    def one(text: str) -> tuple:
        n, payload = payload_of(text)
        media = pack(payload)
        stream = parse(media)
        back = unpack(media, stream)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [one(t) for texts in chunks(batch) for t in texts]
            columns = zip(*rows) if rows else [[] for _ in DIGESTS]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, DIGESTS.values())], list(DIGESTS))

    made = fresh(df, "media")
    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rest = [quoted(c) for c in df.columns if c.lower() not in DIGESTS]
    return map_column(df, text_col, run, ddl, made).select(*rest, *[F.col(made)[c].alias(c) for c in DIGESTS])


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(digests(read_table(spark, sf_dir, "documents").select("doc_id", "text")), ["text"])
