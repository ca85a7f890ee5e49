import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pointlake.llm import mpeg

SF = "/root/testdata/sf0.01"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=5000))
def test_any_bytes_come_back(data):
    media = mpeg.pack(data)
    s = mpeg.parse(media)
    assert mpeg.unpack(media, s) == data
    assert s.bad_sums == 0 and s.skipped == 0 and s.samples == 1152 * len(s.frames)
    if data:
        assert s.table["frames"] == len(s.frames)


def test_checksum_of_a_known_message():
    assert mpeg.crc16(b"123456789", 0) == 0xFEE8  # the 0x8005 polynomial, not reflected
    assert mpeg.crc16(b"123456789") == 0xAEE7


def test_resynchronises_and_finds_damage():
    media = mpeg.pack(b"payload " * 2000)
    clean = mpeg.parse(media)
    noisy = b"junk\xff\xfbjunk" + media[: clean.frames[2][0]] + b"\xff\xe0noise" + media[clean.frames[2][0] :]
    s = mpeg.parse(noisy)
    assert s.skipped == 17 and [size for _, size in s.frames] == [size for _, size in clean.frames]
    hurt = bytearray(media)
    hurt[clean.frames[1][0] + 7] ^= 1
    assert mpeg.parse(bytes(hurt)).bad_sums == 1
    assert s.seek(1e9) == s.frames[-1][0] and s.seek(0) == s.frames[0][0]
    assert mpeg.parse(b"").frames == [] and mpeg.parse(b"\xff" * 50).frames == []


def test_sizes_of_other_layers():
    layer2 = mpeg.header(bytes([0xFF, 0xFD, 0x80, 0x00]))  # MPEG-1 layer II, 128 kbit/s, 44.1 kHz
    assert (layer2.layer, layer2.kbits, layer2.size, layer2.samples) == (2, 128, 417, 1152)
    layer1 = mpeg.header(bytes([0xFF, 0xFF, 0x40, 0x00]))
    assert (layer1.layer, layer1.kbits, layer1.size, layer1.samples) == (1, 128, 136, 384)
    low = mpeg.header(bytes([0xFF, 0xF3, 0x84, 0xC0]))  # MPEG-2 layer III, 64 kbit/s, 24 kHz, mono
    assert (low.layer, low.kbits, low.rate, low.size, low.samples, low.side) == (3, 64, 24000, 192, 576, 9)


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, "", "z"), (2, "a" * 64, "z"), (3, "é" * 100_000, "z")], "doc_id long, text string, Feature string")
    out = {r.doc_id: r for r in mpeg.digests(df).collect()}
    assert mpeg.digests(df).columns[:2] == ["doc_id", "text"] and out[1].payload_bytes == 64 and out[2].payload_bytes == 64 and out[3].n_bytes == 200_000
    back = mpeg.parsed(mpeg.with_audio(df)).collect()
    assert [bytes(r.stream.payload) for r in back] == [mpeg.payload_of(r.text or "")[1] for r in back]
    assert mpeg.parsed(spark.createDataFrame([(None,)], "audio binary")).first().stream is None
    assert mpeg.digests(df.limit(0)).count() == 0


def test_whole_table(spark):
    got = {r.doc_id: r for r in mpeg.op8_mpeg_audio(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert "bad_sums=0;skipped=0" in r.feature and "table=1" in r.feature


def plain_sum(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ int(b) else 0)
    return crc


def guarded_frame(head, covered):
    """A frame of the header with the bits that its checksum covers, the rest zeros."""
    bits = "".join(f"{b:08b}" for b in head[2:]) + covered
    body = int(covered.ljust(-(-len(covered) // 8) * 8, "0"), 2).to_bytes(-(-len(covered) // 8), "big")
    return (head + plain_sum(bits).to_bytes(2, "big") + body).ljust(mpeg.header(head).size, b"\0")


def test_sums_of_layers_one_and_two():
    one = guarded_frame(bytes([0xFF, 0xFE, 0x80, 0x00]), "0101" * 64)  # stereo
    joint = guarded_frame(bytes([0xFF, 0xFE, 0x80, 0x50]), "0011" * (8 * 2 + 24))  # one allocation from band 8 on
    # Layer II, 192 kbit/s, 44.1 kHz, stereo: 30 bands; the first has an allocation in both channels, so two selections
    two = guarded_frame(bytes([0xFF, 0xFC, 0xA0, 0x00]), "0001" * 2 + "0" * (4 * 20 + 3 * 24 + 2 * 14) + "1001")
    for frame, last in ((one, 37), (joint, 25), (two, 29)):
        assert mpeg.parse(frame * 3).bad_sums == 0 and len(mpeg.parse(frame * 3).frames) == 3
        for at in (6, last):
            bad = bytearray(frame)
            bad[at] ^= 0x40
            assert mpeg.parse(frame + bytes(bad) + frame).bad_sums == 1


def test_vbri_seek_entries():
    frame = bytearray(mpeg._HEADS[9] + bytes(mpeg._ROOMS[9]))
    frame[36 : 36 + 32] = b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (3, 2, 2, 5, 10, 20, 30))
    assert mpeg._table(bytes(frame), mpeg.header(bytes(frame[:4]))) == {"kind": 3, "bytes": 900, "frames": 7, "per": 5, "seeks": [20, 40, 60]}
