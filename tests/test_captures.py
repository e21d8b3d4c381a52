"""Capture files built byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.functions import scalars
from callscope.functions.media_headers import control_packets, rtcp_events, rtp_packets
from callscope.functions.sip_messages import sdp_codecs, sdp_endpoints, sip_events
from callscope.operators import media
from callscope.sources import pcap


def ethernet(payload, src="10.0.0.1", dst="192.0.2.1", sport=4000, dport=5000, vlan=False, fragment=None, ident=1):
    udp = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    flags, body = (0, udp) if fragment is None else (fragment[0], udp[fragment[1]])
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), ident, flags, 64, 17, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + body


def rtp(seq, ts, body, pt=0, ssrc=7, first=0x80):
    return struct.pack(">BBHII", first, pt, seq % 65536, ts % 2**32, ssrc) + body


def classic(frames, order="<", magic=0xA1B2C3D4, per=1, cut=0, snap=65535):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, 1)
    for k, f in enumerate(frames):
        kept = f[:snap]
        out += struct.pack(order + "IIII", 1700000000 + k // 50, (k % 50) * 20000 * per, len(kept), len(f)) + kept
    return out[: len(out) - cut]


def blocks(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 100) + struct.pack("<HHBxxxHH", 9, 1, 9, 0, 0))
    for k, f in enumerate(frames):
        t = (1700000000 * 1000 + 20 * k) * 1_000_000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


FRAMES = [ethernet(rtp(65530 + k, 160 * k, bytes([255]) * 160), vlan=k % 2 == 1) for k in range(50)]


@pytest.mark.parametrize("name,data", [("le", classic(FRAMES)), ("be", classic(FRAMES, ">")), ("ns", classic(FRAMES, magic=0xA1B23C4D, per=1000)), ("ng", blocks(FRAMES))])
def test_formats(spark, tmp_path, name, data):
    (tmp_path / f"{name}.pcap").write_bytes(data)
    pcap.register(spark)
    for df in (spark.read.format("pcap").load(str(tmp_path)), pcap.read_captures(spark, str(tmp_path))):
        rows = rtp_packets(df).orderBy("pkt_no").collect()
        assert len(rows) == 50
        assert [r.seq for r in rows] == [(65530 + k) % 65536 for k in range(50)]
        assert rows[1].t_us - rows[0].t_us == 20000 and rows[0].ssrc == 7 and len(rows[0].body) == 160


def test_fragments_and_extension(spark, tmp_path):
    whole = rtp(1, 160, b"x" * 100, first=0x90)[:12] + struct.pack(">HH", 0xBEDE, 1) + b"abcd" + b"x" * 100
    parts = [ethernet(whole, fragment=(0x2000, slice(0, 64))), ethernet(whole, fragment=(8, slice(64, None)))]
    (tmp_path / "a.pcap").write_bytes(classic(parts[::-1]))
    (row,) = rtp_packets(pcap.read_captures(spark, str(tmp_path))).collect()
    assert bytes(row.body) == b"x" * 100


def test_integrity(spark, tmp_path):
    (tmp_path / "ok.pcap").write_bytes(classic(FRAMES))
    (tmp_path / "cut.pcap").write_bytes(classic(FRAMES, cut=30))
    (tmp_path / "snap.pcap").write_bytes(classic(FRAMES, snap=100))
    (tmp_path / "other.bin").write_bytes(b"nothing of the kind")
    rows = {r.path.rsplit("/", 1)[1]: r for r in pcap.integrity(spark, str(tmp_path)).collect()}
    assert (rows["ok.pcap"].records, rows["ok.pcap"].truncated, rows["ok.pcap"].tail_incomplete) == (50, 0, False)
    assert rows["cut.pcap"].tail_incomplete and rows["snap.pcap"].truncated == 50 and not rows["other.bin"].supported


def test_control(spark, tmp_path):
    report = struct.pack(">IIIIII", 9, (64 << 24) | 5, 1000, 3, 0, 0)
    sr = struct.pack(">BBHI5I", 0x81, 200, 12, 7, 1, 2, 3, 4, 5) + report
    nack = struct.pack(">BBHIIHH", 0x81, 205, 3, 7, 9, 100, 0b101)
    rows = control_packets(sr + nack)
    assert [r[0] for r in rows] == ["SR", "NACK"] and rows[1][8] == 3
    assert rows[0][9][0]["fraction_pct"] == 25.0 and rows[0][9][0]["lost"] == 5
    (tmp_path / "a.pcap").write_bytes(classic([ethernet(sr + nack)]))
    assert rtcp_events(pcap.read_captures(spark, str(tmp_path))).count() == 2


def test_signalling(spark, tmp_path):
    sdp = "v=0\r\nc=IN IP4 10.0.0.9\r\nm=audio 4000 RTP/AVP 0 96 101\r\na=rtpmap:96 opus/48000/2\r\na=rtpmap:101 telephone-event/8000\r\nm=video 0 RTP/AVP 97\r\n"
    text = f'INVITE sip:b@x SIP/2.0\r\nVia: a\r\nv: b\r\nFrom: "Ann" <sip:a@10.0.0.1>;tag=1\r\nTo: <tel:+4912>\r\ni: id1\r\nCSeq: 5 INVITE\r\n\r\n{sdp}'
    answer = "SIP/2.0 200 OK\r\nCall-ID: id1\r\nCSeq: 5 INVITE\r\n\r\n"
    (tmp_path / "a.pcap").write_bytes(classic([ethernet(t.encode(), sport=5060) for t in (text, answer, "OPTIONS sip:b@x SIP/2.0\r\nCSeq: 1 OPTIONS\r\n\r\n")]))
    events = sip_events(pcap.read_captures(spark, str(tmp_path)))
    rows = events.orderBy("frame_no").collect()
    assert [(r.method, r.call_id, r.cseq) for r in rows] == [("INVITE", "id1", 5), ("200", "id1", 5)]
    assert rows[0].via_count == 2 and rows[0].from_hdr.name == "Ann" and rows[0].from_hdr.user == "a" and rows[0].to_hdr.user == "+4912"
    assert [(r.kind, r.addr, r.port) for r in sdp_endpoints(events).collect()] == [("audio", "10.0.0.9", 4000)]
    assert [(r.kind, r.pt, r.name, r.rate) for r in sdp_codecs(events).where("kind = 'audio'").orderBy("place").collect()] == [("audio", 0, "PCMU", 8000), ("audio", 96, "OPUS", 48000)]


def test_g711():
    u, a = media.ulaw_table(), media.alaw_table()
    assert (u[0xFF], u[0x7F], u[0x00], u[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x80], a[0x00]) == (8, -8, 5504, -5504)


def encode(x):
    table = media.ulaw_table().astype(np.int32)
    order = np.argsort(table, kind="stable")
    at = np.clip(np.searchsorted(table[order], x), 0, 255)
    return order[at].astype(np.uint8).tobytes()


def speech(seconds, seed=1):
    r = np.random.default_rng(seed)
    n = int(seconds * 8000)
    loud = np.repeat(r.uniform(0, 1, n // 1600 + 1) > 0.5, 1600)[:n]
    return r.normal(0, 3000, n) * loud


@pytest.mark.parametrize("kind,x", [
    ("clean", speech(4)),
    ("howling", 8000 * np.sin(2 * np.pi * 1000 * np.arange(16000) / 8000)),
    ("hum", 6000 * np.sin(2 * np.pi * 100 * np.arange(16000) / 8000)),
    ("silent", np.zeros(16000)),
])
def test_audio(spark, tmp_path, kind, x):
    data = encode(np.clip(x, -32000, 32000))
    frames = [ethernet(rtp(k, 160 * k, data[160 * k : 160 * k + 160])) for k in range(len(data) // 160)]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    packets = rtp_packets(pcap.read_captures(spark, str(tmp_path)))
    (row,) = media.audio_quality(packets).collect()
    assert row.verdict == {"howling": "bad", "hum": "bad"}.get(kind, kind)
    if kind in ("howling", "hum"):
        assert row[kind] >= 1
    (wav,) = media.rebuilt_audio(packets).collect()
    assert len(wav.wav) == 44 + 2 * 160 * len(frames)


def test_video(spark, tmp_path):
    key = bytes([0x65]) + bytes(range(200))
    pieces = [key[1:][k : k + 40] for k in range(0, 200, 40)]
    fua = [bytes([0x7C, (0x80 if k == 0 else 0) | (0x40 if k == 4 else 0) | 5]) + p for k, p in enumerate(pieces)]
    for name, bodies in (("whole", [b"\x67abc", *fua, b"\x41def"]), ("hole", [b"\x67abc", *fua[:2], None, *fua[3:], b"\x41def"])):
        frames = [ethernet(rtp(k, 3000, b, pt=96)) for k, b in enumerate(bodies) if b]
        (tmp_path / f"{name}.pcap").write_bytes(classic(frames))
    packets = rtp_packets(pcap.read_captures(spark, str(tmp_path)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in media.video_quality(packets).collect()}
    assert (rows["whole.pcap"].verdict, rows["whole.pcap"].key_frames, rows["whole.pcap"].broken) == ("clean", 1, 0)
    assert (rows["hole.pcap"].verdict, rows["hole.pcap"].lost, rows["hole.pcap"].broken) == ("broken", 1, 1)
    out = {r.path.rsplit("/", 1)[1]: bytes(r.h264) for r in media.rebuilt_video(packets).collect()}
    assert out["whole.pcap"] == b"\0\0\0\1\x67abc\0\0\0\1" + key + b"\0\0\0\1\x41def"


def test_ogg(spark, tmp_path):
    from callscope.sources import ogg

    frames = [ethernet(rtp(k, 960 * k, bytes([k % 251]) * (300 if k % 7 == 0 else 40), pt=111)) for k in range(400)]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    (row,) = ogg.rebuilt_opus(rtp_packets(pcap.read_captures(spark, str(tmp_path))), [111]).collect()
    data, at, packets, granules = bytes(row.ogg), 0, [], []
    while at < len(data):
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        whole = data[at : at + size]
        assert ogg.checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == struct.unpack("<I", whole[22:26])[0]
        granules.append(struct.unpack("<q", whole[6:14])[0])
        body, packet = whole[27 + n :], b""
        for x in lacing:
            packet, body = packet + body[:x], body[x:]
            if x < 255:
                packets.append(packet)
                packet = b""
        at += size
    assert packets[0].startswith(b"OpusHead") and packets[1].startswith(b"OpusTags")
    assert [len(p) for p in packets[2:]] == [300 if k % 7 == 0 else 40 for k in range(400)]
    assert granules[-1] == 960 * 400 and granules == sorted(granules)


def test_offsets_are_no_hum_and_video_is_no_audio():
    steady = np.full(16000, 2000, np.int16)
    mag, rms = media.spectra(steady)
    assert media.hums(mag, rms) == [] and media.tones(mag, rms) == []
    hum = (3000 * np.sin(2 * np.pi * 50 * np.arange(16000) / 8000)).astype(np.int16)
    assert len(media.hums(*media.spectra(hum))) == 1


def test_audio_of_decoded_types_only(spark):
    rows = [("f", s, k, k, 160 * k, pt, bytes([k % 256] * 160)) for s, pt in ((1, 0), (2, 8), (3, 96), (4, 111)) for k in range(30)]
    df = spark.createDataFrame(rows, "path string, ssrc long, pkt_no long, seq int, rtp_ts long, pt int, body binary")
    assert sorted(r.ssrc for r in media.audio_quality(df).collect()) == [1, 2]


def test_role_names(spark):
    names = ["FS", " Terminal", "caller", "主叫", "zuoxi", "被叫", "seat", "server", None]
    got = [r.x for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.canonical_role(F.col("n")).alias("x")).collect()]
    assert got == ["fs", "terminal", "terminal", "terminal", "seat", "seat", "seat", "server", None]
