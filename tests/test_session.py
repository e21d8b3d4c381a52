"""Captures to problems: bytes of three captures of two calls in, problems out."""

import struct

import numpy as np
import pytest
from test_captures import encode, ethernet, rtp, speech

from callscope.plans import session

SERVER, CALLER, CALLEE, OTHER = "192.0.2.1", "10.0.0.1", "10.0.0.2", "10.0.0.9"
START = 1_700_000_000


def capture(events):
    """A classic capture file of (seconds, frame)."""
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, frame in sorted(events):
        us = round(t * 1e6)
        out += struct.pack("<IIII", START + us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame
    return out


def sip(line, call_id, cseq, method, src, dst, body=""):
    head = [line, "Via: SIP/2.0/UDP x", f"From: <sip:a@{CALLER}>", f"To: <sip:b@{CALLEE}>", f"Call-ID: {call_id}", f"CSeq: {cseq} {method}", f"Content-Length: {len(body)}"]
    return ethernet(("\r\n".join(head) + "\r\n\r\n" + body).encode(), src=src, dst=dst, sport=5060, dport=5060)


def offer(addr, port):
    return f"v=0\r\nc=IN IP4 {addr}\r\nm=audio {port} RTP/AVP 0\r\n"


def dialog(call_id, a, b, spot_a, spot_b, start, end):
    """Signalling of one leg between a and b, as seen by whoever captures it."""
    request = lambda m, n, body="": sip(f"{m} sip:x SIP/2.0", call_id, n, m, a, b, body)
    return [(start, request("INVITE", 1, offer(*spot_a))), (start + 1, sip("SIP/2.0 200 OK", call_id, 1, "INVITE", b, a, offer(*spot_b))), (start + 1.1, request("ACK", 1)), (end, request("BYE", 2))]


def stream(ssrc, src, dst, sport, dport, start, n, body, first=0, drop=()):
    return [(start + 0.02 * k, ethernet(rtp(first + k, 160 * k, body(k), ssrc=ssrc), src=src, dst=dst, sport=sport, dport=dport)) for k in range(n) if k not in drop]


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    """Call 1: both ways, captured three times; the callee's device sends silence and the caller's stream loses packets on its way.
    Call 2, at the same time through the same server: another device, whose media the server never passes on."""
    top, n = tmp_path_factory.mktemp("captures"), 400
    quiet = lambda k: bytes([0xFF]) * 160
    spoken = encode(np.clip(speech(10), -32000, 32000))
    say = lambda k: spoken[160 * k : 160 * k + 160]
    lost = set(range(60, 90)) | {200, 201}
    out = {r: [] for r in ("terminal", "fs", "seat")}
    for role, late in (("terminal", 0), ("fs", 0.21)):
        out[role] += stream(1, CALLER, SERVER, 4000, 20000, 10 + late, n, say, drop=lost if role == "fs" else ())
        out[role] += stream(4, SERVER, CALLER, 20000, 4000, 10.04 + late, n, quiet)
        out[role] += [(t + late, f) for t, f in dialog("one-a", CALLER, SERVER, (CALLER, 4000), (SERVER, 20000), 5, 18.3)]
    for role, late in (("fs", 0.2), ("seat", 0.11)):
        out[role] += stream(2, SERVER, CALLEE, 20002, 6000, 10.03 + late, n, say, drop=lost)
        out[role] += stream(3, CALLEE, SERVER, 6000, 20002, 10 + late, n, quiet)
        out[role] += [(t + late, f) for t, f in dialog("one-b", SERVER, CALLEE, (SERVER, 20002), (CALLEE, 6000), 6, 18.4)]
    out["fs"] += stream(9, OTHER, SERVER, 7000, 20100, 11, 500, say, first=65_400)
    out["fs"] += dialog("two", OTHER, SERVER, (OTHER, 7000), (SERVER, 20100), 7, 21.2)
    for role, events in out.items():
        (top / f"{role}.pcap").write_bytes(capture(events))
    return top


def test_from_captures_to_problems(spark, captures):
    files = spark.createDataFrame([(1, r, f"{captures}/{r}.pcap") for r in ("terminal", "fs", "seat")] + [(2, "fs", f"{captures}/none.pcap")], "session_id long, role string, path string")
    frames = session.frames_of(spark, files, str(captures))
    calls, evidence, found = session.analyse(frames)
    calls = {x.caller_ip: x for x in calls.collect()}
    assert set(calls) == {CALLER, OTHER} and calls[CALLER].callee_ip == CALLEE and not calls[CALLER].direct
    assert (calls[CALLER].dialogs, calls[OTHER].dialogs) == (2, 1) and calls[CALLER].start_s == START + 10
    one, two = calls[CALLER].call_id, calls[OTHER].call_id
    rows = evidence.collect()
    assert {x.check_name for x in rows if x.call_id == one} == {"loss", "jitter", "order", "continuity", "codec", "quality", "silence", "server", "chain", "roundtrip"}
    loss = {x.subject: (x.n, x.value) for x in rows if x.check_name == "loss"}
    assert loss["terminal 0x00000001"][0] == 0 and loss["fs 0x00000001"][0] == 32 and loss["fs 0x00000009"][0] == 0
    assert {x.subject: x.verdict for x in rows if x.check_name == "silence" and x.call_id == one} == {"caller_to_callee": "ok", "callee_to_caller": "silent_source"}
    assert {x.subject: x.verdict for x in rows if x.check_name == "roundtrip"} == {"caller": "ok", "callee": "ok"}
    got = {(x.call_id, x.problem): (x.severity, x.place) for x in found.where("media = 'audio'").collect()}
    assert got[one, "one_way_audio"] == ("critical", 1) and got[one, "loss_artifact"][0] == "critical" and got[one, "narrowband"][0] == "info"
    assert (two, "loss_artifact") not in got and (two, "narrowband") in got
    assert {m for m, in found.select("media").distinct().collect()} == {"audio"}
