"""Offer and answer rounds, leg roles and announced addresses on small dialogs, and against a plain fold."""

import random

from callscope.operators import negotiation

COLUMNS = "call_no long, call_id string, t_us long, msg_no long, method string, cseq int, src string, dst string, body string"
SERVER, A, B = "192.0.2.1", "10.0.0.1", "10.0.0.2"
NAMES = {"PCMU": "0", "PCMA": "8", "G722": "9", "OPUS": "96", "SPEEX": "98"}


def sdp(audio="", video="", addr=A, port=4000):
    maps = {"OPUS": "a=rtpmap:96 opus/48000/2", "SPEEX": "a=rtpmap:98 SPEEX/16000"}
    lines = ["v=0", f"c=IN IP4 {addr}"]
    if audio:
        lines += [f"m=audio {port} RTP/AVP {' '.join(NAMES[a] for a in audio.split())} 101", *(maps[a] for a in audio.split() if a in maps), "a=rtpmap:101 telephone-event/8000"]
    if video:
        names = video.split()
        lines += [f"m=video {port + 2} RTP/AVP {' '.join(str(110 + k) for k in range(len(names)))}", *(f"a=rtpmap:{110 + k} {v}/90000" for k, v in enumerate(names))]
    return "\r\n".join(lines) + "\r\n"


def dialog(spark, *messages, src=A, dst=SERVER):
    rows = [(1, "d", k, 0, m[0], m[1], src, dst, m[2] if len(m) > 2 else "") for k, m in enumerate(messages)]
    df = negotiation.negotiation(spark.createDataFrame(rows, COLUMNS))
    return {x.media: x for x in df.collect()}


ALL, SUBSET = sdp("PCMU PCMA G722", "H264 H265"), sdp("PCMA G722", "H264", B, 6000)


def test_early_answer_keeps_the_order_of_the_offer(spark):
    got = dialog(spark, ("INVITE", 1, ALL), ("183", 1, SUBSET), ("200", 1, sdp("G722 PCMA", "H264", B, 6100)), ("BYE", 2))
    assert got["audio"].codecs == "PCMA/8000,G722/8000" and got["video"].codecs == "H264/90000"
    assert (got["audio"].answered, got["audio"].rounds, got["audio"].cseq) == (True, 1, 1)
    assert (got["audio"].offered_at, got["audio"].answered_at, got["video"].answered_at) == (f"{A}:4000", f"{B}:6100", f"{B}:6102")


def test_slow_start_and_declined_video(spark):
    got = dialog(spark, ("INVITE", 1), ("200", 1, ALL), ("ACK", 1, sdp("OPUS")))
    assert (got["audio"].codecs, got["video"].codecs, got["audio"].answered) == ("OPUS/48000", "", True)
    got = dialog(spark, ("INVITE", 1), ("200", 1, ALL), ("ACK", 1, sdp("G722")))
    assert (got["audio"].codecs, got["video"].codecs) == ("G722/8000", "")


def test_no_answer_leaves_candidates(spark):
    got = dialog(spark, ("INVITE", 1, ALL), ("486", 1))
    assert (got["audio"].codecs, got["video"].codecs, got["audio"].answered) == ("PCMU/8000,PCMA/8000,G722/8000", "H264/90000,H265/90000", False)
    got = dialog(spark, ("INVITE", 1), ("BYE", 2))
    assert (got["audio"].codecs, got["video"].codecs, got["audio"].answered, got["audio"].cseq, got["audio"].rounds) == ("", "", False, None, 0)


def test_the_last_complete_round_holds(spark):
    renewed = (("INVITE", 1, ALL), ("200", 1, SUBSET), ("INVITE", 2, sdp("OPUS PCMU")), ("200", 2, sdp("PCMU")), ("INVITE", 3, sdp("SPEEX")), ("491", 3))
    got = dialog(spark, *renewed)
    assert (got["audio"].codecs, got["video"].codecs, got["audio"].cseq, got["audio"].rounds) == ("PCMU/8000", "", 2, 2)
    # A description without known names, as of a server that lists dynamic types only, opens no round.
    got = dialog(spark, ("INVITE", 1, sdp("OPUS SPEEX")), ("INVITE", 20, "v=0\r\nm=audio 9 RTP/AVP 97\r\n"), ("183", 1, sdp("PCMU", "H264")))
    assert (got["audio"].codecs, got["video"].codecs) == ("PCMU/8000", "H264/90000")
    # An answer of another transaction is none, and rates that differ are other codecs.
    assert dialog(spark, ("INVITE", 1, ALL), ("200", 7, SUBSET))["audio"].answered is False
    wide = sdp("OPUS").replace("48000/2", "16000")
    assert dialog(spark, ("INVITE", 1, sdp("OPUS")), ("200", 1, wide))["audio"].codecs == "OPUS/16000"


def test_held_and_rejected_media_announce_nothing(spark):
    got = dialog(spark, ("INVITE", 1, sdp("PCMU", addr="0.0.0.0")), ("200", 1, sdp("PCMU", port=0)))
    assert (got["audio"].codecs, got["audio"].offered_at, got["audio"].answered_at) == ("PCMU/8000", "", "")


def rounds_by_hand(messages):
    """The plain fold over a dialog's descriptions: (answered, cseq, rounds, offer, answer)."""
    done = pending = last = None
    n = 0
    for method, cseq, body in messages:
        if not body:
            continue
        if method == "INVITE":
            pending = (cseq, body)
        elif method.isdigit() or method == "ACK":
            if pending and pending[0] == cseq:
                done, last, pending, n = (pending[1], body), pending, None, n + 1
            elif method != "ACK" and not pending:
                if last and last[0] == cseq:
                    done = (last[1], body)
                else:
                    pending = (cseq, body)
    if done:
        return (True, last[0], n, *done)
    return (False, pending[0], 0, pending[1], None) if pending else None


def test_random_dialogs_of_any_length(spark):
    """One dialog holds a third of all messages; rows come in any order."""
    r = random.Random(3)
    sizes = [r.randint(1, 9) for _ in range(200)] + [500]
    dialogs = {f"c{k}": [(r.choice(["INVITE", "180", "183", "200", "200", "ACK", "BYE"]), r.randint(1, 3), r.choice(["", sdp(r.choice(["PCMU", "PCMA PCMU", "OPUS"]), port=4000 + j)])) for j in range(n)] for k, n in enumerate(sizes)}
    rows = [(1, c, k, 0, *m[:2], A, SERVER, m[2]) for c, ms in dialogs.items() for k, m in enumerate(ms)]
    r.shuffle(rows)
    got = {x.call_id: tuple(x)[1:] for x in negotiation.dialog_rounds(spark.createDataFrame(rows, COLUMNS)).collect()}
    expected = {c: rounds_by_hand(ms) for c, ms in dialogs.items()}
    assert got == {c: v for c, v in expected.items() if v}


def test_roles_and_codec_path(spark):
    def call(no, caller_body, callee_body, fork=None):
        rows = [(no, f"{no}a", 0, 0, "INVITE", 1, A, SERVER, caller_body), (no, f"{no}a", 9, 0, "200", 1, SERVER, A, caller_body)]
        rows += [(no, f"{no}b", 2, 0, "INVITE", 1, SERVER, B, fork or callee_body)]
        rows += [(no, f"{no}c", 3, 0, "INVITE", 1, SERVER, B, callee_body), (no, f"{no}c", 5, 0, "200", 1, B, SERVER, callee_body)]
        return rows

    rows = call(1, sdp("PCMU PCMA"), sdp("PCMA")) + call(2, sdp("OPUS"), sdp("PCMA"), fork=sdp("OPUS")) + call(3, sdp("PCMU", "H264"), sdp("PCMU", "H265")) + call(4, sdp("PCMU", "H264"), sdp("PCMU"))
    rows += [(5, "5x", 4, 0, "INVITE", 1, A, B, sdp("PCMU")), (5, "5y", 3, 0, "INVITE", 1, B, A, sdp("PCMU")), (5, "5z", 1, 0, "BYE", 1, B, A, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    roles = {x.call_id: x.role for x in negotiation.leg_roles(df).collect()}
    assert roles == {**{f"{n}{k}": "caller" if k == "a" else "callee" for n in range(1, 5) for k in "abc"}, "5x": "callee", "5y": "caller", "5z": "callee"}
    got = {x.call_no: x for x in negotiation.codec_path(df).collect()}
    assert {k: v.verdict for k, v in got.items()} == {1: "same", 2: "transcode", 3: "transcode", 4: "same", 5: "same"}
    assert got[2].callee == "2c" and got[1].common == "audio:PCMA/8000" and got[3].common == "audio:PCMU/8000 video:"


def test_evidence(spark):
    packets = [("fs", ssrc, k, 160 * k, pt, 20_000 * k, 100 * ssrc + k) for ssrc, pt in ((1, 0), (2, 96), (3, 96), (4, 111), (5, 97)) for k in range(10)]
    packets = spark.createDataFrame(packets, "role string, ssrc long, seq int, rtp_ts long, pt int, t_us long, pkt_no long")
    ends = [(1, 4000), (2, 4000), (3, 4002), (4, 1), (5, 2)]
    streams = spark.createDataFrame([("fs", s, A, p, SERVER, 7) for s, p in ends], "role string, ssrc long, src_ip string, sport int, dst_ip string, dport int")
    bodies = [sdp("PCMU OPUS", "H264 H265"), sdp("PCMU", addr=B, port=4000)]
    messages = spark.createDataFrame([(1, "d", k, 0, "INVITE", 1, A, SERVER, b) for k, b in enumerate(bodies)], COLUMNS)
    got = {x.ssrc: x for x in negotiation.endpoint_evidence(packets, streams, messages).collect()}
    assert {s: (x.audio_hits, x.video_hits, x.kind) for s, x in got.items()} == {1: (1, 0, "audio"), 2: (1, 0, "audio"), 3: (0, 1, "video"), 4: (0, 0, "video"), 5: (0, 0, None)}
    kinds = {x.ssrc: (x.kind, x.codec) for x in negotiation.stream_media(packets, streams, messages).collect()}
    assert kinds == {1: ("audio", "PCMU"), 2: ("audio", "OPUS"), 3: ("video", None), 4: ("video", "H265"), 5: ("audio", None)}
