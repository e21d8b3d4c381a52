"""Relay verdicts on small calls: who sends, who gets, and under which address."""

from callscope.operators import relay

SERVER, A, B, PRIVATE = "192.0.2.1", "10.0.0.1", "10.0.0.2", "192.168.1.5"


def tables(spark, streams, announced=(), agreed=(), bodies=(), callee=B):
    rows = [(1, k, *s, *((0, 40) if len(s) == 4 else ())) for k, s in enumerate(streams)]
    return (
        spark.createDataFrame([(1, A, callee)], "call_no long, caller_ip string, callee_ip string"),
        spark.createDataFrame(rows, "call_no long, stream long, src_ip string, dst_ip string, media string, packets long, start_s long, end_s long"),
        spark.createDataFrame([(1, *x) for x in announced], "call_no long, side string, ip string"),
        spark.createDataFrame([(1, *x) for x in agreed], "call_no long, side string, media string"),
        spark.createDataFrame([(1, "d", k, k, "INVITE", src, dst, body) for k, (src, dst, body) in enumerate(bodies)], "call_no long, call_id string, msg_no long, t_us long, method string, src string, dst string, body string"),
    )


BOTH = [(A, SERVER, "audio", 900), (SERVER, B, "audio", 890), (B, SERVER, "audio", 800), (SERVER, A, "audio", 795)]


def verdict(spark, *args, **how):
    (x,) = relay.relay_verdict(*tables(spark, *args, **how)).collect()
    return x.verdict, x.missing


def notes(spark, *args, **how):
    return {(x.side, x.media, x.note): (x.down, x.peer) for x in relay.relay_notes(*tables(spark, *args, **how)).collect()}


def test_verdicts(spark):
    assert verdict(spark, BOTH) == ("relayed", "") and notes(spark, BOTH) == {}
    assert verdict(spark, []) == ("no_relay", "")
    assert verdict(spark, [(SERVER, A, "audio", 5)]) == ("no_relay", "")
    assert verdict(spark, BOTH[:2]) == ("partial_uplink", "")
    assert verdict(spark, BOTH[:3]) == ("partial_downlink", "caller:audio")
    assert notes(spark, BOTH[:3]) == {("caller", "audio", "not_passed_on"): (0, 800)}
    assert verdict(spark, BOTH[:1], callee=None) == ("relayed", "")


def test_video_that_one_side_never_agreed_on_is_not_missed(spark):
    video = [*BOTH, (A, SERVER, "video", 500)]
    assert verdict(spark, video) == ("partial_downlink", "callee:video")
    agreed = [("caller", "audio"), ("caller", "video"), ("callee", "audio")]
    assert verdict(spark, video, agreed=agreed) == ("relayed", "") and notes(spark, video, agreed=agreed) == {}
    assert verdict(spark, video, agreed=[*agreed, ("callee", "video")])[0] == "partial_downlink"


def test_what_nobody_sent_comes_from_the_server(spark):
    assert notes(spark, [*BOTH, (SERVER, A, "video", 300)]) == {("caller", "video", "local_source"): (300, 0)}
    much = [(A, SERVER, "audio", 100), (SERVER, B, "audio", 401, 0, 31), (B, SERVER, "audio", 90), (SERVER, A, "audio", 90)]
    assert notes(spark, much) == {("callee", "audio", "mostly_local"): (401, 100)}
    much[1] = (SERVER, B, "audio", 401, 0, 30)
    assert notes(spark, much) == {}


def test_second_address_counts_with_its_device(spark):
    streams = [BOTH[0], (SERVER, B, "audio", 890), BOTH[2], (SERVER, PRIVATE, "audio", 795)]
    announced = [("caller", PRIVATE), ("caller", A), ("caller", SERVER), ("caller", B), ("callee", B)]
    calls, rows, said, agreed, messages = tables(spark, streams, announced)
    assert [(x.side, x.party_ip, x.alias_ip) for x in relay.aliases(calls, said).collect()] == [("caller", A, PRIVATE)]
    assert {x.side: (x.audio_up, x.audio_down) for x in relay.relay_matrix(calls, rows, said).collect()} == {"caller": (900, 795), "callee": (800, 890)}
    assert verdict(spark, streams, announced) == ("relayed", "") and verdict(spark, streams)[0] == "partial_downlink"
    assert notes(spark, streams, announced) == {("caller", "audio", "second_address"): (795, None)}


def test_media_sent_past_the_server(spark):
    body = lambda ip, port=4000: f"v=0\r\nc=IN IP4 {ip}\r\nm=audio {port} RTP/AVP 0\r\n"
    bodies = [(A, SERVER, body(A)), (SERVER, B, body(SERVER)), (SERVER, B, body("10.9.9.9")), (SERVER, B, body(A, 0)), (SERVER, A, body(B))]
    calls, rows, said, agreed, messages = tables(spark, BOTH, bodies=bodies)
    assert [(x.msg_no, x.dst, x.targets) for x in relay.media_redirects(messages, rows).collect()] == [(4, A, B)]
    assert verdict(spark, BOTH, bodies=bodies) == ("redirected", "") and verdict(spark, BOTH, bodies=bodies[:4]) == ("relayed", "")
