"""Delay and silence along a call's way, on captures whose truth is known."""

import pytest

from callscope.operators import paths

CALLER, CALLEE, SERVER = "10.0.0.1", "10.0.0.2", "192.0.2.1"
A, B, C, D = 1, 2, 3, 4
#: Clocks of the captures, in microseconds: 0, 0.2 s and 0.1 s ahead; 10 ms on each way, 15 ms in the server.
CLOCK = {"terminal": 0, "fs": 200_000, "seat": 100_000}
AT = {("terminal", A): 0, ("fs", A): 10_000, ("fs", B): 25_000, ("seat", B): 35_000, ("seat", C): 0, ("fs", C): 10_000, ("fs", D): 25_000, ("terminal", D): 35_000}
ENDS = {A: (CALLER, SERVER), B: (SERVER, CALLEE), C: (CALLEE, SERVER), D: (SERVER, CALLER)}


def call(spark, at=None, ends=None, roles=("terminal", "fs", "seat"), direct=False, late=lambda role, ssrc, k: 0, gone=lambda role, ssrc, k: False, call_id=1, caller=CALLER):
    at, ends = AT if at is None else at, ENDS if ends is None else ends
    seen = {(r, s): t for (r, s), t in at.items() if r in roles}
    packets = [(call_id, r, s, k, 1000 * s + k, 20_000 * k + t + CLOCK[r] + late(r, s, k)) for (r, s), t in seen.items() for k in range(100) if not gone(r, s, k)]
    return (
        spark.createDataFrame([(call_id, caller, CALLEE, direct)], "call_id long, caller_ip string, callee_ip string, direct boolean"),
        spark.createDataFrame([(call_id, r, s, *ends[s], 100) for r, s in seen], "call_id long, role string, ssrc long, src_ip string, dst_ip string, packets long"),
        spark.createDataFrame(packets, "call_id long, role string, ssrc long, seq int, pkt_no long, t_us long"),
        spark.createDataFrame([(call_id, r) for r in roles], "call_id long, role string"),
    )


def measured(spark, **how):
    calls, streams, packets, _ = call(spark, **how)
    segments = {(x.direction, x.segment): x for x in paths.delay_segments(calls, streams, packets).collect()}
    ways = {x.direction: (x.verdict, x.high) for x in paths.path_delays(calls, streams, packets).collect()}
    return segments, ways, {x.device: x for x in paths.round_trips(calls, streams, packets).collect()}


def test_segments_and_round_trips_of_clocks_that_differ(spark):
    segments, ways, back = measured(spark)
    out = {k[1]: round(v.mean_ms, 3) for k, v in segments.items() if k[0] == "caller_to_callee"}
    assert out == {"up": 210, "server": 15, "down": -90}
    assert {k[1]: round(v.mean_ms, 3) for k, v in segments.items() if k[0] == "callee_to_caller"} == {"up": 110, "server": 15, "down": -190}
    assert segments["caller_to_callee", "up"].offset_ms == pytest.approx(210) and not segments["caller_to_callee", "up"].clocks_apart
    assert set(ways.values()) == {("ok", "")} and set(back) == {"caller", "callee"}
    # The clocks are gone from the sums: 10 ms there and 10 ms back.
    assert all(x.return_ms == pytest.approx(20) and x.status == "ok" for x in back.values())


def test_one_capture_measures_the_server_only(spark):
    segments, ways, back = measured(spark, roles=("fs",))
    assert {k[1]: v.status for k, v in segments.items() if k[0] == "caller_to_callee"} == {"up": "missing", "server": "ok", "down": "missing"}
    assert set(ways.values()) == {("partial", "")} and not back


def test_slow_parts_stand_out(spark):
    segments, ways, back = measured(spark, late=lambda role, ssrc, k: 400_000 * (k % 10 == 0) if (role, ssrc) == ("fs", C) else 0, gone=lambda role, ssrc, k: ssrc == B and k % 10 > 0)
    assert segments["caller_to_callee", "server"].status == "high" and ways["caller_to_callee"] == ("high", "server")
    assert segments["callee_to_caller", "up"].status == "high" and segments["callee_to_caller", "up"].spread_ms > 150
    segments, ways, back = measured(spark, late=lambda role, ssrc, k: 400_000 if role == "fs" and ssrc == A else 0)
    assert segments["caller_to_callee", "up"].clocks_apart and back["caller"].status == "high" and back["callee"].status == "ok"


def test_direct_media_is_one_segment(spark):
    at = {("terminal", A): 0, ("seat", A): 15_000, ("seat", C): 0, ("terminal", C): 15_000}
    segments, ways, back = measured(spark, at=at, ends={A: (CALLER, CALLEE), C: (CALLEE, CALLER)}, roles=("terminal", "seat"), direct=True)
    assert {(k, round(v.mean_ms, 3)) for k, v in segments.items()} == {(("caller_to_callee", "direct"), 115), (("callee_to_caller", "direct"), -85)}
    assert set(ways.values()) == {("ok", "")} and not back
    # Nothing at all to compare.
    assert measured(spark, at={("terminal", A): 0}, ends={A: (CALLER, CALLEE)}, roles=("terminal",), direct=True)[1]["caller_to_callee"][0] == "unavailable"


def silence(spark, sounds, **how):
    calls, streams, _, points = call(spark, **how)
    heard = spark.createDataFrame([(1, r, s, v) for (r, s), v in sounds.items()], "call_id long, role string, ssrc long, sound string")
    legs = {(x.direction, x.leg): x.status for x in paths.path_legs(calls, streams, points, heard).collect()}
    return {x.direction: (x.verdict, x.broken_at) for x in paths.path_silence(calls, streams, points, heard).collect()}, legs


NORMAL = dict.fromkeys(AT, "normal")
UP, BACK = "caller_to_callee", "callee_to_caller"


def without(*gone):
    return {k: v for k, v in AT.items() if k not in gone}


def test_where_sound_is_lost(spark):
    assert silence(spark, NORMAL)[0] == {UP: ("ok", ""), BACK: ("ok", "")}
    # Sent, but never at the server; at the server, but not at the listener; not passed on by the server.
    assert silence(spark, NORMAL, at=without(("fs", A)))[0][UP] == ("blocked", "up")
    assert silence(spark, NORMAL, at=without(("seat", B)))[0][UP] == ("blocked", "down")
    assert silence(spark, NORMAL, at=without(("seat", B), ("fs", B)))[0] == {UP: ("blocked", "down"), BACK: ("ok", "")}
    # The speaker's device sends nothing, or silence; the sound goes on the way.
    assert silence(spark, NORMAL, at=without(("terminal", A), ("fs", A)))[0][UP] == ("no_source", "")
    assert silence(spark, {**NORMAL, ("terminal", A): "silent", ("fs", A): "silent"})[0][UP] == ("silent_source", "")
    assert silence(spark, {**NORMAL, ("seat", B): "silent", ("fs", B): "silent"})[0] == {UP: ("silent_path", ""), BACK: ("ok", "")}
    assert silence(spark, {**NORMAL, ("fs", A): "sparse"})[0][UP] == ("ok", "")
    assert silence(spark, dict.fromkeys(AT, "unknown"))[0] == {UP: ("unknown", ""), BACK: ("unknown", "")}


def test_fewer_captures_say_less(spark):
    # From the server alone: silence there can't be laid to the device, and legs that end elsewhere aren't broken.
    got, legs = silence(spark, {**NORMAL, ("fs", A): "silent"}, roles=("fs",))
    assert got == {UP: ("silent_path", ""), BACK: ("ok", "")} and legs[BACK, "up"] == "ok"
    got, _ = silence(spark, NORMAL, at=without(("fs", B), ("seat", B)), roles=("terminal", "seat"))
    assert got[UP] == ("unknown", "")
    direct = {("terminal", A): 0, ("seat", C): 0, ("terminal", C): 1}
    ends = {A: (CALLER, CALLEE), C: (CALLEE, CALLER)}
    got, legs = silence(spark, {("terminal", A): "normal", ("seat", C): "silent"}, at=direct, ends=ends, roles=("terminal", "seat"), direct=True)
    assert got == {UP: ("blocked", "direct"), BACK: ("silent_source", "")} and set(legs.values()) == {"blocked", "silent_source"}


def test_activity_goes_by_media_time(spark):
    """A sender that is quiet sends nothing: what its clock skips is silence, but a restart isn't."""

    def stream(ssrc, packets):
        return [("fs", ssrc, (65_530 + k) % 65_536, ts % 2**32, pt, 20_000 * k, 1000 * ssrc + k, float(level)) for k, (ts, pt, level) in enumerate(packets)]

    rows = stream(1, [(160 * k, 0, 1000) for k in range(10)]) + stream(2, [(160 * k if k < 5 else 160 * k + 8000, 0, 1000) for k in range(10)])
    rows += stream(3, [(160 * k if k < 5 else 160 * k + 800_000, 0, 1000) for k in range(10)]) + stream(4, [(2**32 - 800 + 160 * k, 13 if k in (3, 4) else 0, 1000) for k in range(10)])
    rows += stream(5, [(160 * k, 0, 499) for k in range(10)]) + stream(6, [(240 * k, 0, 1000 * (k == 0)) for k in range(100)])
    rows.append(("fs", 1, 65_530, 0, 0, 900_000, 5000, 0.0))
    df = spark.createDataFrame(rows, "role string, ssrc long, seq int, rtp_ts long, pt int, t_us long, pkt_no long, level double").repartition(4)
    got = {x.ssrc: (x.packet_samples, x.speech_samples, x.media_samples, x.sound) for x in paths.activity(df).collect()}
    assert got == {
        1: (160, 1600, 1600, "normal"), 2: (160, 1600, 9600, "normal"), 3: (160, 1600, 1600, "normal"), 4: (160, 1280, 1600, "normal"), 5: (160, 0, 1600, "silent"), 6: (240, 240, 24_000, "sparse"),
    }
