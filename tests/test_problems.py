"""Gates over evidence: each kind of problem, its severity and priority, and what is merely not known."""

import pytest

from callscope.operators import problems
from callscope.plans.registry import QUERIES

COLUMNS = "call_id long, media string, subject string, check_name string, verdict string, level string, value double, n long, backward long, duplicates long"


def row(check, media="audio", subject="s1", verdict=None, level=None, value=None, n=None, backward=None, duplicates=None, call=1):
    return (call, media, subject, check, verdict, level, value, n, backward, duplicates)


def found(spark, *rows):
    df = spark.createDataFrame(list(rows), COLUMNS)
    return {(x.media, x.problem): x for x in problems.call_problems(df).collect()}


def facts(x):
    return x.severity, x.priority, x.checks, x.subjects, x.findings


def test_one_way_audio_comes_first(spark):
    got = found(spark, row("silence", None, "caller to callee", "blocked"), row("silence", None, "callee to caller", "ok"), row("order", backward=2, duplicates=0))
    assert facts(got["audio", "one_way_audio"]) == ("critical", 0, "silence", 1, 1)
    assert got["audio", "one_way_audio"].place == 1 and got["audio", "clock_anomaly"].place == 2
    assert found(spark, row("silence", None, verdict="silent_path"))["audio", "one_way_audio"].severity == "warning"
    got = found(spark, row("relay", None, verdict="partial_downlink"))
    assert set(got) == {("audio", "one_way_audio")}
    assert set(found(spark, row("relay", None, verdict="redirected"))) == {("audio", "one_way_audio"), ("video", "no_video")}
    assert not found(spark, row("relay", None, verdict="relayed"), row("relay", None, verdict="insufficient"))


def test_loss_from_two_checks_is_one_problem(spark):
    got = found(spark, row("loss", value=5.0, n=50), row("reports", value=5.0), row("loss", subject="s2", value=0.4, n=3))
    assert set(got) == {("audio", "loss_artifact")} and facts(got["audio", "loss_artifact"]) == ("critical", 1, "loss,reports", 2, 3)
    assert facts(found(spark, row("reports", value=2.1))["audio", "loss_artifact"])[:2] == ("warning", 2)
    assert not found(spark, row("reports", value=2.0), row("loss", value=0.0, n=0))


@pytest.mark.parametrize("media", ["audio", "video"])
def test_findings_in_media(spark, media):
    kinds = problems.MEDIA_FINDINGS[media]
    got = found(spark, *(row("quality", media, verdict=k, level="warning") for k in kinds), row("quality", media, verdict="prompt_tone", level="info"), row("quality", media, verdict="rtp_ok"))
    assert {p for _, p in got} == set(kinds.values()) and {x.severity for x in got.values()} == {"warning"}
    assert found(spark, row("quality", "audio", verdict="hum"))["audio", "buzz"].severity == "info"


def test_clocks_delays_and_codecs(spark):
    got = found(spark, row("continuity", n=3, value=400.0, backward=1, duplicates=2), row("server", None, value=60.0, n=10), row("jitter", value=10.0), row("codec", verdict="G.711 PCMU"), row("codec", verdict="OPUS"))
    assert {(p, x.severity, x.priority) for (m, p), x in got.items() if m == "audio"} == {
        ("dropouts", "critical", 1), ("clock_anomaly", "critical", 2), ("dup_audio", "warning", 2), ("latency", "critical", 1), ("narrowband", "info", 3)
    }
    assert {(p, x.priority) for (m, p), x in got.items() if m == "video"} == {("video_latency", 1)}
    assert [found(spark, row("continuity", n=1, value=v, backward=0, duplicates=0))["audio", "dropouts"].severity for v in (49.0, 50.0)] == ["info", "warning"]
    assert found(spark, row("chain", verdict="high"), row("roundtrip", verdict="high"))["audio", "latency"].checks == "chain,roundtrip"
    assert not found(spark, row("server", None, value=60.0, n=0), row("chain", verdict="ok"), row("jitter", value=None))


def test_pictures(spark):
    assert facts(found(spark, row("pair", None, "a to b", "unseen"))["video", "no_video"])[:2] == ("critical", 0)
    # Media that is sent elsewhere explains what one side doesn't see.
    assert found(spark, row("pair", None, "a to b", "unseen"), row("relay", None, verdict="redirected"))["video", "no_video"].checks == "relay"
    got = found(spark, row("nack", "video", n=4), row("reports", "video", value=0.6), row("key_requests", "video", n=3), row("frames", "video", value=9.0, n=100), row("order", "video", backward=1, duplicates=5))
    assert {(p, x.severity, x.priority) for (_, p), x in got.items()} == {("video_loss", "warning", 2), ("keyframe_issue", "warning", 1), ("low_fps", "warning", 2), ("video_clock_anomaly", "critical", 1)}
    assert not found(spark, row("key_requests", "video", n=2), row("frames", "video", value=9.0, n=99), row("frames", "video", value=15.0, n=500), row("nack", "video", n=0))
    assert found(spark, row("frames", "video", value=14.0, n=500))["video", "low_fps"].priority == 3
    # The same loss isn't told twice: a stream whose media was looked into has it there.
    assert found(spark, row("loss", "video", value=2.0, n=9))["video", "video_loss"].severity == "critical"
    assert not found(spark, row("loss", "video", value=2.0, n=9), row("quality", "video", verdict="rtp_ok"))


def test_what_is_known(spark):
    rows = [row("loss", value=0.0, n=0), row("relay", None, verdict="no_relay"), row("jitter", "video", value=1.0), row("codec", verdict="PCMA", call=2)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(x.call_id, x.problem): x.state for x in problems.problem_states(df).collect()}
    assert len(got) == 2 * sum(len(v) for k in (problems.PROBLEMS, problems.UNOBSERVABLE) for v in k.values())
    wanted = {(1, "one_way_audio"): "found", (1, "no_video"): "found", (1, "loss_artifact"): "clear", (1, "video_loss"): "unchecked", (1, "video_latency"): "clear", (1, "latency"): "unchecked", (2, "narrowband"): "found", (2, "one_way_audio"): "unchecked", (1, "wind_noise"): "unobservable"}
    assert {k: got[k] for k in wanted} == wanted
    worst = {(x.call_id, x.media): (x.problems, x.remarks, x.worst) for x in problems.summaries(df).collect()}
    assert worst == {(1, "audio"): (1, 0, "one_way_audio"), (1, "video"): (1, 0, "no_video"), (2, "audio"): (0, 1, None)}


def test_gates_and_tables_agree():
    assert {(g.media, g.problem) for g in problems.GATES} == {(m, p) for m, ps in problems.PROBLEMS.items() for p in ps}
    assert {g.check for g in problems.GATES} == set(problems.CHECKS) and set(problems.BY_SEVERITY) <= {p for ps in problems.PROBLEMS.values() for p in ps}


def test_every_problem_occurs(spark, data):
    rows = QUERIES["rl19_call_problems"](spark, data.replace("sf0.001", "sf0.01")).collect()
    assert {x.problem for x in rows} == {p for ps in problems.PROBLEMS.values() for p in ps}
