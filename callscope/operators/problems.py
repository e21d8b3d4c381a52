"""Problems that users hear or see, out of what all checks say: a table of gates compiled to one plan.

evidence: call_id, media ('audio', 'video', null for what concerns both), subject (a stream, direction or device), check_name, and what
that check gives, by its name in CHECKS: verdict, level, value, n, backward, duplicates. A gate is a condition over one check's columns and the
severity that it means. All gates are tried in one pass over the evidence, and one aggregation follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.plans.registry import query

SEVERITIES = ("critical", "warning", "info")
#: What the columns of each check mean.
CHECKS = {
    "silence": "verdict of the silence diagnosis of a direction",
    "relay": "verdict on the server's relaying",
    "pair": "verdict 'unseen': one device sends video that the server never passes to the other",
    "loss": "value: per cent lost, n: packets lost",
    "reports": "value: per cent lost as receivers report it",
    "nack": "n: packets asked for again",
    "key_requests": "n: key frames asked for",
    "order": "backward, duplicates: timestamps that went back or stood still",
    "quality": "verdict: what the media showed, level: how bad",
    "codec": "verdict: codec of a decoded stream",
    "continuity": "n: jumps of the sender's clock, value: milliseconds of media missing, backward, duplicates",
    "frames": "value: frames a second, n: packets",
    "server": "value: mean milliseconds inside the server, n: packets",
    "jitter": "value: spread of packet gaps in milliseconds",
    "chain": "verdict on a direction's delay by segment",
    "roundtrip": "verdict on the way there and back",
}


@dataclass(frozen=True)
class Gate:
    problem: str
    media: str
    check: str
    #: Conditions and what they mean, the first that holds counts; severity 'level' is the finding's own.
    cases: tuple[tuple[str, str], ...]


# Problems with their usual priority (0 is most urgent), priorities by severity where these differ, and thresholds.
PROBLEMS = {
    "audio": {
        "one_way_audio": 0, "loss_artifact": 2, "dropouts": 2, "clock_anomaly": 2, "dup_audio": 2, "howling": 1, "clipping": 2, "buzz": 2,
        "transient_noise": 2, "noise_floor": 3, "low_volume": 2, "high_volume": 3, "latency": 2, "narrowband": 3,
    },
    "video": {"no_video": 0, "corrupt_video": 1, "video_loss": 2, "keyframe_issue": 1, "video_clock_anomaly": 1, "video_latency": 2, "low_fps": 2},
}
BY_SEVERITY = {
    "loss_artifact": {"critical": 1, "warning": 2, "info": 2}, "dropouts": {"critical": 1, "warning": 2, "info": 3}, "latency": {"critical": 1, "warning": 2, "info": 3},
    "no_video": {"critical": 0, "warning": 1}, "video_loss": {"critical": 1, "warning": 2}, "keyframe_issue": {"critical": 0, "warning": 1, "info": 2},
    "video_clock_anomaly": {"critical": 1, "warning": 2}, "video_latency": {"critical": 1, "warning": 2, "info": 3}, "low_fps": {"warning": 2, "info": 3},
}
#: What no capture shows, whatever is checked: only people can.
UNOBSERVABLE = {
    "audio": ("wind_noise", "breath_pops", "sharp_sibilants", "gain_pumping", "loose_contact", "own_echo", "double_talk_suppression", "app_audio_session"),
    "video": ("blur", "colour_exposure", "rotation_scaling", "lip_sync", "screen_sharing", "overheating", "device_model", "preprocessing"),
}
SERVER = (("n > 0 AND value >= 50", "critical"), ("n > 0 AND value >= 20", "warning"))
MEDIA_FINDINGS = {
    "audio": {
        "rtp_loss": "loss_artifact", "howling": "howling", "hum": "buzz", "clipping": "clipping", "clicks": "transient_noise", "noise": "noise_floor", "low_level": "low_volume",
        "high_level": "high_volume", "no_speech": "one_way_audio",
    },
    "video": {"broken_nal": "corrupt_video", "decode_errors": "corrupt_video", "video_loss": "video_loss", "no_idr": "keyframe_issue", "idr_gap": "keyframe_issue"},
}
GATES = (
    Gate("one_way_audio", "audio", "silence", (("verdict IN ('blocked', 'no_source', 'silent_source')", "critical"), ("verdict = 'silent_path'", "warning"))),
    Gate("one_way_audio", "audio", "relay", (("verdict IN ('redirected', 'no_relay', 'partial_downlink')", "critical"), ("verdict = 'partial_uplink'", "warning"))),
    Gate("loss_artifact", "audio", "loss", (("n > 0 AND value >= 3", "critical"), ("n > 0", "warning"))),
    Gate("loss_artifact", "audio", "reports", (("value > 2", "warning"),)),
    Gate("clock_anomaly", "audio", "order", (("backward > 0", "critical"),)),
    Gate("dup_audio", "audio", "order", (("duplicates > 0", "warning"),)),
    Gate("narrowband", "audio", "codec", (("verdict LIKE '%PCMU%' OR verdict LIKE '%PCMA%' OR verdict LIKE '%G.711%'", "info"),)),
    Gate("dropouts", "audio", "continuity", (("n > 0 AND value >= 300", "critical"), ("n > 0 AND value >= 50", "warning"), ("n > 0", "info"))),
    Gate("clock_anomaly", "audio", "continuity", (("backward > 0", "critical"),)),
    Gate("dup_audio", "audio", "continuity", (("duplicates > 0", "warning"),)),
    Gate("latency", "audio", "server", SERVER),
    Gate("latency", "audio", "jitter", (("value > 10", "warning"),)),
    Gate("latency", "audio", "chain", (("verdict = 'high'", "warning"),)),
    Gate("latency", "audio", "roundtrip", (("verdict = 'high'", "warning"),)),
    Gate("no_video", "video", "relay", (("verdict IN ('redirected', 'no_relay')", "critical"), ("verdict = 'partial_uplink'", "warning"))),
    Gate("no_video", "video", "pair", (("verdict = 'unseen' AND NOT redirected", "critical"),)),
    Gate("video_clock_anomaly", "video", "order", (("backward > 0", "critical"),)),
    Gate("video_loss", "video", "loss", (("n > 0 AND NOT looked_into AND value >= 1", "critical"), ("n > 0 AND NOT looked_into", "warning"))),
    Gate("video_loss", "video", "reports", (("value > 0.5", "warning"),)),
    Gate("video_loss", "video", "nack", (("n > 0", "warning"),)),
    Gate("keyframe_issue", "video", "key_requests", (("n >= 3", "warning"),)),
    Gate("video_clock_anomaly", "video", "continuity", (("backward > 0", "critical"),)),
    Gate("low_fps", "video", "frames", (("n >= 100 AND value > 0 AND value < 10", "warning"), ("n >= 100 AND value > 0 AND value < 15", "info"))),
    Gate("video_latency", "video", "server", SERVER),
    Gate("video_latency", "video", "jitter", (("value > 10", "warning"),)),
    *(Gate(p, media, "quality", ((f"verdict = '{kind}'", "level"),)) for media, kinds in MEDIA_FINDINGS.items() for kind, p in kinds.items()),
)


def compiled(gates: tuple[Gate, ...]) -> str:
    """One expression: the problems that a row of evidence shows, each with its severity (0 is worst)."""
    level = "CASE level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"

    def one(g: Gate) -> str:
        cases = " ".join(f"WHEN {when} THEN {level if severity == 'level' else SEVERITIES.index(severity)}" for when, severity in g.cases)
        here = f"check_name = '{g.check}' AND (media = '{g.media}' OR media IS NULL)"
        return f"CASE WHEN {here} THEN named_struct('problem', '{g.problem}', 'media', '{g.media}', 'rank', CASE {cases} END) END"

    return f"filter(array({', '.join(map(one, gates))}), x -> x.rank IS NOT NULL)"


def shown(evidence: DataFrame, gates: tuple[Gate, ...] = GATES) -> DataFrame:
    """(call_id, media, problem, rank, check_name, subject): what each row of evidence shows.

    Two gates look beyond their row: the loss of a video stream counts only if its media wasn't looked into, and a missing picture on one side only
    if the call's media isn't sent elsewhere.
    """
    looked = evidence.where("check_name = 'quality' AND media = 'video'").select("call_id", "subject", F.lit(True).alias("looked_into")).distinct()
    away = evidence.where("check_name = 'relay' AND verdict = 'redirected'").select("call_id", F.lit(True).alias("redirected")).distinct()
    rows = evidence.join(looked, ["call_id", "subject"], "left").join(away, "call_id", "left").fillna(False, ["looked_into", "redirected"])
    rows = rows.withColumn("p", F.explode(F.expr(compiled(gates))))
    return rows.select("call_id", "p.media", "p.problem", "p.rank", "check_name", "subject")


SHOWN_SQL = """, e AS (SELECT *, EXISTS (SELECT 1 FROM evidence q WHERE q.check_name = 'quality' AND q.media = 'video' AND q.call_id = evidence.call_id AND q.subject = evidence.subject) AS looked,
      EXISTS (SELECT 1 FROM evidence q WHERE q.check_name = 'relay' AND q.verdict = 'redirected' AND q.call_id = evidence.call_id) AS away, coalesce(media, 'audio') = 'audio' AS a, coalesce(media, 'video') = 'video' AS v,
      CASE level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS lv FROM evidence),
    sh(call_id, media, problem, rank, check_name, subject) AS (
      SELECT call_id, 'audio', 'one_way_audio', CASE WHEN verdict = 'silent_path' THEN 1 ELSE 0 END, check_name, subject FROM e WHERE a AND check_name = 'silence' AND verdict IN ('blocked', 'no_source', 'silent_source', 'silent_path')
      UNION ALL SELECT call_id, 'audio', 'one_way_audio', CASE WHEN verdict = 'partial_uplink' THEN 1 ELSE 0 END, check_name, subject FROM e WHERE a AND check_name = 'relay' AND verdict NOT IN ('relayed', 'insufficient')
      UNION ALL SELECT call_id, 'audio', 'loss_artifact', CASE WHEN value >= 3 THEN 0 ELSE 1 END, check_name, subject FROM e WHERE a AND check_name = 'loss' AND n > 0
      UNION ALL SELECT call_id, 'audio', 'loss_artifact', 1, check_name, subject FROM e WHERE a AND check_name = 'reports' AND value > 2
      UNION ALL SELECT call_id, 'audio', 'clock_anomaly', 0, check_name, subject FROM e WHERE a AND check_name IN ('order', 'continuity') AND backward > 0
      UNION ALL SELECT call_id, 'audio', 'dup_audio', 1, check_name, subject FROM e WHERE a AND check_name IN ('order', 'continuity') AND duplicates > 0
      UNION ALL SELECT call_id, 'audio', 'narrowband', 2, check_name, subject FROM e WHERE a AND check_name = 'codec' AND regexp_matches(verdict, 'PCM[UA]|G[.]711')
      UNION ALL SELECT call_id, 'audio', 'dropouts', CASE WHEN value >= 300 THEN 0 WHEN value >= 50 THEN 1 ELSE 2 END, check_name, subject FROM e WHERE a AND check_name = 'continuity' AND n > 0
      UNION ALL SELECT call_id, 'audio', 'latency', CASE WHEN check_name = 'server' AND value >= 50 THEN 0 ELSE 1 END, check_name, subject FROM e WHERE a AND ((check_name = 'server' AND n > 0 AND value >= 20) OR (check_name = 'jitter' AND value > 10) OR (check_name IN ('chain', 'roundtrip') AND verdict = 'high'))
      UNION ALL SELECT call_id, 'audio', CASE verdict WHEN 'rtp_loss' THEN 'loss_artifact' WHEN 'hum' THEN 'buzz' WHEN 'clicks' THEN 'transient_noise' WHEN 'noise' THEN 'noise_floor' WHEN 'low_level' THEN 'low_volume' WHEN 'high_level' THEN 'high_volume' WHEN 'no_speech' THEN 'one_way_audio' ELSE verdict END, lv, check_name, subject
        FROM e WHERE a AND check_name = 'quality' AND verdict IN ('rtp_loss', 'howling', 'hum', 'clipping', 'clicks', 'noise', 'low_level', 'high_level', 'no_speech')
      UNION ALL SELECT call_id, 'video', 'no_video', CASE WHEN verdict = 'partial_uplink' THEN 1 ELSE 0 END, check_name, subject FROM e WHERE v AND check_name = 'relay' AND verdict IN ('redirected', 'no_relay', 'partial_uplink')
      UNION ALL SELECT call_id, 'video', 'no_video', 0, check_name, subject FROM e WHERE v AND check_name = 'pair' AND verdict = 'unseen' AND NOT away
      UNION ALL SELECT call_id, 'video', 'video_clock_anomaly', 0, check_name, subject FROM e WHERE v AND check_name IN ('order', 'continuity') AND backward > 0
      UNION ALL SELECT call_id, 'video', 'video_loss', CASE WHEN check_name = 'loss' AND value >= 1 THEN 0 ELSE 1 END, check_name, subject FROM e WHERE v AND ((check_name = 'loss' AND n > 0 AND NOT looked) OR (check_name = 'reports' AND value > 0.5) OR (check_name = 'nack' AND n > 0))
      UNION ALL SELECT call_id, 'video', 'keyframe_issue', 1, check_name, subject FROM e WHERE v AND check_name = 'key_requests' AND n >= 3
      UNION ALL SELECT call_id, 'video', 'low_fps', CASE WHEN value < 10 THEN 1 ELSE 2 END, check_name, subject FROM e WHERE v AND check_name = 'frames' AND n >= 100 AND value > 0 AND value < 15
      UNION ALL SELECT call_id, 'video', 'video_latency', CASE WHEN check_name = 'server' AND value >= 50 THEN 0 ELSE 1 END, check_name, subject FROM e WHERE v AND ((check_name = 'server' AND n > 0 AND value >= 20) OR (check_name = 'jitter' AND value > 10))
      UNION ALL SELECT call_id, 'video', CASE WHEN verdict IN ('broken_nal', 'decode_errors') THEN 'corrupt_video' WHEN verdict = 'video_loss' THEN verdict ELSE 'keyframe_issue' END, lv, check_name, subject FROM e WHERE v AND check_name = 'quality' AND verdict IN ('broken_nal', 'decode_errors', 'video_loss', 'no_idr', 'idr_gap')),
    g AS (SELECT call_id, media, problem, min(rank) AS rank, array_to_string(list_sort(list(DISTINCT check_name)), ',') AS checks, count(DISTINCT subject) AS subjects, count(*) AS findings FROM sh GROUP BY ALL),
    pr AS (SELECT *, CAST(CASE WHEN problem IN ('loss_artifact', 'video_loss', 'video_clock_anomaly') THEN CASE WHEN rank = 0 THEN 1 WHEN problem = 'video_clock_anomaly' AND rank = 2 THEN 1 ELSE 2 END
      WHEN problem IN ('dropouts', 'latency', 'video_latency') THEN rank + 1 WHEN problem = 'no_video' THEN CASE WHEN rank = 1 THEN 1 ELSE 0 END WHEN problem = 'keyframe_issue' THEN rank WHEN problem = 'low_fps' THEN CASE WHEN rank = 2 THEN 3 ELSE 2 END
      WHEN problem = 'one_way_audio' THEN 0 WHEN problem IN ('howling', 'corrupt_video') THEN 1 WHEN problem IN ('noise_floor', 'high_volume', 'narrowband') THEN 3 ELSE 2 END AS INTEGER) AS priority FROM g)"""


@query(
    "rl19_call_problems", "evidence",
    sql=SHOWN_SQL + """ SELECT call_id, media, problem, CASE rank WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, priority, checks, subjects, findings,
      CAST(row_number() OVER (PARTITION BY call_id, media ORDER BY priority, rank, problem) AS INTEGER) AS place FROM pr""",
)
def call_problems(evidence: DataFrame) -> DataFrame:
    """Problems of each call, most urgent first: worst severity, priority, which checks found them, and on how many subjects."""
    found = shown(evidence).groupBy("call_id", "media", "problem").agg(
        F.min("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("check_name")), ",").alias("checks"), F.count_distinct("subject").alias("subjects"), F.count("*").alias("findings")
    )
    usual = {p: n for kinds in PROBLEMS.values() for p, n in kinds.items()}
    table = F.create_map(*(F.lit(x) for p, n in usual.items() for k, s in enumerate(SEVERITIES) for x in (f"{p}{k}", BY_SEVERITY.get(p, {}).get(s, n))))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1)
    out = found.withColumn("priority", F.element_at(table, F.concat("problem", F.col("rank").cast("string"))))
    place = F.row_number().over(Window.partitionBy("call_id", "media").orderBy("priority", "rank", "problem"))
    return out.select("call_id", "media", "problem", severity.alias("severity"), "priority", "checks", "subjects", "findings", place.alias("place"))


STATES_SQL = SHOWN_SQL + """, kinds(media, problem, looks) AS (VALUES ('audio', 'one_way_audio', ['silence', 'relay', 'quality']), ('audio', 'loss_artifact', ['loss', 'reports', 'quality']), ('audio', 'dropouts', ['continuity']),
      ('audio', 'clock_anomaly', ['order', 'continuity']), ('audio', 'dup_audio', ['order', 'continuity']), ('audio', 'howling', ['quality']), ('audio', 'clipping', ['quality']), ('audio', 'buzz', ['quality']), ('audio', 'transient_noise', ['quality']),
      ('audio', 'noise_floor', ['quality']), ('audio', 'low_volume', ['quality']), ('audio', 'high_volume', ['quality']), ('audio', 'latency', ['server', 'jitter', 'chain', 'roundtrip']), ('audio', 'narrowband', ['codec']),
      ('video', 'no_video', ['relay', 'pair']), ('video', 'corrupt_video', ['quality']), ('video', 'video_loss', ['loss', 'reports', 'nack', 'quality']), ('video', 'keyframe_issue', ['key_requests', 'quality']),
      ('video', 'video_clock_anomaly', ['order', 'continuity']), ('video', 'video_latency', ['server', 'jitter']), ('video', 'low_fps', ['frames'])),
    never(media, problem) AS (SELECT 'audio', unnest(['wind_noise', 'breath_pops', 'sharp_sibilants', 'gain_pumping', 'loose_contact', 'own_echo', 'double_talk_suppression', 'app_audio_session'])
      UNION ALL SELECT 'video', unnest(['blur', 'colour_exposure', 'rotation_scaling', 'lip_sync', 'screen_sharing', 'overheating', 'device_model', 'preprocessing'])),
    ids AS (SELECT DISTINCT call_id FROM evidence)
    SELECT ids.call_id, kinds.media, kinds.problem, CASE WHEN g.call_id IS NOT NULL THEN 'found' WHEN EXISTS (SELECT 1 FROM evidence e WHERE e.call_id = ids.call_id AND list_contains(looks, e.check_name) AND coalesce(e.media, kinds.media) = kinds.media) THEN 'clear' ELSE 'unchecked' END AS state
    FROM ids CROSS JOIN kinds LEFT JOIN g ON g.call_id = ids.call_id AND g.media = kinds.media AND g.problem = kinds.problem
    UNION ALL SELECT call_id, media, problem, 'unobservable' FROM ids CROSS JOIN never"""


@query("rl19_problem_states", "evidence", sql=STATES_SQL)
def problem_states(evidence: DataFrame, gates: tuple[Gate, ...] = GATES) -> DataFrame:
    """What is known of each problem of each call: found, clear (a check looked and saw nothing), unchecked, or unobservable in captures."""
    looks: dict[tuple[str, str], set[str]] = {}
    for g in gates:
        looks.setdefault((g.media, g.problem), set()).add(g.check)
    known = evidence.groupBy("call_id").agg(*(F.coalesce(F.bool_or((F.col("check_name") == c) & (F.col("media").isNull() | (F.col("media") == m))), F.lit(False)).alias(f"{c}_{m}") for c in CHECKS for m in PROBLEMS))
    each = []
    for (media, problem), checks in looks.items():
        seen = F.lit(False)
        for c in sorted(checks):
            seen = seen | F.col(f"{c}_{media}")
        each.append(F.struct(F.lit(media).alias("media"), F.lit(problem).alias("problem"), F.when(seen, "clear").otherwise("unchecked").alias("state")))
    each += [F.struct(F.lit(m).alias("media"), F.lit(p).alias("problem"), F.lit("unobservable").alias("state")) for m, names in UNOBSERVABLE.items() for p in names]
    grid = known.select("call_id", F.explode(F.array(*each)).alias("k")).select("call_id", "k.*")
    found = shown(evidence, gates).select("call_id", "media", "problem", F.lit(True).alias("found")).distinct()
    out = grid.join(found, ["call_id", "media", "problem"], "left")
    return out.select("call_id", "media", "problem", F.when(F.col("found"), "found").otherwise(F.col("state")).alias("state"))


@query(
    "rl19_summaries", "evidence",
    sql=SHOWN_SQL + """ SELECT call_id, media, count(*) FILTER (rank < 2) AS problems, count(*) FILTER (rank = 2) AS remarks, arg_min(problem, (priority, rank, problem)) FILTER (rank < 2) AS worst FROM pr GROUP BY call_id, media""",
)
def summaries(evidence: DataFrame) -> DataFrame:
    """How many problems each call has, and the one to see to first; what only explains (a narrow-band codec, say) is a remark."""
    rows = call_problems(evidence)
    real = F.col("severity") != "info"
    worst = F.min(F.when(real, F.struct("place", "problem"))).getField("problem")
    return rows.groupBy("call_id", "media").agg(F.count_if(real).alias("problems"), F.count_if(~real).alias("remarks"), worst.alias("worst"))
