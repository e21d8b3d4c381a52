"""Problems that users hear, out of what the streams measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators import delay, signalling, streams
from callscope.operators.folds import spread
from callscope.plans.registry import ORACLES, query

#: Problem, usual priority; and priorities by severity (critical, warning, info) where these differ.
AUDIO = {
    "one_way_audio": 0, "loss_artifact": 2, "dropouts": 2, "clock_anomaly": 2, "dup_audio": 2, "howling": 1, "clipping": 2, "buzz": 2,
    "transient_noise": 2, "noise_floor": 3, "low_volume": 2, "high_volume": 3, "latency": 2, "narrowband": 3,
}
VIDEO = {"no_video": 0, "corrupt_video": 1, "video_loss": 2, "keyframe_issue": 1, "video_clock_anomaly": 1, "video_latency": 2, "low_fps": 2}
BY_SEVERITY = {"loss_artifact": (1, 2, 2), "dropouts": (1, 2, 3), "latency": (1, 2, 3)}
LOSS_PCT, REPORTED_PCT, GAP_MS, SMALL_GAP_MS, SERVER_MS, HIGH_SERVER_MS, JITTER_MS = 3.0, 2.0, 300.0, 50.0, 20.0, 50.0, 10.0
SEVERITIES = ["critical", "warning", "info"]

SQL = f""", l AS ({ORACLES["wn3_packet_loss"]}), j AS ({ORACLES["ag5_jitter"]}), i AS ({ORACLES["wn5_rtp_integrity"]}), c AS ({ORACLES["wn4_ts_continuity"]}),
    r AS ({ORACLES["ag13_rtcp_summary"]}), d AS ({ORACLES["jn2_server_delay"]}),
    e AS (SELECT ssrc, 'loss_artifact' AS problem, CASE WHEN loss_pct >= 3 THEN 0 ELSE 1 END AS sev, 'loss' AS origin FROM l WHERE role = 'terminal' AND lost > 0
      UNION ALL SELECT ssrc, 'loss_artifact', 1, 'report' FROM r WHERE fraction > 2
      UNION ALL SELECT ssrc, 'clock_anomaly', 0, 'order' FROM i WHERE role = 'terminal' AND ts_backward > 0
      UNION ALL SELECT ssrc, 'dup_audio', 1, 'order' FROM i WHERE role = 'terminal' AND ts_duplicate > 0
      UNION ALL SELECT ssrc, 'dropouts', CASE WHEN media_gap_ms >= 300 THEN 0 WHEN media_gap_ms >= 50 THEN 1 ELSE 2 END, 'continuity' FROM c WHERE jumps > 0
      UNION ALL SELECT ssrc, 'clock_anomaly', 0, 'continuity' FROM c WHERE backward > 0
      UNION ALL SELECT ssrc, 'dup_audio', 1, 'continuity' FROM c WHERE duplicates > 0
      UNION ALL SELECT ssrc, 'latency', CASE WHEN mean_ms >= 50 THEN 0 ELSE 1 END, 'server' FROM d WHERE mean_ms >= 20
      UNION ALL SELECT ssrc, 'latency', 1, 'jitter' FROM j WHERE role = 'terminal' AND std_ms > 10),
    g AS (SELECT ssrc, problem, min(sev) AS sev, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM e GROUP BY ssrc, problem)
    SELECT ssrc, problem, CASE sev WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, origins,
      CASE WHEN problem IN ('dropouts', 'latency') THEN sev + 1 WHEN problem = 'loss_artifact' THEN CASE WHEN sev = 0 THEN 1 ELSE 2 END ELSE 2 END AS priority FROM g"""


@query("rl18_stream_problems", "captures", "pkt", "pkt_fs", "pkt_out", "rtcp", sql=SQL, recursive=True)
def stream_problems(captures: DataFrame, pkt: DataFrame, at_server: DataFrame, sent_on: DataFrame, reports: DataFrame, role: str = "terminal") -> DataFrame:
    """Problems of each audio stream with their worst severity, priority and the checks that found them."""
    gap = F.col("media_gap_ms")
    # Each check runs once, whatever it finds.
    checks = [
        (streams.stream_checks(captures.where(F.col("role") == role)), [
            (F.col("lost") > 0, "loss_artifact", F.when(F.col("loss_pct") >= LOSS_PCT, 0).otherwise(1), "loss"),
            (F.col("ts_backward") > 0, "clock_anomaly", F.lit(0), "order"),
            (F.col("ts_duplicate") > 0, "dup_audio", F.lit(1), "order"),
            (F.col("std_ms") > JITTER_MS, "latency", F.lit(1), "jitter"),
        ]),
        (signalling.rtcp_summary(reports), [(F.col("fraction") > REPORTED_PCT, "loss_artifact", F.lit(1), "report")]),
        (streams.ts_continuity(pkt), [
            (F.col("jumps") > 0, "dropouts", F.when(gap >= GAP_MS, 0).when(gap >= SMALL_GAP_MS, 1).otherwise(2), "continuity"),
            (F.col("backward") > 0, "clock_anomaly", F.lit(0), "continuity"),
            (F.col("duplicates") > 0, "dup_audio", F.lit(1), "continuity"),
        ]),
        (delay.server_delay(at_server, sent_on), [(F.col("mean_ms") >= SERVER_MS, "latency", F.when(F.col("mean_ms") >= HIGH_SERVER_MS, 0).otherwise(1), "server")]),
    ]

    def found(df: DataFrame, gates: list[tuple[Column, str, Column, str]]) -> DataFrame:
        """Findings of a check, moved once: branches of a union that are partitioned alike run in the same tasks, whose memory would be that of all checks."""
        each = (F.when(where, F.struct(F.lit(problem).alias("problem"), severity.cast("int").alias("sev"), F.lit(origin).alias("origin"))) for where, problem, severity, origin in gates)
        return spread(df.select("ssrc", F.explode(F.array_compact(F.array(*each))).alias("x")).select("ssrc", "x.*"), "ssrc", "problem")

    rows = reduce(DataFrame.unionByName, (found(*c) for c in checks))
    g = rows.groupBy("ssrc", "problem").agg(F.min("sev").alias("sev"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))
    priorities = F.create_map(*(F.lit(x) for p, usual in {**AUDIO, **VIDEO}.items() for k in range(3) for x in (f"{p}{k}", BY_SEVERITY.get(p, (usual,) * 3)[k])))
    priority = F.try_element_at(priorities, F.concat("problem", F.col("sev").cast("string")))
    return g.select("ssrc", "problem", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("sev") + 1).alias("severity"), "origins", priority.alias("priority"))
