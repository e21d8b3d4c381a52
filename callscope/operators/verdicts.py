"""Verdicts that combine streams, signalling and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import scalars
from callscope.operators.assembly import merged_units
from callscope.operators.calls import bucketed, first_shared_bucket, with_calls
from callscope.operators.signalling import answer_and_bye
from callscope.operators.streams import clock_rate, main_pt
from callscope.plans.registry import query
from callscope.work import materialize

SERVER = "192.0.2.1"
#: Clock bands of audio (narrow, wide) and video, in Hz.
AUDIO_BANDS, VIDEO_BAND = ((7200, 8800), (43000, 53000)), (81000, 99000)


@query(
    "rl1_stream_kind", "captures", doubles="clock_rate",
    sql=""", k AS (SELECT *, row_number() OVER (PARTITION BY role, ssrc ORDER BY pkt_no DESC) AS k FROM captures),
    d AS (SELECT role, ssrc, ((rtp_ts - lag(rtp_ts) OVER w + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS ts, t_us - lag(t_us) OVER w AS t FROM k WHERE k <= 64
      WINDOW w AS (PARTITION BY role, ssrc ORDER BY pkt_no)),
    r AS (SELECT role, ssrc, ts * CAST(1000000 AS DOUBLE) / t AS rate FROM d WHERE t > 1000 AND ts > 0),
    c AS (SELECT role, ssrc, list_sort(list(rate))[len(list(rate)) // 2 + 1] AS clock_rate FROM r GROUP BY role, ssrc HAVING count(*) >= 4),
    p AS (SELECT role, ssrc, arg_min(pt, (-n, pt)) AS main_pt FROM (SELECT role, ssrc, pt, count(*) AS n FROM captures GROUP BY ALL) GROUP BY role, ssrc)
    SELECT p.role, p.ssrc, main_pt, clock_rate, CASE WHEN clock_rate BETWEEN 7200 AND 8800 OR clock_rate BETWEEN 43000 AND 53000 THEN 'audio' WHEN clock_rate BETWEEN 81000 AND 99000 THEN 'video'
      WHEN main_pt IN (0, 3, 8, 9, 18) THEN 'audio' WHEN main_pt BETWEEN 96 AND 127 THEN 'video' ELSE 'unknown' END AS kind FROM p LEFT JOIN c ON p.role = c.role AND p.ssrc = c.ssrc""",
)
def stream_kind(packets: DataFrame) -> DataFrame:
    """Audio or video: by the clock as measured, else by the payload type."""
    clock = F.col("clock_rate")
    audio = clock.between(*AUDIO_BANDS[0]) | clock.between(*AUDIO_BANDS[1])
    kind = F.when(audio, "audio").when(clock.between(*VIDEO_BAND), "video").otherwise(scalars.media_kind(F.col("main_pt")))
    return main_pt(packets).join(clock_rate(packets), ["role", "ssrc"], "left").select("role", "ssrc", "main_pt", "clock_rate", kind.alias("kind"))


@query(
    "ag15_session_codecs", "captures",
    sql=""" SELECT role, array_to_string(list_sort(list(DISTINCT CASE pt WHEN 0 THEN 'PCMU' WHEN 3 THEN 'GSM' WHEN 8 THEN 'PCMA' WHEN 9 THEN 'G722' WHEN 18 THEN 'G729' ELSE 'unknown' END)), ',') AS codecs FROM captures GROUP BY role""",
)
def session_codecs(packets: DataFrame) -> DataFrame:
    return packets.groupBy("role").agg(F.array_join(F.array_sort(F.collect_set(scalars.codec_name(F.col("pt")))), ",").alias("codecs"))


@query(
    "jn9_nearest_dialog", "legs", "dialogs",
    sql=""", c AS (SELECT l.leg_id, d.dialog_id, least(abs(l.end_s - d.bye_s), abs(l.start_s - d.invite_s)) AS apart FROM legs l JOIN dialogs d ON d.session_id = l.session_id AND d.ip = l.ip
      WHERE abs(l.end_s - d.bye_s) <= 6 OR abs(l.start_s - d.invite_s) <= 6)
    SELECT leg_id, arg_min(dialog_id, (apart, dialog_id)) AS dialog_id, min(apart) AS apart FROM c GROUP BY leg_id""",
)
def nearest_dialog(legs: DataFrame, dialogs: DataFrame, within_s: int = 6) -> DataFrame:
    """The dialog of a leg's device that begins or ends within 6 s of it, the nearest: the last before it and the first after it at either end, from sorts, without pairs."""

    def ends(df: DataFrame, leg: Column, dialog: Column, start: str, end: str) -> DataFrame:
        each = F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col(start).alias("s")), F.struct(F.lit("end").alias("which"), F.col(end).alias("s"))))
        return df.select("session_id", "ip", leg.alias("leg_id"), dialog.alias("dialog_id"), each.alias("e")).select("session_id", "ip", "leg_id", "dialog_id", "e.*")

    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    rows = ends(legs, F.col("leg_id"), none(dialogs, "dialog_id"), "start_s", "end_s").unionByName(ends(dialogs, none(legs, "leg_id"), F.col("dialog_id"), "invite_s", "bye_s"))
    rows = rows.where("session_id is not null and ip is not null and s is not null")
    at, is_dialog = Window.partitionBy("session_id", "ip", "which"), F.col("dialog_id").isNotNull()
    # Both frames grow from the first row, so that each is one pass: of those before, the latest, then the smallest; of those after, the earliest, then the smallest.
    before = F.max(F.when(is_dialog, F.struct("s", (-F.col("dialog_id")).alias("d")))).over(at.orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_dialog, F.struct("s", F.col("dialog_id").alias("d")))).over(at.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    j = rows.withColumns({"before": before, "after": after}).where("leg_id is not null")
    sides = F.array(F.struct((F.col("s") - F.col("before.s")).alias("apart"), (-F.col("before.d")).alias("dialog_id")), F.struct((F.col("after.s") - F.col("s")).alias("apart"), F.col("after.d").alias("dialog_id")))
    best = F.min(F.struct("k.apart", "k.dialog_id"))
    near = j.select("leg_id", F.explode(sides).alias("k")).where(F.col("k.apart") <= within_s)
    return near.groupBy("leg_id").agg(best.alias("k")).select("leg_id", "k.dialog_id", "k.apart")


@query(
    "rl12_call_parties", "sip",
    sql=""", c AS (SELECT call_id, arg_min(src, (t_us, cseq)) FILTER (method = 'INVITE') AS caller FROM sip GROUP BY call_id)
    SELECT c.call_id, caller, min(CASE WHEN method = '200' AND src <> caller THEN src END) AS answerer, coalesce(bool_or(method = '200' AND src = '192.0.2.1'), false) AS relayed FROM c JOIN sip ON sip.call_id = c.call_id GROUP BY c.call_id, caller""",
)
def call_parties(messages: DataFrame) -> DataFrame:
    """Who called, who answered, and whether the server answered for them."""
    invite = F.col("method") == "INVITE"
    first = F.min(F.when(invite, F.struct("t_us", "cseq", "src"))).over(Window.partitionBy("call_id"))
    df = messages.withColumn("caller", first.getField("src"))
    ok = F.col("method") == "200"
    return df.groupBy("call_id", "caller").agg(F.min(F.when(ok & (F.col("src") != F.col("caller")), F.col("src"))).alias("answerer"), F.coalesce(F.bool_or(ok & (F.col("src") == SERVER)), F.lit(False)).alias("relayed"))


@query(
    "rl14_silence_diagnosis", "streams", "frames",
    sql=""", p AS (SELECT ssrc, count(*) FILTER (level >= 60) > 0 AS heard, count(*) AS n FROM frames GROUP BY ssrc)
    SELECT s.role, s.ssrc, CASE WHEN s.src_ip <> '192.0.2.1' THEN 'up' ELSE 'down' END AS direction, CASE WHEN n IS NULL THEN 'no_source' WHEN n < 5 THEN 'unknown' WHEN heard THEN 'ok' ELSE 'silent_source' END AS diagnosis
    FROM streams s LEFT JOIN p ON p.ssrc = s.ssrc""",
)
def silence_diagnosis(streams: DataFrame, frames: DataFrame) -> DataFrame:
    """Per stream and direction: heard, silent at its source, or never seen."""
    p = frames.groupBy("ssrc").agg((F.count_if(F.col("level") >= 60) > 0).alias("heard"), F.count("*").alias("n"))
    diagnosis = F.when(F.col("n").isNull(), "no_source").when(F.col("n") < 5, "unknown").when(F.col("heard"), "ok").otherwise("silent_source")
    direction = F.when(F.col("src_ip") != SERVER, "up").otherwise("down")
    return streams.join(p, "ssrc", "left").select("role", "ssrc", direction.alias("direction"), diagnosis.alias("diagnosis"))


@query(
    "snk5_media_manifest", "streams", "captures",
    sql=""", n AS (SELECT role, ssrc, count(*) AS packets FROM captures GROUP BY role, ssrc)
    SELECT s.role || '_' || CASE WHEN s.role = 'fs' THEN CASE WHEN dst_ip = '192.0.2.1' THEN 'inbound' ELSE 'outbound' END ELSE CASE WHEN dst_ip = '192.0.2.1' THEN 'outbound' ELSE 'inbound' END END
      || '_' || lpad(lower(to_hex(s.ssrc)), 8, '0') AS name, packets FROM streams s JOIN n ON n.role = s.role AND n.ssrc = s.ssrc""",
)
def media_manifest(streams: DataFrame, packets: DataFrame) -> DataFrame:
    """Names of the media files that a session's streams give."""
    n = packets.groupBy("role", "ssrc").agg(F.count("*").alias("packets"))
    direction = scalars.endpoint_direction(F.col("role"), F.col("dst_ip"), F.lit(SERVER))
    name = F.concat_ws("_", "role", direction, F.substring(scalars.hex_source(F.col("ssrc")), 3, 8))
    return streams.join(n, ["role", "ssrc"]).select(name.alias("name"), "packets")


@query("gr4_merged_calls", "legs")
def merged_calls(legs: DataFrame) -> DataFrame:
    """Calls after the order-dependent merge of those that hold two devices at most together, overlap and end aligned."""
    rows = materialize(with_calls(legs).withColumnRenamed("call_id", "unit_id"))
    nothing = {c: F.lit(None).cast("string") for c in ("at", "peer_ip", "peer_at")}
    merged = merged_units(rows.select("session_id", "unit_id", "start_s", "end_s", "ip").withColumns(nothing))
    out = rows.join(merged, ["session_id", "unit_id"]).groupBy("session_id", "call_id")
    return out.agg(F.count("*").alias("legs"), F.count_distinct("ip").alias("devices"))


@query(
    "jn10_orphan_legs", "legs", "dialogs",
    sql=""", bound AS (SELECT DISTINCT l.leg_id FROM dialogs d JOIN legs l ON d.session_id = l.session_id AND d.ip = l.ip AND l.start_s <= d.bye_s + 6 AND l.end_s >= d.invite_s - 6),
    o AS (SELECT * FROM legs WHERE leg_id NOT IN (SELECT leg_id FROM bound)), b AS (SELECT legs.* FROM legs JOIN bound ON bound.leg_id = legs.leg_id),
    j AS (SELECT o.leg_id, b.leg_id AS to_leg, least(o.end_s, b.end_s) - greatest(o.start_s, b.start_s) AS shared FROM o JOIN b ON o.session_id = b.session_id AND o.ip = b.ip WHERE least(o.end_s, b.end_s) > greatest(o.start_s, b.start_s))
    SELECT leg_id, arg_min(to_leg, (-shared, to_leg)) AS to_leg, max(shared) AS shared FROM j GROUP BY leg_id""",
)
def orphan_legs(legs: DataFrame, dialogs: DataFrame) -> DataFrame:
    """For each leg without a dialog, the bound leg of its device that it overlaps most."""
    from callscope.operators.calls import strong_binding

    bound = strong_binding(legs, dialogs).select("leg_id").distinct()
    o = bucketed(legs.join(bound, "leg_id", "left_anti"), "start_s", "end_s")
    b = legs.join(bound, "leg_id", "left_semi").select("session_id", "ip", F.col("leg_id").alias("to_leg"), F.col("start_s").alias("s2"), F.col("end_s").alias("e2"))
    j = o.join(bucketed(b, "s2", "e2"), ["session_id", "ip", "bucket"]).where(first_shared_bucket(F.col("start_s"), F.col("s2")))
    j = j.withColumn("shared", F.least("end_s", "e2") - F.greatest("start_s", "s2")).where("shared > 0")
    best = F.min(F.struct((-F.col("shared")).alias("o"), "to_leg"))
    return j.groupBy("leg_id").agg(best.alias("k")).select("leg_id", "k.to_leg", (-F.col("k.o")).alias("shared"))


@query(
    "rl4_call_times", "sip",
    sql=""", t AS (SELECT call_id, coalesce(min(t_us) FILTER (method = '200' AND src <> '192.0.2.1'), min(t_us) FILTER (method = '200')) AS a, min(t_us) FILTER (method = 'BYE') AS b, min(t_us) AS s FROM sip GROUP BY call_id)
    SELECT call_id, CAST((a - s) // 1000 AS BIGINT) AS setup_ms, CAST((b - a) // 1000 AS BIGINT) AS talk_ms, CASE WHEN a IS NULL THEN 'unanswered' WHEN b IS NULL THEN 'open' ELSE 'ended' END AS state FROM t""",
)
def call_times(messages: DataFrame) -> DataFrame:
    """Set-up and talk time of each dialog and how it ended."""
    t = answer_and_bye(messages).join(messages.groupBy("call_id").agg(F.min("t_us").alias("s")), "call_id")
    ms = lambda c: F.expr(f"({c}) div 1000")
    state = F.when(F.col("answer_us").isNull(), "unanswered").when(F.col("bye_us").isNull(), "open").otherwise("ended")
    return t.select("call_id", ms("answer_us - s").alias("setup_ms"), ms("bye_us - answer_us").alias("talk_ms"), state.alias("state"))
