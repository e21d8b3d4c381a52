"""From captures to problems: one path over everything that a session's captures hold.

files: session_id, role, path says which capture was taken where. A session has one server, the address that takes part in most streams; it is written as
SERVER from there on, so that sessions of many servers are one table. Streams, dialogs and legs get numbers of their own, hashes of what names them, so that
all operators see one key set: session, role, stream, leg, dialog, call. Nothing is collected: each step is a join or an aggregation over all sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.media_headers import rtcp_events, rtp_packets
from callscope.functions.scalars import AUDIO_PT, STATIC_PT, hex_source
from callscope.functions.sip_messages import media_sections, sip_events
from callscope.operators import assembly, media, negotiation, paths, problems, signalling, streams
from callscope.sources.pcap import read_captures
from callscope.work import materialize

SERVER = paths.SERVER
# Silence in seconds after which ports are used anew, packets of a stream that counts.
QUIET_S, LEAST = 30, 10


def number(*parts: str | Column) -> Column:
    """A number of 62 bits for what the parts name."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


@dataclass
class Session:
    """What is known of the sessions, by name of the operators' inputs."""

    packets: DataFrame
    messages: DataFrame
    flows: DataFrame
    sources: DataFrame
    dialogs: DataFrame
    ends: DataFrame
    peers: DataFrame
    reports: DataFrame
    bodies: DataFrame


def frames_of(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Frames below a folder, with the session and role of their file; files that the table doesn't name are left out."""
    names = files.select("session_id", "role", F.regexp_replace("path", "^file:/*", "/").alias("_p"))
    return read_captures(spark, folder).withColumn("_p", F.regexp_replace("path", "^file:/*", "/")).join(F.broadcast(names), "_p").drop("_p")


def opened(frames: DataFrame) -> Session:
    """Everything that frames hold, under common keys. frames: as read_captures gives them, with session_id and role."""
    where = frames.select("path", "session_id", "role").distinct()
    raw = rtp_packets(frames).join(where, "path")
    raw = materialize(raw.withColumn("stream", number("session_id", "role", "ssrc")))
    sizes = raw.groupBy("session_id", "stream", "src_ip", "dst_ip").agg(F.count("*").alias("n"))
    seen = sizes.select("session_id", "stream", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().groupBy("session_id", "ip").agg(F.count("*").alias("n"))
    servers = seen.groupBy("session_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "ip")).getField("ip").alias("server_ip"))
    as_server = lambda c: F.when(F.col(c) == F.col("server_ip"), SERVER).otherwise(F.col(c))

    big = raw.groupBy("stream").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("stream")
    rows = raw.join(big, "stream").join(servers, "session_id").withColumns({c: as_server(c) for c in ("src_ip", "dst_ip")})
    ends = [F.struct(F.col(i).alias("ip"), F.col(p).alias("port")) for i, p in (("src_ip", "sport"), ("dst_ip", "dport"))]
    rows = rows.withColumn("a", F.least(*ends)).withColumn("b", F.greatest(*ends))
    talk = Window.partitionBy("session_id", "role", "a", "b").orderBy("t_us", "pkt_no")
    rows = rows.withColumn("cut", F.coalesce((F.col("t_us") - F.lag("t_us").over(talk) > QUIET_S * 1_000_000).cast("int"), F.lit(0)))
    rows = rows.withColumn("flow_id", number("session_id", "role", "a", "b", F.sum("cut").over(talk))).drop("cut", "server_ip")
    packets = materialize(rows)
    at_server = F.col("a.ip") == SERVER
    device, other = F.when(at_server, F.col("b")).otherwise(F.col("a")), F.when(at_server, F.col("a")).otherwise(F.col("b"))
    flows = packets.groupBy("session_id", "flow_id", "role", "a", "b").agg((F.min("t_us") / 1e6).alias("start_s"), (F.max("t_us") / 1e6).alias("end_s"))
    flows = flows.select("session_id", "flow_id", "role", device["ip"].alias("ip"), device["port"].alias("port"), other["ip"].alias("peer_ip"), other["port"].alias("peer_port"), "start_s", "end_s")

    said = sip_events(frames).join(where, "path").join(servers, "session_id", "left").withColumns({c: as_server(c) for c in ("src", "dst")})
    said = said.withColumn("call_id", F.concat_ws("/", F.col("session_id").cast("string"), "call_id")).withColumn("file", F.col("role"))
    said = materialize(said.select("session_id", "file", "frame_no", "call_id", "t_us", "method", "cseq", "cseq_method", "src", "dst", "body", "server_ip"))
    kept = signalling.message_dedupe(said).select(*signalling.KEY, "t_us", "file")
    once = said.groupBy(*signalling.KEY, "t_us", "file").agg(F.min(F.struct("frame_no", "session_id", "cseq_method", "body", "server_ip")).alias("m"))
    messages = once.join(kept, [*signalling.KEY, "t_us", "file"]).select(*signalling.KEY, "t_us", F.col("m.frame_no").alias("msg_no"), "m.session_id", "m.cseq_method", "m.body", "m.server_ip")
    messages = materialize(messages.withColumn("dialog_id", number("call_id")))
    spots = messages.select("session_id", "dialog_id", "server_ip", F.explode(media_sections(F.col("body"))).alias("m")).select("session_id", "dialog_id", "server_ip", "m.kind", F.col("m.addr").alias("ip"), "m.port")
    spots = spots.where("port > 0 and ip not in ('', '0.0.0.0') and kind in ('audio', 'video')").withColumn("ip", as_server("ip")).drop("server_ip").distinct()
    dialogs = messages.groupBy("session_id", "dialog_id").agg((F.min("t_us") / 1e6).alias("first_s"), (F.max("t_us") / 1e6).alias("last_s"))
    peers = messages.select("session_id", "dialog_id", F.explode(F.array("src", "dst")).alias("ip")).distinct()
    reports = rtcp_events(frames).join(where, "path").select("session_id", "kind", F.explode("reports").alias("r")).select("session_id", F.col("r.ssrc").alias("ssrc"), F.col("r.fraction_pct").alias("pct"))
    return Session(packets, messages, flows, packets.select("session_id", "flow_id", "ssrc").distinct(), dialogs, spots, peers, reports, raw)


def calls_of(s: Session) -> tuple[DataFrame, DataFrame]:
    """The calls, and their streams at each point.

    calls: session_id, call_id, caller_ip, callee_ip, direct, start_s, end_s, dialogs. streams: call_id, session_id, role, stream, ssrc, src_ip, dst_ip, packets, media, codec.
    """
    of_flow = materialize(assembly.leg_of_flow(s.flows, s.sources))
    legs = materialize(assembly.merged_legs(s.flows, s.sources))
    ends = s.ends.select("session_id", "dialog_id", "ip", "port").distinct()
    bonds = materialize(assembly.bound(legs, s.dialogs, ends, s.peers))
    of = materialize(assembly.call_of_leg(legs, bonds, ends))
    place = of_flow.join(of, "leg_id").select("flow_id", "call_id")

    n = s.packets.groupBy("session_id", "role", "flow_id", "stream", "ssrc", "src_ip", "sport", "dst_ip", "dport").agg(F.count("*").alias("packets"), F.min("pt").alias("pt"))
    kinds = s.ends.groupBy("session_id", F.col("ip").alias("at_ip"), F.col("port").alias("at_port")).agg(F.min("kind").alias("one"), F.max("kind").alias("other")).where("one = other").drop("other")
    side = lambda i, p, k: kinds.select("session_id", F.col("at_ip").alias(i), F.col("at_port").alias(p), F.col("one").alias(k))
    n = n.join(side("src_ip", "sport", "k1"), ["session_id", "src_ip", "sport"], "left").join(side("dst_ip", "dport", "k2"), ["session_id", "dst_ip", "dport"], "left")
    rates = streams.clock_rate(keyed(s.packets)).select(F.col("ssrc").alias("stream"), "clock_rate")
    n = n.join(rates, "stream", "left")
    by_clock = F.when(negotiation.in_bands(F.col("clock_rate"), negotiation.AUDIO_BANDS), "audio").when(negotiation.in_bands(F.col("clock_rate"), negotiation.VIDEO_BANDS), "video")
    by_type = F.when(F.col("pt").isin(AUDIO_PT), "audio").when(F.col("pt").between(96, 127), "video").otherwise("audio")
    static = F.create_map(*(F.lit(x) for k, v in STATIC_PT.items() for x in (k, v[0])))
    n = n.withColumn("media", F.coalesce("k1", "k2", by_clock, by_type)).withColumn("codec", F.try_element_at(static, F.col("pt").cast("int")))
    found = n.join(place, "flow_id").groupBy("call_id", "session_id", "role", "stream", "ssrc", "src_ip", "dst_ip", "media", "codec").agg(F.sum("packets").alias("packets"))
    found = materialize(found)

    # Who called whom: by the first INVITE and the device that answered it, else by where the devices were captured.
    told = bonds.join(of, "leg_id").select("call_id", "dialog_id").distinct().join(s.messages.drop("call_id"), "dialog_id")
    invite, answer = F.col("method") == "INVITE", (F.col("method") == "200") & (F.col("cseq_method") == "INVITE")
    first = lambda cond, c: F.min(F.when(cond & (F.col(c) != SERVER), F.struct("t_us", "msg_no", F.col(c).alias("ip")))).getField("ip")
    parties = told.groupBy("call_id").agg(first(invite, "src").alias("caller"), first(answer, "src").alias("answered"), first(invite, "dst").alias("invited"), F.count_distinct("dialog_id").alias("dialogs"))
    device = F.when(F.col("src_ip") != SERVER, F.col("src_ip")).otherwise(F.col("dst_ip"))
    most = lambda role: F.max(F.when(F.col("role") == role, F.struct("packets", F.col("device").alias("ip")))).getField("ip")
    shown = found.withColumn("device", device).groupBy("session_id", "call_id").agg(most("terminal").alias("t"), most("seat").alias("u"), F.bool_and((F.col("src_ip") != SERVER) & (F.col("dst_ip") != SERVER)).alias("direct"))
    spans = legs.join(of, "leg_id").groupBy("call_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    calls = shown.join(parties, "call_id", "left").join(spans, "call_id")
    caller, callee = F.coalesce("caller", "t"), F.coalesce("answered", "invited", "u")
    calls = calls.select("session_id", "call_id", caller.alias("caller_ip"), callee.alias("callee_ip"), "direct", "start_s", "end_s", F.coalesce("dialogs", F.lit(0)).alias("dialogs"))
    return materialize(calls), found


def keyed(packets: DataFrame) -> DataFrame:
    """Packets as the stream operators want them, a stream being its number."""
    return packets.select(F.lit("x").alias("role"), F.col("stream").alias("ssrc"), "seq", "rtp_ts", "pt", "t_us", "pkt_no")


def evidence_of(s: Session, calls: DataFrame, found: DataFrame) -> DataFrame:
    """What all checks say, in the form that the gates of `problems` take."""
    subject = F.concat_ws(" ", "role", hex_source(F.col("ssrc")))
    named = found.select("call_id", "media", "stream", "session_id", F.col("ssrc").alias("source"), subject.alias("subject"), "role").distinct()

    def row(df: DataFrame, check: str, **columns: Column) -> DataFrame:
        kinds = {"verdict": "string", "level": "string", "value": "double", "n": "long", "backward": "long", "duplicates": "long"}
        return df.select("call_id", "media", "subject", F.lit(check).alias("check_name"), *(columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    packets = keyed(s.packets)
    of = lambda df: df.drop("role").withColumnRenamed("ssrc", "stream").join(named, "stream")
    c = F.col
    rows = [
        row(of(streams.packet_loss(packets)), "loss", value=c("loss_pct"), n=c("lost")),
        row(of(streams.jitter(packets)), "jitter", value=c("std_ms")),
        row(of(streams.rtp_integrity(packets)), "order", backward=c("ts_backward"), duplicates=c("ts_duplicate")),
        row(of(streams.ts_continuity(packets)).where("media = 'audio'"), "continuity", n=c("jumps"), value=c("media_gap_ms"), backward=c("backward"), duplicates=c("duplicates")),
        row(named.join(s.reports.groupBy("session_id", c("ssrc").alias("source")).agg(F.max("pct").alias("pct")), ["session_id", "source"]), "reports", value=c("pct")),
        row(found.where("media = 'audio' and codec is not null").select("call_id", "media", "codec", subject.alias("subject")).distinct(), "codec", verdict=c("codec")),
    ]
    # The media itself: streams are told apart by a path made of their number.
    heard = media.audio_quality(s.packets.select(F.col("stream").cast("string").alias("path"), "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body"))
    heard = materialize(heard.withColumn("stream", F.col("path").cast("long")).drop("path", "ssrc"))
    finding = lambda when, verdict, level: F.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(level).alias("level")))
    findings = F.array_compact(
        F.array(
            finding(c("howling") > 0, "howling", "critical"), finding(c("hum") > 0, "hum", "warning"), finding((c("clip_runs") >= 2) | (c("clip_samples") > 200), "clipping", "warning"),
            finding(c("clicks") >= 3, "clicks", "warning"), finding(c("noise_db") > -40, "noise", "warning"), finding(c("silence") == "silent", "no_speech", "warning"),
        )
    )
    looked = heard.join(named, "stream").withColumn("f", F.explode_outer(findings))
    rows.append(row(looked, "quality", verdict=c("f.verdict"), level=c("f.level")))

    # The way of the media, in calls of which both ends are known.
    ways = calls.where("caller_ip is not null and callee_ip is not null").select("call_id", "caller_ip", "callee_ip", "direct")
    audio = found.where("media = 'audio'").groupBy("call_id", "role", "ssrc", "src_ip", "dst_ip").agg(F.sum("packets").alias("packets"))
    carried = s.packets.join(found.select("call_id", "stream").distinct(), "stream").select("call_id", "role", "ssrc", "seq", "pkt_no", "t_us")
    # A capture is a point of every call of its session that it could have seen.
    points = calls.select("session_id", "call_id").join(s.packets.select("session_id", "role").distinct(), "session_id").select("call_id", "role")
    sounds = heard.join(found.select("call_id", "role", "ssrc", "stream").distinct(), "stream").select("call_id", "role", "ssrc", F.col("silence").alias("sound"))
    way = lambda df, media_, **cols: df.select("call_id", F.lit(media_).cast("string").alias("media"), F.col("direction").alias("subject"), *(v.alias(k) for k, v in cols.items()))
    silence = paths.path_silence(ways, audio, points, sounds).where("verdict <> 'unknown'")
    rows.append(row(way(silence, None, v=c("verdict")), "silence", verdict=c("v")))
    segments = materialize(paths.delay_segments(ways, audio, carried))
    inside = segments.where("segment = 'server' and n is not null")
    rows.append(row(way(inside, None, x=c("mean_ms"), k=c("n")), "server", value=c("x"), n=c("k")))
    measured = segments.groupBy("call_id", "direction").agg(F.count("n").alias("k"), F.bool_or(c("status") == "high").alias("high")).where("k > 0")
    rows.append(row(way(measured, "audio", v=F.when(c("high"), "high").otherwise("ok")), "chain", verdict=c("v")))
    back = paths.round_trips(ways, audio, carried).select("call_id", F.lit("audio").alias("media"), c("device").alias("subject"), c("status").alias("v"))
    rows.append(row(back, "roundtrip", verdict=c("v")))
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def analyse(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, evidence, problems) of all sessions."""
    s = opened(frames)
    calls, found = calls_of(s)
    evidence = materialize(evidence_of(s, calls, found))
    return calls, evidence, problems.call_problems(evidence)
