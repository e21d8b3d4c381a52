"""Whether a call's media passes the server both ways, and what that says about where to look.

calls: call_no, caller_ip, callee_ip (null if not known). streams: call_no, stream, src_ip, dst_ip, media, packets, start_s, end_s, between devices and the server.
announced: call_no, side, ip, media addresses that a side's dialogs announced. agreed: call_no, side, media, what each side negotiated; a side without rows isn't known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.sip_messages import media_sections
from callscope.plans.registry import query
from callscope.work import materialize

SERVER = "192.0.2.1"
KINDS = ("audio", "video")
# Seconds of media sent down, and times the media that came up, beyond which most of it can't have been passed on.
LONG_S, TIMES = 30, 4

SIDES_SQL = """, sd AS (SELECT call_no, 'caller' AS side, caller_ip AS ip, callee_ip AS other FROM relay_calls WHERE caller_ip IS NOT NULL UNION ALL SELECT call_no, 'callee', callee_ip, caller_ip FROM relay_calls WHERE callee_ip IS NOT NULL),
    al AS (SELECT DISTINCT a.call_no, a.side, sd.ip AS party_ip, a.ip AS alias_ip FROM relay_announced a JOIN sd ON sd.call_no = a.call_no AND sd.side = a.side WHERE a.ip <> '192.0.2.1' AND a.ip <> sd.ip AND a.ip IS DISTINCT FROM sd.other)"""


def sides(calls: DataFrame) -> DataFrame:
    """(call_no, side, ip, other): the two devices of each call, as far as they are known."""
    side = lambda name, own, other: F.struct(F.lit(name).alias("side"), F.col(own).alias("ip"), F.col(other).alias("other"))
    both = F.array(side("caller", "caller_ip", "callee_ip"), side("callee", "callee_ip", "caller_ip"))
    return calls.select("call_no", F.explode(both).alias("s")).select("call_no", "s.*").where("ip is not null")


@query("rl11_aliases", "relay_calls", "relay_announced", sql=SIDES_SQL + " SELECT * FROM al")
def aliases(calls: DataFrame, announced: DataFrame, server: str = SERVER) -> DataFrame:
    """Second addresses of a call's devices: what a side announces that is neither its own address, the server's, nor the other side's."""
    a = announced.select("call_no", "side", F.col("ip").alias("alias_ip")).join(sides(calls), ["call_no", "side"])
    own = (F.col("alias_ip") != server) & (F.col("alias_ip") != F.col("ip")) & ~F.col("alias_ip").eqNullSafe(F.col("other"))
    return a.where(own).select("call_no", "side", F.col("ip").alias("party_ip"), "alias_ip").distinct()


MATRIX_SQL = SIDES_SQL + """, dv AS (SELECT call_no, CASE WHEN src_ip = '192.0.2.1' THEN 'down' ELSE 'up' END AS way, CASE WHEN src_ip = '192.0.2.1' THEN dst_ip ELSE src_ip END AS ip, media, packets, start_s, end_s FROM relay_streams WHERE (src_ip = '192.0.2.1') <> (dst_ip = '192.0.2.1')),
    fo AS (SELECT dv.call_no, way, coalesce(al.party_ip, dv.ip) AS ip, media, packets, start_s, end_s FROM dv LEFT JOIN al ON al.call_no = dv.call_no AND al.alias_ip = dv.ip),
    mx AS (SELECT sd.call_no, sd.side, sd.ip, CAST(coalesce(sum(packets) FILTER (way = 'up' AND media = 'audio'), 0) AS BIGINT) AS audio_up, CAST(coalesce(sum(packets) FILTER (way = 'down' AND media = 'audio'), 0) AS BIGINT) AS audio_down,
      CAST(coalesce(sum(packets) FILTER (way = 'up' AND media = 'video'), 0) AS BIGINT) AS video_up, CAST(coalesce(sum(packets) FILTER (way = 'down' AND media = 'video'), 0) AS BIGINT) AS video_down,
      CAST(coalesce(max(end_s) FILTER (way = 'down' AND media = 'audio') - min(start_s) FILTER (way = 'down' AND media = 'audio'), 0) AS BIGINT) AS audio_down_s, CAST(coalesce(max(end_s) FILTER (way = 'down' AND media = 'video') - min(start_s) FILTER (way = 'down' AND media = 'video'), 0) AS BIGINT) AS video_down_s
      FROM sd LEFT JOIN fo ON fo.call_no = sd.call_no AND fo.ip = sd.ip GROUP BY ALL)"""


@query("ag14_relay_matrix", "relay_calls", "relay_streams", "relay_announced", sql=MATRIX_SQL + " SELECT * FROM mx")
def relay_matrix(calls: DataFrame, streams: DataFrame, announced: DataFrame, server: str = SERVER) -> DataFrame:
    """Packets of each kind that each device of a call sends to the server and gets from it, second addresses counted with the first, and how long it was sent to."""
    return matrix(calls, folded(streams, aliases(calls, announced, server), server))


def folded(streams: DataFrame, named: DataFrame, server: str) -> DataFrame:
    """Streams to and from the server, by the device's own address; `second` is the side whose second address it is, if it is one."""
    down = F.col("src_ip") == server
    here = streams.where(down != (F.col("dst_ip") == server)).withColumn("way", F.when(down, "down").otherwise("up")).withColumn("at", F.when(down, F.col("dst_ip")).otherwise(F.col("src_ip")))
    known = named.select("call_no", F.col("alias_ip").alias("at"), "party_ip", F.col("side").alias("second"))
    return here.join(known, ["call_no", "at"], "left").select("call_no", F.coalesce("party_ip", "at").alias("ip"), "second", "way", "media", "packets", "start_s", "end_s")


def matrix(calls: DataFrame, of_device: DataFrame) -> DataFrame:
    of = lambda way, kind: (F.col("way") == way) & (F.col("media") == kind)
    counts = [F.coalesce(F.sum(F.when(of(w, k), F.col("packets"))), F.lit(0)).cast("long").alias(f"{k}_{w}") for k in KINDS for w in ("up", "down")]
    spans = [F.coalesce(F.max(F.when(of("down", k), F.col("end_s"))) - F.min(F.when(of("down", k), F.col("start_s"))), F.lit(0)).cast("long").alias(f"{k}_down_s") for k in KINDS]
    rows = sides(calls).select("call_no", "side", "ip").join(of_device.drop("second"), ["call_no", "ip"], "left")
    return rows.groupBy("call_no", "side", "ip").agg(*counts, *spans)


REDIRECT_SQL = """, rd AS (SELECT call_no, call_id, msg_no, t_us, method, dst, body FROM offers WHERE src = '192.0.2.1' AND body <> ''),
    sp AS (SELECT call_no, call_id, msg_no, t_us, method, dst, coalesce(nullif(regexp_extract(sec, 'c=IN IP4 (\\S+)', 1), ''), regexp_extract(head, 'c=IN IP4 (\\S+)', 1)) AS addr, CAST(regexp_extract(sec, '^\\w+ (\\d+)', 1) AS INTEGER) AS port
      FROM (SELECT *, p[1] AS head, unnest(p[2:]) AS sec FROM (SELECT *, string_split(replace(body, chr(13), ''), chr(10) || 'm=') AS p FROM rd))),
    mv AS (SELECT sp.call_no, call_id, msg_no, t_us, method, dst, array_to_string(list_sort(list(DISTINCT addr)), ',') AS targets FROM sp JOIN (SELECT DISTINCT call_no, ip FROM (SELECT call_no, src_ip AS ip FROM relay_streams UNION SELECT call_no, dst_ip FROM relay_streams) WHERE ip <> '192.0.2.1') d
      ON d.call_no = sp.call_no AND d.ip = sp.addr WHERE port > 0 GROUP BY ALL)"""


@query("rl5_media_redirects", "offers", "relay_streams", sql=REDIRECT_SQL + " SELECT call_no, call_id, msg_no, t_us, method, dst, targets FROM mv")
def media_redirects(messages: DataFrame, streams: DataFrame, server: str = SERVER) -> DataFrame:
    """Messages in which the server announces a device of the call in place of itself: from then on media goes past it."""
    devices = streams.select("call_no", F.explode(F.array("src_ip", "dst_ip")).alias("addr")).where(F.col("addr") != server).distinct()
    said = messages.where((F.col("src") == server) & (F.col("body") != "")).select("call_no", "call_id", "msg_no", "t_us", "method", "dst", F.explode(media_sections(F.col("body"))).alias("m"))
    said = said.where("m.port > 0 and m.addr not in ('', '0.0.0.0')").withColumn("addr", F.col("m.addr")).drop("m")
    hits = said.join(devices, ["call_no", "addr"]).groupBy("call_no", "call_id", "msg_no", "t_us", "method", "dst")
    return hits.agg(F.array_join(F.array_sort(F.collect_set("addr")), ",").alias("targets"))


WANT_SQL = MATRIX_SQL + REDIRECT_SQL + """, wt AS (SELECT mx.*, (SELECT count(*) FROM relay_agreed g WHERE g.call_no = mx.call_no AND g.side = mx.side) = 0 AS open_, EXISTS (SELECT 1 FROM relay_agreed g WHERE g.call_no = mx.call_no AND g.side = mx.side AND g.media = 'audio') AS wa,
      EXISTS (SELECT 1 FROM relay_agreed g WHERE g.call_no = mx.call_no AND g.side = mx.side AND g.media = 'video') AS wv FROM mx),
    pr AS (SELECT a.*, b.call_no IS NOT NULL AS paired, coalesce(b.audio_up, 0) AS peer_audio, coalesce(b.video_up, 0) AS peer_video FROM wt a LEFT JOIN wt b ON b.call_no = a.call_no AND b.side <> a.side)"""


def expected(calls: DataFrame, of_device: DataFrame, agreed: DataFrame) -> DataFrame:
    """The matrix, made once, with what the other device sends up and whether a side expects each kind of media."""
    wants = agreed.groupBy("call_no", "side").agg(*(F.bool_or(F.col("media") == k).alias(f"wants_{k}") for k in KINDS))
    m = materialize(matrix(calls, of_device))
    flip = F.when(F.col("side") == "caller", "callee").otherwise("caller")
    peer = m.select("call_no", flip.alias("side"), F.lit(True).alias("paired"), *(F.col(f"{k}_up").alias(f"peer_{k}") for k in KINDS))
    out = m.join(wants, ["call_no", "side"], "left").join(peer, ["call_no", "side"], "left")
    return out.fillna(True, [f"wants_{k}" for k in KINDS]).fillna(0, [f"peer_{k}" for k in KINDS]).fillna(False, ["paired"])


@query(
    "rl8_relay_verdict", "relay_calls", "relay_streams", "relay_announced", "relay_agreed", "offers",
    sql=WANT_SQL + """, md AS (SELECT *, audio_up + video_up > 0 AS sends, (audio_down = 0 AND peer_audio > 0 AND (open_ OR wa)) AS ma, (video_down = 0 AND peer_video > 0 AND (open_ OR wv)) AS mv_ FROM pr),
    v AS (SELECT call_no, count(*) AS devices, count(*) FILTER (sends) AS senders, 
      coalesce(string_agg(CASE WHEN ma THEN side || ':audio' END, ',' ORDER BY side), '') AS x, coalesce(string_agg(CASE WHEN mv_ THEN side || ':video' END, ',' ORDER BY side), '') AS y, coalesce(bool_or(ma OR mv_), false) AS missing FROM md GROUP BY call_no)
    SELECT v.call_no, CASE WHEN r.call_no IS NOT NULL THEN 'redirected' WHEN senders = 0 THEN 'no_relay' WHEN senders < devices THEN 'partial_uplink' WHEN missing THEN 'partial_downlink' ELSE 'relayed' END AS verdict,
      CASE WHEN r.call_no IS NULL AND senders = devices THEN CASE WHEN x <> '' AND y <> '' THEN x || ',' || y ELSE x || y END ELSE '' END AS missing FROM v LEFT JOIN (SELECT DISTINCT call_no FROM mv) r ON r.call_no = v.call_no""",
)
def relay_verdict(calls: DataFrame, streams: DataFrame, announced: DataFrame, agreed: DataFrame, messages: DataFrame, server: str = SERVER) -> DataFrame:
    """Redirected past the server, not relayed at all, sent by one side only, not passed on to a side that expects it, or relayed."""
    m = expected(calls, folded(streams, aliases(calls, announced, server), server), agreed)
    lacks = lambda k: (F.col(f"{k}_down") == 0) & (F.col(f"peer_{k}") > 0) & F.col(f"wants_{k}")
    gone = [F.array_join(F.array_sort(F.collect_list(F.when(lacks(k), F.concat("side", F.lit(f":{k}"))))), ",") for k in KINDS]
    v = m.groupBy("call_no").agg(F.count("*").alias("devices"), F.count_if(F.col("audio_up") + F.col("video_up") > 0).alias("senders"), gone[0].alias("x"), gone[1].alias("y"))
    away = media_redirects(messages, streams, server).select("call_no", F.lit(True).alias("away")).distinct()
    v = v.join(away, "call_no", "left")
    missing = F.concat_ws(",", F.nullif("x", F.lit("")), F.nullif("y", F.lit("")))
    verdict = F.when(F.col("away"), "redirected").when(F.col("senders") == 0, "no_relay").when(F.col("senders") < F.col("devices"), "partial_uplink").when(missing != "", "partial_downlink").otherwise("relayed")
    whole = F.col("away").isNull() & (F.col("senders") == F.col("devices"))
    return v.select("call_no", verdict.alias("verdict"), F.when(whole, missing).otherwise("").alias("missing"))


@query(
    "rl8_relay_notes", "relay_calls", "relay_streams", "relay_announced", "relay_agreed", "offers",
    sql=WANT_SQL + """, e AS (SELECT call_no, side, 'audio' AS media, audio_down AS down, audio_down_s AS span, peer_audio AS peer, open_ OR wa AS wants FROM pr WHERE paired UNION ALL SELECT call_no, side, 'video', video_down, video_down_s, peer_video, open_ OR wv FROM pr WHERE paired)
    SELECT call_no, side, media, CASE WHEN down = 0 THEN 'not_passed_on' WHEN peer = 0 THEN 'local_source' ELSE 'mostly_local' END AS note, down, peer FROM e WHERE (down = 0 AND peer > 0 AND wants) OR (down > 0 AND (peer = 0 OR (span > 30 AND down > 4 * peer)))
    UNION ALL SELECT dv.call_no, al.side, media, 'second_address', CAST(sum(packets) AS BIGINT), CAST(NULL AS BIGINT) FROM dv JOIN al ON al.call_no = dv.call_no AND al.alias_ip = dv.ip WHERE way = 'down' GROUP BY ALL""",
)
def relay_notes(calls: DataFrame, streams: DataFrame, announced: DataFrame, agreed: DataFrame, messages: DataFrame, server: str = SERVER) -> DataFrame:
    """What doesn't add up between what comes up and what goes down, for each device and kind of media.

    not_passed_on: the other side sends it, this one never gets it. local_source: it gets what nobody sent (a tone or an announcement). mostly_local: far
    more than was sent. second_address: the server sends to another address of the device than it sends from.
    """
    of_device = materialize(folded(streams, aliases(calls, announced, server), server))
    m = expected(calls, of_device, agreed).where("paired")
    each = F.array(*(F.struct(F.lit(k).alias("media"), F.col(f"{k}_down").alias("down"), F.col(f"{k}_down_s").alias("span"), F.col(f"peer_{k}").alias("peer"), F.col(f"wants_{k}").alias("wants")) for k in KINDS))
    e = m.select("call_no", "side", F.explode(each).alias("e")).select("call_no", "side", "e.*")
    note: Column = F.when(F.col("down") == 0, F.when((F.col("peer") > 0) & F.col("wants"), "not_passed_on")).when(F.col("peer") == 0, "local_source").when((F.col("span") > LONG_S) & (F.col("down") > TIMES * F.col("peer")), "mostly_local")
    found = e.select("call_no", "side", "media", note.alias("note"), "down", "peer").where("note is not null")
    sent = of_device.where("way = 'down' and second is not null").groupBy("call_no", F.col("second").alias("side"), "media").agg(F.sum("packets").cast("long").alias("down"))
    second = sent.select("call_no", "side", "media", F.lit("second_address").alias("note"), "down", F.lit(None).cast("long").alias("peer"))
    return found.unionByName(second)
