"""The way of a call's media from who speaks to who listens: which streams carry it, where it is slow and where the sound is lost.

calls: call_id, caller_ip, callee_ip, direct (media between the devices). streams: call_id, role (capture point), ssrc, src_ip, dst_ip, packets, audio only.
points: call_id, role, the captures there are. packets: call_id, role, ssrc, seq, pkt_no, t_us. sounds: call_id, role, ssrc, sound. Each call has two directions, and each
direction a segment up to the server, one inside it and one down, or a single one if media goes direct. All calls are measured at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.modular import signed32
from callscope.operators.delay import TOLERANCE_US, next_at
from callscope.operators.streams import extended, upper_median
from callscope.plans.registry import query

SERVER = "192.0.2.1"
# Fixed values, milliseconds: spread of a segment, mean inside the server, there and back, and difference of clocks beyond which they stand out.
SPREAD_MS, SERVER_MS, RETURN_MS, CLOCK_MS = 150.0, 50.0, 300.0, 300.0
# Level of a packet with a voice, share of time below which hardly anyone speaks, longest gap that counts as silence, samples a second.
ACTIVE, SILENT_SHARE, MAX_GAP_S, RATE = 500, 0.02, 10, 8000

DIRECTIONS_SQL = """, dir AS (SELECT call_id, direct, d.*, CASE WHEN spk = 'terminal' THEN caller_ip ELSE callee_ip END AS spk_ip, CASE WHEN spk = 'terminal' THEN callee_ip ELSE caller_ip END AS lst_ip
      FROM path_calls CROSS JOIN (VALUES ('caller_to_callee', 'terminal', 'seat'), ('callee_to_caller', 'seat', 'terminal')) d(direction, spk, lst)),
    upc AS (SELECT dir.call_id, direction, s.ssrc, s.role, packets, CASE WHEN role = spk AND dst_ip = CASE WHEN direct THEN lst_ip ELSE '192.0.2.1' END THEN 0 WHEN role = spk AND direct THEN 1 WHEN role = 'fs' AND src_ip = spk_ip THEN 2 END AS pref FROM dir JOIN path_streams s ON s.call_id = dir.call_id),
    dnc AS (SELECT dir.call_id, direction, s.ssrc, s.role, packets, CASE WHEN role = lst AND src_ip = CASE WHEN direct THEN spk_ip ELSE '192.0.2.1' END THEN 0 WHEN role = lst AND direct THEN 1 WHEN role = 'fs' AND dst_ip = lst_ip THEN 2 END AS pref FROM dir JOIN path_streams s ON s.call_id = dir.call_id),
    up AS (SELECT call_id, direction, arg_min(ssrc, (pref, -packets, ssrc)) AS up_ssrc, arg_min(role, (pref, -packets, ssrc)) AS up_at FROM upc WHERE pref IS NOT NULL GROUP BY ALL),
    dn AS (SELECT call_id, direction, arg_min(ssrc, (pref, -packets, ssrc)) AS down_ssrc, arg_min(role, (pref, -packets, ssrc)) AS down_at FROM dnc WHERE pref IS NOT NULL GROUP BY ALL),
    pth AS (SELECT dir.*, up_ssrc, up_at, down_ssrc, down_at FROM dir LEFT JOIN up USING (call_id, direction) LEFT JOIN dn USING (call_id, direction) WHERE up_ssrc IS NOT NULL OR down_ssrc IS NOT NULL)"""


@query("fl9_path_streams", "path_calls", "path_streams", sql=DIRECTIONS_SQL + " SELECT call_id, direction, direct, spk, lst, up_ssrc, up_at, down_ssrc, down_at FROM pth")
def path_streams(calls: DataFrame, streams: DataFrame, server: str = SERVER) -> DataFrame:
    """For each direction of a call the stream that carries it up and the one that carries it down, and where they were seen.

    The speaker's own capture comes first, by where its packets go; in a direct call any of its streams; else the server's capture, by the
    speaker's address. The same for the listener, by where packets come from. Among several the one of most packets, then the smallest source.
    """
    way = lambda name, spk, lst, a, b: F.struct(F.lit(name).alias("direction"), F.lit(spk).alias("spk"), F.lit(lst).alias("lst"), F.col(a).alias("spk_ip"), F.col(b).alias("lst_ip"))
    ways = F.array(way("caller_to_callee", "terminal", "seat", "caller_ip", "callee_ip"), way("callee_to_caller", "seat", "terminal", "callee_ip", "caller_ip"))
    rows = calls.select("call_id", "direct", F.explode(ways).alias("w")).select("call_id", "direct", "w.*").join(streams, "call_id")
    at_server = lambda ip: F.when(F.col("direct"), F.col(ip)).otherwise(server)

    def pick(role: str, end: str, far: str, opposite: str, own: str) -> Column:
        there = F.col("role") == F.col(role)
        pref = F.when(there & (F.col(far) == at_server(opposite)), 0).when(there & F.col("direct"), 1).when((F.col("role") == "fs") & (F.col(end) == F.col(own)), 2)
        return F.min(F.when(pref.isNotNull(), F.struct(pref.alias("pref"), (-F.col("packets")).alias("n"), "ssrc", "role")))

    found = rows.groupBy("call_id", "direction", "direct", "spk", "lst").agg(pick("spk", "src_ip", "dst_ip", "lst_ip", "spk_ip").alias("u"), pick("lst", "dst_ip", "src_ip", "spk_ip", "lst_ip").alias("d"))
    out = found.select("call_id", "direction", "direct", "spk", "lst", F.col("u.ssrc").alias("up_ssrc"), F.col("u.role").alias("up_at"), F.col("d.ssrc").alias("down_ssrc"), F.col("d.role").alias("down_at"))
    return out.where("up_ssrc is not null or down_ssrc is not null")


SEGMENTS_SQL = DIRECTIONS_SQL + """, want AS (SELECT call_id, direction, 'direct' AS segment, coalesce(up_ssrc, down_ssrc) AS ssrc, spk AS a, lst AS b FROM pth WHERE direct
      UNION ALL SELECT call_id, direction, 'up', up_ssrc, spk, 'fs' FROM pth WHERE NOT direct UNION ALL SELECT call_id, direction, 'down', down_ssrc, 'fs', lst FROM pth WHERE NOT direct),
    frst AS (SELECT call_id, role, ssrc, seq, arg_min(t_us, pkt_no) AS t_us FROM path_packets GROUP BY ALL),
    x AS (SELECT w.call_id, direction, segment, (q.t_us - p.t_us) / CAST(1000 AS DOUBLE) AS d FROM want w JOIN frst p ON p.call_id = w.call_id AND p.role = w.a AND p.ssrc = w.ssrc JOIN frst q ON q.call_id = w.call_id AND q.role = w.b AND q.ssrc = w.ssrc AND q.seq = p.seq),
    med AS (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY call_id, direction, segment) AS m FROM x),
    crx AS (SELECT call_id, direction, segment, count(*) AS n, avg(d) AS mean_ms, max(m) AS offset_ms, quantile_cont(d, 0.95) AS p95_ms, quantile_cont(d - m, 0.95) AS spread_ms FROM med GROUP BY ALL),
    i AS (SELECT p.call_id, direction, (q.t_us - p.t_us) / CAST(1000 AS DOUBLE) AS d FROM (SELECT pth.call_id, direction, down_ssrc, t_us FROM pth JOIN path_packets k ON k.call_id = pth.call_id AND k.role = 'fs' AND k.ssrc = up_ssrc WHERE NOT direct) p
      ASOF JOIN (SELECT call_id, ssrc, t_us FROM path_packets WHERE role = 'fs') q ON q.call_id = p.call_id AND q.ssrc = p.down_ssrc AND p.t_us <= q.t_us),
    ins AS (SELECT call_id, direction, 'server' AS segment, count(*) AS n, avg(d) AS mean_ms, CAST(NULL AS DOUBLE) AS offset_ms, quantile_cont(d, 0.95) AS p95_ms, CAST(NULL AS DOUBLE) AS spread_ms FROM i WHERE d < 500 GROUP BY ALL),
    seg AS (SELECT call_id, direction, unnest(CASE WHEN direct THEN ['direct'] ELSE ['up', 'server', 'down'] END) AS segment FROM pth),
    sg AS (SELECT seg.*, n, mean_ms, offset_ms, p95_ms, spread_ms, CASE WHEN n IS NULL THEN 'missing' WHEN spread_ms > 150 OR (segment = 'server' AND mean_ms >= 50) THEN 'high' ELSE 'ok' END AS status, coalesce(abs(offset_ms) > 300, false) AS clocks_apart
      FROM seg LEFT JOIN (SELECT * FROM crx UNION ALL SELECT * FROM ins) m USING (call_id, direction, segment))"""


@query("rl15_delay_segments", "path_calls", "path_streams", "path_packets", doubles="mean_ms offset_ms p95_ms spread_ms", sql=SEGMENTS_SQL + " SELECT * FROM sg")
def delay_segments(calls: DataFrame, streams: DataFrame, packets: DataFrame, server: str = SERVER) -> DataFrame:
    """Each segment of each direction: mean and tail, the median as the estimate of the clocks' difference, and the spread without it.

    Between captures a packet is matched by its number, the first copy of each; inside the server each packet in goes with the first one out at or after it,
    up to half a second. A segment that can't be measured is missing.
    """
    paths = path_streams(calls, streams, server)
    part = lambda name, ssrc, a, b: F.struct(F.lit(name).alias("segment"), ssrc.alias("ssrc"), a.alias("a"), b.alias("b"))
    fs, spk, lst = F.lit("fs"), F.col("spk"), F.col("lst")
    none = F.lit(None).cast("long")
    relayed = F.array(part("up", F.col("up_ssrc"), spk, fs), part("server", none, fs, fs), part("down", F.col("down_ssrc"), fs, lst))
    whole = F.array(part("direct", F.coalesce("up_ssrc", "down_ssrc"), spk, lst))
    wanted = paths.select("call_id", "direction", "up_ssrc", "down_ssrc", F.explode(F.when(F.col("direct"), whole).otherwise(relayed)).alias("s")).select("call_id", "direction", "up_ssrc", "down_ssrc", "s.*")
    key = ["call_id", "direction", "segment"]

    first = packets.groupBy("call_id", "role", "ssrc", "seq").agg(F.min(F.struct("pkt_no", "t_us")).getField("t_us").alias("t_us"))
    side = lambda c, name: F.struct(F.col(c).alias("role"), F.lit(name).alias("side"))
    ends = wanted.where("ssrc is not null").select(*key, "ssrc", F.explode(F.array(side("a", "a"), side("b", "b"))).alias("e")).select(*key, "ssrc", "e.role", "e.side")
    seen = ends.join(first, ["call_id", "role", "ssrc"]).groupBy(*key, "seq").agg(*(F.min(F.when(F.col("side") == k, F.col("t_us"))).alias(k) for k in "ab"))
    apart = seen.where("a is not null and b is not null").select(*key, ((F.col("b") - F.col("a")) / 1000).alias("d"))
    middle = apart.groupBy(*key).agg(F.percentile("d", 0.5).alias("offset_ms"))
    crossing = apart.join(middle, key).groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_ms"), F.max("offset_ms").alias("offset_ms"), F.percentile("d", 0.95).alias("p95_ms"), F.percentile(F.col("d") - F.col("offset_ms"), 0.95).alias("spread_ms")
    )

    inside = wanted.where("segment = 'server' and up_ssrc is not null and down_ssrc is not null")
    there = packets.where("role = 'fs'").select("call_id", "ssrc", "t_us")
    into = inside.select(*key, F.col("up_ssrc").alias("ssrc"), F.lit("in").alias("side"))
    out = inside.select(*key, F.col("down_ssrc").alias("ssrc"), F.lit("out").alias("side"))
    passed = next_at(into.unionByName(out).join(there, ["call_id", "ssrc"]).select(*key, "side", "t_us"), key).where(F.col("next_us") - F.col("t_us") < TOLERANCE_US)
    passed = passed.withColumn("d", (F.col("next_us") - F.col("t_us")) / 1000).groupBy(*key).agg(F.count("*").alias("n"), F.avg("d").alias("mean_ms"), F.percentile("d", 0.95).alias("p95_ms"))
    measured = crossing.unionByName(passed, allowMissingColumns=True)

    high = (F.col("spread_ms") > SPREAD_MS) | ((F.col("segment") == "server") & (F.col("mean_ms") >= SERVER_MS))
    status = F.when(F.col("n").isNull(), "missing").when(high, "high").otherwise("ok")
    rows = wanted.select(*key).join(measured, key, "left")
    return rows.select(*key, "n", "mean_ms", "offset_ms", "p95_ms", "spread_ms", status.alias("status"), F.coalesce(F.abs("offset_ms") > CLOCK_MS, F.lit(False)).alias("clocks_apart"))


@query(
    "rl15_path_delays", "path_calls", "path_streams", "path_packets", doubles="total_ms",
    sql=SEGMENTS_SQL + """ SELECT call_id, direction, sum(mean_ms) AS total_ms, count(n) AS measured, count(*) AS segments,
      CASE WHEN count(n) = 0 THEN 'unavailable' WHEN bool_or(status = 'high') THEN 'high' WHEN count(n) < count(*) THEN 'partial' ELSE 'ok' END AS verdict, coalesce(string_agg(CASE WHEN status = 'high' THEN segment END, ',' ORDER BY segment), '') AS high FROM sg GROUP BY call_id, direction""",
)
def path_delays(calls: DataFrame, streams: DataFrame, packets: DataFrame, server: str = SERVER) -> DataFrame:
    """The delay of each direction and which segments stand out; the total holds the clocks' differences, too."""
    s = delay_segments(calls, streams, packets, server)
    n, all_ = F.count("n"), F.count("*")
    verdict = F.when(n == 0, "unavailable").when(F.bool_or(F.col("status") == "high"), "high").when(n < all_, "partial").otherwise("ok")
    high = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "high", F.col("segment")))), ",")
    return s.groupBy("call_id", "direction").agg(F.sum("mean_ms").alias("total_ms"), n.alias("measured"), all_.alias("segments"), verdict.alias("verdict"), high.alias("high"))


@query(
    "rl15_round_trips", "path_calls", "path_streams", "path_packets", doubles="return_ms",
    sql=SEGMENTS_SQL + """, e AS (SELECT call_id, segment, mean_ms, CASE WHEN (segment = 'up') = (direction = 'caller_to_callee') THEN 'caller' ELSE 'callee' END AS device FROM sg WHERE segment IN ('up', 'down') AND n IS NOT NULL)
    SELECT call_id, device, sum(mean_ms) AS return_ms, CASE WHEN sum(mean_ms) > 300 THEN 'high' ELSE 'ok' END AS status FROM e GROUP BY call_id, device HAVING count(*) = 2""",
)
def round_trips(calls: DataFrame, streams: DataFrame, packets: DataFrame, server: str = SERVER) -> DataFrame:
    """Each device's way to the server and back: one holds the clocks' difference with a plus, the other with a minus, so that their sum is free of it."""
    s = delay_segments(calls, streams, packets, server).where("segment in ('up', 'down') and n is not null")
    device = F.when((F.col("segment") == "up") == (F.col("direction") == "caller_to_callee"), "caller").otherwise("callee")
    both = s.groupBy("call_id", device.alias("device")).agg(F.sum("mean_ms").alias("return_ms"), F.count("*").alias("k")).where("k = 2")
    return both.select("call_id", "device", "return_ms", F.when(F.col("return_ms") > RETURN_MS, "high").otherwise("ok").alias("status"))


LEGS_SQL = DIRECTIONS_SQL + """, lg AS (SELECT call_id, direction, direct, spk, lst, 'direct' AS leg, coalesce(up_ssrc, down_ssrc) AS ssrc, up_ssrc IS NOT NULL AND up_at IN (spk, lst) AS at_device, spk AS a, lst AS b FROM pth WHERE direct
      UNION ALL SELECT call_id, direction, direct, spk, lst, 'up', up_ssrc, up_ssrc IS NOT NULL AND up_at IN (spk, lst), spk, 'fs' FROM pth WHERE NOT direct UNION ALL SELECT call_id, direction, direct, spk, lst, 'down', down_ssrc, false, 'fs', lst FROM pth WHERE NOT direct),
    st AS (SELECT lg.*, pa.role IS NOT NULL AS has_a, CASE WHEN pa.role IS NOT NULL THEN sa.ssrc IS NOT NULL END AS sent, CASE WHEN pb.role IS NOT NULL THEN sb.ssrc IS NOT NULL END AS arrived, ga.sound AS va, gb.sound AS vb
      FROM lg LEFT JOIN path_points pa ON pa.call_id = lg.call_id AND pa.role = a LEFT JOIN path_points pb ON pb.call_id = lg.call_id AND pb.role = b
      LEFT JOIN path_streams sa ON sa.call_id = lg.call_id AND sa.role = a AND sa.ssrc = lg.ssrc LEFT JOIN path_streams sb ON sb.call_id = lg.call_id AND sb.role = b AND sb.ssrc = lg.ssrc
      LEFT JOIN path_sounds ga ON ga.call_id = lg.call_id AND ga.role = a AND ga.ssrc = lg.ssrc LEFT JOIN path_sounds gb ON gb.call_id = lg.call_id AND gb.role = b AND gb.ssrc = lg.ssrc),
    ls AS (SELECT *, CASE WHEN ssrc IS NULL THEN CASE WHEN has_a THEN 'no_source' ELSE 'unknown' END WHEN va = 'silent' AND at_device THEN 'silent_source' WHEN sent AND NOT arrived THEN 'blocked'
      WHEN va = 'silent' OR vb = 'silent' THEN 'silent_path' WHEN va IN ('normal', 'sparse') OR vb IN ('normal', 'sparse') THEN 'ok' ELSE 'unknown' END AS status FROM st)"""


@query("rl14_path_legs", "path_calls", "path_streams", "path_points", "path_sounds", sql=LEGS_SQL + " SELECT call_id, direction, leg, ssrc, CASE WHEN ssrc IS NOT NULL THEN sent END AS sent, CASE WHEN ssrc IS NOT NULL THEN arrived END AS arrived, status FROM ls")
def path_legs(calls: DataFrame, streams: DataFrame, points: DataFrame, sounds: DataFrame, server: str = SERVER) -> DataFrame:
    """Each leg of each direction: whether its stream was sent and arrived, and what became of the sound.

    blocked: sent, but not seen at the next point. silent_source: silent where the speaker's device sends it. silent_path: silent at either end of the leg.
    no_source: nothing sent, though the point was captured. unknown: not enough captures, or sound that can't be decoded.
    """
    paths = path_streams(calls, streams, server)
    at_device = F.col("up_ssrc").isNotNull() & ((F.col("up_at") == F.col("spk")) | (F.col("up_at") == F.col("lst")))
    part = lambda name, ssrc, own, a, b: F.struct(F.lit(name).alias("leg"), ssrc.alias("ssrc"), own.alias("at_device"), a.alias("a"), b.alias("b"))
    fs, spk, lst = F.lit("fs"), F.col("spk"), F.col("lst")
    relayed = F.array(part("up", F.col("up_ssrc"), at_device, spk, fs), part("down", F.col("down_ssrc"), F.lit(False), fs, lst))
    whole = F.array(part("direct", F.coalesce("up_ssrc", "down_ssrc"), at_device, spk, lst))
    legs = paths.select("call_id", "direction", F.explode(F.when(F.col("direct"), whole).otherwise(relayed)).alias("l")).select("call_id", "direction", "l.*")
    # One row for each point that a call was captured at, with the streams and sounds there: a call has three points at most, its streams are few.
    for k in "ab":
        legs = legs.join(points.select("call_id", F.col("role").alias(k), F.lit(True).alias(f"has_{k}")), ["call_id", k], "left")
        here = streams.select("call_id", F.col("role").alias(k), "ssrc", F.lit(True).alias(f"in_{k}")).join(sounds.select("call_id", F.col("role").alias(k), "ssrc", F.col("sound").alias(f"v{k}")), ["call_id", k, "ssrc"], "left")
        legs = legs.join(here, ["call_id", k, "ssrc"], "left")
    seen = lambda k: F.when(F.col(f"has_{k}"), F.coalesce(f"in_{k}", F.lit(False)))
    either = lambda *sounds: F.coalesce(F.col("va").isin(*sounds), F.lit(False)) | F.coalesce(F.col("vb").isin(*sounds), F.lit(False))
    status = (
        F.when(F.col("ssrc").isNull(), F.when(F.col("has_a"), "no_source").otherwise("unknown"))
        .when((F.col("va") == "silent") & F.col("at_device"), "silent_source")
        .when(seen("a") & ~seen("b"), "blocked")
        .when(either("silent"), "silent_path")
        .when(either("normal", "sparse"), "ok")
        .otherwise("unknown")
    )
    return legs.select("call_id", "direction", "leg", "ssrc", F.when(F.col("ssrc").isNotNull(), seen("a")).alias("sent"), F.when(F.col("ssrc").isNotNull(), seen("b")).alias("arrived"), status.alias("status"))


@query(
    "rl14_path_silence", "path_calls", "path_streams", "path_points", "path_sounds",
    sql=LEGS_SQL + """, v AS (SELECT call_id, direction, direct, max(CASE WHEN leg <> 'down' THEN status END) AS u, max(CASE WHEN leg = 'down' THEN status END) AS d FROM ls GROUP BY ALL)
    SELECT call_id, direction, CASE WHEN direct THEN u WHEN u = 'blocked' OR d = 'blocked' THEN 'blocked' WHEN u = 'no_source' THEN 'no_source' WHEN d = 'no_source' THEN 'blocked'
      WHEN u = 'silent_source' OR d = 'silent_source' THEN 'silent_source' WHEN u = 'silent_path' OR d = 'silent_path' THEN 'silent_path' WHEN u = 'unknown' OR d = 'unknown' THEN 'unknown' ELSE 'ok' END AS verdict,
      CASE WHEN NOT direct AND (u = 'blocked' OR d = 'blocked') THEN CASE WHEN u = 'blocked' AND d = 'blocked' THEN 'up,down' WHEN u = 'blocked' THEN 'up' ELSE 'down' END WHEN NOT direct AND u <> 'no_source' AND d = 'no_source' THEN 'down' WHEN direct AND u = 'blocked' THEN 'direct' ELSE '' END AS broken_at FROM v""",
)
def path_silence(calls: DataFrame, streams: DataFrame, points: DataFrame, sounds: DataFrame, server: str = SERVER) -> DataFrame:
    """Where the sound of a direction is lost, in the order of its way: broken, never sent, not passed on, silent at its source or on the way."""
    legs = path_legs(calls, streams, points, sounds, server)
    up, down = F.max(F.when(F.col("leg") != "down", F.col("status"))), F.max(F.when(F.col("leg") == "down", F.col("status")))
    v = legs.groupBy("call_id", "direction").agg(up.alias("u"), down.alias("d"))
    u, d = F.col("u"), F.coalesce("d", F.lit("ok"))
    either = lambda s: (u == s) | (d == s)
    direct = F.col("d").isNull()
    verdict = (
        F.when(direct, u).when(either("blocked"), "blocked").when(u == "no_source", "no_source").when(d == "no_source", "blocked")
        .when(either("silent_source"), "silent_source").when(either("silent_path"), "silent_path").when(either("unknown"), "unknown").otherwise("ok")
    )
    dead = F.concat_ws(",", F.when(u == "blocked", F.when(direct, "direct").otherwise("up")), F.when(d == "blocked", "down"))
    broken = F.when(dead != "", dead).when((u != "no_source") & (d == "no_source"), "down").otherwise("")
    return v.select("call_id", "direction", verdict.alias("verdict"), broken.alias("broken_at"))


@query(
    "ds10_activity", "levels", doubles="active_share",
    sql=""", s AS (SELECT *, seq - lag(seq) OVER w AS dq FROM levels WINDOW w AS (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)),
    x AS (SELECT *, sum(coalesce(CASE WHEN dq > 32767 THEN dq - 65536 WHEN dq < -32768 THEN dq + 65536 ELSE dq END, seq)) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS ext FROM s),
    o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY role, ssrc, ext ORDER BY pkt_no) = 1),
    m AS (SELECT role, ssrc, arg_min(pt, (-n, pt)) AS main FROM (SELECT role, ssrc, pt, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT o.*, main, ((rtp_ts - lag(rtp_ts) OVER (PARTITION BY o.role, o.ssrc ORDER BY ext) + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS d FROM o JOIN m ON m.role = o.role AND m.ssrc = o.ssrc),
    p AS (SELECT role, ssrc, list_sort(list(d) FILTER (d > 0)) AS ds FROM g GROUP BY role, ssrc),
    q AS (SELECT role, ssrc, CASE WHEN ds[len(ds) // 2 + 1] BETWEEN 1 AND 4000 THEN ds[len(ds) // 2 + 1] ELSE 160 END AS spp FROM p),
    t AS (SELECT g.role, g.ssrc, spp, pt = main AND level >= 500 AS on_, CASE WHEN d - spp BETWEEN 1 AND 80000 THEN d - spp ELSE 0 END AS gap FROM g JOIN q ON q.role = g.role AND q.ssrc = g.ssrc),
    a AS (SELECT role, ssrc, max(spp) AS packet_samples, CAST(coalesce(sum(spp) FILTER (on_), 0) AS BIGINT) AS speech, CAST(sum(gap) + sum(spp) AS BIGINT) AS media FROM t GROUP BY ALL)
    SELECT role, ssrc, packet_samples, speech AS speech_samples, media AS media_samples, speech / CAST(media AS DOUBLE) AS active_share, CASE WHEN speech / CAST(media AS DOUBLE) >= 0.02 THEN 'normal' WHEN speech > 0 THEN 'sparse' ELSE 'silent' END AS sound FROM a""",
)
def activity(levels: DataFrame) -> DataFrame:
    """Share of each stream's media time with a voice. Time goes by the sender's clock, so that what a sender leaves out when nobody speaks is silence.

    levels: role, ssrc, seq, rtp_ts, pt, t_us, pkt_no, level (root mean square of a packet). Packets of other types than the main one are silence; a leap of the
    clock of over 10 s is a restart, not silence. Rows stay spread by stream; the length of a packet comes from an exact percentile.
    """
    of = ["role", "ssrc"]
    once = extended(levels).groupBy(*of, "ext").agg(F.min(F.struct("pkt_no", "rtp_ts", "pt", "level")).alias("p")).select(*of, "ext", "p.rtp_ts", "p.pt", "p.level")
    counts = once.groupBy(*of, "pt").agg(F.count("*").alias("n"))
    main = counts.groupBy(*of).agg(F.min(F.struct((-F.col("n")).alias("n"), "pt")).getField("pt").alias("main"))
    steps = once.withColumn("d", signed32("rtp_ts", F.lag("rtp_ts").over(Window.partitionBy(*of).orderBy("ext"))))
    middle = upper_median(steps.where("d > 0"), of, "d").withColumnRenamed("upper_median", "m")
    size = F.when(F.col("m").between(1, RATE // 2), F.col("m")).otherwise(160)
    rows = steps.join(main, of).join(middle, of, "left").withColumn("size", size)
    gap = F.col("d") - F.col("size")
    on = (F.col("pt") == F.col("main")) & (F.col("level") >= ACTIVE)
    sums = rows.groupBy(*of).agg(
        F.max("size").alias("packet_samples"), F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0)).cast("long").alias("speech_samples"),
        F.sum(F.col("size") + F.when((gap > 0) & (gap <= MAX_GAP_S * RATE), gap).otherwise(0)).cast("long").alias("media_samples"),
    )
    share = F.col("speech_samples") / F.col("media_samples")
    return sums.withColumn("active_share", share).withColumn("sound", F.when(share >= SILENT_SHARE, "normal").when(share > 0, "sparse").otherwise("silent"))
