"""Delay inside the server and between captures."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.operators.folds import sorted_fold, spread
from callscope.operators.streams import OFFSET_MS, STAT_SQL, statistics
from callscope.plans.registry import query

TOLERANCE_US = 500_000
STATS = "mean_ms median_ms p95_ms p99_ms min_ms max_ms std_ms"

CROSS_SQL = """, x AS (SELECT a.ssrc, (b.t_us - a.t_us) / CAST(1000 AS DOUBLE) AS x FROM pkt a JOIN pkt_fs b ON a.ssrc = b.ssrc AND a.seq = b.seq)"""


def cross_delays(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signed delay of each packet seen in both captures."""
    later = b.select("ssrc", "seq", F.col("t_us").alias("t2"))
    return a.join(later, ["ssrc", "seq"]).select("ssrc", "seq", ((F.col("t2") - F.col("t_us")) / 1000).alias("delay_ms"))


@query("jn1_cross_capture_delay", "pkt", "pkt_fs", doubles=STATS, sql=CROSS_SQL + f" SELECT ssrc, {STAT_SQL} FROM x GROUP BY ssrc")
def cross_capture_delay(a: DataFrame, b: DataFrame) -> DataFrame:
    return cross_delays(a, b).groupBy("ssrc").agg(*statistics("delay_ms"))


@query(
    "ag4_detrended_delay", "pkt", "pkt_fs", doubles="offset_ms mean_ms std_ms p95_ms p99_ms",
    sql=CROSS_SQL + """, m AS (SELECT ssrc, quantile_cont(x, 0.5) AS m FROM x GROUP BY ssrc)
    SELECT x.ssrc, max(m) AS offset_ms, avg(x - m) AS mean_ms, stddev_pop(x - m) AS std_ms, quantile_cont(x - m, 0.95) AS p95_ms, quantile_cont(x - m, 0.99) AS p99_ms
    FROM x JOIN m ON x.ssrc = m.ssrc GROUP BY x.ssrc""",
)
def detrended_delay(a: DataFrame, b: DataFrame) -> DataFrame:
    """The clocks' offset (median delay) and what remains of the delays without it."""
    d = cross_delays(a, b)
    offset = d.groupBy("ssrc").agg(F.percentile("delay_ms", 0.5).alias("offset_ms"))
    rest = d.join(offset, "ssrc").withColumn("r", F.col("delay_ms") - F.col("offset_ms"))
    return rest.groupBy("ssrc").agg(
        F.max("offset_ms").alias("offset_ms"), F.avg("r").alias("mean_ms"), F.stddev_pop("r").alias("std_ms"),
        F.percentile("r", 0.95).alias("p95_ms"), F.percentile("r", 0.99).alias("p99_ms"),
    )


@query(
    "ag7_clock_offsets", "pkt", "pkt_fs", doubles="largest_ms",
    sql=CROSS_SQL + """, m AS (SELECT ssrc, quantile_cont(x, 0.5) AS m FROM x GROUP BY ssrc)
    SELECT count(*) AS streams, max(abs(m)) AS largest_ms, max(abs(m)) > 500 AS warning FROM m""",
)
def clock_offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    m = cross_delays(a, b).groupBy("ssrc").agg(F.abs(F.percentile("delay_ms", 0.5)).alias("m"))
    return m.agg(F.count("*").alias("streams"), F.max("m").alias("largest_ms"), (F.max("m") > OFFSET_MS).alias("warning"))


@query(
    "ag8_end_to_end", "pkt", "pkt_fs", doubles="mean_ms p95_ms p99_ms",
    sql=CROSS_SQL + " SELECT avg(x) + 4 AS mean_ms, quantile_cont(x, 0.95) + 4 AS p95_ms, quantile_cont(x, 0.99) + 4 AS p99_ms FROM x",
)
def end_to_end(a: DataFrame, b: DataFrame, local_ms: float = 2.0) -> DataFrame:
    """End-to-end estimate: the delay between captures and a fixed local share at both ends."""
    d = cross_delays(a, b)
    more = F.lit(2 * local_ms)
    return d.agg((F.avg("delay_ms") + more).alias("mean_ms"), (F.percentile("delay_ms", 0.95) + more).alias("p95_ms"), (F.percentile("delay_ms", 0.99) + more).alias("p99_ms"))


def next_at(rows: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """rows: keys, t_us, side ('in' or 'out'). Each 'in' row with next_us, the first 'out' time at or after it (strictly after, if strict). One sort, latest
    first, no pairs: the frame grows from there in one pass, where one that reaches to the end would be read anew for each row."""
    w = Window.partitionBy(*keys).orderBy(F.desc("t_us")).rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    return rows.withColumn("next_us", F.min(F.when(F.col("side") == "out", F.col("t_us"))).over(w)).where("side = 'in'").drop("side")


@query(
    "jn2_server_delay", "pkt_fs", "pkt_out", doubles=STATS,
    sql=f""", o AS (SELECT ssrc - 1000000 AS ssrc, t_us FROM pkt_out),
    j AS (SELECT i.ssrc, (o.t_us - i.t_us) / CAST(1000 AS DOUBLE) AS x FROM pkt_fs i ASOF JOIN o ON i.ssrc = o.ssrc AND i.t_us <= o.t_us)
    SELECT ssrc, {STAT_SQL}, count(*) FILTER (x > 50) AS over_50, count(*) FILTER (x > 100) AS over_100 FROM j WHERE x < 500 GROUP BY ssrc""",
)
def server_delay(inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """Time from each inbound packet to the first outbound one of the stream, up to half a second."""
    rows = inbound.select("ssrc", "t_us", F.lit("in").alias("side")).unionByName(outbound.select((F.col("ssrc") - 1_000_000).alias("ssrc"), "t_us", F.lit("out").alias("side")))
    d = next_at(spread(rows, "ssrc"), ["ssrc"]).where(F.col("next_us") - F.col("t_us") < TOLERANCE_US).withColumn("d", (F.col("next_us") - F.col("t_us")) / 1000)
    return d.groupBy("ssrc").agg(*statistics("d"), F.count_if(F.col("d") > 50).alias("over_50"), F.count_if(F.col("d") > 100).alias("over_100"))


@query(
    "jn4_reverse_ports", "streams",
    sql=""" SELECT a.role, a.ssrc, b.ssrc AS reverse_ssrc FROM streams a JOIN streams b
    ON a.role = b.role AND a.src_ip = b.dst_ip AND a.sport = b.dport AND a.dst_ip = b.src_ip AND a.dport = b.sport WHERE a.ssrc < b.ssrc""",
)
def reverse_ports(streams: DataFrame) -> DataFrame:
    """Streams of the two directions of one flow: the same endpoints and ports, swapped."""
    back = streams.select("role", F.col("ssrc").alias("reverse_ssrc"), F.col("dst_ip").alias("src_ip"), F.col("dport").alias("sport"), F.col("src_ip").alias("dst_ip"), F.col("sport").alias("dport"))
    return streams.join(back, ["role", "src_ip", "sport", "dst_ip", "dport"]).where("ssrc < reverse_ssrc").select("role", "ssrc", "reverse_ssrc")


@query(
    "jn3_stream_pairing", "streams", "pkt_fs", "pkt_out",
    sql=""", c AS (SELECT a.ssrc, b.ssrc AS o FROM streams a JOIN streams b ON a.role = 'fs' AND b.role = 'fs' AND a.dst_ip = '192.0.2.1' AND b.src_ip = '192.0.2.1' AND a.src_ip = b.dst_ip),
    i AS (SELECT c.ssrc, c.o, p.t_us FROM c JOIN pkt_fs p ON p.ssrc = c.ssrc),
    j AS (SELECT i.ssrc, i.o, q.t_us - i.t_us AS d FROM i ASOF JOIN pkt_out q ON i.o = q.ssrc AND i.t_us <= q.t_us),
    n AS (SELECT ssrc, o, count(*) AS n FROM j WHERE d < 500000 GROUP BY ssrc, o)
    SELECT ssrc, arg_min(o, (-n, o)) AS out_ssrc, max(n) AS matched FROM n GROUP BY ssrc""",
)
def stream_pairing(streams: DataFrame, inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """For each stream into the server, the outbound stream to the same device that follows it most often.

    An outbound packet takes the inbound ones of the half second before it, so that a stream covers a few spans of time. One whose only span lies
    inside a span of a smaller stream never wins. A stream covered whole is settled without its packets; what is left is counted pair by pair.
    """
    s = streams.where("role = 'fs'")
    into = s.where("dst_ip = '192.0.2.1'").select("ssrc", F.col("src_ip").alias("ip"))
    out = s.where("src_ip = '192.0.2.1'").select(F.col("ssrc").alias("o"), F.col("dst_ip").alias("ip"))
    at = Window.partitionBy("o").orderBy("t_us")
    sent = outbound.select(F.col("ssrc").alias("o"), "t_us").where("o is not null and t_us is not null")
    sent = sent.withColumn("cut", F.coalesce(F.col("t_us") - F.lag("t_us").over(at) > TOLERANCE_US, F.lit(False)).cast("long"))
    sent = sent.withColumn("span", F.sum("cut").over(at)).groupBy("o", "span").agg((F.min("t_us") - TOLERANCE_US).alias("low"), F.max("t_us").alias("high"))
    spans = out.join(sent.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans")), "o").where("ip is not null").select("ip", "o", "spans")
    kept = sorted_fold(spans, ["ip"], ["o"], Covering, T.StructType([spans.schema["o"], spans.schema["spans"]]))
    mine = into.join(inbound.groupBy("ssrc").agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"), F.count("t_us").alias("packets")), "ssrc")
    whole = F.exists("spans", lambda x: (x["low"] < F.col("first")) & (x["high"] >= F.col("last")))
    pairs = mine.join(kept, "ip").withColumn("sure", F.min(F.when(whole, F.col("o"))).over(Window.partitionBy("ssrc"))).where("packets > 0")
    sure = pairs.where("o = sure").select("ssrc", "o", F.col("packets").alias("n")).distinct()
    left = pairs.where(F.col("sure").isNull() | ((F.col("o") < F.col("sure")) & (F.size("spans") > 1))).select("ssrc", "o", "spans")
    taken = F.exists("spans", lambda x: (x["low"] < F.col("t_us")) & (x["high"] >= F.col("t_us")))
    counted = left.join(inbound.select("ssrc", "t_us"), "ssrc").where(taken).groupBy("ssrc", "o").agg(F.count("*").alias("n"))
    return sure.unionByName(counted).groupBy("ssrc").agg(F.min(F.struct(-F.col("n"), "o")).getField("o").alias("out_ssrc"), F.max("n").alias("matched"))


class Covering:
    """Streams of a device by their numbers, without those whose one span lies inside a span of an earlier one. Holds spans that lie in no other."""

    def __init__(self) -> None:
        self.lows: list[int] = []
        self.highs: list[int] = []

    def inside(self, low: int, high: int) -> bool:
        i = bisect.bisect_right(self.lows, low) - 1
        return i >= 0 and self.highs[i] >= high

    def feed(self, o: int, spans: list[dict]) -> tuple:
        if len(spans) == 1 and self.inside(spans[0]["low"], spans[0]["high"]):
            return ()
        for low, high in ((x["low"], x["high"]) for x in spans):
            if self.inside(low, high):
                continue
            i = j = bisect.bisect_left(self.lows, low)
            while j < len(self.highs) and self.highs[j] <= high:
                j += 1
            self.lows[i:j], self.highs[i:j] = [low], [high]
        return ((o, spans),)

    def close(self) -> tuple:
        return ()


@query(
    "jn11_loss_to_key_frame", "events", doubles="recover_s",
    sql=""", l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), k AS (SELECT user_id, ts AS kt FROM events WHERE event_type = 'purchase')
    SELECT l.user_id, l.event_id, (epoch_us(kt) - epoch_us(ts)) / CAST(1000000 AS DOUBLE) AS recover_s FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND l.ts < k.kt""",
)
def loss_to_key_frame(events: DataFrame) -> DataFrame:
    """Time from each loss to the next key frame after it, null if none comes."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us")
    rows = events.where("event_type in ('error', 'purchase')").select("user_id", "event_id", t, F.when(F.col("event_type") == "error", "in").otherwise("out").alias("side"))
    return next_at(rows, ["user_id"], strict=True).select("user_id", "event_id", ((F.col("next_us") - F.col("t_us")) / 1e6).alias("recover_s"))


@query(
    "wn16_key_frame_spacing", "events", doubles="longest_s",
    sql=""", g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / CAST(1000000 AS DOUBLE) AS g FROM events WHERE event_type = 'purchase')
    SELECT user_id, count(*) AS key_frames, max(g) AS longest_s FROM g GROUP BY user_id""",
)
def key_frame_spacing(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    k = events.where("event_type = 'purchase'").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    k = k.withColumn("g", (F.col("t") - F.lag("t").over(w)) / 1e6)
    return k.groupBy("user_id").agg(F.count("*").alias("key_frames"), F.max("g").alias("longest_s"))


@query(
    "rl15_delay_chains", "pkt", "pkt_fs", "pkt_out", doubles="up_ms fs_ms",
    sql=CROSS_SQL + """, o AS (SELECT ssrc - 1000000 AS ssrc, t_us FROM pkt_out), j AS (SELECT i.ssrc, (o.t_us - i.t_us) / CAST(1000 AS DOUBLE) AS d FROM pkt_fs i ASOF JOIN o ON i.ssrc = o.ssrc AND i.t_us <= o.t_us),
    u AS (SELECT ssrc, avg(x) AS up_ms FROM x GROUP BY ssrc), f AS (SELECT ssrc, avg(d) AS fs_ms FROM j WHERE d < 500 GROUP BY ssrc)
    SELECT u.ssrc, up_ms, fs_ms, CASE WHEN fs_ms IS NULL THEN 'unknown' WHEN abs(up_ms) > 300 THEN 'offset' WHEN fs_ms > 50 THEN 'server' WHEN up_ms > 150 THEN 'path' ELSE 'ok' END AS verdict
    FROM u LEFT JOIN f ON u.ssrc = f.ssrc""",
)
def delay_chains(a: DataFrame, b: DataFrame, out: DataFrame) -> DataFrame:
    """Delay by segment (to the server, inside it) and which one stands out."""
    up = cross_delays(a, b).groupBy("ssrc").agg(F.avg("delay_ms").alias("up_ms"))
    inside = server_delay(b, out).select("ssrc", F.col("mean_ms").alias("fs_ms"))
    verdict = F.when(F.col("fs_ms").isNull(), "unknown").when(F.abs("up_ms") > 300, "offset").when(F.col("fs_ms") > 50, "server").when(F.col("up_ms") > 150, "path").otherwise("ok")
    return up.join(inside, "ssrc", "left").withColumn("verdict", verdict)
