"""SIP messages and RTCP reports: retransmissions, transactions, ladders, receiver summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.operators.folds import sorted_fold
from callscope.plans.registry import query

WINDOW_US = 32_000_000
PRIORITY = {"fs": 0, "terminal": 1, "seat": 2}
KEY = ["call_id", "method", "cseq", "src", "dst"]


def priority(c: Column) -> Column:
    out = F.lit(9)
    for k, v in PRIORITY.items():
        out = F.when(c == k, v).otherwise(out)
    return out


DEDUPE_SQL = """, s AS (SELECT *, CASE file WHEN 'fs' THEN 0 WHEN 'terminal' THEN 1 WHEN 'seat' THEN 2 ELSE 9 END AS pr,
      row_number() OVER (PARTITION BY call_id, method, cseq, src, dst ORDER BY t_us, file) AS i FROM sip_copies),
    f AS (SELECT call_id, method, cseq, src, dst, i, 1 AS slot, t_us, file, pr, 0 AS retrans FROM s WHERE i = 1
      UNION ALL
      SELECT s.call_id, s.method, s.cseq, s.src, s.dst, s.i, CASE WHEN s.t_us - f.t_us > 32000000 THEN slot + 1 ELSE slot END,
        CASE WHEN s.t_us - f.t_us > 32000000 OR (s.file <> f.file AND s.pr < f.pr) THEN s.t_us ELSE f.t_us END,
        CASE WHEN s.t_us - f.t_us > 32000000 OR (s.file <> f.file AND s.pr < f.pr) THEN s.file ELSE f.file END,
        CASE WHEN s.t_us - f.t_us > 32000000 OR (s.file <> f.file AND s.pr < f.pr) THEN s.pr ELSE f.pr END,
        CASE WHEN s.t_us - f.t_us > 32000000 THEN 0 WHEN s.file = f.file THEN retrans + 1 ELSE retrans END
      FROM f JOIN s ON s.call_id = f.call_id AND s.method = f.method AND s.cseq = f.cseq AND s.src = f.src AND s.dst = f.dst AND s.i = f.i + 1),
    k AS (SELECT call_id, method, cseq, src, dst, slot, arg_max(t_us, i) AS t_us, arg_max(file, i) AS file, CAST(max(retrans) AS BIGINT) AS retrans FROM f GROUP BY ALL)"""


@query("wn8_message_dedupe", "sip_copies", recursive=True, sql=DEDUPE_SQL + " SELECT call_id, method, cseq, src, dst, t_us, file, retrans FROM k")
def message_dedupe(messages: DataFrame) -> DataFrame:
    """One row per message: copies within 32 s of the kept one are resends (same capture) or replace it (better capture).

    Copies of a key pass by in order of time; only the kept one is held.
    """
    rows = messages.select(*KEY, "t_us", "file", priority(F.col("file")).cast("int").alias("rank"))
    return sorted_fold(rows, KEY, ["t_us", "file"], Copies, T.StructType().add("t_us", "long").add("file", "string").add("retrans", "long"))


class Copies:
    """The kept copy of a message: its time, its capture and that one's rank (least is best), and its resends."""

    def __init__(self, *now: object) -> None:
        self.now = now or None

    def feed(self, t_us: int, file: object, rank: int) -> list[tuple]:
        """The copy that this one ends, if any, as (t_us, file, retrans)."""
        if self.now is None or t_us - self.now[0] > WINDOW_US:
            done, self.now = self.close(), (t_us, file, rank, 0)
            return done
        if file == self.now[1]:
            self.now = (*self.now[:3], self.now[3] + 1)
        elif rank < self.now[2]:
            self.now = (t_us, file, rank, self.now[3])
        return []

    def close(self) -> list[tuple]:
        done, self.now = [(self.now[0], self.now[1], self.now[3])] if self.now else [], None
        return done


@query(
    "wn9_invite_issues", "sip", "sip_copies", recursive=True,
    sql=DEDUPE_SQL + """, i AS (SELECT call_id, t_us, retrans, lead(t_us) OVER (PARTITION BY call_id ORDER BY t_us) AS nxt FROM k WHERE method = 'INVITE'),
    r AS (SELECT call_id, t_us, CAST(method AS INTEGER) AS code FROM k WHERE regexp_full_match(method, '[0-9]+')),
    j AS (SELECT i.call_id, i.t_us, i.retrans, max(code) AS most, count(code) AS n FROM i LEFT JOIN r ON r.call_id = i.call_id AND r.t_us >= i.t_us AND (nxt IS NULL OR r.t_us < nxt) GROUP BY ALL)
    SELECT call_id, t_us, retrans, CASE WHEN n = 0 THEN 'no_response' ELSE 'provisional_only' END AS issue FROM j WHERE n = 0 OR most < 200""",
)
def invite_issues(_: DataFrame, messages: DataFrame) -> DataFrame:
    """INVITEs that got no response, or provisional ones only, before the dialog's next INVITE."""
    m = message_dedupe(messages)
    by_time = Window.partitionBy("call_id").orderBy("t_us", F.when(F.col("method") == "INVITE", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    m = m.where(F.col("method").rlike("^(INVITE|[0-9]+)$")).withColumn("turn", F.sum((F.col("method") == "INVITE").cast("int")).over(by_time)).where("turn > 0")
    code = F.when(F.col("method").rlike("^[0-9]+$"), F.col("method").try_cast("int"))
    per = m.groupBy("call_id", "turn").agg(F.min("t_us").alias("t_us"), F.max(F.when(F.col("method") == "INVITE", F.col("retrans"))).alias("retrans"), F.max(code).alias("most"))
    bad = per.where("most is null or most < 200")
    return bad.select("call_id", "t_us", "retrans", F.when(F.col("most").isNull(), "no_response").otherwise("provisional_only").alias("issue"))


@query(
    "fn14_message_kind", "sip",
    sql=""" SELECT method, CASE WHEN method IN ('INVITE','BYE','CANCEL','ACK','UPDATE','PRACK','INFO') THEN 'request' WHEN method LIKE '1__' THEN 'provisional' WHEN method LIKE '2__' THEN 'success' ELSE 'error' END AS kind,
      count(*) AS n FROM sip GROUP BY method""",
)
def message_kinds(messages: DataFrame) -> DataFrame:
    return messages.groupBy("method").agg(F.count("*").alias("n")).withColumn("kind", message_kind(F.col("method")))


def message_kind(method: Column) -> Column:
    """Request, provisional, success or error."""
    request = method.isin("INVITE", "BYE", "CANCEL", "ACK", "UPDATE", "PRACK", "INFO")
    return F.when(request, "request").when(method.rlike("^1..$"), "provisional").when(method.rlike("^2..$"), "success").otherwise("error")


@query(
    "wn19_answer_and_bye", "sip",
    sql=""" SELECT call_id, coalesce(min(t_us) FILTER (method = '200' AND src <> '192.0.2.1'), min(t_us) FILTER (method = '200')) AS answer_us, min(t_us) FILTER (method = 'BYE') AS bye_us FROM sip GROUP BY call_id""",
)
def answer_and_bye(messages: DataFrame, server: str = "192.0.2.1") -> DataFrame:
    """When each dialog was answered (by the device, if it was seen to) and ended."""
    ok = F.col("method") == "200"
    return messages.groupBy("call_id").agg(
        F.coalesce(F.min(F.when(ok & (F.col("src") != server), F.col("t_us"))), F.min(F.when(ok, F.col("t_us")))).alias("answer_us"),
        F.min(F.when(F.col("method") == "BYE", F.col("t_us"))).alias("bye_us"),
    )


@query(
    "fl11_ag23_talk_window", "sip", "pkt", doubles="talk_s",
    sql=""", w AS (SELECT min(t_us) FILTER (method = '200') AS a, max(t_us) FILTER (method = 'BYE') AS b FROM sip)
    SELECT ssrc, count(*) AS packets, CAST(max(t_us) - min(t_us) AS DOUBLE) / 1000000 AS talk_s FROM pkt WHERE t_us + 17000000 BETWEEN (SELECT a FROM w) AND (SELECT b FROM w) GROUP BY ssrc""",
)
def talk_window(messages: DataFrame, packets: DataFrame, clock_us: int = 17_000_000) -> DataFrame:
    """Media between answer and hang-up, the media clock being clock_us behind: the window is a single row, sent to every task."""
    w = messages.agg(F.min(F.when(F.col("method") == "200", F.col("t_us"))).alias("a"), F.max(F.when(F.col("method") == "BYE", F.col("t_us"))).alias("b"))
    inside = packets.join(F.broadcast(w), (F.col("t_us") + clock_us >= F.col("a")) & (F.col("t_us") + clock_us <= F.col("b")))
    return inside.groupBy("ssrc").agg(F.count("*").alias("packets"), ((F.max("t_us") - F.min("t_us")).cast("double") / 1e6).alias("talk_s"))


@query(
    "rl22_ladder", "sip",
    sql=""" SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY t_us, cseq, method) AS INTEGER) AS row_no, method, src, dst, CAST(t_us - min(t_us) OVER (PARTITION BY call_id) AS BIGINT) AS at_us FROM sip""",
)
def ladder(messages: DataFrame) -> DataFrame:
    """Numbered messages of each dialog with times from its first."""
    w = Window.partitionBy("call_id")
    at = F.col("t_us") - F.min("t_us").over(w)
    return messages.select("call_id", F.row_number().over(w.orderBy("t_us", "cseq", "method")).alias("row_no"), "method", "src", "dst", at.alias("at_us"))


@query(
    "ag13_rtcp_summary", "rtcp", doubles="fraction",
    sql=""" SELECT ssrc, count(*) FILTER (kind = 'SR') AS sender_reports, arg_max(fraction, (t_us, report_no)) FILTER (kind IN ('SR', 'RR')) AS fraction,
      arg_max(lost, (t_us, report_no)) FILTER (kind IN ('SR', 'RR')) AS lost, count(DISTINCT reporter) FILTER (kind IN ('SR', 'RR')) AS reporters,
      count(*) FILTER (kind = 'NACK') AS nacks, count(*) FILTER (kind = 'PLI') AS plis FROM rtcp GROUP BY ssrc""",
)
def rtcp_summary(reports: DataFrame) -> DataFrame:
    """The latest report about each stream, who reported, and how much feedback came."""
    report = F.col("kind").isin("SR", "RR")
    latest = F.max(F.when(report, F.struct("t_us", "report_no", "fraction", "lost")))
    return reports.groupBy("ssrc").agg(
        F.count_if(F.col("kind") == "SR").alias("sender_reports"),
        latest.getField("fraction").alias("fraction"),
        latest.getField("lost").alias("lost"),
        F.count_distinct(F.when(report, F.col("reporter"))).alias("reporters"),
        F.count_if(F.col("kind") == "NACK").alias("nacks"),
        F.count_if(F.col("kind") == "PLI").alias("plis"),
    )


@query(
    "jn14_stream_enrichment", "streams", "rtcp", "pkt_fs", doubles="fraction",
    sql=""", s AS (SELECT ssrc, count(*) AS reports, max(fraction) AS fraction FROM rtcp GROUP BY ssrc), f AS (SELECT ssrc, count(*) AS at_server FROM pkt_fs GROUP BY ssrc)
    SELECT streams.role, streams.ssrc, coalesce(reports, 0) AS reports, fraction, coalesce(at_server, 0) AS at_server FROM streams LEFT JOIN s ON s.ssrc = streams.ssrc LEFT JOIN f ON f.ssrc = streams.ssrc""",
)
def stream_enrichment(streams: DataFrame, reports: DataFrame, packets: DataFrame) -> DataFrame:
    """Streams with what reports and the server capture know of them."""
    r = reports.groupBy("ssrc").agg(F.count("*").alias("reports"), F.max("fraction").alias("fraction"))
    p = packets.groupBy("ssrc").agg(F.count("*").alias("at_server"))
    out = streams.select("role", "ssrc").join(r, "ssrc", "left").join(p, "ssrc", "left")
    return out.select("role", "ssrc", F.coalesce("reports", F.lit(0)).alias("reports"), "fraction", F.coalesce("at_server", F.lit(0)).alias("at_server"))


@query(
    "ag12_server_address", "streams",
    sql=""", e AS (SELECT src_ip AS ip FROM streams UNION ALL SELECT dst_ip FROM streams), n AS (SELECT ip, count(*) AS n FROM e GROUP BY ip)
    SELECT arg_min(ip, (-n, ip)) AS server_ip, max(n) AS streams FROM n""",
)
def server_address(streams: DataFrame) -> DataFrame:
    """The address that takes part in most streams, the smallest on ties."""
    n = streams.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    return n.agg(F.min(F.struct(-F.col("n"), "ip")).getField("ip").alias("server_ip"), F.max("n").alias("streams"))


@query(
    "rl20_directions", "captures",
    sql=", r AS (SELECT list_distinct(list(role)) AS r FROM captures) SELECT d AS direction FROM (SELECT unnest(CASE WHEN list_contains(r, 'terminal') AND list_contains(r, 'fs') THEN ['terminal_to_fs', 'fs_to_terminal'] ELSE [] END || CASE WHEN list_contains(r, 'seat') THEN ['fs_to_seat'] ELSE [] END) AS d FROM r)",
)
def directions(packets: DataFrame) -> DataFrame:
    """Directions that the captures at hand can show."""
    r = packets.agg(F.collect_set("role").alias("r"))
    has = lambda x: F.array_contains("r", x)
    none = F.array().cast("array<string>")
    both = F.when(has("terminal") & has("fs"), F.array(F.lit("terminal_to_fs"), F.lit("fs_to_terminal"))).otherwise(none)
    return r.select(F.explode(F.concat(both, F.when(has("seat"), F.array(F.lit("fs_to_seat"))).otherwise(none))).alias("direction"))
