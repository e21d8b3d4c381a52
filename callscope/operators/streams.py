"""Per-stream packet metrics. Every window shares one partitioning and order, so Spark shuffles and sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.modular import ahead16, signed16, signed32
from callscope.operators.folds import sorted_fold, spread
from callscope.plans.registry import query

GAP_MS, ABNORMAL_MS, OFFSET_MS = 200.0, 100.0, 500.0


def stream() -> WindowSpec:
    return Window.partitionBy("role", "ssrc")


def by_time() -> WindowSpec:
    return stream().orderBy("t_us", "pkt_no")


def running() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def as_sent() -> WindowSpec:
    return stream().orderBy("ext", "pkt_no")


def statistics(x: str) -> list[Column]:
    """Count, mean, median, tail and spread of a column of milliseconds."""
    c = F.col(x)
    return [
        F.count(c).alias("n"),
        F.avg(c).alias("mean_ms"),
        F.percentile(c, 0.5).alias("median_ms"),
        F.percentile(c, 0.95).alias("p95_ms"),
        F.percentile(c, 0.99).alias("p99_ms"),
        F.min(c).alias("min_ms"),
        F.max(c).alias("max_ms"),
        F.stddev_pop(c).alias("std_ms"),
    ]


STAT_SQL = """count(x) AS n, avg(x) AS mean_ms, quantile_cont(x, 0.5) AS median_ms, quantile_cont(x, 0.95) AS p95_ms,
  quantile_cont(x, 0.99) AS p99_ms, min(x) AS min_ms, max(x) AS max_ms, stddev_pop(x) AS std_ms"""


@query(
    "wn6_first_occurrence", "captures",
    sql=" SELECT role, ssrc, seq, min(pkt_no) AS pkt_no FROM captures GROUP BY role, ssrc, seq",
)
def first_occurrence(packets: DataFrame) -> DataFrame:
    """The first packet of each (capture, source, sequence number), in file order."""
    w = Window.partitionBy("role", "ssrc", "seq").orderBy("pkt_no")
    return packets.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("role", "ssrc", "seq", "pkt_no")


@query(
    "fl1_ag1_stream_summary", "captures",
    sql=""" SELECT role, ssrc, count(*) AS packets, list_sort(list_distinct(list(pt)))[1] AS lowest_pt, len(list_distinct(list(pt))) AS n_pts,
        min(t_us) AS first_us, max(t_us) AS last_us FROM captures GROUP BY role, ssrc HAVING count(*) >= 10""",
)
def stream_summary(packets: DataFrame, least: int = 10) -> DataFrame:
    """Streams of at least ten packets, duplicates counted."""
    pts = F.array_sort(F.collect_set("pt"))
    out = packets.groupBy("role", "ssrc").agg(F.count("*").alias("packets"), pts.alias("pts"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    return out.where(F.col("packets") >= least).select("role", "ssrc", "packets", F.get("pts", F.lit(0)).alias("lowest_pt"), F.size("pts").cast("long").alias("n_pts"), "first_us", "last_us")


@query(
    "ag2_capture_summary", "captures",
    sql=" SELECT role, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS packets, count(DISTINCT ssrc) AS sources FROM captures GROUP BY role",
)
def capture_summary(packets: DataFrame) -> DataFrame:
    per = packets.groupBy("role", "ssrc").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.count("*").alias("n"))
    return per.groupBy("role").agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.sum("n").alias("packets"), F.count("*").alias("sources"))


@query(
    "ag9_main_pt", "captures",
    sql=""" SELECT role, ssrc, arg_min(pt, (-n, pt)) AS main_pt FROM (SELECT role, ssrc, pt, count(*) AS n FROM captures GROUP BY ALL) GROUP BY role, ssrc""",
)
def main_pt(packets: DataFrame) -> DataFrame:
    """The most frequent payload type, the smallest on ties."""
    n = packets.groupBy("role", "ssrc", "pt").agg(F.count("*").alias("n"))
    return n.groupBy("role", "ssrc").agg(F.min(F.struct(-F.col("n"), "pt")).getField("pt").alias("main_pt"))


@query(
    "wn1_packet_gaps", "captures", doubles="gap_ms",
    sql=""" SELECT role, ssrc, pkt_no, (t_us - lag(t_us) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)) / CAST(1000 AS DOUBLE) AS gap_ms FROM captures""",
)
def packet_gaps(packets: DataFrame) -> DataFrame:
    gap = (F.col("t_us") - F.lag("t_us").over(by_time())) / 1000
    return packets.select("role", "ssrc", "pkt_no", gap.alias("gap_ms"))


@query(
    "ag5_jitter", "captures", doubles="mean_ms median_ms p95_ms p99_ms min_ms max_ms std_ms expected_ms",
    sql=f""", g AS (SELECT role, ssrc, (t_us - lag(t_us) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)) / CAST(1000 AS DOUBLE) AS x FROM captures),
    k AS (SELECT * FROM g WHERE x > 0 AND x < 200),
    b AS (SELECT role, ssrc, arg_min(bin, (-n, bin)) + CAST(0.5 AS DOUBLE) AS expected_ms FROM
      (SELECT role, ssrc, least(floor(x), 49) AS bin, count(*) AS n FROM k WHERE x <= 50 GROUP BY ALL) GROUP BY role, ssrc)
    SELECT role, ssrc, {STAT_SQL}, count(*) FILTER (x > 100) AS abnormal, coalesce(max(expected_ms), CAST(0.5 AS DOUBLE)) AS expected_ms
    FROM k LEFT JOIN b USING (role, ssrc) GROUP BY role, ssrc""",
)
def jitter(packets: DataFrame) -> DataFrame:
    """Gap statistics per stream and the expected gap: the centre of the fullest 1 ms bin up to 50 ms, the first on ties."""
    kept = packet_gaps(packets).where((F.col("gap_ms") > 0) & (F.col("gap_ms") < GAP_MS))
    stats = kept.groupBy("role", "ssrc").agg(*statistics("gap_ms"), F.count_if(F.col("gap_ms") > ABNORMAL_MS).alias("abnormal"))
    return stats.join(modal_gap(kept), ["role", "ssrc"], "left").withColumn("expected_ms", F.coalesce("expected_ms", F.lit(0.5)))


def modal_gap(gaps: DataFrame) -> DataFrame:
    """(role, ssrc, expected_ms) of streams that have gaps of up to 50 ms."""
    bins = gaps.where("gap_ms > 0 and gap_ms <= 50").groupBy("role", "ssrc", F.least(F.floor("gap_ms"), F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("role", "ssrc").agg((F.min(F.struct(-F.col("n"), "bin")).getField("bin") + F.lit(0.5)).cast("double").alias("expected_ms"))


@query(
    "ag6_worst_jitter", "captures", doubles="std_ms",
    sql=""", g AS (SELECT role, ssrc, (t_us - lag(t_us) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)) / CAST(1000 AS DOUBLE) AS x FROM captures),
    s AS (SELECT role, ssrc, round(stddev_pop(x), 6) AS std_ms FROM g WHERE x > 0 AND x < 200 GROUP BY role, ssrc)
    SELECT role, arg_min(ssrc, (-std_ms, ssrc)) AS ssrc, max(std_ms) AS std_ms FROM s GROUP BY role""",
)
def worst_jitter(packets: DataFrame) -> DataFrame:
    per = jitter(packets).where("mean_ms <> 0").select("role", "ssrc", F.round("std_ms", 6).alias("std_ms"))
    worst = per.groupBy("role").agg(F.min(F.struct(-F.col("std_ms"), "ssrc")).getField("ssrc").alias("ssrc"), F.max("std_ms").alias("std_ms"))
    return worst


@query(
    "wn2_drift", "captures", doubles="expected_ms drift_ms largest_ms drift_ms_per_s",
    sql=""", g AS (SELECT role, ssrc, t_us, pkt_no, t_us - lag(t_us) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS gap FROM captures),
    b AS (SELECT role, ssrc, arg_min(bin, (-n, bin)) + CAST(0.5 AS DOUBLE) AS e FROM
      (SELECT role, ssrc, least(floor(gap / CAST(1000 AS DOUBLE)), 49) AS bin, count(*) AS n FROM g WHERE gap > 0 AND gap <= 50000 GROUP BY ALL) GROUP BY role, ssrc),
    w AS (SELECT g.*, coalesce(e, 20) AS e, gap - coalesce(e, 20) * 1000 AS d FROM g LEFT JOIN b USING (role, ssrc)),
    c AS (SELECT *, sum(d) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS s FROM w WHERE gap IS NOT NULL)
    SELECT role, ssrc, max(e) AS expected_ms, sum(d) / 1000 AS drift_ms, max(abs(s)) / 1000 AS largest_ms, sum(d) * 1000 / nullif(max(t_us) - min(t_us), 0) AS drift_ms_per_s FROM c GROUP BY role, ssrc""",
)
def drift(packets: DataFrame, usual_ms: float = 20.0) -> DataFrame:
    """Accumulated difference between gaps and the stream's own usual gap: the centre of its fullest 1 ms bin up to 50 ms, `usual_ms` if it has no such gap."""
    gaps = packets.withColumn("gap", F.col("t_us") - F.lag("t_us").over(by_time())).where("gap is not null")
    df = gaps.join(modal_gap(gaps.withColumn("gap_ms", F.col("gap") / 1000)), ["role", "ssrc"], "left").withColumn("expected_ms", F.coalesce("expected_ms", F.lit(usual_ms)))
    df = df.withColumn("d", F.col("gap") - F.col("expected_ms") * 1000).withColumn("s", F.sum("d").over(running()))
    total = F.sum("d")
    return df.groupBy("role", "ssrc").agg(
        F.max("expected_ms").alias("expected_ms"),
        (total / 1000).alias("drift_ms"),
        (F.max(F.abs("s")) / 1000).alias("largest_ms"),
        F.try_divide(total * 1000, F.max("t_us") - F.min("t_us")).alias("drift_ms_per_s"),
    )


def extended(packets: DataFrame) -> DataFrame:
    """Adds ext, the sequence number unrolled over wraps, and top, the largest so far."""
    step = F.coalesce(signed16("seq", F.lag("seq").over(by_time())), F.col("seq").cast("long"))
    df = packets.withColumn("_step", step).withColumn("ext", F.sum("_step").over(running())).drop("_step")
    return df.withColumn("top", F.max("ext").over(running()))


EXT_SQL = """, s AS (SELECT *, seq - lag(seq) OVER w AS d FROM captures WINDOW w AS (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)),
    e AS (SELECT *, sum(coalesce(CASE WHEN d > 32767 THEN d - 65536 WHEN d < -32768 THEN d + 65536 ELSE d END, seq)) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS ext FROM s),
    m AS (SELECT *, max(ext) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS top, first_value(ext) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) AS start FROM e),
    q AS (SELECT *, top - lag(top) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) - 1 AS gap FROM m)"""


@query(
    "wn3_packet_loss", "captures", doubles="loss_pct",
    sql=EXT_SQL + """ SELECT role, ssrc, count(*) AS packets, CAST(max(ext) - min(start) + 1 - count(DISTINCT CASE WHEN ext >= start THEN ext END) AS BIGINT) AS lost,
      count(*) FILTER (gap > 0) AS loss_events, CAST(coalesce(max(gap) FILTER (gap > 0), 0) AS BIGINT) AS longest_gap, count(*) FILTER (ext < top) AS reordered,
      (max(ext) - min(start) + 1 - count(DISTINCT CASE WHEN ext >= start THEN ext END)) * CAST(100 AS DOUBLE)
        / (count(*) + max(ext) - min(start) + 1 - count(DISTINCT CASE WHEN ext >= start THEN ext END)) AS loss_pct FROM q GROUP BY role, ssrc""",
)
def packet_loss(packets: DataFrame) -> DataFrame:
    """Lost packets per stream; a late packet is refunded. loss_events and longest_gap keep gaps later filled."""
    return numbered(packets).groupBy("role", "ssrc").agg(*losses())


def numbered(packets: DataFrame) -> DataFrame:
    """Adds to ext and top start, the first ext; gap, the numbers passed over; de, the step from the number before it as sent. Two sorts of a stream, no table of its packets."""
    df = extended(packets).withColumn("start", F.first("ext").over(running())).withColumn("gap", F.col("top") - F.lag("top").over(by_time()) - 1)
    return df.withColumn("de", F.col("ext") - F.lag("ext").over(as_sent()))


def losses() -> list[Column]:
    """Of a stream's numbered packets: what was lost. A number counts once, where it differs from the one before it as sent."""
    arrived = F.count_if((F.col("ext") >= F.col("start")) & F.coalesce(F.col("de") != 0, F.lit(True)))
    lost = F.max("ext") - F.min("start") + 1 - arrived
    return [
        F.count("*").alias("packets"),
        lost.alias("lost"),
        F.count_if(F.col("gap") > 0).alias("loss_events"),
        F.coalesce(F.max(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0).cast("long")).alias("longest_gap"),
        F.count_if(F.col("ext") < F.col("top")).alias("reordered"),
        (lost * 100.0 / (F.count("*") + lost)).alias("loss_pct"),
    ]


@query(
    "wn5_rtp_integrity", "captures",
    sql=EXT_SQL + """, p AS (SELECT role, ssrc, arg_min(pt, (-n, pt)) AS main_pt FROM (SELECT role, ssrc, pt, count(*) AS n FROM captures GROUP BY ALL) GROUP BY role, ssrc),
    o AS (SELECT q.*, main_pt, ext - lag(ext) OVER (PARTITION BY q.role, q.ssrc ORDER BY ext, pkt_no) AS de FROM q JOIN p ON q.role = p.role AND q.ssrc = p.ssrc),
    a AS (SELECT role, ssrc, rtp_ts, lag(rtp_ts) OVER (PARTITION BY role, ssrc ORDER BY ext, pkt_no) AS prev FROM o WHERE pt = main_pt),
    z AS (SELECT role, ssrc, rtp_ts < prev AS less, ((rtp_ts - prev + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS d FROM a),
    t AS (SELECT role, ssrc, count(*) FILTER (d < 0) AS ts_backward, count(*) FILTER (d = 0) AS ts_duplicate, count(*) FILTER (d > 0 AND less) AS ts_wrap FROM z GROUP BY role, ssrc)
    SELECT role, ssrc, count(*) FILTER (de > 1) AS seq_gaps, CAST(coalesce(sum(de - 1) FILTER (de > 1), 0) AS BIGINT) AS lost_packets,
      count(*) FILTER (pt <> main_pt) AS other_pt_packets, max(ts_backward) AS ts_backward, max(ts_duplicate) AS ts_duplicate, max(ts_wrap) AS ts_wrap
    FROM o JOIN t USING (role, ssrc) GROUP BY role, ssrc""",
)
def rtp_integrity(packets: DataFrame) -> DataFrame:
    """Order of sequence numbers and timestamps as sent; timestamps among packets of the main payload type only."""
    return clocked(numbered(packets).join(main_pt(packets), ["role", "ssrc"])).groupBy("role", "ssrc").agg(*orders())


def clocked(packets: DataFrame) -> DataFrame:
    """Adds to numbered packets with main_pt before, the timestamp of the main type before it as sent, and d, the step from there."""
    df = packets.withColumn("main", F.col("pt") == F.col("main_pt"))
    before = F.last(F.when(F.col("main"), F.col("rtp_ts")), ignorenulls=True).over(as_sent().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", before).withColumn("d", F.when(F.col("main"), signed32("rtp_ts", "before")))


def orders() -> list[Column]:
    """Of a stream's clocked packets: gaps and order."""
    return [
        F.count_if(F.col("de") > 1).alias("seq_gaps"),
        F.coalesce(F.sum(F.when(F.col("de") > 1, F.col("de") - 1)), F.lit(0)).cast("long").alias("lost_packets"),
        F.count_if(~F.col("main")).alias("other_pt_packets"),
        F.count_if(F.col("d") < 0).alias("ts_backward"),
        F.count_if(F.col("d") == 0).alias("ts_duplicate"),
        F.count_if((F.col("d") > 0) & (F.col("rtp_ts") < F.col("before"))).alias("ts_wrap"),
    ]


def stream_checks(packets: DataFrame) -> DataFrame:
    """Loss, order and std_ms of the gaps of each stream (as packet_loss, rtp_integrity and jitter have them) from one pass over its packets."""
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap_ms = (F.col("t_us") - F.lag("t_us").over(by_time())) / 1000
    # What has no source has losses and gaps, but no order.
    main = F.when(F.col("ssrc").isNotNull(), F.mode("pt", True).over(whole))
    df = clocked(numbered(spread(packets, "ssrc").withColumn("gap_ms", gap_ms).withColumn("main_pt", main)))
    kept = F.when((F.col("gap_ms") > 0) & (F.col("gap_ms") < GAP_MS), F.col("gap_ms"))
    return df.groupBy("role", "ssrc").agg(*losses(), *orders(), F.stddev_pop(kept).alias("std_ms"))


@query(
    "ag10_median_ts_delta", "captures", doubles="median_delta",
    sql=""", d AS (SELECT role, ssrc, ((rtp_ts - lag(rtp_ts) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no) + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS d FROM captures)
    SELECT role, ssrc, quantile_cont(CAST(d AS DOUBLE), 0.5) AS median_delta, list_sort(list(d))[len(list(d)) // 2 + 1] AS upper_median FROM d WHERE d > 0 GROUP BY role, ssrc""",
)
def median_ts_delta(packets: DataFrame) -> DataFrame:
    """Median of the positive timestamp steps: the usual one, and the upper one."""
    d = packets.select("role", "ssrc", signed32("rtp_ts", F.lag("rtp_ts").over(by_time())).alias("d")).where("d > 0")
    return d.groupBy("role", "ssrc").agg(F.percentile("d", 0.5).alias("median_delta")).join(upper_median(d, ["role", "ssrc"], "d"), ["role", "ssrc"])


def upper_median(rows: DataFrame, keys: list[str], c: str) -> DataFrame:
    """(keys, upper_median): the value at place n div 2 of n sorted ones, by counts of equal values, so that no group is gathered."""
    counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_k"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys).orderBy(c)))
    half = upto.groupBy(*keys).agg(F.expr("max(_upto) div 2").alias("_half"))
    return upto.join(half, keys).where("_upto > _half").groupBy(*keys).agg(F.min(c).alias("upper_median"))


@query(
    "ag11_clock_rate", "captures", doubles="clock_rate",
    sql=""", k AS (SELECT *, row_number() OVER (PARTITION BY role, ssrc ORDER BY pkt_no DESC) AS k FROM captures),
    d AS (SELECT role, ssrc, ((rtp_ts - lag(rtp_ts) OVER w + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS ts, t_us - lag(t_us) OVER w AS t FROM k WHERE k <= 64
      WINDOW w AS (PARTITION BY role, ssrc ORDER BY pkt_no)),
    r AS (SELECT role, ssrc, ts * CAST(1000000 AS DOUBLE) / t AS rate FROM d WHERE t > 1000 AND ts > 0)
    SELECT role, ssrc, list_sort(list(rate))[len(list(rate)) // 2 + 1] AS clock_rate FROM r GROUP BY role, ssrc HAVING count(*) >= 4""",
)
def clock_rate(packets: DataFrame, tail: int = 64) -> DataFrame:
    """Clock estimate from the last packets in arrival order: upper median of timestamp step over time step."""
    arrival = stream().orderBy("pkt_no")
    last = packets.withColumn("_k", F.row_number().over(stream().orderBy(F.desc("pkt_no")))).where(F.col("_k") <= tail)
    d = last.select("role", "ssrc", signed32("rtp_ts", F.lag("rtp_ts").over(arrival)).alias("ts"), (F.col("t_us") - F.lag("t_us").over(arrival)).alias("t")).where("t > 1000 and ts > 0")
    rates = d.groupBy("role", "ssrc").agg(F.array_sort(F.collect_list(F.col("ts") * 1e6 / F.col("t"))).alias("r"))
    return rates.where(F.size("r") >= 4).select("role", "ssrc", F.element_at("r", F.floor(F.size("r") / 2).cast("int") + 1).alias("clock_rate"))


@query(
    "wn4_ts_continuity", "pkt", doubles="media_gap_ms", recursive=True,
    sql=""", p AS (SELECT ssrc, arg_min(pt, (-n, pt)) AS main_pt FROM (SELECT ssrc, pt, count(*) AS n FROM pkt GROUP BY ALL) GROUP BY ssrc),
    o AS (SELECT pkt.ssrc, seq, rtp_ts, pt = main_pt AS main, row_number() OVER (PARTITION BY pkt.ssrc ORDER BY t_us, pkt_no) AS i FROM pkt JOIN p ON pkt.ssrc = p.ssrc),
    d AS (SELECT *, ((rtp_ts - lag(rtp_ts) OVER (PARTITION BY ssrc ORDER BY i) + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS d,
      (seq - lag(seq) OVER (PARTITION BY ssrc ORDER BY i) + 65536) % 65536 AS g, rtp_ts < lag(rtp_ts) OVER (PARTITION BY ssrc ORDER BY i) AS less,
      main AND lag(main) OVER (PARTITION BY ssrc ORDER BY i) AS use FROM o),
    md AS (SELECT ssrc, round_even(quantile_cont(CAST(d AS DOUBLE), 0.5), 0) AS med FROM d WHERE d > 0 GROUP BY ssrc),
    x AS (SELECT d.*, coalesce(med, 0) AS med, greatest(floor(coalesce(med, 0) / 2), 1) AS thr FROM d LEFT JOIN md ON d.ssrc = md.ssrc),
    f AS (SELECT ssrc, i, CAST(0 AS DOUBLE) AS pending, CAST('' AS VARCHAR) AS kind, CAST(0 AS DOUBLE) AS gap FROM x WHERE i = 1
      UNION ALL
      SELECT x.ssrc, x.i,
        CASE WHEN NOT use THEN pending WHEN d < 0 AND g >= 32768 THEN pending + d + (65536 - g) * med WHEN d < 0 THEN pending + d - g * med WHEN d = 0 THEN pending - med
          WHEN med > 0 AND g < 32768 THEN CASE WHEN d - g * med + pending > thr THEN 0 ELSE least(d - g * med + pending, 0) END ELSE pending END,
        CASE WHEN NOT use THEN '' WHEN d < 0 AND g >= 32768 THEN 'reorder' WHEN d < 0 THEN 'backward' WHEN d = 0 THEN 'duplicate'
          WHEN med > 0 AND g < 32768 AND d - g * med + pending > thr THEN 'jump' ELSE '' END,
        CASE WHEN use AND d > 0 AND med > 0 AND g < 32768 AND d - g * med + pending > thr THEN d - g * med + pending ELSE 0 END
      FROM f JOIN x ON x.ssrc = f.ssrc AND x.i = f.i + 1)
    SELECT f.ssrc, count(*) FILTER (less AND d > 0) AS wraps, count(*) FILTER (kind = 'jump') AS jumps, count(*) FILTER (kind = 'backward') AS backward,
      count(*) FILTER (kind = 'reorder') AS reorders, count(*) FILTER (kind = 'duplicate') AS duplicates, sum(gap) / 8 AS media_gap_ms FROM f JOIN x ON f.ssrc = x.ssrc AND f.i = x.i GROUP BY f.ssrc""",
)
def ts_continuity(packets: DataFrame, rate: int = 8000) -> DataFrame:
    """Timestamp jumps, steps back, reorders and duplicates of each audio stream: an ordered fold with a debt.

    Packets pass by in order of time, only the counts and the debt are held; packets outside the main payload type are skipped. One shuffle and one sort.
    """
    w = Window.partitionBy("ssrc").orderBy("t_us", "pkt_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = spread(packets.where("ssrc is not null"), "ssrc").withColumn("main", F.col("pt") == F.mode("pt", True).over(whole)).withColumn("d", signed32("rtp_ts", F.lag("rtp_ts").over(w)))
    df = df.withColumn("g", ahead16("seq", F.lag("seq").over(w))).withColumn("use", F.coalesce(F.col("main") & F.lag("main").over(w), F.lit(False)))
    df = df.withColumn("wrap", (F.col("d") > 0) & (F.col("rtp_ts") < F.lag("rtp_ts").over(w)))
    med = F.coalesce(F.rint(F.percentile(F.when(F.col("d") > 0, F.col("d")), 0.5).over(whole)), F.lit(0.0))
    steps = df.select("ssrc", "t_us", "pkt_no", "d", "g", "use", med.alias("med"), F.count_if("wrap").over(whole).alias("wraps"))
    found = sorted_fold(steps, ["ssrc"], ["t_us", "pkt_no"], Continuity, CONTINUITY, apart=True)
    return found.select("ssrc", "wraps", "jumps", "backward", "reorders", "duplicates", (F.col("gap") * 1000 / rate).alias("media_gap_ms"))


CONTINUITY = T.StructType().add("wraps", "long").add("jumps", "long").add("backward", "long").add("reorders", "long").add("duplicates", "long").add("gap", "double")


class Continuity:
    """How a sender's clock moves against its packets' numbers. What a step falls short of is a debt that later steps make up for first."""

    def __init__(self) -> None:
        self.wraps = self.jumps = self.backward = self.reorders = self.duplicates = 0
        self.debt = self.gap = 0.0

    def feed(self, t_us: int, pkt_no: int, d: int | None, g: int | None, use: bool, med: float, wraps: int) -> tuple:
        self.wraps = wraps
        if not use or d is None:
            return ()
        if d == 0:
            self.duplicates += 1
            self.debt -= med
        elif d < 0 and g < 32768:
            self.backward += 1
            self.debt += d - g * med
        elif d < 0:
            self.reorders += 1
            self.debt += d + (65536 - g) * med
        elif med > 0 and g < 32768:
            net = d - g * med + self.debt
            if net > max(med // 2, 1):
                self.jumps += 1
                self.gap += net
                self.debt = 0.0
            else:
                self.debt = min(net, 0.0)
        return ()

    def close(self) -> tuple:
        return ((self.wraps, self.jumps, self.backward, self.reorders, self.duplicates, self.gap),)


@query(
    "wn7_inactivity_segments", "events",
    sql="""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS cut FROM events),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g)
    SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS packets, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY user_id, segment""",
)
def inactivity_segments(events: DataFrame, quiet_us: int = 43_200_000_000) -> DataFrame:
    """Segments of each conversation: a silence longer than the limit starts a new one, an equal one doesn't."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    df = events.withColumn("_t", t).withColumn("_cut", F.coalesce((F.col("_t") - F.lag("_t").over(w) > quiet_us).cast("int"), F.lit(0)))
    df = df.withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("user_id", "segment").agg(F.count("*").alias("packets"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    "tk2_worst_gaps", "captures", doubles="gap_ms",
    sql=""", g AS (SELECT role, ssrc, pkt_no, t_us, (t_us - lag(t_us) OVER (PARTITION BY role, ssrc ORDER BY t_us, pkt_no)) / CAST(1000 AS DOUBLE) AS gap_ms FROM captures)
    SELECT role, ssrc, pkt_no, gap_ms, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY role, ssrc ORDER BY gap_ms DESC, pkt_no) AS k FROM g WHERE gap_ms IS NOT NULL) WHERE k <= 5""",
)
def worst_gaps(packets: DataFrame, k: int = 5) -> DataFrame:
    """The longest gaps of each stream."""
    gaps = packet_gaps(packets).where("gap_ms is not null")
    return gaps.withColumn("k", F.row_number().over(stream().orderBy(F.desc("gap_ms"), "pkt_no"))).where(F.col("k") <= k)
