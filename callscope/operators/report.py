"""Frame-level series, findings, taxonomy and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.plans.registry import query

#: Finding, problem, priority.
TAXONOMY = [("loss", "choppy", 1), ("jitter", "choppy", 1), ("silence", "one_way", 2), ("delay", "laggy", 3), ("clipping", "distorted", 4)]
SEVERITY = ["critical", "warning", "info"]
LOUD = 30.0


@query(
    "wn11_wn12_active_runs", "frames",
    sql=""", a AS (SELECT *, level >= 30 AS raw FROM frames),
    h AS (SELECT *, raw OR (coalesce(lag(raw) OVER w, false) AND coalesce(lead(raw) OVER w, false)) AS act FROM a WINDOW w AS (PARTITION BY ssrc ORDER BY frame)),
    i AS (SELECT *, frame - row_number() OVER (PARTITION BY ssrc, act ORDER BY frame) AS island FROM h)
    SELECT ssrc, min(frame) AS start, max(frame) AS stop, count(*) AS frames FROM i WHERE act GROUP BY ssrc, island""",
)
def active_runs(frames: DataFrame, loud: float = LOUD) -> DataFrame:
    """Runs of loud frames; a single quiet frame between two loud ones doesn't break a run."""
    w = Window.partitionBy("ssrc").orderBy("frame")
    raw = F.col("level") >= loud
    df = frames.withColumn("_raw", raw)
    df = df.withColumn("act", F.col("_raw") | (F.coalesce(F.lag("_raw").over(w), F.lit(False)) & F.coalesce(F.lead("_raw").over(w), F.lit(False))))
    df = df.where("act").withColumn("island", F.col("frame") - F.row_number().over(w))
    return df.groupBy("ssrc", "island").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count("*").alias("frames")).drop("island")


@query(
    "wn14_moving_average", "frames", doubles="smooth",
    sql=" SELECT ssrc, frame, sum(level) OVER (PARTITION BY ssrc ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM frames",
)
def moving_average(frames: DataFrame) -> DataFrame:
    """Centred average of five frames, zero beyond the ends."""
    w = Window.partitionBy("ssrc").orderBy("frame").rowsBetween(-2, 2)
    return frames.select("ssrc", "frame", (F.sum("level").over(w) / 5).alias("smooth"))


@query(
    "wn15_span_merge", "frames",
    sql=""", a AS (SELECT *, frame - row_number() OVER (PARTITION BY ssrc, level >= 30 ORDER BY frame) AS island FROM frames),
    r AS (SELECT ssrc, min(frame) AS s, max(frame) AS e FROM a WHERE level >= 30 GROUP BY ssrc, island),
    c AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY ssrc ORDER BY s) <= 3 THEN 0 ELSE 1 END AS cut FROM r),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY ssrc ORDER BY s) AS k FROM c)
    SELECT ssrc, min(s) AS start, max(e) AS stop, count(*) AS spans FROM g GROUP BY ssrc, k""",
)
def span_merge(frames: DataFrame, gap: int = 3) -> DataFrame:
    """Loud spans, those at most `gap` frames apart as one."""
    w = Window.partitionBy("ssrc").orderBy("frame")
    runs = frames.where(F.col("level") >= LOUD).withColumn("island", F.col("frame") - F.row_number().over(w))
    runs = runs.groupBy("ssrc", "island").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    v = Window.partitionBy("ssrc").orderBy("s")
    cut = F.when(F.col("s") - F.lag("e").over(v) <= gap, 0).otherwise(1)
    merged = runs.withColumn("cut", cut).withColumn("k", F.sum("cut").over(v))
    return merged.groupBy("ssrc", "k").agg(F.min("s").alias("start"), F.max("e").alias("stop"), F.count("*").alias("spans")).drop("k")


@query(
    "fn12_ds7_levels", "frames", doubles="rms dbfs noise",
    sql=""", r AS (SELECT ssrc, sqrt(avg(level * level * 10000)) AS rms, quantile_cont(level, 0.5) FILTER (level < 30) AS noise FROM frames GROUP BY ssrc)
    SELECT ssrc, rms, 20 * log10(greatest(rms, 1) / 32768) AS dbfs, noise FROM r""",
)
def levels(frames: DataFrame) -> DataFrame:
    """RMS, its level and the noise floor of each stream."""
    from callscope.functions.scalars import dbfs

    x = F.col("level") * 100
    quiet = F.percentile(F.when(F.col("level") < LOUD, F.col("level")), 0.5)
    return frames.groupBy("ssrc").agg(F.sqrt(F.avg(x * x)).alias("rms"), quiet.alias("noise")).select("ssrc", "rms", dbfs(F.col("rms")).alias("dbfs"), "noise")


@query(
    "ds10_silence_profile", "frames", doubles="active_ratio",
    sql=""" SELECT ssrc, avg(CASE WHEN level >= 60 THEN 1.0 ELSE 0.0 END) AS active_ratio, CASE WHEN count(*) < 5 THEN 'unknown' WHEN avg(CASE WHEN level >= 60 THEN 1.0 ELSE 0.0 END) >= 0.02 THEN 'normal'
      WHEN count(*) FILTER (level >= 60) > 0 THEN 'sparse' ELSE 'silent' END AS verdict FROM frames GROUP BY ssrc""",
)
def silence_profile(frames: DataFrame, active: float = 60.0) -> DataFrame:
    """Share of active frames and what it says of the stream."""
    n, a = F.count("*"), F.count_if(F.col("level") >= active)
    verdict = F.when(n < 5, "unknown").when(a / n >= 0.02, "normal").when(a > 0, "sparse").otherwise("silent")
    return frames.groupBy("ssrc").agg((a / n).alias("active_ratio"), verdict.alias("verdict"))


@query(
    "jn12_tone_overlap", "frames",
    sql=""", t AS (SELECT ssrc, frame - 1 AS s, frame + 2 AS e FROM frames WHERE level > 95)
    SELECT f.ssrc, count(*) AS frames, count(*) FILTER (level >= 30 AND NOT EXISTS (SELECT 1 FROM t WHERE t.ssrc = f.ssrc AND f.frame BETWEEN s AND e)) AS active FROM frames f GROUP BY f.ssrc""",
)
def tone_overlap(frames: DataFrame) -> DataFrame:
    """Loud frames outside any tone interval. Intervals are a few frames long: each frame of one is a key."""
    tones = frames.where("level > 95").select("ssrc", F.explode(F.sequence(F.col("frame") - 1, F.col("frame") + 2)).alias("frame")).distinct().withColumn("tone", F.lit(True))
    df = frames.join(tones, ["ssrc", "frame"], "left")
    return df.groupBy("ssrc").agg(F.count("*").alias("frames"), F.count_if((F.col("level") >= LOUD) & F.col("tone").isNull()).alias("active"))


def severity(value: Column) -> Column:
    return F.when(value >= 60, "critical").when(value >= 20, "warning").otherwise("info")


@query(
    "rl16_issues", "findings",
    sql=" SELECT call_id, kind, CASE WHEN value >= 60 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM findings GROUP BY ALL",
)
def issues(findings: DataFrame) -> DataFrame:
    return findings.groupBy("call_id", "kind", severity(F.col("value")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    "ag18_rl18_problems", "findings",
    sql=""", t AS (SELECT * FROM (VALUES ('loss', 'choppy', 1), ('jitter', 'choppy', 1), ('silence', 'one_way', 2), ('delay', 'laggy', 3), ('clipping', 'distorted', 4)) AS t(kind, problem, priority)),
    f AS (SELECT call_id, problem, priority, finding_id, stream, CASE WHEN value >= 60 THEN 0 WHEN value >= 20 THEN 1 ELSE 2 END AS sev FROM findings JOIN t ON t.kind = findings.kind WHERE value >= 20)
    SELECT call_id, problem, priority, CASE min(sev) WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, array_to_string(list_sort(list(DISTINCT stream)), ',') AS streams,
      array_to_string(list_sort(list(finding_id))[1:10], ',') AS evidence, count(*) AS findings FROM f GROUP BY call_id, problem, priority""",
)
def problems(findings: DataFrame) -> DataFrame:
    """Findings gathered into problems, with at most ten as evidence (a display limit)."""
    table = F.create_map(*(F.lit(x) for kind, problem, priority in TAXONOMY for x in (kind, f"{priority}:{problem}")))
    df = findings.where("value >= 20").withColumn("p", F.split(F.try_element_at(table, F.col("kind")), ":")).withColumn("sev", F.when(F.col("value") >= 60, 0).when(F.col("value") >= 20, 1).otherwise(2))
    g = df.where("p is not null").groupBy("call_id", F.col("p")[1].alias("problem"), F.col("p")[0].cast("int").alias("priority"))
    out = g.agg(F.min("sev").alias("sev"), F.array_sort(F.collect_set("stream")).alias("s"), F.array_sort(F.collect_list("finding_id")).alias("e"), F.count("*").alias("findings"))
    evidence = F.transform(F.slice("e", 1, 10), lambda x: x.cast("string"))
    return out.select("call_id", "problem", "priority", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("sev") + 1).alias("severity"), F.array_join("s", ",").alias("streams"), F.array_join(evidence, ",").alias("evidence"), "findings")


@query(
    "rl17_ag21_conclusion", "findings",
    sql=""" SELECT call_id, bool_and(value < 20) AS clean, bool_or(value >= 60) AS critical, arg_max(kind, (value, -finding_id)) AS root_cause, count(*) FILTER (value >= 20) AS issues FROM findings GROUP BY call_id""",
)
def conclusion(findings: DataFrame) -> DataFrame:
    """Overall state of each call and its gravest finding."""
    worst = F.max(F.struct("value", (-F.col("finding_id")).alias("o"), "kind"))
    return findings.groupBy("call_id").agg(
        F.bool_and(F.col("value") < 20).alias("clean"), F.bool_or(F.col("value") >= 60).alias("critical"),
        worst.getField("kind").alias("root_cause"), F.count_if(F.col("value") >= 20).alias("issues"),
    )


@query(
    "tk4_ranked_problems", "findings",
    sql=""", t AS (SELECT * FROM (VALUES ('loss', 1), ('jitter', 1), ('silence', 2), ('delay', 3), ('clipping', 4)) AS t(kind, priority))
    SELECT call_id, finding_id, findings.kind, CAST(row_number() OVER (PARTITION BY call_id ORDER BY priority, value DESC, finding_id) AS INTEGER) AS rank FROM findings JOIN t ON t.kind = findings.kind""",
)
def ranked_problems(findings: DataFrame) -> DataFrame:
    priority = F.create_map(*(F.lit(x) for kind, _, p in TAXONOMY for x in (kind, p)))
    w = Window.partitionBy("call_id").orderBy(F.try_element_at(priority, F.col("kind")), F.desc("value"), "finding_id")
    return findings.select("call_id", "finding_id", "kind", F.row_number().over(w).alias("rank"))


@query("snk7_report", "findings")
def report(findings: DataFrame) -> DataFrame:
    """One JSON report per call."""
    p = problems(findings).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("priority", "problem", "severity", "streams", "findings"))).alias("problems"))
    whole = conclusion(findings).join(p, "call_id", "left")
    return whole.select("call_id", F.to_json(F.struct("clean", "critical", "root_cause", "issues", "problems")).alias("report"))
