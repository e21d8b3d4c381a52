"""Usage statistics, catalogues and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import scalars
from callscope.plans.registry import query


@query(
    "ag19_totals", "visits", "analyses",
    sql=""" SELECT (SELECT count(*) FROM visits) AS views, (SELECT count(DISTINCT vid) FROM visits) AS visitors, (SELECT count(*) FROM analyses) AS analyses, (SELECT count(DISTINCT vid) FROM analyses) AS analysts,
      (SELECT count(*) FROM visits WHERE day = (SELECT max(day) FROM visits)) AS views_last_day, (SELECT count(DISTINCT vid) FROM visits WHERE day = (SELECT max(day) FROM visits)) AS visitors_last_day""",
)
def totals(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    last = visits.agg(F.max("day").alias("last"))
    v = visits.join(F.broadcast(last)).agg(
        F.count("*").alias("views"), F.count_distinct("vid").alias("visitors"), F.count_if(F.col("day") == F.col("last")).alias("views_last_day"),
        F.count_distinct(F.when(F.col("day") == F.col("last"), F.col("vid"))).alias("visitors_last_day"),
    )
    a = analyses.agg(F.count("*").alias("analyses"), F.count_distinct("vid").alias("analysts"))
    return v.join(a).select("views", "visitors", "analyses", "analysts", "views_last_day", "visitors_last_day")


@query(
    "ag20_daily", "visits", "analyses",
    sql=""", v AS (SELECT day, count(*) AS pv, count(DISTINCT vid) AS uv FROM visits GROUP BY day), a AS (SELECT day, count(*) AS n, CAST(sum(files) AS BIGINT) AS files FROM analyses GROUP BY day),
    d AS (SELECT day FROM v UNION SELECT day FROM a)
    SELECT d.day, coalesce(pv, 0) AS pv, coalesce(uv, 0) AS uv, coalesce(n, 0) AS analyses, coalesce(files, 0) AS files FROM d LEFT JOIN v ON v.day = d.day LEFT JOIN a ON a.day = d.day""",
)
def daily(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    """Views, visitors and analyses by day, zero where there are none."""
    v = visits.groupBy("day").agg(F.count("*").alias("pv"), F.count_distinct("vid").alias("uv"))
    a = analyses.groupBy("day").agg(F.count("*").alias("analyses"), F.sum("files").alias("files"))
    days = v.select("day").union(a.select("day")).distinct()
    return days.join(v, "day", "left").join(a, "day", "left").na.fill(0)


@query(
    "jn17_regions", "visits", "analyses",
    sql=""", v AS (SELECT country, province, count(*) AS pv, count(DISTINCT vid) AS uv FROM visits GROUP BY ALL), a AS (SELECT country, province, count(*) AS analyses FROM analyses GROUP BY ALL)
    SELECT v.country, v.province, pv, uv, coalesce(analyses, 0) AS analyses FROM v LEFT JOIN a ON a.country = v.country AND a.province IS NOT DISTINCT FROM v.province""",
)
def regions(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    v = visits.groupBy("country", "province").agg(F.count("*").alias("pv"), F.count_distinct("vid").alias("uv"))
    a = analyses.groupBy(F.col("country").alias("c"), F.col("province").alias("p")).agg(F.count("*").alias("analyses"))
    both = v.join(a, (F.col("country") == F.col("c")) & F.col("province").eqNullSafe(F.col("p")), "left")
    return both.select("country", "province", "pv", "uv", F.coalesce("analyses", F.lit(0)).alias("analyses"))


@query("jn17_domains", "visits", "analyses", sql=", a AS (SELECT domain, count(*) AS analyses FROM analyses GROUP BY domain) SELECT v.domain, count(*) AS pv, max(coalesce(analyses, 0)) AS analyses FROM visits v LEFT JOIN a ON a.domain = v.domain GROUP BY v.domain")
def domains(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    v = visits.groupBy("domain").agg(F.count("*").alias("pv"))
    return v.join(analyses.groupBy("domain").agg(F.count("*").alias("analyses")), "domain", "left").na.fill(0, ["analyses"])


@query("tk5_recent", "analyses", sql=" SELECT event_id, day, vid FROM analyses ORDER BY event_id DESC LIMIT 20")
def recent(analyses: DataFrame, k: int = 20) -> DataFrame:
    return analyses.orderBy(F.desc("event_id")).limit(k).select("event_id", "day", "vid")


@query("so1_days", "visits", "analyses", sql=" SELECT day FROM visits UNION SELECT day FROM analyses")
def days(visits: DataFrame, analyses: DataFrame) -> DataFrame:
    return visits.select("day").union(analyses.select("day")).distinct()


@query(
    "src11_region_lookup", "ip_ranges", "addresses",
    sql=" SELECT id, ip, region FROM addresses LEFT JOIN ip_ranges ON ip BETWEEN start_ip AND end_ip",
)
def region_lookup(ranges: DataFrame, addresses: DataFrame) -> DataFrame:
    """The region whose address range holds each address: ranges are cut at /16 blocks, which gives an equi key."""
    block = F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))).alias("block")
    cut = ranges.select("start_ip", "end_ip", "region", block)
    a = addresses.withColumn("block", F.shiftright("ip", 16))
    inside = (a["block"] == cut["block"]) & (a["ip"] >= cut["start_ip"]) & (a["ip"] <= cut["end_ip"])
    return a.join(cut, inside, "left").select("id", "ip", "region")


@query(
    "wn20_latest_per_group", "part",
    sql="SELECT p_brand, p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey DESC) AS k FROM part) WHERE k = 1",
)
def latest_per_group(files: DataFrame) -> DataFrame:
    """The newest file of each platform and architecture."""
    newest = F.max(F.struct("p_size", "p_partkey"))
    return files.groupBy("p_brand", "p_type").agg(newest.alias("k")).select("p_brand", "p_type", "k.p_partkey", "k.p_size")


@query(
    "jn18_catalogue_merge", "supplier", "customer",
    sql="SELECT s_suppkey AS id, 'local' AS origin, s_acctbal AS size FROM supplier UNION ALL SELECT c_custkey, 'remote', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def catalogue_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local entries, and remote ones of other names."""
    here = local.select(F.col("s_suppkey").alias("id"), F.lit("local").alias("origin"), F.col("s_acctbal").alias("size"))
    there = remote.select(F.col("c_custkey").alias("id"), F.lit("remote").alias("origin"), F.col("c_acctbal").alias("size"))
    return here.unionByName(there.join(here.select("id"), "id", "left_anti"))


@query("so6_missing_chunks", "events", sql="SELECT user_id, CAST(n AS BIGINT) AS missing FROM (SELECT user_id, unnest(range(0, 20)) AS n FROM (SELECT DISTINCT user_id FROM events)) r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.event_id % 20 = r.n)")
def missing_chunks(events: DataFrame, n: int = 20) -> DataFrame:
    """Numbers of 0 to n-1 that an upload lacks."""
    have = events.groupBy("user_id").agg(F.collect_set(F.col("event_id") % n).alias("have"))
    return have.select("user_id", F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), "have")).alias("missing"))


@query(
    "so3_codec_intersection", "legs",
    sql=""", s AS (SELECT session_id, list_sort(list_distinct(list(ssrc % 7) FILTER (role = 'terminal'))) AS offer, list_sort(list_distinct(list(ssrc % 5) FILTER (role = 'seat'))) AS answer FROM legs GROUP BY session_id),
    x AS (SELECT session_id, offer, answer, list_filter(offer, lambda c: list_contains(answer, c)) AS common FROM s)
    SELECT session_id, array_to_string(CASE WHEN coalesce(len(common), 0) = 0 THEN coalesce(answer, []) ELSE common END, ',') AS codecs FROM x""",
)
def codec_intersection(legs: DataFrame) -> DataFrame:
    """Offered codecs that the answer has too, in the offer's order; the answer if there are none."""
    side = lambda role, m: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("ssrc") % m)))
    s = legs.groupBy("session_id").agg(side("terminal", 7).alias("offer"), side("seat", 5).alias("answer"))
    both = F.filter("offer", lambda c: F.array_contains("answer", c))
    chosen = F.when(F.size(both) == 0, F.col("answer")).otherwise(both)
    return s.select("session_id", F.array_join(F.transform(chosen, lambda c: c.cast("string")), ",").alias("codecs"))


@query(
    "so4_so5_device_sets", "legs",
    sql=""", s AS (SELECT session_id, list(DISTINCT ip) FILTER (role = 'terminal') AS a, list(DISTINCT ip) FILTER (role = 'fs') AS b FROM legs GROUP BY session_id)
    SELECT session_id, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS shared, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_terminal FROM s""",
)
def device_sets(legs: DataFrame) -> DataFrame:
    side = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("ip")))
    s = legs.groupBy("session_id").agg(side("terminal").alias("a"), side("fs").alias("b"))
    return s.select("session_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_except("a", "b")).cast("long").alias("only_terminal"))


@query(
    "fn10_fn17_payload_kinds", "part",
    sql="""SELECT p_size AS pt, count(*) AS n, CASE p_size WHEN 0 THEN 'PCMU' WHEN 3 THEN 'GSM' WHEN 8 THEN 'PCMA' WHEN 9 THEN 'G722' WHEN 18 THEN 'G729' ELSE CASE WHEN p_size BETWEEN 96 AND 127 THEN 'dynamic' ELSE 'unknown' END END AS codec,
      CASE WHEN p_size IN (0, 3, 8, 9, 18) THEN 8000 WHEN p_size BETWEEN 96 AND 127 THEN 90000 END AS clock, CASE WHEN p_size IN (0, 3, 8, 9, 18) THEN 'audio' WHEN p_size BETWEEN 96 AND 127 THEN 'video' ELSE 'unknown' END AS kind
    FROM part GROUP BY p_size""",
)
def payload_kinds(parts: DataFrame) -> DataFrame:
    pt = F.col("pt")
    n = parts.groupBy(F.col("p_size").alias("pt")).agg(F.count("*").alias("n"))
    return n.select("pt", "n", scalars.codec_name(pt).alias("codec"), scalars.codec_clock(pt).alias("clock"), scalars.media_kind(pt).alias("kind"))


@query(
    "fn6_sip_address", "nation",
    sql="""WITH h AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '"' || n_name || '" <sip:u' || n_nationkey || '@10.0.0.' || n_nationkey || ':5060;tag=a>' WHEN 1 THEN '<sips:host' || n_nationkey || '.example>'
        WHEN 2 THEN 'sip:x' || n_nationkey || '@h.example;tag=1' ELSE n_name || ' <tel:+49' || n_nationkey || ';phone-context=x>' END AS header FROM nation)
    SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN regexp_extract(header, '"(.*)"', 1) WHEN 3 THEN regexp_extract(header, '^([^ ]*) ', 1) END AS name,
      CASE n_nationkey % 4 WHEN 0 THEN 'u' || n_nationkey WHEN 2 THEN 'x' || n_nationkey WHEN 3 THEN '+49' || n_nationkey END AS user,
      CASE n_nationkey % 4 WHEN 0 THEN '10.0.0.' || n_nationkey WHEN 1 THEN 'host' || n_nationkey || '.example' WHEN 2 THEN 'h.example' END AS host FROM h""",
)
def sip_addresses(nations: DataFrame) -> DataFrame:
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    form = F.col("n_nationkey") % 4
    header = (
        F.when(form == 0, F.concat(F.lit('"'), name, F.lit('" <sip:u'), k, F.lit("@10.0.0."), k, F.lit(":5060;tag=a>")))
        .when(form == 1, F.concat(F.lit("<sips:host"), k, F.lit(".example>")))
        .when(form == 2, F.concat(F.lit("sip:x"), k, F.lit("@h.example;tag=1")))
        .otherwise(F.concat(name, F.lit(" <tel:+49"), k, F.lit(";phone-context=x>")))
    )
    return nations.select("n_nationkey", scalars.sip_address(header).alias("a")).select("n_nationkey", "a.name", "a.user", "a.host")


@query(
    "fn13_formats", "orders",
    sql="""SELECT o_orderkey, '0x' || lpad(lower(to_hex(o_orderkey * 7919)), 8, '0') AS source, strftime(make_timestamp(1704067200000000 + o_orderkey * 1234567), '%H:%M:%S') AS at,
      CASE WHEN o_orderkey % 1000 < 300 THEN CAST(o_orderkey % 300 AS VARCHAR) || ' ms' WHEN o_orderkey % 1000 < 700 THEN CAST(o_orderkey % 50 + 2 AS VARCHAR) || '.0 s' ELSE CAST(o_orderkey % 9 + 1 AS VARCHAR) || '.0 min' END AS gap FROM orders""",
)
def formats(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ms = F.when(k % 1000 < 300, (k % 300).cast("double")).when(k % 1000 < 700, (k % 50 + 2) * 1000.0).otherwise((k % 9 + 1) * 60000.0)
    return orders.select("o_orderkey", scalars.hex_source(k * 7919).alias("source"), scalars.clock_time(F.lit(1704067200000000) + k * 1234567).alias("at"), scalars.human_gap(ms).alias("gap"))


@query(
    "fn21_json_fields", "events",
    sql="SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
)
def json_fields(events: DataFrame) -> DataFrame:
    return events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(
    "fn16_directions", "streams",
    sql=" SELECT role, ssrc, CASE WHEN role = 'fs' THEN CASE WHEN dst_ip = '192.0.2.1' THEN 'inbound' ELSE 'outbound' END ELSE CASE WHEN dst_ip = '192.0.2.1' THEN 'outbound' ELSE 'inbound' END END AS direction FROM streams",
)
def stream_directions(streams: DataFrame) -> DataFrame:
    return streams.select("role", "ssrc", scalars.endpoint_direction(F.col("role"), F.col("dst_ip"), F.lit("192.0.2.1")).alias("direction"))


@query(
    "jn15_alias_lookup", "streams", "addresses",
    sql=""", m AS (SELECT concat('10.', CAST(id % 200 AS STRING), '.0.1') AS ip, min(id) AS party FROM addresses WHERE id % 3 = 0 GROUP BY ALL)
    SELECT role, ssrc, coalesce('party' || CAST(party AS VARCHAR), src_ip) AS sender FROM streams LEFT JOIN m ON m.ip = src_ip""",
)
def alias_lookup(streams: DataFrame, addresses: DataFrame) -> DataFrame:
    """Senders by the party their announced address belongs to, else by address."""
    m = addresses.where("id % 3 = 0").groupBy(F.concat(F.lit("10."), (F.col("id") % 200).cast("string"), F.lit(".0.1")).alias("src_ip")).agg(F.min("id").alias("party"))
    return streams.join(m, "src_ip", "left").select("role", "ssrc", F.coalesce(F.concat(F.lit("party"), F.col("party").cast("string")), "src_ip").alias("sender"))


@query("fl2_public_addresses", "streams", sql=r" SELECT DISTINCT dst_ip AS ip FROM streams WHERE NOT regexp_matches(dst_ip, '^(224\.|239\.)') AND dst_ip NOT IN ('0.0.0.0', '255.255.255.255')")
def plain_addresses(streams: DataFrame) -> DataFrame:
    return streams.where(~scalars.multicast_or_void(F.col("dst_ip"))).select(F.col("dst_ip").alias("ip")).distinct()


@query(
    "snk8_expired_folders", "orders",
    sql="SELECT o_custkey % 50 AS top, max(o_orderdate) AS newest FROM orders GROUP BY 1 HAVING max(o_orderdate) < (SELECT max(o_orderdate) FROM orders) - INTERVAL 2 DAY",
)
def expired_folders(files: DataFrame) -> DataFrame:
    """Top folders whose newest file is older than the retention."""
    per = files.groupBy((F.col("o_custkey") % 50).alias("top")).agg(F.max("o_orderdate").alias("newest"))
    return per.join(F.broadcast(per.agg(F.max("newest").alias("now"))), F.col("newest") < F.expr("now - INTERVAL 2 DAYS")).select("top", "newest")
