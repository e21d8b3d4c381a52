"""SIP messages and session descriptions out of datagram payloads, in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.scalars import STATIC_PT, sip_address

REQUESTS = ["INVITE", "BYE", "CANCEL", "ACK", "UPDATE", "PRACK", "INFO"]
MOST_BYTES = 8000


def header(lines: Column, *names: str) -> Column:
    """The first header of one of the names, as written or in its short form."""
    wanted = "^(" + "|".join(names) + r")\s*:\s*(.*)$"
    return F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(wanted)), F.lit(0)), wanted, 2)


def sip_events(frames: DataFrame) -> DataFrame:
    """Requests of the known methods, and responses to them."""
    text = F.make_valid_utf8(F.substring("payload", 1, MOST_BYTES).cast("string"))
    df = frames.where((F.col("sport") == 5060) | (F.col("dport") == 5060)).withColumn("_text", text)
    df = df.withColumn("_head", F.split(F.split("_text", "\r?\n\r?\n", 2)[0], "\r?\n"))
    line = F.col("_head")[0]
    code = F.nullif(F.regexp_extract(line, r"^SIP/2\.0\s+([1-6]\d\d)", 1), F.lit(""))
    request = F.nullif(F.regexp_extract(line, r"^([A-Z]+)\s+\S+\s+SIP/2\.0", 1), F.lit(""))
    cseq = header(F.col("_head"), "CSeq")
    df = df.select(
        "path", "frame_no", "t_us", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"),
        F.coalesce(code, request).alias("method"), F.nullif(F.regexp_extract(line, r"^SIP/2\.0\s+\d+\s+(.*)$", 1), F.lit("")).alias("reason"),
        header(F.col("_head"), "Call-ID", "i").alias("call_id"), F.regexp_extract(cseq, r"^(\d+)", 1).try_cast("int").alias("cseq"), F.regexp_extract(cseq, r"^\d+\s+(\w+)", 1).alias("cseq_method"),
        F.size(F.filter("_head", lambda x: x.rlike(r"^(Via|v)\s*:"))).alias("via_count"),
        sip_address(header(F.col("_head"), "From", "f")).alias("from_hdr"), sip_address(header(F.col("_head"), "To", "t")).alias("to_hdr"),
        F.coalesce(F.get(F.split("_text", "\r?\n\r?\n", 2), F.lit(1)), F.lit("")).alias("body"),
    )
    known = F.col("method").isin(REQUESTS) | (F.col("method").rlike(r"^\d") & F.col("cseq_method").isin(REQUESTS))
    return df.where(known)


def media_sections(body: Column) -> Column:
    """array<struct<kind, port, pts, addr, lines>>: the m= sections of a description, each with its own or the session's address."""
    lines = F.filter(F.split(body, "\r?\n"), lambda x: x != "")
    cut = F.split(F.array_join(lines, "\n"), "\n(?=m=)")
    one = lambda s, session: F.struct(
        F.regexp_extract(s, r"^m=(\w+)", 1).alias("kind"),
        F.regexp_extract(s, r"^m=\w+ (\d+)", 1).try_cast("int").alias("port"),
        F.split(F.regexp_extract(s, r"^m=\w+ \S+ \S+ ?([^\n]*)", 1), " ").alias("pts"),
        F.coalesce(F.nullif(F.regexp_extract(s, r"(?m)^c=IN IP[46] (\S+)", 1), F.lit("")), session).alias("addr"),
        F.filter(F.split(s, "\n"), lambda x: x.rlike("^a=rtpmap:")).alias("maps"),
    )
    session = lambda c: F.regexp_extract(F.get(F.filter(c, lambda s: ~s.rlike("^m=")), F.lit(0)), r"(?m)^c=IN IP[46] (\S+)", 1)
    return bound_once(cut, lambda c: bound_once(session(c), lambda at: F.transform(F.filter(c, lambda s: s.rlike("^m=")), lambda s: one(s, at))))


def bound_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being computed once a row, however often `then` names it inside its own lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sdp_endpoints(events: DataFrame) -> DataFrame:
    """(…, kind, addr, port): media addresses that each message announces; port 0 and 0.0.0.0 announce nothing."""
    m = events.select("path", "frame_no", "call_id", F.explode(media_sections(F.col("body"))).alias("m"))
    return m.select("path", "frame_no", "call_id", "m.kind", "m.addr", "m.port").where("port > 0 and addr not in ('', '0.0.0.0')")


def sdp_codecs(events: DataFrame) -> DataFrame:
    """(…, kind, pt, name, rate) in the order of the m= line; static types have their fixed names, telephone events are left out."""
    m = events.select("path", "frame_no", "call_id", F.explode(media_sections(F.col("body"))).alias("m"))
    m = m.select("path", "frame_no", "call_id", "m.kind", "m.maps", F.posexplode("m.pts").alias("place", "p")).where("p rlike '^[0-9]+$'")
    mine = F.get(F.filter("maps", lambda x: F.regexp_extract(x, r"^a=rtpmap:(\d+)", 1) == F.col("p")), F.lit(0))
    known = F.create_map(*(F.lit(v) for k, (name, rate) in STATIC_PT.items() for v in (str(k), f"{name}/{rate}")))
    whole = F.coalesce(F.nullif(F.regexp_extract(mine, r"^a=rtpmap:\d+\s+(\S+)", 1), F.lit("")), F.try_element_at(known, F.col("p")))
    name = F.upper(F.split(whole, "/")[0])
    out = m.select("path", "frame_no", "call_id", "kind", "place", F.col("p").cast("int").alias("pt"), name.alias("name"), F.get(F.split(whole, "/"), F.lit(1)).try_cast("int").alias("rate"))
    return out.where("name is null or name not like 'TELEPHONE%'")
