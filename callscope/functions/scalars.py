"""Formatting, classification and text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Static payload types, their codec and clock.
STATIC_PT = {0: ("PCMU", 8000), 3: ("GSM", 8000), 8: ("PCMA", 8000), 9: ("G722", 8000), 18: ("G729", 8000)}
AUDIO_PT = [0, 3, 8, 9, 18]


def cases(c: Column, table: dict, otherwise: Column) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(c == next(iter(table)), F.lit(next(iter(table.values()))))).otherwise(otherwise)


def codec_name(pt: Column) -> Column:
    return cases(pt, {k: v[0] for k, v in STATIC_PT.items()}, F.when(pt.between(96, 127), "dynamic").otherwise("unknown"))


def codec_clock(pt: Column) -> Column:
    return cases(pt, {k: v[1] for k, v in STATIC_PT.items()}, F.when(pt.between(96, 127), 90000))


def media_kind(pt: Column) -> Column:
    return F.when(pt.isin(AUDIO_PT), "audio").when(pt.between(96, 127), "video").otherwise("unknown")


def dbfs(rms: Column) -> Column:
    """Level of a 16-bit signal, not below that of one step."""
    return 20 * F.log10(F.greatest(rms, F.lit(1.0)) / 32768)


def hex_source(ssrc: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(ssrc)), 8, "0"))


def human_gap(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms")))
        .when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s")))
        .otherwise(F.concat(F.format_string("%.1f", ms / 60000), F.lit(" min")))
    )


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.1f", n / 1024**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024**3), F.lit(" GB")))
    )


def clock_time(t_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(t_us), "HH:mm:ss")


def canonical_role(role: Column) -> Column:
    """The role that a file name stands for; unknown names stay as they are."""
    r = F.lower(F.trim(role))
    # Fixed values.
    named = F.when(r.isin("terminal", "caller", "终端", "主叫"), "terminal").when(r == "fs", "fs").when(r.isin("seat", "zuoxi", "坐席", "被叫"), "seat")
    return F.coalesce(named, role)


def endpoint_direction(role: Column, dst: Column, server: Column) -> Column:
    """Into or out of the capture point."""
    return F.when(role == "fs", F.when(dst == server, "inbound").otherwise("outbound")).otherwise(F.when(dst == server, "outbound").otherwise("inbound"))


def codec_match(name_a: Column, rate_a: Column, name_b: Column, rate_b: Column) -> Column:
    return (name_a == name_b) & (rate_a.isNull() | rate_b.isNull() | (rate_a == rate_b))


def sip_address(header: Column) -> Column:
    """struct<name, user, host> of a From or To header."""
    name = F.nullif(F.trim(F.regexp_extract(header, '^\\s*"?([^"<]*?)"?\\s*<', 1)), F.lit(""))
    uri = F.coalesce(F.nullif(F.regexp_extract(header, "<([^>]*)>", 1), F.lit("")), F.trim(header))
    user = F.coalesce(F.nullif(F.regexp_extract(uri, "^sips?:([^@;]+)@", 1), F.lit("")), F.nullif(F.regexp_extract(uri, "^tel:([^;]+)", 1), F.lit("")))
    host = F.nullif(F.regexp_extract(uri, "^sips?:(?:[^@;]+@)?([^;:>]+)", 1), F.lit(""))
    return F.struct(name.alias("name"), user.alias("user"), host.alias("host"))


def private_address(ip: Column) -> Column:
    return ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)")


def multicast_or_void(ip: Column) -> Column:
    return ip.rlike(r"^(224\.|239\.)") | ip.isin("0.0.0.0", "255.255.255.255")
