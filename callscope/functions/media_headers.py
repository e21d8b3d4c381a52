"""Media and control packets out of datagram payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORTS = "array<struct<ssrc:bigint,fraction_pct:double,lost:bigint,highest:bigint,jitter:bigint,lsr:bigint,dlsr:bigint>>"
RTCP = f"kind string, ssrc long, media_ssrc long, ntp_sec long, ntp_frac long, rtp_ts long, packets long, octets long, requested int, reports {REPORTS}"
REPORT_TYPE = pa.list_(
    pa.struct([("ssrc", pa.int64()), ("fraction_pct", pa.float64()), ("lost", pa.int64()), ("highest", pa.int64()), ("jitter", pa.int64()), ("lsr", pa.int64()), ("dlsr", pa.int64())])
)


def number(payload: Column, at: int | Column, n: int) -> Column:
    """The big-endian number of n bytes from byte `at` (from 1)."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(payload, at, F.lit(n))), 16, 10).cast("long")


def rtp_packets(frames: DataFrame) -> DataFrame:
    """Media packets among the frames: version 2, not a control packet, no signalling port. Contributing sources, extension and padding are taken off the payload."""
    p = F.col("payload")
    first, second = number(p, 1, 1), number(p, 2, 1)
    ok = (F.length(p) >= 12) & (F.col("sport") != 5060) & (F.col("dport") != 5060)
    df = frames.where(ok).withColumns({"_b0": first, "_b1": second}).where("_b0 >= 128 and _b0 < 192 and _b1 not between 200 and 206")
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(1)
    after_csrc = 12 + 4 * F.col("_b0").bitwiseAND(15)
    df = df.withColumn("_at", after_csrc)
    words = F.coalesce(number(p, (F.col("_at") + 3).cast("int"), 2), F.lit(0))
    df = df.withColumn("_at", F.col("_at") + F.when(bit(F.col("_b0"), 4) == 1, 4 + 4 * words).otherwise(0))
    pad = F.when(bit(F.col("_b0"), 5) == 1, number(p, F.length(p), 1)).otherwise(0)
    body = F.substring(p, (F.col("_at") + 1).cast("int"), F.greatest(F.lit(0), F.length(p) - F.col("_at") - pad).cast("int"))
    return df.select(
        "path", F.col("frame_no").alias("pkt_no"), "t_us", number(p, 9, 4).alias("ssrc"), number(p, 3, 2).cast("int").alias("seq"), number(p, 5, 4).alias("rtp_ts"),
        F.col("_b1").bitwiseAND(127).cast("int").alias("pt"), (F.col("_b1") >= 128).alias("marker"), "src_ip", "sport", "dst_ip", "dport", body.alias("body"),
    )


def control_packets(data: bytes, most: int = 16) -> list[tuple]:
    """Rows of RTCP for the sub-packets of a compound packet; stops at the first inconsistency."""
    out, at = [], 0
    while at + 8 <= len(data) and len(out) < most:
        head, kind, words = struct.unpack(">BBH", data[at : at + 4])
        size = 4 * (words + 1)
        if head >> 6 != 2 or not 200 <= kind <= 206 or at + size > len(data):
            break
        body, count = data[at + 4 : at + size], head & 31
        ssrc = int.from_bytes(body[:4], "big")
        media = int.from_bytes(body[4:8], "big") if len(body) >= 8 else None
        if kind == 200 and len(body) >= 24:
            out.append(("SR", ssrc, None, *struct.unpack(">5I", body[4:24]), None, blocks(body[24:], count)))
        elif kind == 201:
            out.append(("RR", ssrc, None, *[None] * 6, blocks(body[4:], count)))
        elif kind == 205 and count == 1:
            lost = sum(1 + int.from_bytes(body[k + 2 : k + 4], "big").bit_count() for k in range(8, len(body) - 3, 4))
            out.append(("NACK", ssrc, media, *[None] * 5, lost, []))
        elif kind == 206 and count in (1, 4):
            target = int.from_bytes(body[8:12], "big") if count == 4 and len(body) >= 12 else media
            out.append(("PLI" if count == 1 else "FIR", ssrc, target, *[None] * 5, 1, []))
        at += size
    return out


def blocks(data: bytes, count: int) -> list[dict]:
    """Report blocks: loss as a share of 256, cumulative loss signed."""
    out = []
    for k in range(0, min(24 * count, len(data) - 23), 24):
        ssrc, lost, highest, jitter, lsr, dlsr = struct.unpack(">6I", data[k : k + 24])
        total = lost & 0xFFFFFF
        out.append({"ssrc": ssrc, "fraction_pct": (lost >> 24) * 100 / 256, "lost": total - (1 << 24) * (total >> 23), "highest": highest, "jitter": jitter, "lsr": lsr, "dlsr": dlsr})
    return out


def rtcp_events(frames: DataFrame) -> DataFrame:
    """Control packets among the frames, one row per sub-packet."""
    kinds = [pa.string(), *[pa.int64()] * 7, pa.int32(), REPORT_TYPE]
    names = [c.split()[0] for c in RTCP.split(", ", 9)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, t, *x) for p, n, t, data in zip(*(c.to_pylist() for c in b.columns)) for x in control_packets(data)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), *kinds])], names=["path", "frame_no", "t_us", *names])

    p = F.col("payload")
    some = frames.where((F.length(p) >= 8) & number(p, 2, 1).between(200, 206) & number(p, 1, 1).between(128, 191))
    return some.select("path", "frame_no", "t_us", "payload").mapInArrow(parse, "path string, frame_no long, t_us long, " + RTCP)
