"""Ogg Opus files from Opus media packets."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from callscope.operators.media import stream_arrays

RATE, SERIAL = 48_000, 1
#: Fixed value: the checksum's generator polynomial.
POLYNOMIAL = 0x04C11DB7


def table() -> list[int]:
    out = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = (r << 1) ^ (POLYNOMIAL if r & 0x80000000 else 0)
        out.append(r & 0xFFFFFFFF)
    return out


TABLE = table()


def checksum(data: bytes) -> int:
    r = 0
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ TABLE[(r >> 24) ^ b]
    return r


def page(packets: list[bytes], granule: int, number: int, first: bool = False, last: bool = False) -> bytes:
    """One page that holds whole packets, of 255 segments at most."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, 2 * first + 4 * last, granule, SERIAL, number, 0, len(lacing)) + lacing
    data = head + b"".join(packets)
    return data[:22] + struct.pack("<I", checksum(data)) + data[26:]


def opus_file(packets: Iterable[tuple[int, bytes]], samples: int = 960) -> bytes:
    """packets: (media timestamp at 48 kHz, payload) in sending order; time never runs back."""
    out = [
        page([b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 0, RATE, 0, 0)], 0, 0, first=True),
        page([b"OpusTags" + struct.pack("<I", 9) + b"callscope" + struct.pack("<I", 0)], 0, 1),
    ]
    waiting: list[bytes] = []
    base, at, segments, number = None, 0, 0, 2
    for ts, body in packets:
        base = ts if base is None else base
        need = len(body) // 255 + 1
        if waiting and segments + need > 255:
            out.append(page(waiting, at, number))
            waiting, segments, number = [], 0, number + 1
        at = max(at, (ts - base) % 2**32 % 2**31 + samples)
        waiting.append(body)
        segments += need
    out.append(page(waiting, at, number, last=True))
    return b"".join(out)


def rebuilt_opus(packets: DataFrame, payload_types: list[int]) -> DataFrame:
    """(path, ssrc, ogg): each stream of the given payload types as an Ogg Opus file."""
    from pyspark.sql import functions as F

    def one(key: tuple, t: pa.Table) -> pa.Table:
        _, ts, _, bodies = stream_arrays(t)
        data = opus_file(zip(ts.tolist(), bodies))
        return pa.table({"path": [key[0].as_py()], "ssrc": [key[1].as_py()], "ogg": pa.array([data], pa.binary())})

    some = packets.where(F.col("pt").isin(payload_types)).select("path", "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body")
    return some.groupBy("path", "ssrc").applyInArrow(one, "path string, ssrc long, ogg binary")
