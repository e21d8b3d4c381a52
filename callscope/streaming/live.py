"""Live forms of the stateful packet operators, in Structured Streaming.

Operators whose result depends on the order of events hold what has come until the watermark has passed it, and take it up in order of time:
whatever order events arrive in, the results are those of the batch forms. What a key holds is bounded by its events of the
allowed lateness, and beyond that by what each operator says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callscope.operators.signalling import KEY, PRIORITY, WINDOW_US, Copies
from callscope.streaming.gaps import Sequence

TOLERANCE_US = 500_000


def deduplicated(packets: DataFrame, late: str = "1 minute") -> DataFrame:
    """First copies of packets; packets: role, ssrc, seq, at (timestamp)."""
    return packets.withWatermark("at", late).dropDuplicatesWithinWatermark(["role", "ssrc", "seq"])


def legs(packets: DataFrame, quiet: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Stretches of each stream without a silence longer than the limit."""
    w = packets.withWatermark("at", late).groupBy("role", "ssrc", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("packets"))
    return w.select("role", "ssrc", F.col("w.start").alias("start"), "packets")


def health(packets: DataFrame, every: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Packets and distinct sequence numbers of each stream by time window."""
    w = packets.withWatermark("at", late).groupBy("role", "ssrc", F.window("at", every).alias("w"))
    return w.agg(F.count("*").alias("packets"), F.approx_count_distinct("seq").alias("distinct_seq")).select("role", "ssrc", F.col("w.start").alias("start"), "packets", "distinct_seq")


def crossing(a: DataFrame, b: DataFrame, within: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Delay of each packet between two live captures."""
    a = a.withWatermark("at", late).select("ssrc", "seq", F.col("at").alias("at_a"))
    b = b.withWatermark("at", late).select(F.col("ssrc").alias("ssrc_b"), F.col("seq").alias("seq_b"), F.col("at").alias("at_b"))
    near = f"at_b between at_a - interval {within} and at_a + interval {within}"
    j = a.join(b, F.expr(f"ssrc = ssrc_b and seq = seq_b and {near}"))
    return j.select("ssrc", "seq", ((F.unix_micros("at_b") - F.unix_micros("at_a")) / 1000).alias("delay_ms"))


def in_order(rows: DataFrame, keys: list[str], columns: list[str], result: str, state_type: str, step: Callable) -> DataFrame:
    """What `step` makes of each key's rows, held until the watermark has passed them.

    rows: keys, at (timestamp with a watermark), columns, which are all long and begin with a time in microseconds. step(kept, settled, mark_us)
    gets the key's state (None at first), the rows that are settled, sorted, as a matrix, and the watermark; it gives output rows, the new
    state (None to drop the key) and the time in microseconds at which it wants to be called again, or None.
    """
    width = len(columns)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, kept = (state.get[0], state.get[1:]) if state.exists else ([], None)
        parts = [np.array(held, np.int64).reshape(-1, width)]
        if not state.hasTimedOut:
            parts += [f[columns].to_numpy(np.int64) for f in frames]
        all_, mark = np.concatenate(parts), state.getCurrentWatermarkMs() * 1000
        settled = all_[all_[:, 0] <= mark]
        settled, waiting = settled[np.lexsort(settled.T[::-1])], all_[all_[:, 0] > mark]
        out, kept, call_us = step(kept, settled, mark)
        times = [t for t in (waiting[:, 0].min() if len(waiting) else None, call_us) if t is not None]
        if kept is None and not len(waiting):
            if state.exists:
                state.remove()
        else:
            state.update((waiting.reshape(-1).tolist(), *(kept if kept is not None else empty)))
            if times:
                # A timer rings once the watermark is past it.
                state.setTimeoutTimestamp(max(mark // 1000 + 1, int(-(-min(times) // 1000))))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=names)

    key_types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, *(f.split()[0] for f in result.split(", "))]
    # What a key without a state of its own but with waiting rows has.
    empty = tuple([] if "array" in f else None for f in state_type.split(", "))
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{key_types}, {result}", f"held array<bigint>, {state_type}", "append", GroupStateTimeout.EventTimeTimeout)


def losses(packets: DataFrame, late: str = "1 minute") -> DataFrame:
    """Running totals of lost packets, as soon as the watermark has passed them: a row for a stream each time they change.

    packets: role, ssrc, seq, t_us, pkt_no, at. `refunded` is by how much late packets have lessened the loss since the row before; the last
    row of a stream has the totals of the batch operator. A stream holds its open gaps, which lie within 65536 numbers of its highest.
    """
    rows = packets.withWatermark("at", late).select("role", "ssrc", "at", *(F.col(c).cast("long").alias(c) for c in ("t_us", "pkt_no", "seq")))

    def step(kept: tuple | None, settled: np.ndarray, mark: int) -> tuple:
        if not len(settled):
            return [], kept, None
        sequence = Sequence.of(kept)
        before = sequence.refunded
        for seq in settled[:, 2].tolist():
            sequence.take(seq)
        out = (sequence.packets, sequence.lost, sequence.loss_events, sequence.longest_gap, sequence.reordered, sequence.refunded - before, int(settled[-1, 0]))
        return [out], sequence.state(), None

    result = "packets bigint, lost bigint, loss_events bigint, longest_gap bigint, reordered bigint, refunded bigint, upto_us bigint"
    return in_order(rows, ["role", "ssrc"], ["t_us", "pkt_no", "seq"], result, "numbers array<bigint>, gaps array<bigint>", step)


def server_delays(inbound: DataFrame, outbound: DataFrame, late: str = "1 minute", within_us: int = TOLERANCE_US) -> DataFrame:
    """(ssrc, t_us, delay_ms): time from each inbound packet to the first outbound one of the stream at or after it, if that comes within half a second.

    inbound, outbound: ssrc, t_us, at. A stream holds its packets of the last half second before the watermark.
    """
    rows = inbound.select("ssrc", "at", "t_us", F.lit(1).alias("into")).unionByName(outbound.select("ssrc", "at", "t_us", F.lit(0).alias("into")))
    rows = rows.withWatermark("at", late).select("ssrc", "at", *(F.col(c).cast("long").alias(c) for c in ("t_us", "into")))

    def step(kept: tuple | None, settled: np.ndarray, mark: int) -> tuple:
        waiting, sent = (np.array(x, np.int64) for x in kept) if kept else (np.empty(0, np.int64), np.empty(0, np.int64))
        waiting = np.concatenate([waiting, settled[settled[:, 1] == 1, 0]])
        sent = np.concatenate([sent, settled[settled[:, 1] == 0, 0]])
        ready = waiting[waiting + within_us <= mark + 1]
        waiting = waiting[len(ready) :]
        at = np.searchsorted(sent, ready)
        found = at < len(sent)
        after = np.where(found, sent[np.minimum(at, len(sent) - 1)] - ready, within_us) if len(sent) else np.full(len(ready), within_us)
        out = [(int(t), d / 1000) for t, d in zip(ready, after.tolist()) if d < within_us]
        first = int(waiting[0]) if len(waiting) else mark + 1
        sent = sent[np.searchsorted(sent, first) :]
        if not len(waiting) and not len(sent):
            return out, None, None
        return out, (waiting.tolist(), sent.tolist()), first + within_us if len(waiting) else None

    return in_order(rows, ["ssrc"], ["t_us", "into"], "t_us bigint, delay_ms double", "waiting array<bigint>, sent array<bigint>", step)


def messages(copies: DataFrame, late: str = "1 minute") -> DataFrame:
    """One row per message, once no copy can join it any more: copies within 32 s of the kept one are resends, or replace it if of a better capture.

    copies: call_id, method, cseq, src, dst, file, t_us, at. A message key holds one kept copy; its timer ends it 32 s after it.
    Captures of unknown names count as one.
    """
    files = sorted(PRIORITY, key=PRIORITY.get)
    place = F.coalesce(*(F.when(F.col("file") == f, k) for k, f in enumerate(files)), F.lit(len(files)))
    rows = copies.withWatermark("at", late).select(*KEY, "at", F.col("t_us").cast("long").alias("t_us"), place.cast("long").alias("file_no"))

    def step(kept: tuple | None, settled: np.ndarray, mark: int) -> tuple:
        machine = Copies(*kept[0]) if kept and kept[0] else Copies()
        out = [x for t_us, file_no in settled.tolist() for x in machine.feed(t_us, file_no, file_no)]
        if machine.now is not None and machine.now[0] + WINDOW_US <= mark:
            out += machine.close()
        named = [(t, files[f] if f < len(files) else None, n) for t, f, n in out]
        return (named, None, None) if machine.now is None else (named, (list(machine.now),), machine.now[0] + WINDOW_US)

    return in_order(rows, KEY, ["t_us", "file_no"], "t_us bigint, file string, retrans bigint", "now array<bigint>", step)
