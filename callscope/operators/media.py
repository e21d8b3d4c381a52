"""Audio and video quality of media streams, and rebuilt media, as grouped Arrow functions.

A group is one stream of one capture, so a task holds one stream at a time; payloads travel only here.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
FRAME, HOP = 256, 128
#: Detector limits.
TONE_PEAK, TONE_RMS, TONE_FRAMES, TONE_STEP_HZ = 40.0, 300.0, 10, 50.0
PROMPTS_HZ, PROMPT_WIDTH_HZ, PROMPT_S = (425, 440, 450, 480), 40.0, 6.0
HUM_HZ, HUM_SHARE, HUM_RMS, HUM_FRAMES = 220.0, 0.85, 800.0, 50
CLIP_LEVEL, CLIP_RUN, CLICK_LEVEL, CLICK_QUIET, CLICK_RUN = 20000, 4, 24000, 4000, 6
ACTIVE_RMS, MAX_FILL_S = 500.0, 10


def ulaw_table() -> np.ndarray:
    """Every mu-law byte as a 16-bit sample, from the definition."""
    b = ~np.arange(256) & 0xFF
    size = (((b & 15) << 3) + 132 << ((b >> 4) & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Every A-law byte as a 16-bit sample, from the definition."""
    b = np.arange(256) ^ 0x55
    step, m = (b >> 4) & 7, ((b & 15) << 4) + 8
    size = np.where(step == 0, m, (m + 256) << np.maximum(step - 1, 0))
    return np.where(b & 128, size, -size).astype(np.int16)


#: Samples by payload type: the two types that are decoded here.
TABLES = {0: ulaw_table(), 8: alaw_table()}


def decode(body: bytes, pt: int) -> np.ndarray:
    return TABLES[8 if pt == 8 else 0][np.frombuffer(body, np.uint8)]


def main_type(pts: np.ndarray) -> int:
    """The most frequent payload type, the smallest on ties."""
    kinds, n = np.unique(pts, return_counts=True)
    return int(kinds[np.argmax(n)])


def signal(ext: np.ndarray, ts: np.ndarray, pts: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, int]:
    """Samples in sending order, gaps of the timestamp as silence (up to 10 s), other payload types as silence; and samples per packet."""
    order = np.argsort(ext, kind="stable")
    main = main_type(pts)
    steps = np.diff(ts[order]) % 2**32
    steps = steps[(steps > 0) & (steps < 2**31)]
    per = int(np.sort(steps)[len(steps) // 2]) if len(steps) else 160
    out, expected = [], None
    for k in order:
        if expected is not None:
            gap = int((ts[k] - expected + 2**31) % 2**32 - 2**31)
            if 0 < gap <= MAX_FILL_S * RATE:
                out.append(np.zeros(gap, np.int16))
        part = decode(bodies[k], main) if pts[k] == main else np.zeros(per, np.int16)
        out.append(part)
        expected = int(ts[k]) + len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.int16)), per


def spectra(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes and RMS of overlapping frames."""
    if len(x) < FRAME:
        return np.zeros((0, FRAME // 2 + 1)), np.zeros(0)
    view = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), FRAME)[::HOP]
    return np.abs(np.fft.rfft(view * np.hanning(FRAME), axis=1)), np.sqrt((view**2).mean(axis=1))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def filled(flags: np.ndarray) -> np.ndarray:
    """Single false frames between true ones become true."""
    out = flags.copy()
    out[1:-1] |= flags[:-2] & flags[2:]
    return out


def constant(mag: np.ndarray) -> np.ndarray:
    """Frames that are mostly an offset: bin 0 exceeds the sum of all others."""
    return mag[:, 0] > mag[:, 1:].sum(axis=1)


def tones(mag: np.ndarray, rms: np.ndarray) -> list[tuple[str, float, float, float]]:
    """(kind, start s, end s, Hz): steady single frequencies; prompts are the network's own and short."""
    if not len(mag):
        return []
    hz = RATE / FRAME
    band = slice(int(300 / hz), int(3400 / hz) + 1)
    peak = band.start + mag[:, band].argmax(axis=1)
    height = mag[np.arange(len(mag)), peak]
    clear = (height / np.maximum(np.median(mag, axis=1), 1e-9) >= TONE_PEAK) & (height >= mag[:, 1:].max(axis=1)) & (rms >= TONE_RMS) & ~constant(mag)
    for factor in (2, 3, 0.5):
        k = np.minimum((peak * factor).round().astype(int), mag.shape[1] - 1)
        partner = np.max([mag[np.arange(len(mag)), np.clip(k + d, 0, mag.shape[1] - 1)] for d in (-1, 0, 1)], axis=0)
        clear &= ~((partner > 0.25 * height) & ((peak * factor) < mag.shape[1]) & (np.abs(k - peak) > 2))
    found = []
    for a, b in runs(filled(clear)):
        start = a
        for i in range(a, b + 1):
            if i == b or abs(peak[i] - peak[start]) * hz > TONE_STEP_HZ:
                if i - start >= TONE_FRAMES:
                    f = float(np.median(peak[start:i]) * hz)
                    s, e = start * HOP / RATE, (i * HOP + FRAME - HOP) / RATE
                    prompt = min(abs(f - p) for p in PROMPTS_HZ) <= PROMPT_WIDTH_HZ and e - s <= PROMPT_S
                    found.append(("prompt" if prompt else "howling", s, e, f))
                start = i
    return found


def hums(mag: np.ndarray, rms: np.ndarray) -> list[tuple[str, float, float, float]]:
    if not len(mag):
        return []
    low = int(HUM_HZ / (RATE / FRAME)) + 1
    energy = mag**2
    flags = (energy[:, 1:low].sum(1) >= HUM_SHARE * np.maximum(energy[:, 1:].sum(1), 1e-9)) & (rms >= HUM_RMS) & ~constant(mag)
    return [("hum", a * HOP / RATE, b * HOP / RATE, 0.0) for a, b in runs(filled(flags)) if b - a >= HUM_FRAMES]


def clipped(x: np.ndarray, skip: list[tuple[str, float, float, float]]) -> tuple[int, int]:
    """Runs of equal samples at high level outside tones, and their samples."""
    flat = np.concatenate([[False], (x[1:] == x[:-1]) & (np.abs(x[1:].astype(np.int32)) >= CLIP_LEVEL)]) if len(x) else np.zeros(0, bool)
    n = total = 0
    for a, b in runs(flat):
        at = a / RATE
        if b - a + 1 >= CLIP_RUN and not any(s <= at <= e for _, s, e, _ in skip):
            n, total = n + 1, total + b - a + 1
    return n, total


def clicks(x: np.ndarray) -> int:
    """Short bursts between quiet neighbours."""
    level = np.abs(x.astype(np.int32))
    n = 0
    for a, b in runs(level >= CLICK_LEVEL):
        around = np.concatenate([level[max(0, a - 4) : a], level[b : b + 4]])
        n += b - a <= CLICK_RUN and len(around) > 0 and around.max() < CLICK_QUIET
    return n


def level_db(rms: float) -> float:
    return float(20 * np.log10(max(rms, 1.0) / 32768))


def voice_mask(rms: np.ndarray) -> np.ndarray | None:
    """Frames that hold voice: all where levels vary as speech does, else long bursts well above the median."""
    if len(rms) < 25:
        return None
    smooth = np.convolve(rms, np.ones(5) / 5, "same")
    p10, p50 = np.percentile(smooth, [10, 50])
    if smooth.std() / max(smooth.mean(), 1e-9) >= 0.5 or p10 / max(p50, 1e-9) <= 0.55:
        return np.ones(len(rms), bool)
    mask = np.zeros(len(rms), bool)
    for a, b in runs(smooth >= 1.8 * p50):
        if b - a >= 10:
            mask[a:b] = True
    return mask


AUDIO = (
    "path string, ssrc long, duration_s double, howling int, prompts int, hum int, clip_runs int, clip_samples int, clicks int, noise_db double, speech_db double, "
    "active_ratio double, silence string, verdict string"
)


def audio_row(path: str, ssrc: int, ext: np.ndarray, ts: np.ndarray, pts: np.ndarray, bodies: list[bytes]) -> dict:
    x, _ = signal(ext, ts, pts, bodies)
    mag, rms = spectra(x)
    found = tones(mag, rms)
    hum = hums(mag, rms)
    clip_runs, clip_samples = clipped(x, found)
    active = rms >= ACTIVE_RMS
    for _, s, e, _ in found + hum:
        active[int(s * RATE / HOP) : int(e * RATE / HOP) + 1] = False
    quiet = rms[rms < ACTIVE_RMS]
    mask = voice_mask(rms)
    speech = rms[mask & (rms >= ACTIVE_RMS)] if mask is not None else rms[:0]
    ratio = float(active.mean()) if len(active) else 0.0
    silence = "unknown" if not len(active) else "normal" if ratio >= 0.02 else "sparse" if ratio > 0 else "silent"
    kinds = [k for k, *_ in found]
    n_clicks = clicks(x)
    noise = level_db(float(np.median(quiet))) if len(quiet) >= 10 else None
    bad = kinds.count("howling") > 0 or hum or clip_samples > 200
    noisy = clip_runs >= 2 or n_clicks >= 3 or (noise is not None and noise > -40)
    verdict = "unknown" if silence == "unknown" else "bad" if bad else "silent" if silence == "silent" else "noisy" if noisy else "clean"
    return {
        "path": path, "ssrc": ssrc, "duration_s": len(x) / RATE, "howling": kinds.count("howling"), "prompts": kinds.count("prompt"), "hum": len(hum), "clip_runs": clip_runs,
        "clip_samples": clip_samples, "clicks": n_clicks, "noise_db": noise, "speech_db": level_db(float(speech.mean())) if len(speech) else None, "active_ratio": ratio, "silence": silence, "verdict": verdict,
    }


def stream_arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Unrolled sequence numbers, timestamps, payload types and payloads of one stream, first copies only, in file order."""
    t = t.sort_by("pkt_no")
    seq = t["seq"].to_numpy().astype(np.int64)
    step = np.diff(seq, prepend=seq[:1])
    ext = seq[0] + np.cumsum((step + 32768) % 65536 - 32768)
    _, first = np.unique(ext, return_index=True)
    bodies = t["body"].to_pylist()
    return ext[first], t["rtp_ts"].to_numpy()[first], t["pt"].to_numpy()[first], [bodies[k] for k in first]


def audio_quality(packets: DataFrame) -> DataFrame:
    """One row of AUDIO per stream whose main payload type is decoded here; video and other codecs have none. packets: as rtp_packets gives them."""
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in AUDIO.split(", ")])

    def one(key: tuple, t: pa.Table) -> pa.Table:
        arrays = stream_arrays(t)
        rows = [audio_row(key[0].as_py(), key[1].as_py(), *arrays)] if main_type(arrays[2]) in TABLES else []
        return pa.Table.from_pylist(rows, schema=schema)

    audio = packets.select("path", "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body")
    return audio.groupBy("path", "ssrc").applyInArrow(one, AUDIO)


def rebuilt_audio(packets: DataFrame) -> DataFrame:
    """(path, ssrc, wav): each audio stream as a mono 16-bit WAV file."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        x, _ = signal(*stream_arrays(t))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes(x.astype("<i2").tobytes())
        return pa.table({"path": [key[0].as_py()], "ssrc": [key[1].as_py()], "wav": pa.array([out.getvalue()], pa.binary())})

    audio = packets.where(F.col("pt").isin(0, 8)).select("path", "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body")
    return audio.groupBy("path", "ssrc").applyInArrow(one, "path string, ssrc long, wav binary")


def units(ext: np.ndarray, bodies: list[bytes]) -> Iterator[tuple[bytes, bool]]:
    """H.264 units of payloads in sending order and whether each is broken: single, aggregated and fragmented ones."""
    held: bytearray | None = None
    broken, before = False, None
    for e, b in zip(ext.tolist(), bodies):
        gap = before is not None and e != before + 1
        before = e
        if len(b) < 2:
            continue
        kind = b[0] & 31
        if kind != 28 and held is not None:
            yield bytes(held), True
            held = None
        if kind == 24:
            at = 1
            while at + 2 <= len(b):
                n = int.from_bytes(b[at : at + 2], "big")
                if n:
                    yield b[at + 2 : at + 2 + n], at + 2 + n > len(b)
                at += 2 + n
        elif kind == 28:
            start, end = b[1] & 128, b[1] & 64
            if start:
                if held is not None:
                    yield bytes(held), True
                held, broken = bytearray([b[0] & 0xE0 | b[1] & 31]), False
            elif held is None:
                held, broken = bytearray([b[0] & 0xE0 | b[1] & 31]), True
            broken |= bool(gap and not start)
            held += b[2:]
            if end:
                yield bytes(held), broken
                held = None
        elif 1 <= kind <= 23:
            yield b, False
    if held is not None:
        yield bytes(held), True


VIDEO = "path string, ssrc long, packets int, lost int, units int, broken int, key_frames int, parameter_sets int, verdict string"


def video_quality(packets: DataFrame) -> DataFrame:
    """One row of VIDEO per video stream."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in VIDEO.split(", ")])

    def one(key: tuple, t: pa.Table) -> pa.Table:
        ext, _, _, bodies = stream_arrays(t)
        found = [(u[0] & 31, bad) for u, bad in units(ext, bodies) if u]
        lost = int(ext[-1] - ext[0] + 1 - len(ext))
        broken, keys = sum(b for _, b in found), sum(k == 5 for k, _ in found)
        verdict = "no_units" if not found else "no_key_frame" if not keys else "broken" if broken or lost else "clean"
        row = {"path": key[0].as_py(), "ssrc": key[1].as_py(), "packets": len(ext), "lost": lost, "units": len(found), "broken": broken, "key_frames": keys, "parameter_sets": sum(k in (7, 8) for k, _ in found), "verdict": verdict}
        return pa.Table.from_pylist([row], schema=schema)

    video = packets.where(F.col("pt").between(96, 127)).select("path", "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body")
    return video.groupBy("path", "ssrc").applyInArrow(one, VIDEO)


def rebuilt_video(packets: DataFrame) -> DataFrame:
    """(path, ssrc, h264): each video stream as an Annex B byte stream."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        ext, _, _, bodies = stream_arrays(t)
        data = b"".join(b"\0\0\0\1" + u for u, _ in units(ext, bodies))
        return pa.table({"path": [key[0].as_py()], "ssrc": [key[1].as_py()], "h264": pa.array([data], pa.binary())})

    video = packets.where(F.col("pt").between(96, 127)).select("path", "ssrc", "pkt_no", "seq", "rtp_ts", "pt", "body")
    return video.groupBy("path", "ssrc").applyInArrow(one, "path string, ssrc long, h264 binary")
