"""Live forms against their batch forms, on replays in any order."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from callscope.operators import delay, signalling, streams
from callscope.plans.views import view
from callscope.streaming import live
from callscope.streaming.gaps import REACH, Sequence

START = 1_704_067_200_000_000


def test_live_forms(spark, data, tmp_path):
    src = view(spark, data, "pkt").selectExpr("role", "ssrc", "seq", "timestamp_micros(t_us) as at")
    src = src.union(src.limit(1).selectExpr("'z'", "ssrc", "seq", "at + interval 5 minutes"))
    src.union(src.limit(20)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("d", live.deduplicated(stream)), ("l", live.legs(stream)), ("h", live.health(stream)), ("c", live.crossing(stream, stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("d").count() == src.distinct().count()
    assert spark.table("c").where("delay_ms = 0").count() >= src.count()
    # What the watermark has let out is what the whole input gives.
    whole = spark.read.parquet(str(tmp_path / "in"))
    for name, df in (("l", live.legs(whole)), ("h", live.health(whole))):
        out = {tuple(x) for x in spark.table(name).collect()}
        assert out <= {tuple(x) for x in df.collect()}
    assert spark.table("h").count() > 0 and spark.table("l").count() > 0


def replay(spark, tmp_path, name, batches, schema, build, keep="append"):
    """Rows of a live query over one file a batch, each handled before the next comes."""
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if query is None:
            query = build(stream).writeStream.format("memory").queryName(name).outputMode(keep).option("checkpointLocation", str(folder / "state")).start()
        query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def shuffled(r, rows, late_us, n):
    """n batches in which a row comes up to late_us after rows of later times; then two that only move the watermark on."""
    rows = sorted(rows, key=lambda x: x[0] + r.randrange(late_us))
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def packets(r):
    """Streams with losses, late and repeated packets, two of them over a wrap."""
    rows = []
    for ssrc, first in ((1, 10), (2, 65_400), (3, 65_530)):
        sent = [(first + k, START + 20_000 * k) for k in range(250) if r.random() > 0.1]
        for seq, t in sent:
            late = r.choice([0] * 12 + [45_000, 130_000])
            rows.append((t + late + r.randrange(3000), ssrc, seq % 65536))
            if r.random() < 0.03:
                rows.append((t + 61_000, ssrc, seq % 65536))
    return [(t, "fs", s, q, k) for k, (t, s, q) in enumerate(sorted(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_losses_in_any_order_of_arrival(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = packets(r)
    schema = "t_us long, role string, ssrc long, seq int, pkt_no long"
    ends = [[(START + k * 60_000_000, "fs", 99, 1, 10**6 + k)] for k in (1, 2)]
    batches = [*shuffled(r, rows, 900_000, 6), *ends]
    build = lambda s: live.losses(s.withColumn("at", F.timestamp_micros("t_us")), "1 second")
    got = defaultdict(list)
    for x in replay(spark, tmp_path, f"loss{seed}", batches, schema, build):
        got[x.ssrc].append(x)
    batch = {x.ssrc: x for x in streams.packet_loss(spark.createDataFrame(rows, "t_us long, role string, ssrc long, seq int, pkt_no long")).collect()}
    assert set(batch) == {1, 2, 3}
    for ssrc, expected in batch.items():
        last = max(got[ssrc], key=lambda x: x.upto_us)
        for c in ("packets", "lost", "loss_events", "longest_gap", "reordered"):
            assert last[c] == expected[c], (ssrc, c)
        assert len(got[ssrc]) > 2 and sum(x.refunded for x in got[ssrc]) > 0


def test_open_gaps_are_bounded():
    r = random.Random(5)
    s, ext = Sequence(), 0
    for _ in range(60_000):
        ext += r.choice([1, 2, 3, 5, 2000])
        s.take(ext % 65536)
    assert s.top == ext or s.top > 0
    assert s.first[0] >= s.top - 2 * REACH and len(s.first) <= REACH and s.first == sorted(s.first)
    lost = s.lost
    for gap in list(zip(s.first, s.last))[-20:]:
        for x in range(gap[0], gap[1] + 1):
            s.take(x % 65536)
        s.take(s.top % 65536)
    assert s.lost < lost and Sequence.of(s.state()).state() == s.state()


def test_server_delays_in_any_order_of_arrival(spark, tmp_path):
    r = random.Random(3)
    into = [(START + 20_000 * k + r.randrange(5000), ssrc) for ssrc in (1, 2) for k in range(200) if r.random() > 0.1]
    sent = [(t + r.choice([3000, 9000, 40_000, 120_000]), ssrc) for t, ssrc in into if r.random() > 0.3]
    sent = [x for x in sent if not START + 1_000_000 < x[0] < START + 1_900_000]
    rows = [(t, s, 1) for t, s in into] + [(t, s, 0) for t, s in sent]
    ends = [[(START + k * 60_000_000, 99, 1)] for k in (1, 2, 3)]
    schema = "t_us long, ssrc long, side int"
    timed = lambda s, k: s.where(f"side = {k}").select("ssrc", "t_us", F.timestamp_micros("t_us").alias("at"))
    got = replay(spark, tmp_path, "asof", [*shuffled(r, rows, 700_000, 6), *ends], schema, lambda s: live.server_delays(timed(s, 1), timed(s, 0), "1 second"))
    expected = []
    for t, s in into:
        after = [x for x, y in sent if y == s and x >= t]
        if after and min(after) - t < 500_000:
            expected.append((s, t, (min(after) - t) / 1000))
    assert sorted((x.ssrc, x.t_us, x.delay_ms) for x in got) == sorted(expected) and len(expected) < len(into)
    frame = lambda x, shift: spark.createDataFrame([(s + shift, t) for t, s in x], "ssrc long, t_us long")
    batch = {x.ssrc: (x.n, round(x.mean_ms, 6)) for x in delay.server_delay(frame(into, 0), frame(sent, 1_000_000)).collect()}
    live_ = defaultdict(list)
    for x in got:
        live_[x.ssrc].append(x.delay_ms)
    assert {s: (len(d), round(sum(d) / len(d), 6)) for s, d in live_.items()} == batch


def copies(r):
    rows = []
    for call in range(6):
        for method in ("INVITE", "200"):
            t = START + r.randrange(3_000_000)
            for _ in range(r.randint(1, 12)):
                t += r.choice([500_000, 1_000_000, 8_000_000, 20_000_000, 31_999_999, 32_000_000, 32_000_001, 40_000_000])
                rows.append((t, f"c{call}", method, 1, "10.0.0.1", "192.0.2.1", r.choice(["fs", "terminal", "terminal", "seat"])))
    return list({(x[0], x[1], x[2], x[6]): x for x in rows}.values())


def test_messages_in_any_order_of_arrival(spark, tmp_path):
    r = random.Random(4)
    rows = copies(r)
    schema = "t_us long, call_id string, method string, cseq int, src string, dst string, file string"
    ends = [[(START + k * 1_000_000_000, "z", "BYE", 1, "a", "b", "fs")] for k in (1, 2)]
    timed = lambda s: live.messages(s.withColumn("at", F.timestamp_micros("t_us")), "30 seconds")
    got = replay(spark, tmp_path, "copies", [*shuffled(r, rows, 20_000_000, 6), *ends], schema, timed)
    batch = signalling.message_dedupe(spark.createDataFrame(rows, schema)).collect()
    same = lambda found: sorted((x.call_id, x.method, x.t_us, x.file, x.retrans) for x in found if x.call_id != "z")
    assert same(got) == same(batch) and len(batch) > 12
    # A resend at 32 s still belongs to the kept copy, one after it doesn't.
    near = [(START, "c", "BYE", 1, "a", "b", "fs"), (START + 32_000_000, "c", "BYE", 1, "a", "b", "fs"), (START + 32_000_001, "c", "BYE", 1, "a", "b", "fs")]
    assert [(x.t_us, x.retrans) for x in signalling.message_dedupe(spark.createDataFrame(near, schema)).orderBy("t_us").collect()] == [(START, 1), (START + 32_000_001, 0)]
