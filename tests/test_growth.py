"""Work that must grow with its input: results of dense tables, against plain accounts of the same rules."""

import random

import pytest

from callscope.operators import calls, delay, streams, verdicts
from callscope.plans.all import QUERIES

LEGS = "leg_id long, session_id long, ssrc long, ip string, start_s long, end_s long, role string, first_seq long"
DIALOGS = "dialog_id long, session_id long, ip string, invite_s long, bye_s long"


def dense(spark, seed, legs=160, dialogs=120, span=300):
    """Legs and dialogs of two sessions and three devices, many at the same seconds."""
    r = random.Random(seed)
    ls = []
    for k in range(legs):
        a = r.randrange(span)
        ls.append((k, r.randrange(2), r.randrange(legs), f"10.0.0.{r.randrange(3)}", a, a + r.choice([0, 1, 2, 5, 10, 20, 50, 90]), r.choice("abc"), 0))
    ds = []
    for k in range(dialogs):
        a = r.randrange(span)
        ds.append((1000 + k, r.randrange(2), f"10.0.0.{r.randrange(3)}", a, a + r.choice([-3, 0, 1, 8, 30, 90])))
    return ls, ds, spark.createDataFrame(ls, LEGS), spark.createDataFrame(ds, DIALOGS)


def test_nearest_dialog_is_found_without_pairs(spark):
    """Ends that many dialogs share are sorted, not joined: no table of seconds that could be broadcast."""
    for seed in range(3):
        ls, ds, legs, dialogs = dense(spark, seed)
        want = {}
        for leg, session, _, ip, a, b, *_ in ls:
            apart = [(min(abs(b - y), abs(a - x)), d) for d, s, i, x, y in ds if (s, i) == (session, ip) and (abs(b - y) <= 6 or abs(a - x) <= 6)]
            if apart:
                want[leg] = min(apart)
        got = verdicts.nearest_dialog(legs, dialogs)
        assert {x.leg_id: (x.apart, x.dialog_id) for x in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_exactly_seven_tenths_is_not_most(spark):
    """63 of 90 seconds: 0.7 * 90 is less than 63 in doubles."""
    legs = spark.createDataFrame([(1, 1, 1, "a", 0, 90, "x", 0), (2, 1, 2, "a", 27, 200, "x", 0), (3, 1, 3, "a", 26, 116, "x", 0)], LEGS)
    assert {(x.x, x.y) for x in calls.leg_edges(legs).collect()} == {(1, 3), (2, 3)}


def test_stream_pairing_counts_only_what_can_win(spark):
    """Streams with long gaps and of all lengths, many to a device, against counting every pair; few of them reach the join."""
    for seed in range(3):
        r = random.Random(seed)
        times = lambda: sorted({r.randrange(4_000_000) for _ in range(r.choice([1, 2, 5, 30]))})
        server = "192.0.2.1"
        ins, outs = ({k: (f"10.0.0.{r.randrange(2)}", times()) for k in range(a, a + n)} for a, n in ((0, 30), (100, 40)))
        rows = [("fs", k, ip, server) for k, (ip, _) in ins.items()] + [("fs", k, server, ip) for k, (ip, _) in outs.items()]
        streams = spark.createDataFrame(rows, "role string, ssrc long, src_ip string, dst_ip string")
        packets = [spark.createDataFrame([(k, t) for k, (_, ts) in side.items() for t in ts], "ssrc long, t_us long") for side in (ins, outs)]
        want = {}
        for k, (ip, ts) in ins.items():
            n = [(-sum(any(0 <= q - t < 500_000 for q in qs) for t in ts), o) for o, (at, qs) in outs.items() if at == ip]
            if n and min(n)[0] < 0:
                want[k] = (min(n)[1], -min(n)[0])
        assert {x.ssrc: (x.out_ssrc, x.matched) for x in delay.stream_pairing(streams, *packets).collect()} == want
    machine = delay.Covering()
    assert [len(machine.feed(o, [{"low": 0, "high": 100 - o}])) for o in range(50)] == [1] + [0] * 49


def test_best_leg_of_a_dialog_is_found_without_pairs(spark):
    """Legs at the same seconds, short ones, dialogs that end before they begin: as every pair would say."""
    for seed in range(6):
        ls, ds, legs, dialogs = dense(spark, seed, legs=(30, 160, 400)[seed % 3], span=(300, 60)[seed % 2])
        want = {}
        for d, session, ip, x, y in ds:
            fits = [(i != ip, -max(0, min(y, b) - max(x, a)), abs(x - a), leg) for leg, s, _, i, a, b, *_ in ls if s == session and a - 15 <= x <= b + 15]
            if fits:
                _, shared, apart, leg = min(fits)
                want[d] = (leg, -shared, apart)
        got = calls.dialog_to_leg(legs, dialogs)
        assert {x.dialog_id: (x.leg_id, x.shared, x.apart) for x in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_calls_of_dense_legs_need_few_edges(spark):
    """The same calls as all pairs give, from at most two edges for each leg and bucket."""
    for seed in range(4):
        ls, _, legs, _ = dense(spark, seed, legs=300, span=(300, 3000)[seed % 2])
        root = {x[0]: x[0] for x in ls}

        def of(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        pairs = 0
        for a in ls:
            for b in ls:
                if a[0] < b[0] and a[1] == b[1]:
                    near = a[3] == b[3] and 10 * (min(a[5], b[5]) - max(a[4], b[4])) > 7 * min(a[5] - a[4], b[5] - b[4])
                    pairs += near
                    if near or a[2] == b[2]:
                        x, y = of(a[0]), of(b[0])
                        root[max(x, y)] = min(x, y)
        assert {x.leg_id: x.call_id for x in calls.call_of(legs).collect()} == {x: of(x) for x in root}
        few = calls.alike(legs, ["session_id", "ip"], "leg_id").count()
        assert few <= 2 * 300 * 1.2 and (seed % 2 or few < pairs / 2)


def test_descriptions_are_split_once(spark):
    """Sections see the parts that were cut once a row: the split isn't repeated for each of them, nor each line for each payload type."""
    from pyspark.sql import functions as F

    from callscope.functions.sip_messages import media_sections
    from callscope.operators.negotiation import codecs

    body = "v=0\r\nc=IN IP4 10.0.0.1\r\nm=audio 4000 RTP/AVP 96 0 101 77\r\na=rtpmap:96 opus/48000/2\r\na=rtpmap:101 telephone-event/8000\r\n\r\nm=video 5000 RTP/AVP 97\r\nc=IN IP6 ::1\r\na=rtpmap:97 H264\r\n"
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "v=0\r\n"), (5, "m=audio 1 RTP/AVP 8")], "k int, body string")
    s = media_sections(F.col("body"))
    got = {x.k: x for x in df.select("k", s.alias("s"), codecs(s, "audio").alias("a"), codecs(s, "audio", "video").alias("b")).collect()}
    assert [(x.kind, x.port, x.addr, x.pts) for x in got[1].s] == [("audio", 4000, "10.0.0.1", ["96", "0", "101", "77"]), ("video", 5000, "::1", ["97"])]
    assert [tuple(x) for x in got[1].a] == [("96", "OPUS", 48000), ("0", "PCMU", 8000)] and [tuple(x) for x in got[1].b][2:] == [("97", "H264", None)]
    assert got[2].s is None and got[3].s == got[4].s == [] and [tuple(x) for x in got[5].a] == [("8", "PCMA", 8000)] and got[5].s[0].addr is None
    assert df.select(s)._jdf.queryExecution().analyzed().toString().count("split(body#") == 1


def meeting(spark, seed, span, odd=False):
    """Legs, dialogs and what they announce at a few ends of two sessions, many at the same seconds; odd ones end before they begin or lack a value."""
    r = random.Random(seed)
    spot = lambda: r.choice([("a", 1), ("a", 2), ("b", 1), ("192.0.2.1", 7)])
    length = lambda: r.choice([0, 1, 5, 40, *([-20, -9] if odd else [])])
    ls = [(r.randrange(2), k, *(spot() if not odd or r.random() < 0.9 else (None, 1)), *spot(), a := r.randrange(span), a + length(), 1) for k in range(120)]
    ds = [(r.randrange(2), 500 + k, a := r.randrange(span), a + length()) for k in range(80)]
    es = [(s, d, *spot()) for s, d, *_ in ds if d % 5 for _ in range(r.choice([1, 2, 2]))] + ([(0, 501, None, 1)] if odd else [])
    ps = [(s, d, r.choice("ab")) for s, d, *_ in ds]
    return ls, ds, es, (
        spark.createDataFrame(ls, "session_id long, leg_id long, ip string, port int, peer_ip string, peer_port int, start_s long, end_s long, flows long"), spark.createDataFrame(ds, "session_id long, dialog_id long, first_s long, last_s long"),
        spark.createDataFrame(es, "session_id long, dialog_id long, ip string, port int"), spark.createDataFrame(ps, "session_id long, dialog_id long, ip string"),
    )


def test_legs_and_dialogs_are_connected_without_pairs(spark):
    """Every announced pair once, and few of them that connect the same and leave out no leg or dialog."""
    from collections import defaultdict

    from callscope.operators import assembly

    for seed in range(3):
        ls, ds, es, (legs, dialogs, ends, peers) = meeting(spark, seed, (1500, 100, 300)[seed], odd=seed == 2)
        want = sorted({(leg[1], d[1]) for leg in ls for d in ds for e in es if leg[0] == d[0] and e[:2] == d[:2] and None not in e and e[2:] in (leg[2:4], leg[4:6]) and leg[6] <= d[3] + 6 and leg[7] >= d[2] - 6})
        rows = assembly.bound(legs, dialogs, ends, peers).collect()
        assert sorted((x.leg_id, x.dialog_id) for x in rows if x.by_ == "announced") == want
        few = {(x.leg_id, x.dialog_id) for x in assembly.meetings(legs, assembly.announced(dialogs, ends)).collect()}
        assert few <= set(want) and (seed != 1 or len(few) < len(want) / 2) and {x for x, _ in few} == {x for x, _ in want} and {y for _, y in few} == {y for _, y in want}

        def parts(pairs):
            root, of = {}, lambda x: x if root.setdefault(x, x) == x else of(root[x])
            for x, y in pairs:
                a, b = of(x), of(y)
                root[max(a, b)] = min(a, b)
            sets = defaultdict(set)
            for x in list(root):
                sets[of(x)].add(x)
            return sorted(map(sorted, sets.values()))

        assert parts(few) == parts(want)
        same = parts([(x.leg_id, x.dialog_id) for x in rows])
        got = defaultdict(set)
        for x in assembly.units(assembly.connected(legs, dialogs, ends, peers)).collect():
            got[x.unit_id].add(x.leg_id)
        assert sorted(map(sorted, got.values())) == sorted([x for x in p if x < 500] for p in same)


def test_refined_calls_need_no_pairs(spark):
    """Few edges between legs that lie together, few spans of a call against which legs are held, and one span for what a worker knows of a call's time."""
    from callscope.operators import assembly

    legs = spark.createDataFrame([(1, k, "a", 1, "192.0.2.1", 2, k % 7, 100 + k % 5) for k in range(120)], "session_id long, leg_id long, ip string, port int, peer_ip string, peer_port int, start_s long, end_s long")
    edges = {(x.x, x.y) for x in assembly.overlapping_legs(legs).collect()}
    assert len(edges) <= 2 * 120 and len({x for e in edges for x in e}) == 120
    spans = [(c, a, a + n) for c in (1, 2) for a in range(0, 90, 3) for n in (0, 5, 20, 50 + a % 2)]
    want = {(c, a, b) for c, a, b in spans if not any(c == d and (x, y) != (a, b) and x <= a and b <= y for d, x, y in spans)}
    got = assembly.outer(spark.createDataFrame(spans * 2, "c long, a long, b long"), "c", "a", "b").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    machine = assembly.Merger()
    for k in range(1000):
        machine.feed(0, 1, k, k + 2, "a", None, None, None)
    assert machine.units[0]["spans"] == [(0, 1001)]


def test_relay_notes_read_streams_once(spark):
    from pyspark.sql import functions as F

    from callscope.operators import relay

    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    calls_ = spark.createDataFrame([(1, "10.0.0.1", "10.0.0.2")], "call_no long, caller_ip string, callee_ip string")
    rows = [(1, 1, "10.0.0.1", relay.SERVER, "audio", 500, 0, 20), (1, 2, relay.SERVER, "172.16.0.1", "audio", 300, 0, 20), (1, 3, relay.SERVER, "10.0.0.1", "audio", 40, 0, 20)]
    streams = spark.createDataFrame(rows, "call_no long, stream long, src_ip string, dst_ip string, media string, packets long, start_s long, end_s long").withColumn("packets", F.udf(one, "long")("packets"))
    said = spark.createDataFrame([(1, "callee", "172.16.0.1")], "call_no long, side string, ip string")
    agreed = spark.createDataFrame([], "call_no long, side string, media string")
    got = {(x.side, x.note, x.down, x.peer) for x in relay.relay_notes(calls_, streams, said, agreed, None).collect()}
    assert got == {("caller", "local_source", 40, 0), ("callee", "second_address", 300, None)} and seen.value == 3


def test_checks_of_a_stream_share_one_pass(spark):
    """Losses, order and jitter of streams with gaps, copies, late packets, wraps and packets without a source, as each alone has them, without joins or tables of packets."""
    r, rows = random.Random(3), []
    for ssrc in [None, *range(30)]:
        for i in range(r.choice([1, 2, 12, 70])):
            if r.random() < 0.9:
                seq = 65500 + i + r.choice([0, 0, 0, 0, -1, -3, 2])
                rows.append(("x", ssrc, seq % 65536, (4294960000 + seq * 160) % 2**32, r.choice([0, 0, 0, 8]), i * 20000 + r.randrange(5) * 9000, len(rows)))
    packets = spark.createDataFrame(rows, "role string, ssrc long, seq int, rtp_ts long, pt int, t_us long, pkt_no long")
    assert "distinct" not in streams.packet_loss(packets)._jdf.queryExecution().executedPlan().toString().lower()
    got = streams.stream_checks(packets)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {x.ssrc: x.asDict() for x in got.collect()}
    for alone in (streams.packet_loss(packets), streams.rtp_integrity(packets), streams.jitter(packets).select("ssrc", "std_ms")):
        for x in alone.collect():
            assert all(got[x.ssrc][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in x.asDict().items())
    for ssrc, x in got.items():
        own = sorted(((p[5], p[6], p[2]) for p in rows if p[1] == ssrc))
        ext = [own[0][2]]
        for _, _, seq in own[1:]:
            ext.append(ext[-1] + (seq - ext[-1] + 32768) % 65536 - 32768)
        assert x["lost"] == max(ext) - ext[0] + 1 - len({e for e in ext if e >= ext[0]})
    assert got[None]["ts_backward"] == got[None]["ts_duplicate"] == 0 and sum(x["lost"] for x in got.values()) > 0


def test_checks_of_stream_problems_run_in_tasks_of_their_own(spark, data):
    """What sorts packets lies below an exchange: branches of a union that are partitioned alike would run in the same tasks, with the memory of all."""
    lines = QUERIES["rl18_stream_problems"](spark, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if line.lstrip(" :+-").startswith("Union"))
    column = lines[top].index("Union")
    above, branches, open_ = [], 0, False
    for line in lines[top + 1 :]:
        name = line.lstrip(" :+-")
        if len(line) - len(name) == column + 3:
            branches, open_ = branches + 1, True
        open_ = open_ and not name.startswith("Exchange")
        above += [name] * open_
    assert not [x for x in above if x.startswith(("Sort", "Window", "MapInArrow"))] and branches == 4


def test_descriptions_of_a_call_are_read_in_one_pass(spark, data):
    """One fold reads what dialogs agree on and who called; what it reads is what column functions read, of odd descriptions too."""
    from pyspark.sql import functions as F

    from callscope.functions.sip_messages import media_sections
    from callscope.operators import negotiation

    for name in ("rl7_codec_path", "wn10_negotiation"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan
    r, bodies = random.Random(5), ["", "m=audio", "\nm=audio 1 RTP/AVP 0", "m=video 1 RTP/AVP \r\n\r\na=rtpmap:97 H264/90000"]
    parts = ["m=audio 4 RTP/AVP 0 8 96", "m=audio 4 RTP/AVP  97 x 0", "m=video 5 RTP/AVP 96 97", "m=audiox 1 RTP/AVP 0", "m= audio 1 RTP/AVP 0", "m=audio 9", "a=rtpmap:96 opus/48000/2", "a=rtpmap:96 ", "a=rtpmap:97", "a=rtpmap:x a/1", "a=rtpmap:97  /8000",
             "a=rtpmap:97\tspeex", "a=rtpmap:0 pcmu/1e3", "a=rtpmap:8 own", "a=rtpmap:97 h264/99999999999", "a=rtpmap:96 a/+5", "a=rtpmap:96 straße/ 7", "a=rtpmap:96 telephone-event/8000", "c=IN IP4 1.2.3.4", "", "\r"]
    bodies += [r.choice(["\r\n", "\n"]).join(r.choice(parts) for _ in range(r.randrange(1, 9))) + r.choice(["", "\r\n"]) for _ in range(600)]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    one = lambda kind: F.array_distinct(F.transform(negotiation.codecs(media_sections(F.col("body")), kind), lambda c: F.struct(c["name"], c["rate"])))
    want = {x.k: [tuple(map(tuple, c)) for c in (x.audio, x.video)] for x in df.select("k", *(one(k).alias(k) for k in negotiation.KINDS)).collect()}
    assert {k: negotiation.named_by_kind(b) for k, b in enumerate(bodies)} == want and sum(any(x) for x in want.values()) > 200


def test_pairs_of_legs_are_not_moved(spark):
    """Each pair once, as every pair of rows would say, without a shuffle of pairs: of dense legs, backward ones, and legs without a source, device or time."""
    for seed in range(3):
        r = random.Random(seed)
        ls = [(*x[:2], None if r.random() < 0.1 else x[2], None if r.random() < 0.1 else x[3], x[4], None if r.random() < 0.05 else x[5] - r.choice([0, 0, 0, 30]), *x[6:]) for x in dense(spark, seed, span=(300, 60, 3000)[seed])[0]]
        legs = spark.createDataFrame(ls, LEGS)
        want = []
        for a in ls:
            for b in ls:
                if a[0] < b[0] and a[1] == b[1]:
                    near = a[3] is not None and a[3] == b[3] and None not in (a[5], b[5]) and 10 * (min(a[5], b[5]) - max(a[4], b[4])) > 7 * min(a[5] - a[4], b[5] - b[4])
                    if near or (a[2] is not None and a[2] == b[2]):
                        want.append((a[1], a[0], b[0]))
        got = calls.leg_edges(legs)
        assert sorted((x.session_id, x.x, x.y) for x in got.collect()) == sorted(want) and len(want) > 30
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_silent_dialogs_are_bound_without_pairs(spark):
    """The only or nearest dialog of a leg as all pairs would say, of backward spans and dialogs of two spans too; two rows at most for what meets many."""
    from callscope.operators import assembly

    for seed in range(6):
        ls, ds, es, (legs, _, _, peers) = meeting(spark, seed, (3000, 300, 60)[seed % 3], odd=seed > 2)
        es = [e for e in es if e[1] % 5 == 1]
        ds += [(s, d, a + 3, b + 9) for s, d, a, b in ds[:4] * (seed > 2)]
        ps = [tuple(x) for x in peers.collect()] + [(s, d, "b") for s, d, *_ in ds[::3]]
        dialogs, ends = spark.createDataFrame(ds, "session_id long, dialog_id long, first_s long, last_s long"), spark.createDataFrame(es, "session_id long, dialog_id long, ip string, port int")
        peers = spark.createDataFrame(ps, peers.schema)
        cross = {(leg, d) for leg in ls for d in ds if leg[0] == d[0] and leg[6] <= d[3] + 6 and leg[7] >= d[2] - 6}
        strong = {leg[1] for leg, d in cross for e in es if e[:2] == d[:2] and None not in e and e[2:] in (leg[2:4], leg[4:6])}
        cand = {(leg[1], d[1], min(abs(leg[7] - d[3]), abs(leg[6] - d[2]))) for leg, d in cross for p in ps if p[:2] == d[:2] and p[2] in (leg[2], leg[4]) and leg[1] not in strong and d[1] not in {e[1] for e in es}}
        want = set()
        for leg in {x[0] for x in cand}:
            mine = sorted((apart, d) for x, d, apart in cand if x == leg)
            if len(mine) == 1 and sum(d == mine[0][1] for _, d, _ in cand) == 1:
                want.add((leg, mine[0][1], "only"))
            elif mine[0][0] <= 6:
                want.add((leg, mine[0][1], "nearest"))
        rows = assembly.bound(legs, dialogs, ends, peers).where("by_ <> 'announced'").collect()
        assert {(x.leg_id, x.dialog_id, x.by_) for x in rows} == want and len(rows) == len(want) > 0
    machine, made = assembly.Choices(), []
    for k in range(3000):
        made += machine.feed(k, k % 2, k + 1500, k)
    assert len(made) + len(machine.close()) == 3000 and len(machine.few[0]) + len(machine.few[1]) < 4 and {len(x) for x in machine.last} == {2}
