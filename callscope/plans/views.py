"""Packet, signalling and usage views over the star-schema tables, as SQL that both engines run.

Only the input views are shared text; every metric is written twice, as DataFrame code and as SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = set("region nation customer supplier part orders lineitem events conversations".split())

VIEWS = {
    # One media stream per user: losses, reordering, jumps, duplicates and both wraps.
    "pkt": """
        SELECT 'terminal' AS role, ssrc, (65500 + rn) % 65536 AS seq,
          (ssrc * 1000000 + 10000 + rn * 160 + CASE WHEN rn >= 40 THEN 8000 ELSE 0 END
            - CASE WHEN event_id % 41 = 0 THEN 160 ELSE 0 END - CASE WHEN event_id % 53 = 0 THEN 1600 ELSE 0 END
            + CASE WHEN ssrc % 10 = 3 THEN 4294950000 - ssrc * 1000000 ELSE 0 END) % 4294967296 AS rtp_ts,
          CASE WHEN event_type = 'signup' THEN 8 ELSE 0 END AS pt,
          1704067200000000 + (rn + CASE WHEN event_id % 29 = 0 THEN 2 ELSE 0 END) * 20000 + (event_id * 7919) % 5000 AS t_us,
          event_id AS pkt_no
        FROM (SELECT event_id, user_id AS ssrc, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events})
        WHERE event_id % 17 <> 0""",
    # The same streams at the server, another clock, a few packets gone.
    "pkt_fs": """
        SELECT 'fs' AS role, ssrc, seq, rtp_ts, pt, t_us + 210000 + (pkt_no * 104729) % 3000 AS t_us, pkt_no FROM {pkt} WHERE pkt_no % 13 <> 0""",
    # What the server sends on, under new sources.
    "pkt_out": """
        SELECT 'fs' AS role, ssrc + 1000000 AS ssrc, seq, rtp_ts, pt, t_us + 20000 + (pkt_no * 31) % 4000 AS t_us, pkt_no FROM {pkt_fs} WHERE pkt_no % 19 <> 0""",
    "captures": "SELECT * FROM {pkt} UNION ALL SELECT * FROM {pkt_fs} UNION ALL SELECT * FROM {pkt_out}",
    "streams": """
        SELECT DISTINCT role, ssrc, concat('10.', CAST(ssrc % 200 AS STRING), '.0.1') AS src_ip, 10000 + ssrc % 5000 AS sport,
          '192.0.2.1' AS dst_ip, 20000 + ssrc % 7000 AS dport FROM {captures} WHERE ssrc < 1000000
        UNION ALL
        SELECT DISTINCT role, ssrc, '192.0.2.1', 20000 + (ssrc - 1000000) % 7000, concat('10.', CAST((ssrc - 1000000) % 200 AS STRING), '.0.1'),
          10000 + (ssrc - 1000000) % 5000 FROM {captures} WHERE ssrc >= 1000000""",
    # Audio level of each packet, for frame-level detectors.
    "frames": """
        SELECT user_id AS ssrc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS level FROM {events}""",
    "sip": """
        SELECT file, call_id, t_us, method, cseq, src, dst FROM (
          SELECT 'terminal' AS file, concat('c', CAST(conv_id AS STRING)) AS call_id, conv_id, turn,
            1704067200000000 + conv_id * 15000000 + turn * 2000000 AS t_us,
            CASE WHEN turn = 0 THEN 'INVITE' WHEN turn = 1 AND conv_id % 7 = 0 THEN '183' WHEN turn = 1 AND conv_id % 11 = 0 THEN 'ACK'
                 WHEN turn = 1 THEN '200' WHEN turn = n - 1 THEN 'BYE' WHEN turn % 2 = 0 THEN 'INFO' ELSE '180' END AS method,
            CASE WHEN turn < 2 THEN 1 ELSE turn END AS cseq,
            CASE WHEN turn % 2 = 0 THEN concat('10.', CAST(conv_id % 200 AS STRING), '.0.1') ELSE '192.0.2.1' END AS src,
            CASE WHEN turn % 2 = 0 THEN '192.0.2.1' ELSE concat('10.', CAST(conv_id % 200 AS STRING), '.0.1') END AS dst
          FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations}))
        """,
    # Copies at the server half a second later, and resends a second later at the same point.
    "sip_copies": """
        SELECT * FROM {sip}
        UNION ALL SELECT 'fs', call_id, t_us + 500000, method, cseq, src, dst FROM {sip} WHERE cseq % 2 = 1
        UNION ALL SELECT 'terminal', call_id, t_us + 1000000, method, cseq, src, dst FROM {sip} WHERE method = 'INVITE' AND length(call_id) = 2""",
    # Dialogs with session descriptions: rounds of offers and answers, late offers, refusals, resends under other numbers, legs of one call.
    "sdp_turns": """
        SELECT l_orderkey AS o, l_partkey AS k, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS turn
        FROM {lineitem}""",
    "sdp_parts": """
        SELECT o, turn, k, s, turn % 4 AS step, CASE WHEN turn % 4 IN (0, 3) THEN o % 3 = 0 ELSE o % 3 <> 0 END AS from_device,
          concat('10.', CAST(o % 200 AS STRING), '.0.1') AS device,
          concat(CASE WHEN k % 13 = 0 THEN '' ELSE concat('m=audio ', CAST(CASE WHEN k % 29 = 0 THEN 0 ELSE 10000 + (o + k % 2) % 5000 END AS STRING), ' RTP/AVP ',
              CASE k % 6 WHEN 0 THEN '0 8 9 101' WHEN 1 THEN '8 0' WHEN 2 THEN '96 0 0' WHEN 3 THEN '9' WHEN 4 THEN '18 96 97' ELSE '96' END, chr(13), chr(10),
              'a=rtpmap:96 ', CASE WHEN s % 2 = 0 THEN 'OPUS/48000/2' ELSE 'opus/16000' END, chr(13), chr(10), 'a=rtpmap:101 telephone-event/8000', chr(13), chr(10)) END,
            CASE s % 3 WHEN 0 THEN '' WHEN 1 THEN concat('m=video ', CAST(30000 + k % 1000 AS STRING), ' RTP/AVP 97 98', chr(13), chr(10), 'a=rtpmap:97 H264/90000', chr(13), chr(10), 'a=rtpmap:98 H265/90000', chr(13), chr(10))
              ELSE concat('m=video ', CAST(30000 + k % 1000 AS STRING), ' RTP/AVP 98', chr(13), chr(10), 'c=IN IP4 10.9.', CAST(k % 200 AS STRING), '.9', chr(13), chr(10), 'a=rtpmap:98 H265', chr(13), chr(10)) END) AS media
        FROM {sdp_turns}""",
    "offers": """
        SELECT concat('d', CAST(o AS STRING)) AS call_id, CAST((o - o % 3) / 3 AS BIGINT) AS call_no, turn AS msg_no, 1704067200000000 + CAST(o AS BIGINT) * 15000000 + turn * 1000000 AS t_us,
          CASE step WHEN 0 THEN 'INVITE' WHEN 1 THEN CASE k % 3 WHEN 0 THEN '183' WHEN 1 THEN '180' ELSE '200' END WHEN 2 THEN CASE WHEN k % 7 = 0 THEN '486' ELSE '200' END
            ELSE CASE WHEN k % 5 = 0 THEN 'BYE' ELSE 'ACK' END END AS method,
          CAST(1 + (turn - step) / 4 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS INT) AS cseq,
          CASE WHEN from_device THEN device ELSE '192.0.2.1' END AS src, CASE WHEN from_device THEN '192.0.2.1' ELSE device END AS dst,
          CASE WHEN CASE step WHEN 0 THEN k % 4 <> 0 WHEN 3 THEN k % 2 = 0 ELSE k % 3 <> 1 END
            THEN concat('v=0', chr(13), chr(10), 'c=IN IP4 ', CASE WHEN k % 31 = 0 THEN '0.0.0.0' WHEN from_device OR k % 37 = 0 THEN device ELSE '192.0.2.1' END, chr(13), chr(10), media) ELSE '' END AS body
        FROM {sdp_parts}""",
    "rtcp": """
        SELECT event_id AS report_no, user_id AS ssrc, user_id + 500 + event_id % 3 AS reporter, CAST(event_id % 6 AS DOUBLE) AS fraction,
          event_id % 100 AS lost, 1704067200000000 + event_id * 1000 AS t_us,
          CASE WHEN event_id % 3 = 0 THEN 'SR' WHEN event_id % 3 = 1 THEN 'RR' WHEN event_id % 4 = 0 THEN 'PLI' ELSE 'NACK' END AS kind
        FROM {events} WHERE event_id % 2 = 0""",
    # Call legs: a device and a media source for an interval.
    "legs": """
        SELECT o_orderkey AS leg_id, o_custkey % 400 AS session_id, o_orderkey % 5000 AS ssrc, concat('10.', CAST(o_custkey % 250 AS STRING), '.0.1') AS ip,
          (o_orderkey * 7919) % 20000 AS start_s, (o_orderkey * 7919) % 20000 + 60 + o_orderkey % 600 AS end_s,
          CASE o_orderkey % 3 WHEN 0 THEN 'terminal' WHEN 1 THEN 'fs' ELSE 'seat' END AS role, o_orderkey % 90 AS first_seq FROM {orders}""",
    # Media between two ends as one capture saw it. A call has a leg at each side of the server, each captured twice; a third of all calls are
    # one session's. Some captures share no source with the other, some devices send from a second address, some ends don't align.
    "flow_calls": """
        SELECT o_orderkey AS flow_id, CAST((o_orderkey - o_orderkey % 4) / 4 AS BIGINT) AS c, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 1 END AS side, o_custkey AS z FROM {orders}""",
    "flows": """
        SELECT CASE WHEN c % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((c - c % 20) / 20 AS BIGINT) END AS session_id, flow_id, CASE k WHEN 0 THEN 'terminal' WHEN 3 THEN 'seat' ELSE 'fs' END AS role,
          concat(CASE WHEN c % 13 = 0 AND k = 0 THEN '172.16.' WHEN side = 0 THEN '10.0.' ELSE '10.1.' END, CAST(c % 150 AS STRING), '.1') AS ip, CAST(10000 + c % 5000 AS INT) AS port,
          CASE WHEN c % 23 = 0 THEN concat('10.1.', CAST(c % 150 AS STRING), '.1') ELSE '192.0.2.1' END AS peer_ip, CAST(20000 + (c * 2 + side) % 9000 AS INT) AS peer_port,
          (c * 7919) % 20000 + z % 3 AS start_s, (c * 7919) % 20000 + 60 + c % 600 + z % 3 + CASE WHEN c % 11 = 0 THEN 15 * side ELSE 0 END AS end_s FROM {flow_calls}""",
    "flow_sources": """
        SELECT CASE WHEN c % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST((c - c % 20) / 20 AS BIGINT) END AS session_id, flow_id, c * 10 + side * 4 + d + CASE WHEN c % 7 = 0 THEN 5000000 * k ELSE 0 END AS ssrc
        FROM {flow_calls} CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) WHERE (z + d) % 7 <> 0""",
    # What the signalling of a leg says: its span, announced ends and who took part; some announce nothing, some legs have none.
    "leg_dialogs": """
        SELECT session_id, flow_id AS dialog_id, start_s - 5 - z % 4 AS first_s, end_s + z % 9 AS last_s FROM {flows} JOIN (SELECT flow_id AS f, z, c, k FROM {flow_calls}) ON f = flow_id WHERE k IN (1, 2) AND (c + k) % 9 <> 0""",
    "dialog_ends": """
        SELECT session_id, dialog_id, CASE WHEN d = 0 THEN ip ELSE peer_ip END AS ip, CASE WHEN d = 0 THEN port ELSE peer_port END AS port
        FROM {leg_dialogs} JOIN (SELECT flow_id, ip, port, peer_ip, peer_port FROM {flows}) ON flow_id = dialog_id CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) WHERE dialog_id % 5 <> 0""",
    "dialog_peers": """
        SELECT session_id, dialog_id, ip FROM {leg_dialogs} JOIN (SELECT flow_id, ip FROM {flows}) ON flow_id = dialog_id""",
    "dialogs": """
        SELECT o_orderkey AS dialog_id, o_custkey % 400 AS session_id, concat('10.', CAST(o_custkey % 250 AS STRING), '.0.1') AS ip,
          (o_orderkey * 7919) % 20000 - (o_orderkey % 25) AS invite_s, (o_orderkey * 7919) % 20000 + 40 + o_orderkey % 600 AS bye_s
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "visits": """
        SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS day, user_id AS vid, event_type AS path, CASE user_id % 7 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' ELSE 'DE' END AS country,
          CASE WHEN user_id % 7 > 1 THEN concat('p', CAST(user_id % 3 AS STRING)) END AS province, concat('d', CAST(user_id % 5 AS STRING), '.example') AS domain FROM {events}""",
    "analyses": """
        SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS day, user_id AS vid, CASE user_id % 7 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' ELSE 'DE' END AS country,
          CASE WHEN user_id % 7 > 1 THEN concat('p', CAST(user_id % 3 AS STRING)) END AS province, concat('d', CAST(user_id % 5 AS STRING), '.example') AS domain, event_id % 4 AS files FROM {events} WHERE event_type = 'purchase' AND event_id % 3 <> 0""",
    "ip_ranges": """
        SELECT CAST(n_nationkey AS BIGINT) * 65536 * 3 + 16777216 AS start_ip, CAST(n_nationkey AS BIGINT) * 65536 * 3 + 16777216 + 65536 * 2 + 999 AS end_ip, n_name AS region FROM {nation}""",
    "addresses": "SELECT c_custkey AS id, 16777216 + (c_custkey * 104729) % 5000000 AS ip FROM {customer}",
    # What checks say of calls and their streams, one row a finding. media is null where a check isn't about one kind of media.
    "evidence": """
        SELECT user_id AS call_id, CASE WHEN event_id % 21 IN (0, 1, 13, 14) THEN CAST(NULL AS STRING) WHEN event_id % 2 = 0 THEN 'video' ELSE 'audio' END AS media,
          concat('s', CAST(user_id * 10 + event_id % 4 AS STRING)) AS subject,
          CASE event_id % 21 WHEN 0 THEN 'silence' WHEN 1 THEN 'relay' WHEN 2 THEN 'loss' WHEN 3 THEN 'loss' WHEN 4 THEN 'reports' WHEN 5 THEN 'order' WHEN 6 THEN 'quality' WHEN 7 THEN 'quality' WHEN 8 THEN 'quality' WHEN 9 THEN 'codec'
            WHEN 10 THEN 'continuity' WHEN 11 THEN 'continuity' WHEN 12 THEN 'frames' WHEN 13 THEN 'server' WHEN 14 THEN 'pair' WHEN 15 THEN 'jitter' WHEN 16 THEN 'chain' WHEN 17 THEN 'roundtrip' WHEN 18 THEN 'nack' WHEN 19 THEN 'key_requests' ELSE 'frames' END AS check_name,
          CASE event_id % 21 WHEN 0 THEN CASE user_id % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'silent_path' WHEN 2 THEN 'no_source' ELSE 'ok' END
            WHEN 1 THEN CASE user_id % 7 WHEN 0 THEN 'redirected' WHEN 1 THEN 'no_relay' WHEN 2 THEN 'partial_uplink' WHEN 3 THEN 'partial_downlink' ELSE 'relayed' END
            WHEN 6 THEN CASE event_id % 5 WHEN 0 THEN 'howling' WHEN 1 THEN 'hum' WHEN 2 THEN 'clipping' WHEN 3 THEN 'prompt_tone' ELSE 'broken_nal' END
            WHEN 7 THEN CASE event_id % 5 WHEN 0 THEN 'clicks' WHEN 1 THEN 'noise' WHEN 2 THEN 'low_level' WHEN 3 THEN 'high_level' ELSE 'no_idr' END
            WHEN 8 THEN CASE event_id % 5 WHEN 0 THEN 'no_speech' WHEN 1 THEN 'rtp_loss' WHEN 2 THEN 'decode_errors' WHEN 3 THEN 'video_loss' ELSE 'idr_gap' END
            WHEN 9 THEN CASE event_id % 8 WHEN 1 THEN 'G.711 PCMU' WHEN 3 THEN 'PCMA' ELSE 'OPUS' END
            WHEN 14 THEN CASE user_id % 3 WHEN 0 THEN 'unseen' ELSE 'seen' END ELSE CASE WHEN event_id % 4 < 2 THEN 'high' ELSE 'ok' END END AS verdict,
          CASE WHEN event_id % 21 IN (6, 7, 8) THEN CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' END END AS level,
          CASE event_id % 21 WHEN 2 THEN value / 20 WHEN 3 THEN value / 50 WHEN 4 THEN value / 25 WHEN 12 THEN value / 5 WHEN 20 THEN value / 4 WHEN 15 THEN value / 6 ELSE value END AS value,
          CASE WHEN event_id % 21 IN (12, 20) THEN event_id % 300 ELSE event_id % 6 END AS n, event_id % 5 % 2 AS backward, event_id % 10 % 3 AS duplicates FROM {events}""",
    # Calls through a server between two devices, captured at up to three points with clocks of their own: source 1 is what the caller
    # sends, 2 what the callee gets of it, 3 what the callee sends, 4 what the caller gets. Some captures and streams are missing, some calls go direct.
    "path_calls": """
        SELECT DISTINCT user_id AS call_id, concat('10.0.', CAST(user_id % 200 AS STRING), '.1') AS caller_ip, concat('10.1.', CAST(user_id % 200 AS STRING), '.1') AS callee_ip, user_id % 7 = 0 AS direct FROM {events}""",
    "path_kinds": """
        SELECT 'terminal' AS role, 1 AS kind, 0 AS at_us UNION ALL SELECT 'fs', 1, 210000 UNION ALL SELECT 'fs', 2, 230000 UNION ALL SELECT 'seat', 2, 140000
        UNION ALL SELECT 'seat', 3, 100000 UNION ALL SELECT 'fs', 3, 210000 UNION ALL SELECT 'fs', 4, 230000 UNION ALL SELECT 'terminal', 4, 40000 UNION ALL SELECT 'seat', 1, 110000""",
    "path_packets": """
        SELECT ssrc AS call_id, role, ssrc * 10 + kind AS ssrc, seq, pkt_no, t_us + at_us + (pkt_no * 31 + kind) % 4000
            + CASE WHEN ssrc % 13 = 0 AND role = 'seat' AND pkt_no % 9 = 0 THEN 250000 ELSE 0 END AS t_us
        FROM (SELECT ssrc, seq, pkt_no, t_us FROM {pkt}) CROSS JOIN {path_kinds}
        WHERE (pkt_no + kind) % 23 <> 0 AND (CASE WHEN ssrc % 7 = 0 THEN (kind = 1 AND role IN ('terminal', 'seat')) OR (kind = 4 AND role = 'terminal') ELSE NOT (kind = 1 AND role = 'seat') END)
          AND NOT (ssrc % 5 = 1 AND role = 'seat') AND NOT (ssrc % 17 = 3 AND role = 'fs') AND NOT (ssrc % 6 = 5 AND role = 'terminal') AND NOT (ssrc % 8 = 2 AND kind IN (2, 4)) AND NOT (ssrc % 9 = 4 AND kind = 3 AND role = 'fs') AND NOT (ssrc % 11 = 0 AND kind IN (2, 4) AND pkt_no % 8 <> 0)""",
    "path_points": "SELECT DISTINCT call_id, role FROM {path_packets}",
    "path_streams": """
        SELECT call_id, role, ssrc, CASE kind WHEN 1 THEN caller_ip WHEN 3 THEN callee_ip WHEN 4 THEN CASE WHEN direct THEN callee_ip ELSE '192.0.2.1' END ELSE '192.0.2.1' END AS src_ip,
          CASE kind WHEN 1 THEN CASE WHEN direct THEN callee_ip ELSE '192.0.2.1' END WHEN 2 THEN callee_ip WHEN 3 THEN '192.0.2.1' ELSE caller_ip END AS dst_ip, packets
        FROM (SELECT call_id, role, ssrc, ssrc % 10 AS kind, count(*) AS packets FROM {path_packets} GROUP BY call_id, role, ssrc) s JOIN (SELECT call_id AS c, caller_ip, callee_ip, direct FROM {path_calls}) ON c = call_id""",
    # How each stream of a call sounds at each point.
    "path_sounds": """
        SELECT call_id, role, ssrc, CASE (call_id * 3 + ssrc + length(role)) % 6 WHEN 0 THEN 'silent' WHEN 1 THEN 'sparse' WHEN 2 THEN 'unknown' ELSE 'normal' END AS sound FROM {path_streams} WHERE (call_id + ssrc) % 19 <> 0""",
    # Levels of packets as they were sent, with the sender's clock.
    "levels": """
        SELECT role, ssrc, seq, rtp_ts, pt, t_us, pkt_no, value * 12 AS level FROM {pkt} JOIN (SELECT event_id, value FROM {events}) ON event_id = pkt_no""",
    # Media between devices and the server, by call: who sends what, who gets what, some of it under another address of the device.
    "relay_calls": """
        SELECT DISTINCT c AS call_no, concat('10.', CAST(3 * c % 200 AS STRING), '.0.1') AS caller_ip, CASE WHEN c % 41 = 0 THEN NULL ELSE concat('10.', CAST((3 * c + 1) % 200 AS STRING), '.0.1') END AS callee_ip
        FROM (SELECT CAST((o - o % 3) / 3 AS BIGINT) AS c FROM {sdp_turns})""",
    "relay_streams": """
        SELECT c AS call_no, turn * 10 + o % 3 AS stream, CASE WHEN up THEN device ELSE '192.0.2.1' END AS src_ip, CASE WHEN up THEN '192.0.2.1' WHEN c % 4 = 0 AND side = 1 THEN concat('172.16.', CAST(c % 100 AS STRING), '.1') ELSE device END AS dst_ip,
          CASE WHEN k % 3 = 0 THEN 'video' ELSE 'audio' END AS media, CASE WHEN k % 19 = 0 THEN 9000 ELSE 200 + k END AS packets, turn * 5 AS start_s, turn * 5 + 10 + k % 50 AS end_s
        FROM (SELECT *, CAST((o - o % 3) / 3 AS BIGINT) AS c, o % 3 AS side, s % 2 = 0 OR (o % 9 = 0 AND s % 5 > 0) AS up, concat('10.', CAST(o % 200 AS STRING), '.0.1') AS device FROM {sdp_turns} WHERE o % 7 <> 0 AND o % 3 < 2)""",
    "relay_announced": """
        SELECT call_no, 'caller' AS side, caller_ip AS ip FROM {relay_calls} UNION ALL SELECT call_no, 'callee', callee_ip FROM {relay_calls} WHERE callee_ip IS NOT NULL
        UNION ALL SELECT call_no, 'callee', concat('172.16.', CAST(call_no % 100 AS STRING), '.1') FROM {relay_calls} WHERE call_no % 4 = 0 UNION ALL SELECT call_no, 'caller', '192.0.2.1' FROM {relay_calls}
        UNION ALL SELECT call_no, 'caller', callee_ip FROM {relay_calls} WHERE call_no % 9 = 0""",
    # What each side agreed on; of some calls nothing is known.
    "relay_agreed": """
        SELECT call_no, side, media FROM {relay_calls} CROSS JOIN (SELECT 'caller' AS side UNION ALL SELECT 'callee') CROSS JOIN (SELECT 'audio' AS media UNION ALL SELECT 'video')
        WHERE call_no % 5 <> 0 AND (media = 'audio' OR (side = 'callee' AND call_no % 3 <> 1) OR (side = 'caller' AND call_no % 2 = 0))""",
    "findings": """
        SELECT event_id AS finding_id, user_id AS call_id, CASE event_type WHEN 'error' THEN 'loss' WHEN 'signup' THEN 'jitter' WHEN 'click' THEN 'silence' WHEN 'view' THEN 'delay' ELSE 'clipping' END AS kind,
          value, concat('s', CAST(event_id % 9 AS STRING)) AS stream FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    needed = set(re.findall(r"\{(\w+)\}", body))
    return spark.sql(body, **{n: view(spark, sf_dir, n) for n in needed})


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the views and what they need, ending in a comma-free list."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
            add(n)
        order.append(name)

    for n in names:
        add(n)
    bodies = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(bodies)
