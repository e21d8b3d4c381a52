"""Offers and answers: what each dialog agreed on, which leg is whose, and what announcements say about media streams."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.scalars import AUDIO_PT, STATIC_PT, codec_match
from callscope.functions.sip_messages import bound_once, media_sections
from callscope.operators.folds import sorted_fold
from callscope.operators.streams import clock_rate
from callscope.plans.registry import query

SERVER = "192.0.2.1"
KINDS = ("audio", "video")
#: Names of event types, which are no codecs, and clock bands of audio and video in Hz.
EVENTS = "TELEPHONE"
#: Static types as text, and the parts of a description that name codecs: letters, digits and white space are those of ASCII.
FIXED = {str(pt): (name, str(rate)) for pt, (name, rate) in STATIC_PT.items()}
MEDIA, RTPMAP, NUMBER = (re.compile(x, re.ASCII) for x in (r"(\w+)(?: \S+ \S+ ?([^\n]*))?", r"a=rtpmap:(\d+)\s+(\S*)", r"[+-]?\d+"))
CONTROL = "".join(map(chr, [*range(33), *range(127, 160)]))
AUDIO_BANDS, VIDEO_BANDS = ((7200, 8800), (43000, 53000)), ((81000, 99000),)


def codecs(sections: Column, *kinds: str) -> Column:
    """array<struct<pt, name, rate>> of a description's media sections of some kinds, in their order; types without a name are left out. Each line of a section is read once."""
    known = F.create_map(*(F.lit(v) for k, (name, rate) in STATIC_PT.items() for v in (str(k), f"{name}/{rate}")))

    def read(line: Column) -> Column:
        whole = F.nullif(F.regexp_extract(line, r"^a=rtpmap:\d+\s+(\S+)", 1), F.lit(""))
        return F.struct(F.regexp_extract(line, r"^a=rtpmap:(\d+)\s", 1).alias("pt"), F.split(whole, "/").alias("parts"))

    def one(maps: Column, pt: Column) -> Column:
        own, fixed = F.get(F.filter(maps, lambda x: x["pt"] == pt), F.lit(0))["parts"], F.split(F.try_element_at(known, pt), "/")
        rate = F.coalesce(F.get(own, F.lit(1)), F.get(fixed, F.lit(1))).try_cast("int")
        return F.struct(pt.alias("pt"), F.upper(F.coalesce(F.get(own, F.lit(0)), F.get(fixed, F.lit(0)))).alias("name"), rate.alias("rate"))

    mine_ = F.filter(sections, lambda s: s["kind"].isin(*kinds))
    all_ = F.flatten(F.transform(mine_, lambda s: bound_once(F.transform(s["maps"], read), lambda maps: F.transform(s["pts"], lambda pt: one(maps, pt)))))
    return F.filter(all_, lambda c: c["name"].isNotNull() & ~c["name"].startswith(EVENTS))


def endpoint(sections: Column, kind: str) -> Column:
    """The first address and port that a description announces for a kind of media; a rejected or held one announces nothing."""
    open_ = F.filter(sections, lambda s: (s["kind"] == kind) & (s["port"] > 0) & ~s["addr"].isin("", "0.0.0.0"))
    first = F.get(open_, F.lit(0))
    return F.concat_ws(":", first["addr"], first["port"].cast("string"))


@lru_cache(maxsize=4096)
def named(pts: str, lines: str) -> tuple[tuple[str, int | None], ...]:
    """(name, rate) of the payload types of a section with these lines, each codec once, as `codecs` has them. Devices send the same lists again and again, so that few are read."""
    own: dict[str, list[str]] = {}
    for m in filter(None, map(RTPMAP.match, lines.split("\n")[1:])):
        own.setdefault(m[1], m[2].split("/") if m[2] else [])
    found = {}
    for pt in pts.split(" "):
        parts, fixed = own.get(pt, []), FIXED.get(pt, ())
        name, rate, *_ = *parts, *fixed[len(parts) :], None, None
        if name is not None and not name.upper().startswith(EVENTS):
            found[name.upper(), None if rate is None else whole_number(rate)] = None
    return tuple(found)


def whole_number(text: str) -> int | None:
    """As a cast to int that gives null for what is none."""
    text = text.strip(CONTROL)
    return int(text) if NUMBER.fullmatch(text) and -(2**31) <= int(text) < 2**31 else None


def named_by_kind(body: str) -> list[tuple]:
    """What a description's sections of each of KINDS name, each codec once."""
    found: list[tuple] = [() for _ in KINDS]
    for section in ("\n" + body.replace("\r\n", "\n")).split("\nm=")[1:]:
        m = MEDIA.match(section)
        if m and m[1] in KINDS:
            k, more = KINDS.index(m[1]), named(m[2] or "", section[m.end() :])
            found[k] = tuple(dict.fromkeys(found[k] + more)) if found[k] else more
    return found


@lru_cache(maxsize=4096)
def agreed(offer: tuple, answer: tuple | None) -> str:
    """What both list, in the order of the offer; if nothing, what the answer lists; without an answer, what is offered."""
    both = [(n, r) for n, r in offer if any(n == m and (r is None or s is None or r == s) for m, s in answer or ())]
    return ",".join(n if r is None else f"{n}/{r}" for n, r in (both or (offer if answer is None else answer)))


class Rounds:
    """Offers and answers of one dialog: a round is complete when an answer of the offer's transaction comes.

    An INVITE with a description opens a round. Its responses answer it, later ones of the transaction replace the answer.
    A description in a response to no open round is itself an offer, which an ACK of the transaction answers. Descriptions that name no codec are
    passed over; each is read once, with what it names beside it.
    """

    def __init__(self) -> None:
        self.open: tuple[int | None, tuple] | None = None
        self.last: tuple[int | None, tuple] | None = None
        self.done: tuple[tuple, tuple] | None = None
        self.rounds = 0

    def answer(self, said: tuple) -> None:
        assert self.open is not None
        self.done, self.last, self.open = (self.open[1], said), self.open, None
        self.rounds += 1

    def feed(self, t_us: int, msg_no: int, method: str | None, cseq: int | None, body: str | None) -> tuple:
        found = named_by_kind(body) if body is not None and method is not None else ()
        if not any(found):
            return ()
        response, said = method.isdigit(), (body, found)
        if method == "INVITE":
            self.open = (cseq, said)
        elif self.open is not None:
            if (response or method == "ACK") and self.open[0] == cseq:
                self.answer(said)
        elif response and self.last is not None and self.last[0] == cseq:
            self.done = (self.last[1], said)
        elif response:
            self.open = (cseq, said)
        return ()

    def settled(self) -> tuple:
        """(answered, cseq, rounds, what is agreed on for each of KINDS, offer, answer)"""
        if self.done is None and self.open is None:
            return (False, None, 0, *("" for _ in KINDS), None, None)
        offer, answer = self.done or (self.open[1], (None, None))
        of = [agreed(offer[1][k], answer[1] and answer[1][k]) for k in range(len(KINDS))]
        return (self.done is not None, (self.last if self.done else self.open)[0], self.rounds, *of, offer[0], answer[0])

    def close(self) -> tuple:
        return (self.settled(),)


class SidedRounds:
    """The same with the first INVITE of the dialog in each call that has messages of it, without descriptions. Rows of one time and number come by their ends."""

    def __init__(self) -> None:
        self.of = Rounds()
        self.invites: dict[int | None, tuple] = {}

    def feed(self, t_us: int, msg_no: int, method: str | None, cseq: int | None, body: str | None, call_no: int | None, src: str | None, dst: str | None) -> tuple:
        if not self.invites.get(call_no):
            self.invites[call_no] = (t_us, src, dst) if method == "INVITE" else ()
        return self.of.feed(t_us, msg_no, method, cseq, body)

    def close(self) -> list[tuple]:
        answered, _, _, *of, _, _ = self.of.settled()
        return [(call_no, bool(i), *(i or (None, None, None)), answered, *of) for call_no, i in self.invites.items()]


ROUND = T.StructType().add("answered", "boolean").add("cseq", "integer").add("rounds", "long")
for _c in (*KINDS, "offer", "answer"):
    ROUND = ROUND.add(_c, "string")

#: The same rules over parsed descriptions, row by row in a recursive query.
CODECS_SQL = r""", m AS (SELECT *, replace(body, chr(13), '') AS b FROM offers),
    sec AS (SELECT call_id, msg_no, i, sec, regexp_extract(sec, '^(\w+)', 1) AS kind, CAST(regexp_extract(sec, '^\w+ (\d+)', 1) AS INTEGER) AS port,
        coalesce(nullif(regexp_extract(sec, 'c=IN IP[46] (\S+)', 1), ''), regexp_extract(head, 'c=IN IP[46] (\S+)', 1)) AS addr
      FROM (SELECT call_id, msg_no, p[1] AS head, unnest(p[2:]) AS sec, unnest(generate_series(1, len(p) - 1)) AS i FROM (SELECT call_id, msg_no, string_split(b, chr(10) || 'm=') AS p FROM m))),
    pt AS (SELECT call_id, msg_no, kind, i, unnest(string_split(regexp_extract(sec, '^\w+ \d+ \S+ ([^\n]*)', 1), ' ')) AS pt, generate_subscripts(string_split(regexp_extract(sec, '^\w+ \d+ \S+ ([^\n]*)', 1), ' '), 1) AS j, sec FROM sec),
    own AS (SELECT *, string_split(coalesce(nullif(regexp_extract(sec, 'a=rtpmap:' || pt || ' +(\S+)', 1), ''), CASE pt WHEN '0' THEN 'PCMU' WHEN '3' THEN 'GSM' WHEN '8' THEN 'PCMA' WHEN '9' THEN 'G722' WHEN '18' THEN 'G729' END), '/') AS w FROM pt),
    cod AS (SELECT call_id, msg_no, kind, pt, upper(w[1]) AS name, coalesce(TRY_CAST(w[2] AS INTEGER), CASE WHEN pt IN ('0', '3', '8', '9', '18') THEN 8000 END) AS rate, i * 1000 + j AS place FROM own WHERE w[1] IS NOT NULL AND upper(w[1]) NOT LIKE 'TELEPHONE%'),
    ident AS (SELECT call_id, msg_no, kind, name, rate, min(place) AS place FROM cod GROUP BY ALL)"""
ROUNDS_SQL = CODECS_SQL + r""", s AS (SELECT call_id, msg_no, method, cseq, row_number() OVER (PARTITION BY call_id ORDER BY t_us, msg_no) AS i,
      method = 'INVITE' AS inv, regexp_full_match(method, '[0-9]+') AS resp FROM m WHERE EXISTS (SELECT 1 FROM ident c WHERE c.call_id = m.call_id AND c.msg_no = m.msg_no)),
    f AS (SELECT call_id, i, CASE WHEN inv OR resp THEN msg_no END AS open, CASE WHEN inv OR resp THEN cseq END AS open_c, CAST(NULL AS BIGINT) AS last, CAST(NULL AS INTEGER) AS last_c, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS a, 0 AS rounds FROM s WHERE i = 1
      UNION ALL
      SELECT s.call_id, s.i,
        CASE WHEN inv THEN msg_no WHEN open IS NOT NULL THEN CASE WHEN (resp OR method = 'ACK') AND open_c = cseq THEN NULL ELSE open END WHEN resp AND last_c IS DISTINCT FROM cseq THEN msg_no END,
        CASE WHEN inv THEN cseq WHEN open IS NOT NULL THEN CASE WHEN (resp OR method = 'ACK') AND open_c = cseq THEN NULL ELSE open_c END WHEN resp AND last_c IS DISTINCT FROM cseq THEN cseq END,
        CASE WHEN NOT inv AND open IS NOT NULL AND (resp OR method = 'ACK') AND open_c = cseq THEN open ELSE last END,
        CASE WHEN NOT inv AND open IS NOT NULL AND (resp OR method = 'ACK') AND open_c = cseq THEN open_c ELSE last_c END,
        CASE WHEN NOT inv AND open IS NOT NULL AND (resp OR method = 'ACK') AND open_c = cseq THEN open WHEN NOT inv AND open IS NULL AND resp AND last_c = cseq THEN last ELSE o END,
        CASE WHEN NOT inv AND open IS NOT NULL AND (resp OR method = 'ACK') AND open_c = cseq THEN msg_no WHEN NOT inv AND open IS NULL AND resp AND last_c = cseq THEN msg_no ELSE a END,
        CASE WHEN NOT inv AND open IS NOT NULL AND (resp OR method = 'ACK') AND open_c = cseq THEN rounds + 1 ELSE rounds END
      FROM f JOIN s ON s.call_id = f.call_id AND s.i = f.i + 1),
    e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY i DESC) = 1),
    rd AS (SELECT call_id, o IS NOT NULL AS answered, CASE WHEN o IS NOT NULL THEN last_c ELSE open_c END AS cseq, CAST(rounds AS BIGINT) AS rounds, coalesce(o, open) AS o, a FROM e),
    neg AS (SELECT rd.call_id, kinds.kind, answered, cseq, rounds, o, a,
        coalesce((SELECT string_agg(concat_ws('/', x.name, x.rate), ',' ORDER BY x.place) FROM ident x WHERE x.call_id = rd.call_id AND x.msg_no = rd.o AND x.kind = kinds.kind
          AND (a IS NULL OR EXISTS (SELECT 1 FROM ident y WHERE y.call_id = rd.call_id AND y.msg_no = rd.a AND y.kind = kinds.kind AND y.name = x.name AND (x.rate IS NULL OR y.rate IS NULL OR x.rate = y.rate)))), 
          (SELECT string_agg(concat_ws('/', y.name, y.rate), ',' ORDER BY y.place) FROM ident y WHERE y.call_id = rd.call_id AND y.msg_no = rd.a AND y.kind = kinds.kind), '') AS codecs
      FROM rd, (VALUES ('audio'), ('video')) kinds(kind))"""


@query(
    "wn10_negotiation", "offers", recursive=True,
    sql=ROUNDS_SQL + r""", ep AS (SELECT call_id, msg_no, kind, arg_min(addr || ':' || port, i) AS ep FROM sec WHERE port > 0 AND addr NOT IN ('', '0.0.0.0') GROUP BY ALL)
    SELECT d.call_id, k.kind AS media, coalesce(answered, false) AS answered, cseq, coalesce(rounds, 0) AS rounds, coalesce(codecs, '') AS codecs, coalesce(p.ep, '') AS offered_at, coalesce(q.ep, '') AS answered_at
    FROM (SELECT DISTINCT call_id FROM offers) d CROSS JOIN (VALUES ('audio'), ('video')) k(kind) LEFT JOIN neg ON neg.call_id = d.call_id AND neg.kind = k.kind
      LEFT JOIN ep p ON p.call_id = d.call_id AND p.msg_no = o AND p.kind = k.kind LEFT JOIN ep q ON q.call_id = d.call_id AND q.msg_no = a AND q.kind = k.kind""",
)
def negotiation(messages: DataFrame) -> DataFrame:
    """One row per dialog and kind of media: what the last complete round agreed on, where, and how many rounds there were.

    messages: call_id, t_us, msg_no (order within a time), method, cseq, body. Without an answer the offer's codecs are candidates; messages
    whose description names no codec say nothing about what was agreed and are passed over.
    """
    rows = read_rounds(messages).withColumns({f"{c}_sections": media_sections(F.col(c)) for c in ("offer", "answer")})

    def one(kind: str) -> Column:
        ends = [F.coalesce(endpoint(F.col(f"{c}_sections"), kind), F.lit("")) for c in ("offer", "answer")]
        return F.struct(F.lit(kind).alias("media"), F.col(kind).alias("codecs"), ends[0].alias("offered_at"), ends[1].alias("answered_at"))

    rows = rows.withColumn("m", F.explode(F.array(*map(one, KINDS))))
    return rows.select("call_id", "m.media", "answered", "cseq", "rounds", "m.codecs", "m.offered_at", "m.answered_at")


def fed(messages: DataFrame, *more: str) -> DataFrame:
    """What machines of rounds are fed; only what may describe media is moved. What has no dialog's name is of none."""
    body = F.when(F.col("call_id").isNotNull() & F.col("body").contains("m="), F.col("body"))
    return messages.select("call_id", "t_us", "msg_no", "method", "cseq", body.alias("body"), *more)


def read_rounds(messages: DataFrame) -> DataFrame:
    """(call_id, answered, cseq, rounds, audio, video, offer, answer) of every dialog: the round that holds at the end, what it agreed on, its two descriptions."""
    return sorted_fold(fed(messages), ["call_id"], ["t_us", "msg_no"], Rounds, ROUND)


def dialog_rounds(messages: DataFrame) -> DataFrame:
    """(call_id, answered, cseq, rounds, offer, answer): the round that holds at the end, with its two descriptions, of the dialogs that have one."""
    return read_rounds(messages).drop(*KINDS).where("offer is not null")


ROLE_SQL = r""", inv AS (SELECT call_no, call_id, arg_min(src, (t_us, msg_no)) AS src, arg_min(dst, (t_us, msg_no)) AS dst, min(t_us) AS t_us FROM offers WHERE method = 'INVITE' GROUP BY ALL),
    fst AS (SELECT call_no, arg_min(call_id, (t_us, call_id)) AS call_id FROM inv GROUP BY call_no),
    leg AS (SELECT d.call_no, d.call_id, CASE WHEN inv.call_id IS NULL OR src = '192.0.2.1' THEN 'callee' WHEN dst = '192.0.2.1' THEN 'caller' WHEN fst.call_id = d.call_id THEN 'caller' ELSE 'callee' END AS role
      FROM (SELECT DISTINCT call_no, call_id FROM offers) d LEFT JOIN inv ON inv.call_id = d.call_id LEFT JOIN fst ON fst.call_no = d.call_no)"""


@query("rl6_leg_roles", "offers", sql=ROLE_SQL + " SELECT call_no, call_id, role FROM leg")
def leg_roles(messages: DataFrame, server: str = SERVER) -> DataFrame:
    """Whose leg of a call each dialog is: the caller's if its first INVITE goes to the server, the callee's if it comes from there.

    Between devices the call's first INVITE is the caller's; a dialog without one is taken as a callee's.
    """
    invite = F.when(F.col("method") == "INVITE", F.struct("t_us", "msg_no", "src", "dst"))
    dialogs = messages.groupBy("call_no", "call_id").agg(F.min(invite).alias("i"))
    first = dialogs.where("i is not null").groupBy("call_no").agg(F.min(F.struct("i.t_us", "call_id")).getField("call_id").alias("first_id"))
    return dialogs.join(first, "call_no", "left").select("call_no", "call_id", role_of(F.col("i").isNotNull(), F.col("i.src"), F.col("i.dst"), server).alias("role"))


def role_of(invited: Column, src: Column, dst: Column, server: str) -> Column:
    return F.when(~invited | (src == server), "callee").when((dst == server) | (F.col("first_id") == F.col("call_id")), "caller").otherwise("callee")


@query(
    "rl7_codec_path", "offers", recursive=True,
    sql=ROUNDS_SQL + ROLE_SQL + r""", side AS (SELECT leg.call_no, role, arg_min(leg.call_id, (NOT answered, leg.call_id)) AS call_id FROM leg JOIN (SELECT call_id, any_value(answered) AS answered FROM neg GROUP BY call_id HAVING string_agg(codecs, '') <> '') n ON n.call_id = leg.call_id GROUP BY ALL),
    pair AS (SELECT a.call_no, a.call_id AS x, b.call_id AS y, p.kind, p.codecs AS pc, q.codecs AS qc FROM side a JOIN side b ON a.call_no = b.call_no AND a.role = 'caller' AND b.role = 'callee'
      JOIN neg p ON p.call_id = a.call_id JOIN neg q ON q.call_id = b.call_id AND q.kind = p.kind WHERE p.codecs <> '' AND q.codecs <> ''),
    cmp AS (SELECT *, list_filter(string_split(pc, ','), lambda c: len(list_filter(string_split(qc, ','), lambda d: split_part(c, '/', 1) = split_part(d, '/', 1)
      AND (split_part(c, '/', 2) = '' OR split_part(d, '/', 2) = '' OR split_part(c, '/', 2) = split_part(d, '/', 2)))) > 0) AS both_ FROM pair)
    SELECT call_no, x AS caller, y AS callee, CASE WHEN bool_or(len(both_) = 0) THEN 'transcode' ELSE 'same' END AS verdict, string_agg(kind || ':' || array_to_string(both_, '+'), ' ' ORDER BY kind) AS common FROM cmp GROUP BY ALL""",
)
def codec_path(messages: DataFrame, server: str = SERVER) -> DataFrame:
    """Whether the server has to change the codec between the two sides of a call: they share none for some kind of media that both have.

    Of several legs of a side the answered one counts; calls of which one side, or no kind on both, is known have no row.
    """
    result = T.StructType().add("call_no", messages.schema["call_no"].dataType).add("invited", "boolean").add("t_us", messages.schema["t_us"].dataType)
    for c, kind in (("src", "string"), ("dst", "string"), ("answered", "boolean"), *((k, "string") for k in KINDS)):
        result = result.add(c, kind)
    dialogs = sorted_fold(fed(messages, "call_no", "src", "dst"), ["call_id"], ["t_us", "msg_no", "src", "dst"], SidedRounds, result)
    first = F.min(F.when(F.col("invited"), F.struct("t_us", "call_id"))).over(Window.partitionBy("call_no")).getField("call_id")
    dialogs = dialogs.where("call_no is not null").withColumn("first_id", first).withColumn("role", role_of(F.col("invited"), F.col("src"), F.col("dst"), server))
    known = dialogs.where(reduce(or_, (F.col(k) != "" for k in KINDS)))
    best = [F.min(F.when(F.col("role") == r, F.struct((~F.col("answered")).alias("open"), "call_id", *KINDS))).alias(r) for r in ("caller", "callee")]
    sides = known.groupBy("call_no").agg(*best).where("caller is not null and callee is not null")
    listed = lambda r, k: F.transform(F.split(F.col(r)[k], ","), lambda c: F.struct(c.alias("c"), F.split(c, "/").alias("w")))
    kinds = [F.when((F.col("caller")[k] != "") & (F.col("callee")[k] != ""), F.struct(F.lit(k).alias("media"), *(listed(r, k).alias(r) for r in ("caller", "callee")))) for k in KINDS]
    both = sides.select("call_no", F.col("caller.call_id").alias("caller"), F.col("callee.call_id").alias("callee"), F.array_compact(F.array(*kinds)).alias("m")).where(F.size("m") > 0)
    match = lambda a, b: codec_match(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1)))
    shared = lambda m: F.transform(F.filter(m["caller"], lambda a: F.exists(m["callee"], lambda b: match(a["w"], b["w"]))), lambda a: a["c"])
    both = both.withColumn("m", F.transform("m", lambda m: F.struct(m["media"].alias("media"), shared(m).alias("common"))))
    verdict = F.when(F.exists("m", lambda m: F.size(m["common"]) == 0), "transcode").otherwise("same")
    text = F.array_sort(F.transform("m", lambda m: F.concat_ws(":", m["media"], F.array_join(m["common"], "+"))))
    return both.select("call_no", "caller", "callee", verdict.alias("verdict"), F.array_join(text, " ").alias("common"))


def in_bands(c: Column, bands: tuple) -> Column:
    found = F.lit(False)
    for low, high in bands:
        found = found | c.between(low, high)
    return found


@query(
    "jn16_endpoint_evidence", "captures", "streams", "offers",
    sql=CODECS_SQL + r""", ann AS (SELECT addr, port, arg_min(kind, (t_us, m.msg_no, m.call_id, i)) AS kind FROM sec JOIN m ON m.call_id = sec.call_id AND m.msg_no = sec.msg_no WHERE port > 0 AND addr NOT IN ('', '0.0.0.0') GROUP BY ALL),
    named AS (SELECT CAST(pt AS INTEGER) AS pt, cod.kind, arg_min(name, (t_us, m.msg_no, m.call_id, place)) AS name, arg_min(coalesce(rate, -1), (t_us, m.msg_no, m.call_id, place)) AS rate FROM cod JOIN m ON m.call_id = cod.call_id AND m.msg_no = cod.msg_no GROUP BY ALL),
    hit AS (SELECT s.role, s.ssrc, count(*) FILTER (kind = 'audio') AS a, count(*) FILTER (kind = 'video') AS v FROM (SELECT role, ssrc, src_ip AS ip, sport AS port FROM streams UNION ALL SELECT role, ssrc, dst_ip, dport FROM streams) s JOIN ann ON ann.addr = s.ip AND ann.port = s.port GROUP BY ALL),
    pts AS (SELECT role, ssrc, min(pt) AS pt FROM captures GROUP BY role, ssrc)
    SELECT p.role, p.ssrc, p.pt, coalesce(a, 0) AS audio_hits, coalesce(v, 0) AS video_hits, x.name AS audio_name, y.name AS video_name,
      CASE WHEN coalesce(a, 0) > 0 AND coalesce(v, 0) = 0 THEN 'audio' WHEN coalesce(v, 0) > 0 AND coalesce(a, 0) = 0 THEN 'video' WHEN x.name IS NOT NULL AND y.name IS NULL THEN 'audio' WHEN y.name IS NOT NULL AND x.name IS NULL THEN 'video' END AS kind
    FROM pts p LEFT JOIN hit h ON h.role = p.role AND h.ssrc = p.ssrc LEFT JOIN named x ON x.pt = p.pt AND x.kind = 'audio' LEFT JOIN named y ON y.pt = p.pt AND y.kind = 'video'""",
)
def endpoint_evidence(packets: DataFrame, streams: DataFrame, messages: DataFrame) -> DataFrame:
    """What announcements say about each stream: how often its ends are announced addresses of audio or video, and the names of its smallest payload type.

    An address or type that was announced as several things keeps the first. The address decides, if it is of one kind only; else the type, if
    it is named for one kind only.
    """
    described = messages.where(F.length("body") > 0).withColumn("sections", media_sections(F.col("body")))
    spot = F.struct("t_us", "msg_no", "call_id", "i")
    sections = described.select("t_us", "msg_no", "call_id", F.posexplode("sections").alias("i", "m"))
    at = sections.select(spot.alias("spot"), "m.kind", "m.addr", "m.port").where("port > 0 and addr not in ('', '0.0.0.0')")
    at = at.groupBy(F.col("addr").alias("ip"), "port").agg(F.min(F.struct("spot", "kind")).getField("kind").alias("kind"))
    ends = streams.select("role", "ssrc", F.explode(F.array(*(F.struct(F.col(i).alias("ip"), F.col(p).alias("port")) for i, p in (("src_ip", "sport"), ("dst_ip", "dport"))))).alias("e"))
    hits = ends.select("role", "ssrc", "e.ip", "e.port").join(at, ["ip", "port"]).groupBy("role", "ssrc")
    hits = hits.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_hits") for k in KINDS))
    out = packets.groupBy("role", "ssrc").agg(F.min("pt").alias("pt")).join(hits, ["role", "ssrc"], "left")
    for kind in KINDS:
        each = described.select("t_us", "msg_no", "call_id", F.posexplode(codecs(F.col("sections"), kind)).alias("i", "c"))
        named = each.select(spot.alias("spot"), F.col("c.pt").cast("int").alias("pt"), "c.name").groupBy("pt").agg(F.min(F.struct("spot", "name")).getField("name").alias(f"{kind}_name"))
        out = out.join(named, "pt", "left")
    a, v = (F.coalesce(f"{k}_hits", F.lit(0)) for k in KINDS)
    one, other = F.col("audio_name").isNotNull(), F.col("video_name").isNotNull()
    kind = F.when((a > 0) & (v == 0), "audio").when((v > 0) & (a == 0), "video").when(one & ~other, "audio").when(other & ~one, "video")
    return out.select("role", "ssrc", "pt", a.alias("audio_hits"), v.alias("video_hits"), "audio_name", "video_name", kind.alias("kind"))


def stream_media(packets: DataFrame, streams: DataFrame, messages: DataFrame) -> DataFrame:
    """(role, ssrc, kind, codec): announcements first, then the clock as measured, then the static types."""
    clock, pt = F.col("clock_rate"), F.col("pt")
    known = endpoint_evidence(packets, streams, messages).join(clock_rate(packets), ["role", "ssrc"], "left")
    fallback = F.when(pt.isin(AUDIO_PT), "audio").when(pt.between(96, 127), "video").otherwise("unknown")
    kind = F.coalesce("kind", F.when(in_bands(clock, AUDIO_BANDS), "audio").when(in_bands(clock, VIDEO_BANDS), "video"), fallback)
    static = F.create_map(*(F.lit(x) for k, v in STATIC_PT.items() for x in (k, v[0])))
    out = known.withColumn("kind", kind)
    codec = F.when(F.col("kind") == "audio", F.coalesce("audio_name", F.try_element_at(static, pt.cast("int")))).when(F.col("kind") == "video", F.col("video_name"))
    return out.select("role", "ssrc", "kind", codec.alias("codec"))
