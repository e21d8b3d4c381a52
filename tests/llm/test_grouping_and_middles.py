"""Spelling variants, bit-sliced fingerprints and fill-in-middle against brute force, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import DOCS, rows, space_words

from callscope.llm import fim, simhash, spelling
from callscope.llm.queries import QUERIES

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = [
    (100, " \n", "a", "b", 1), (101, "a <P> b", "a", "b", 1), (102, "x<M>", "a", "b", 1), (103, "  lead and trail \t\n", "a", "b", 1),
    (104, "𝒜é  z w", "a", "b", 1), (105, "<P <S >M>", "a", "b", 1), (106, "a\0b c", "a", "b", 1), (107, "<", "a", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*rows(), *ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def middle_by_hand(key, text, units):
    drawn = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(drawn[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_runs_give_the_cuts_of_the_pattern():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "bc", " ", "\n\t", "é", "𝒜", " ", "<"]) for _ in range(r.randint(0, 12)))
        for unit, units in (("word", UNIT.findall(text)), ("char", list(text))):
            runs = fim.runs_of(text.encode(), unit)
            assert runs.n == len(units)
            assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_fill_in_middle(docs, none):
    clashing = docs.withColumns({c: F.lit(5) for c in ("fim", "row", "n", "form", "output", "_fim_id0")})
    many = clashing.unionByName(clashing.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    got = fim.transform(many)
    assert got.columns == [*(c for c in clashing.columns if c != "fim"), "fim"]
    kept = got.select("doc_id", "text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(kept) == 2 * docs.count() and {x.form for x in kept} == {"plain", "psm", "spm"}
    for x in kept:
        text = x.text or ""
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == middle_by_hand(x.doc_id, text, UNIT.findall(text)) and x.back == text
    by_char = fim.transform(docs, unit="char", fim_percent=50).select("doc_id", "text", "fim.*").collect()
    for x in by_char:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == middle_by_hand(x.doc_id, x.text or "", list(x.text or ""))
    assert fim.transform(none).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, unit="line")


def test_fill_in_middle_query(spark, data):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op13_fill_in_middle"](spark, data).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(x.doc_id for x in got) == sorted(texts)
    for x in got:
        *head, output = middle_by_hand(x.doc_id, texts[x.doc_id] or "", UNIT.findall(texts[x.doc_id] or ""))
        assert [x.n, x.form, x.prefix_chars, x.middle_chars] == head and (x.output_sha256, x.restored_sha256) == (sha(output), sha(texts[x.doc_id] or ""))


def fingerprint_by_hand(text):
    w = space_words(text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def least_reached(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if parent[i] != parent[j] and linked(i, j):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def near_words(r, n, flips=6):
    """Random fingerprints, with many that are a few flipped bits from others."""
    made = [r.getrandbits(64) for _ in range(n)]
    for i in range(1, n):
        if r.random() < 0.7:
            made[i] = made[r.randrange(i)]
            for k in r.sample(range(64), r.randint(0, flips)):
                made[i] ^= 1 << k
    return made


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_pairs(radius, monkeypatch):
    """All pairs of each block within the radius and no others, in slices of any size."""
    r = random.Random(radius)
    for n, words in ((1, 4), (63, 3), (64, 1000), (65, 1), (300, 7), (700, 100_000)):
        monkeypatch.setattr(simhash, "SLICE", words)
        fp, key = near_words(r, n), sorted(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        end = np.array([max(k for k in range(n) if key[k] == x) + 1 for x in key])
        got = [p for a, b in simhash.close_pairs(np.array(fp, np.uint64), end, radius) for p in zip(a.tolist(), b.tolist())]
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and (fp[i] ^ fp[j]).bit_count() <= radius]
        x, y = simhash.compared(np.array([key, key]).T, np.array(fp, np.uint64), radius, range(5, 20))
        assert len(x) == len(y) < n


def test_fingerprints():
    r = random.Random(8)
    for text in ["", "one", "One TWO three", "a b c d", " x\u00c9\t\n y  z w v ", "word " * 9000, *(" ".join(r.choice("abcdef") for _ in range(n)) for n in (5, 50, 4098))]:
        assert simhash.fingerprint(text.encode()) == fingerprint_by_hand(text)


@pytest.mark.parametrize("most", [simhash.BLOCK, 30, 4])
def test_blocks_lose_no_link(spark, most):
    """Blocks as they are, parted, and dealt into pairs of tiles give the same components, with few edges."""
    r = random.Random(9)
    fp = list(dict.fromkeys(near_words(r, 400) + [(r.getrandbits(51) << 13) | 77 for _ in range(150)] + [0xFFFF ^ (1 << k) ^ (1 << j) for k in range(14) for j in range(k)]))
    signed = [x - 2**64 if x >= 2**63 else x for x in fp]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most).collect()
    at = {x: i for i, x in enumerate(signed)}
    linked = {tuple(sorted((at[e.x], at[e.y]), reverse=True)) for e in edges}
    assert least_reached(len(fp), lambda i, j: (i, j) in linked) == least_reached(len(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=8)


def test_simhash(spark, docs, none):
    r = random.Random(10)
    base = [f"w{k}" for k in range(600)]
    more = [(200 + i, " ".join(w if r.random() > 0.01 else w + "x" for w in base), "a", "b", i) for i in range(60)]
    all_docs = [x for x in [*rows(), *ODD, *more] if x[0] is not None]
    df = docs.unionByName(spark.createDataFrame(more, DOCS)).withColumns({c: F.lit(5) for c in ("fp", "node", "root", "block", "part", "x", "y")}).repartition(7)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    prints = [fingerprint_by_hand(t) for _, t, *_ in all_docs]
    assert sorted((x.doc_id, x.fingerprint) for x in got if x.doc_id is not None) == sorted((d[0], f"{p:016x}") for d, p in zip(all_docs, prints))
    parent = least_reached(len(all_docs), lambda i, j: all_docs[i][0] == all_docs[j][0] or (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for d, p in zip(all_docs, parent):
        least[p] = min(least.get(p, d[0]), d[0])
    assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == {d[0]: least[p] for d, p in zip(all_docs, parent)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_query(spark, data):
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [fingerprint_by_hand(texts[i]) for i in ids]
    parent = least_reached(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    expected = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, parent)}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in QUERIES["op12_simhash"](spark, data).collect()} == expected


def edited(w, letters):
    """All texts that are exactly one character away."""
    out = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return (out | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}) - {w}


def words_by_hand(texts, least_chars=7, least_count=2):
    n = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}


def variants_by_hand(n):
    letters = sorted({c for w in n for c in w})
    near = {w: [x for x in edited(w, letters) if x in n] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found_variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def spelled_texts(r, n, letters, sizes):
    words = ["".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(n)]
    weights = [1 / (k + 1) ** 1.3 for k in range(n)]
    return [(i, " ".join(w.upper() if r.random() < 0.05 else w for w in r.choices(words, weights, k=300))) for i in range(60)]


@pytest.mark.parametrize("most", [spelling.BLOCK, 3, 1])
def test_spelling_variants(spark, most):
    """Crowded dictionaries: every length next to its neighbours, and blocks subdivided to the last character."""
    r = random.Random(13)
    texts = spelled_texts(r, 700, "ab", [7, 8, 8, 9, 10]) + spelled_texts(r, 500, "aé", [7, 7, 8, 15])
    texts += [(None, "abababab aaaaaaa"), (3, None), (4, ""), (5, "a" * 3000 + " " + "a" * 2999 + "b"), (6, "a" * 3000 + " " + "a" * 2999 + "b " + "a" * 3001), (7, "a" * 3001), (1, "× ÷ ÷÷÷÷÷÷÷× ÷÷÷÷÷÷÷× Ünïcöde ünïcöde Ünïcöde naïveté naïveté")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("word", "n", "kind", "s", "a", "b", "h", "near", "root")}).repartition(6)
    n = words_by_hand(texts)
    expected = variants_by_hand(n)
    assert any(x[1] and x[1] != x[2] for x in expected) and len(n) > 300
    assert found_variants(spelling.variants(df, most=most)) == expected


def test_pairs_one_edit_apart():
    r = random.Random(14)
    for _ in range(4000):
        x = "".join(r.choice("ab") for _ in range(r.randint(1, 6)))
        y = "".join(r.choice("abc") for _ in range(len(x) + r.randint(0, 1)))
        part = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
        a, b = (np.frombuffer(t.encode(), np.uint8)[None] for t in (x, y))
        for bar in (0, 2, 99):
            got = spelling.scanned_pairs(a, b, len(y) - len(x), np.array([bar]))
            assert got.tolist() == [y in edited(x, "abc") and part < bar]


def test_spelling_query(spark, data, none):
    texts = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert found_variants(QUERIES["op11_spelling_variants"](spark, data)) == variants_by_hand(words_by_hand(texts))
    assert spelling.variants(none).count() == 0
