"""The registered queries over whole tables, against SQL, the libraries or brute force."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import BASE_PHRASES, DOCS, plain_words, rows, runs_by_hand, shingles, space_words

import corpus_pipeline
from callscope.llm import common, html_extract, line_dedup, packing, token_count
from callscope.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        p = f"{data}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def by_id(spark, data, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, data).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data), duck.sql(ORACLES[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    same_order = lambda found, names: sorted(str(tuple(x[names.index(c)] for c in cols)) for x in found)
    assert same_order(ours.collect(), ours.columns) == same_order(theirs.fetchall(), theirs.columns)


def test_line_dedup(spark, data, texts):
    got = by_id(spark, data, "op4_line_dedup")
    expected = runs_by_hand(sorted((i, t) for i, t in texts.items() if t), line_dedup.MIN_WORDS)
    assert {i: got[i].text for i in expected} == expected and len(got) == len(texts)


def test_language_model(spark, data, texts):
    got, c = by_id(spark, data, "op5_class_lm"), Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, t in texts.items():
        if not held[i]:
            c.update([*space_words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = [*space_words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_token_count(spark, data, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_count.MODEL))
    for i, r in by_id(spark, data, "op7_token_count").items():
        n = len(sp.encode(texts[i] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i] or "").encode()), n, n > 4096)


def test_pages(spark, data, duck):
    got = by_id(spark, data, "op8_html_extract", "page_id")
    right = 0
    for i, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        blocks = html_extract.blocks_of(page or "")
        right += got[i].text == "\n".join(b.text for b in blocks if html_extract.taught(b))
        assert got[i].n_chars == len(got[i].text)
    assert right >= 0.98 * len(got)


def test_licenses(spark, data, texts):
    for i, r in by_id(spark, data, "op9_license_scan").items():
        w = plain_words(texts[i])
        found = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        assert (r.n_words, r.n_base) == (len(w), len(found)) and r.base_labels == ",".join(sorted({x for _, x in found}))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None)) and {x for _, x in found} <= set(r.labels.split(","))


def test_toxicity(spark, duck):
    """Held-out accuracy on a table with enough labels."""
    larger = "/root/testdata/sf0.1"
    got = QUERIES["op3_toxicity"](spark, larger).where("held_out").select("doc_id", "predicted").toPandas()
    both = got.merge(duckdb.sql(f"SELECT doc_id, toxic FROM '{larger}/labels.parquet'").df(), on="doc_id")
    hit = ((both.predicted == 1) & (both.toxic == 1)).sum()
    assert 2 * hit / ((both.predicted == 1).sum() + (both.toxic == 1).sum()) > 0.85


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, some in pieces.items():
        ids, at = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(some, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE


def test_packing(spark, data, texts):
    check_packed(QUERIES["op10_packing"](spark, data).collect(), texts)


def test_pipeline(spark, data, duck):
    docs, kept = common.table(spark, data, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, data))
        kept.append(docs)
    toxic, lines, near, clean = ({r.doc_id: r.text for r in d.collect()} for d in kept[:4])
    assert all(d.columns == common.table(spark, data, "documents").columns for d in kept[:4])
    labels = dict(duck.sql("SELECT doc_id, toxic FROM labels").fetchall())
    assert all(labels.get(i) != 0 or i in toxic for i in list(labels)[:50])
    assert lines == {**{i: t for i, t in toxic.items() if not t}, **runs_by_hand(sorted((i, t) for i, t in toxic.items() if t), line_dedup.MIN_WORDS)}
    sets = {i: shingles(t) for i, t in lines.items()}
    dropped = set(lines) - set(near)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    assert all(any(linked(sets[i], sets[j]) for j in sets if j < i) for i in dropped)
    assert not any(linked(sets[i], sets[j]) for i in near for j in near if j < i)
    windows = {tuple(w[s : s + 13]) for (t,) in duck.sql("SELECT text FROM benchmark").fetchall() for w in [plain_words(t)] for s in range(max(1, len(w) - 12)) if w}
    for i, t in near.items():
        w = plain_words(t)
        hit = {p for s in range(len(w)) for n in {len(x) for x in windows} if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        assert (i in clean) == (not hit or 20 * len(hit) < len(w))
    check_packed(kept[4].collect(), clean)


def test_stages_of_odd_rows(spark, data):
    """Null, empty, repeated and very long texts, rows without ids and columns that clash go through each stage."""
    df = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(5) for c in ("row", "n_words", "score", "node", "digest", "items", "window", "fp")})
    before = {x.doc_id for x in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, df, data))
        assert out.columns == df.columns, name
        assert {x.doc_id for x in out.collect()} <= before and out.where("doc_id is null").count() <= 2
        assert stage(spark, df.limit(0), data).count() == 0, name
        df = out
    kept = {x.doc_id: x.text for x in df.where("doc_id is not null").collect()}
    assert len(kept) > 20 and any(not (t or "").strip() for t in kept.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, df, data)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} >= set(kept)
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), data).count() == 0

