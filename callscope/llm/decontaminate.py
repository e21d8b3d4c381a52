"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of 13 consecutive words of a benchmark item is a test string (a shorter item is one
window). Block shift tables say how many words the search may skip, suffix blocks choose the bucket
of windows to try, and a direct comparison confirms an occurrence. A benchmark of one block is
broadcast, and documents are never shuffled. A larger one is searched block by block: each is gathered,
broadcast, searched for and given back before the next, and only what was found is kept, by row.

Defined results: null or empty text has no words and is clean; an item without words has no window;
an item with a null id marks hit words but has no id to report; items that share an id count once;
very long texts are searched whole; spans that touch are one, so that a word counts once; repeated
documents are each reported; other columns, whatever their names, stay in `row`; an empty benchmark
leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

WINDOW = 13
#: Words of benchmark text searched, and broadcast, at once.
BLOCK_WORDS = 200_000

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.LongType())),
]


class WuManber:
    """Test strings of words, one shift table and one set of suffix buckets for each length."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.groups: list[tuple[int, int, dict, dict]] = []
        by_length: dict[int, list[tuple[int | None, list[bytes]]]] = {}
        for key, words in items:
            if words:
                by_length.setdefault(min(window, len(words)), []).append((key, words))
        for length, some in sorted(by_length.items()):
            block = min(2, length)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set]] = {}
            for key, words in some:
                for end in range(block, len(words) + 1):
                    tail = tuple(words[end - block : end])
                    skip = max(0, length - end)
                    if skip < shift.get(tail, length):
                        shift[tail] = skip
                    if end >= length:
                        buckets.setdefault(tail, {}).setdefault(tuple(words[end - length : end]), set()).add(key)
            self.groups.append((length, block, shift, buckets))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words inside an occurrence, merged and in order, and the ids of the items found."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        n = len(words)
        for length, block, shift, buckets in self.groups:
            end, most = length, length - block + 1
            get = shift.get
            while end <= n:
                tail = tuple(words[end - block : end])
                skip = get(tail, most)
                if skip:
                    end += skip
                    continue
                keys = buckets.get(tail, {}).get(tuple(words[end - length : end]))
                if keys is not None:
                    found |= keys
                    spans.append((end - length, end))
                end += 1
        return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, of about block_words words each, and the blocks, each gathered when it is asked for."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * block_words)))
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    return n, ([(r.id, common.word_list(r.text.encode())) for r in items.where(block == k).toLocalIterator()] for k in range(n))


def searcher(shared, window: int) -> Callable:
    """Of texts: n_words, n_hit, spans and items, by one block."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        index = WuManber(shared.value, window)

        def work(texts: pa.Array) -> list[pa.Array]:
            out = [[], [], [], []]
            for text in common.binary_texts(texts):
                words = common.word_list(text)
                hits, keys = index.search(words)
                for o, v in zip(out, (len(words), sum(b - a for a, b in hits), [x for s in hits for x in s], sorted(keys - {None}))):
                    o.append(v)
            return [pa.array(o, T_ARROW[f.name]) for o, f in zip(out, FIELDS)]

        return work

    return make


T_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.int64()), "items": pa.list_(pa.int64())}


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as one, and the words in them. Columns: row, n_words, spans, items."""
    for b in batches:
        n_hit, spans = [], []
        for flat in b.column("spans").to_pylist():
            hits = merge(list(zip(flat[::2], flat[1::2])))
            n_hit.append(sum(y - x for x, y in hits))
            spans.append([x for s in hits for x in s])
        cols = [b.column("row"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(spans, T_ARROW["spans"]), b.column("items")]
        yield pa.RecordBatch.from_arrays(cols, names=["row", *T_ARROW])


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns `row` (the document), n_words, n_hit, spans (flat starts and ends of hit words) and items."""
    sc = docs.sparkSession.sparkContext
    n, blocks = benchmark_blocks(benchmark, id_col, item_text, block_words)
    if n == 1:
        return common.map_text(docs, text_col, searcher(sc.broadcast(next(blocks)), window), FIELDS)
    numbered = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("at", F.monotonically_increasing_id())
    numbered = common.materialize(numbered)
    found, n_words = None, None
    for items in blocks:
        shared = sc.broadcast(items)
        hits = common.map_text(numbered.select("at", F.col("row")[text_col].alias("text")), "text", searcher(shared, window), FIELDS)
        if n_words is None:
            n_words = common.materialize(hits.select("row.at", "n_words"))
        hits = common.materialize(hits.where("n_hit > 0").select("row.at", "spans", "items"))
        found = hits if found is None else found.union(hits)
        shared.destroy()
    both = found.groupBy("at").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<bigint>")
    rows = numbered.join(n_words, "at").join(both, "at", "left").select("row", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"))
    schema = T.StructType([rows.schema["row"], *FIELDS])
    return rows.mapInArrow(united, schema)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents of which under a twentieth of the words lies in a benchmark window."""
    return scan(docs, benchmark, **options).where(~contaminated()).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, s, occ.k AS k, item_id FROM occ JOIN win ON occ.k = win.k AND occ.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
