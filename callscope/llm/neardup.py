"""MinHash near-duplicates through a multi-index Hamming join.

A document's set is its distinct word 5-shingles. One pass over the texts gives each set an exact
digest, a MinHash signature of 72 symbols of 8 bits and a sketch of 2048 bits. The signature-distance
threshold is RADIUS: the signature is cut into 12 chunks of 6 symbols, and by the pigeonhole principle
two signatures that differ in at most RADIUS = 2 * 12 - 1 symbols differ in one symbol at most in some
chunk. So each chunk is indexed under its 6 one-symbol-wildcard forms, and every pair under the
threshold meets under some key; pairs beyond it that meet nevertheless are kept as well. At similarity
0.75 signatures differ in 18 symbols on average, and a pair misses all 12 chunks with probability 1e-4
(0.8: 3e-6).

The sketch holds the least shingle of each of 2048 slots of hash values, as the parities of the bits on
which these fall; two sketches differ in about as many bits as there are shingles in one set only. A pair that
differs in more than similarity `percent` explains, by DEVIATIONS standard deviations, goes; every
other pair is confirmed on full sets.

Groups are never expanded into pairs. Equal sets are one class. Then, in rounds, each key that holds
several components links its members to one hub, another one each round, as long as a quarter of what
is tried links; all links are kept for the components at the end. What is left are members that lie
apart: those of different components that meet under a key are compared by sketch inside the join, each pair under its first common key only, and only pairs
that the sketch can't refuse become rows.

Defined results: null or wordless text is empty and linked with nothing; fewer than 5 words make one
shingle; very long texts are taken whole; rows that share a doc_id are one node; a row without doc_id
takes the component of an equal set that has one, else null, and is never kept; of ties the smallest
doc_id is kept; other columns, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

SHINGLE, CHUNKS, CHUNK_SYMBOLS = 5, 12, 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Pairs whose signatures differ in this many symbols at most are guaranteed to meet.
RADIUS = 2 * CHUNKS - 1
#: Bits (and slots) of a sketch, in words of 64 bits, and how far above the mean it may differ.
BITS, WORDS, DEVIATIONS = 2048, 32, 4.5
#: Most nodes (of 8 bytes) that are broadcast to pick their texts; beyond it they are shuffled.
BROADCAST_NODES = 1_000_000
#: Word hashes that a task keeps, for speed only.
CACHE_WORDS = 500_000
MULTIPLIERS = np.random.default_rng(1).integers(1, 2**63, size=(2, SYMBOLS), dtype=np.uint64)
M32 = ((MULTIPLIERS >> np.uint64(20)).astype(np.uint32)) | np.uint32(1)
POWERS = [pow(0x9E3779B97F4A7C15, k, 2**64) | 1 for k in range(SHINGLE)]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = common.space_words(text)
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        hashes = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        if len(h) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - SHINGLE + 1
        s = np.zeros(n, np.uint64)
        for k, p in enumerate(POWERS):
            s += h[k : k + n] * np.uint64(p)
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
        return np.unique(s)


def signature(shingles: np.ndarray) -> list[int]:
    """The 12 chunks, each of 6 MinHash symbols of 8 bits."""
    a, b = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    for at in range(0, len(a), 4096):
        x = a[at : at + 4096, None] * M32[0] + b[at : at + 4096, None] * M32[1]
        np.minimum(low, x.min(axis=0), out=low)
    low = low * np.uint32(0x9E3779B1)
    symbols = (low >> np.uint32(24)).astype(np.int64).reshape(CHUNKS, CHUNK_SYMBOLS)
    return (symbols << (8 * np.arange(CHUNK_SYMBOLS, dtype=np.int64))).sum(axis=1).tolist()


def sketch(shingles: np.ndarray) -> list[int]:
    """The parities, as WORDS words. shingles: sorted, so that the least of a slot is written last."""
    least = np.zeros(BITS, np.uint64)
    least[shingles[::-1] & np.uint64(BITS - 1)] = shingles[::-1]
    at = (least[least > 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BITS.bit_length())
    odd = (np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


DESCRIBED = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("chunks", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
    ]
)


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b in batches:
        rows: list[tuple] = []
        for text in common.binary_texts(b.column(1)):
            s = shingler(text)
            rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s), sketch(s)) if len(s) else (0, None, None, None))
        longs = pa.list_(pa.int64())
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), longs, longs))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=DESCRIBED.names)


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b in batches:
        sets = [shingler(text).tobytes() for text in common.binary_texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def confirmer(percent: int) -> Callable:
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x_set"), b.column("y_set")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common_size = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common_size >= percent * (len(x) + len(y) - common_size))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def differing(a: Column, b: Column) -> Column:
    """One bit for each symbol in which two chunks differ."""
    x = a.bitwiseXOR(b)
    for k in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return x.bitwiseAND(F.lit(0x010101010101))


def keys(classes: DataFrame) -> DataFrame:
    """(key, form, node): each chunk under its wildcard forms, where any one symbol may differ; form is chunk * 6 + symbol."""
    masks = [(1 << 48) - 1 - (255 << (8 * k)) for k in range(CHUNK_SYMBOLS)]
    form = lambda k: (F.col("at") * CHUNK_SYMBOLS + k).cast("int")
    forms = F.array(*(F.struct(F.xxhash64(F.lit(k), "at", F.col("chunk").bitwiseAND(F.lit(m))).alias("key"), form(k).alias("form")) for k, m in enumerate(masks)))
    return classes.select("node", F.posexplode("chunks").alias("at", "chunk")).select(F.explode(forms).alias("f"), "node").select("f.key", "f.form", "node")


def most_differing(total: Column, percent: int) -> Column:
    """Bits in which the sketches of two sets of similarity `percent` or more may differ; total: the sum of their sizes."""
    j = percent / 100
    union = total / F.lit(1 + j)
    # Slots in use, those whose least shingles differ, and the shingles that these bring: two where both sets use the slot.
    used = BITS * (1 - F.exp(-union / BITS))
    both = 2 - F.exp(-union * ((1 + j) / 2 / BITS))
    apart = used * both * (1 - j)
    fade = F.exp(-apart * (4 / BITS))
    spread = F.greatest(BITS / 4 * (1 - fade) - apart * fade, F.lit(0.0)) + both * both * used * F.greatest(1 - used / union, F.lit(0.0)) * (j * (1 - j)) * fade
    return BITS / 2 * (1 - F.sqrt(fade)) + DEVIATIONS * F.sqrt(spread) + 1


def close(percent: int) -> Column:
    """Whether two sets may be near, by sizes (nx, ny) and sketches (xb, yb)."""
    apart = sum((F.bit_count(F.col("xb")[k].bitwiseXOR(F.col("yb")[k])) for k in range(1, WORDS)), F.bit_count(F.col("xb")[0].bitwiseXOR(F.col("yb")[0])))
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (apart <= most_differing(F.col("nx") + F.col("ny"), percent))


def first_meeting(form: Column, x: Column, y: Column) -> Column:
    """Whether `form` is the first under which the chunks x and y meet."""
    at = F.floor(form / CHUNK_SYMBOLS).cast("int")
    alike = lambda k: F.bit_count(differing(x[k], y[k])) < 2
    earlier = [(at <= k) | ~alike(k) for k in range(CHUNKS - 1)]
    return reduce(lambda a, b: a & b, earlier, (x[at] != y[at]) | (form % CHUNK_SYMBOLS == 0))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs linked on full sets, which are computed for the documents in question only."""
    wanted = pairs.select(F.col("x").alias("node")).distinct().union(pairs.select("y").distinct()).distinct()
    wanted = common.materialize(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    sets = common.materialize(docs.join(wanted, "node", "left_semi").mapInArrow(shingle_sets, "node long, shingles binary"))
    both = pairs.join(sets.toDF("x", "x_set"), "x").join(sets.toDF("y", "y_set"), "y")
    return both.mapInArrow(confirmer(percent), "x long, y long")


def least(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node beside each node that has a smaller one."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each other node can reach; the smallest have no row."""
    return least(contracted(links))


def contracted(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, that connect the same nodes as `links` (x, y), after alternating large and small stars.

    Without `rounds` they are stars around the smallest node of each component. After `rounds` rounds a node may still hold several
    edges, and all of them are needed to connect what the links connect.
    """
    edges = common.materialize(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    for k in itertools.count():
        n = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() if rounds is None else None
        if k == rounds or (rounds is None and n == before):
            return edges
        before = n
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        edges = common.materialize(small.where("u <> v").distinct())


def placed_in_open_keys(members: DataFrame, nodes: DataFrame, parts: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """The members, with component c and what `nodes` has of them, and the keys that hold several components, with their hub of this turn."""
    c = F.col("node") if parts is None else F.coalesce("component", "node")
    known = (nodes if parts is None else nodes.join(parts, "node", "left")).withColumn("c", c).select(*nodes.columns, "c")
    placed = common.materialize(members.select("key", "form", "node").join(known, "node"))
    hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), F.col("node").alias("hub"), F.col("c").alias("hub_c"))).alias("h")
    spread = placed.groupBy("key").agg(hub, F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    return placed, spread.select(F.col("key").alias("k"), "h.hub", "h.hub_c")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    rows = common.materialize(texts.mapInArrow(described, DESCRIBED))
    firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("chunks", "chunks"), ("bits", "bits"))]
    classes = common.materialize(rows.where("digest is not null").groupBy("digest").agg(F.min("node").alias("node"), *firsts))
    # A doc_id that several rows share is one node: its classes are linked here.
    named = classes.where("node is not null")
    same = rows.where("digest is not null").join(named.select("digest", F.col("node").alias("x")), "digest")
    same = common.materialize(same.where("node <> x").select("x", F.col("node").alias("y")).distinct())
    shared = keys(named).groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    members = common.materialize(keys(named).join(shared, "key"))
    parts, tried, edges = None, None, same
    for turn in itertools.count():
        placed, spread = placed_in_open_keys(members, named.select("node", "n", "bits"), parts, turn)
        spread = spread.join(named.select(F.col("node").alias("hub"), F.col("n").alias("ny"), F.col("bits").alias("yb")), "hub")
        left = placed.withColumnsRenamed({"n": "nx", "bits": "xb"})
        stars = left.join(spread, (F.col("key") == F.col("k")) & (F.col("c") != F.col("hub_c")) & close(percent))
        stars = common.materialize(stars.select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).distinct())
        found = common.materialize(confirm(stars, texts, percent))
        # Parted components only choose what is still compared; every link stays in `edges`.
        edges = contracted(edges.union(found), rounds=2).toDF("x", "y")
        parts = common.materialize(least(edges.toDF("u", "v")))
        tried = stars if tried is None else tried.union(stars)
        if 4 * found.count() <= stars.count():
            break
    placed, spread = placed_in_open_keys(members, named.select("node", "n", "chunks", "bits"), parts, 0)
    placed = placed.join(spread.select(F.col("k").alias("key")), "key", "left_semi").select("key", "form", "node", "c", "n", "chunks", "bits")
    left, right = placed.toDF("k", "form", "x", "cx", "nx", "xc", "xb"), placed.drop("form").toDF("key", "y", "cy", "ny", "yc", "yb")
    meet = (F.col("k") == F.col("key")) & (F.col("cx") < F.col("cy")) & close(percent) & first_meeting(F.col("form"), F.col("xc"), F.col("yc"))
    crossing = left.join(right, meet).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    crossing = common.materialize(crossing.join(tried, ["x", "y"], "left_anti"))
    parts = components(edges.union(common.materialize(confirm(crossing, texts, percent))))
    found = rows.select("node", "n_shingles", "digest").join(named.select("digest", F.col("node").alias("rep")), "digest", "left")
    found = found.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("digest").isNull(), F.col("node")).otherwise(F.coalesce("component", "rep"))
    return found.select(
        F.col("node").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. All rows that repeat it stay, and rows without a doc_id."""
    others = near_duplicates(docs, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(others, id_col, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT y, c FROM reach JOIN both_ways ON x = doc_id WHERE c < y),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp ON comp.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
