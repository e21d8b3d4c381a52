"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set if over half of the XXH64 values (seed 42) of its 4-word shingles, repeats included, have it.
Equal fingerprints are one class. Two fingerprints that differ in RADIUS bits at most agree on one of RADIUS + 1 chunks, so classes that
share a chunk's value form a block; a block of over BLOCK classes is parted by the same rule over its remaining bits, and what is still
larger is dealt out by hash into tiles, each pair of which is a block. So every pair within the radius meets in a block of
bounded size, and no block is cut.

Inside a block the bits are stored vertically: plane p holds bit p of 64 fingerprints in one word. A fingerprint is held against a word of 64 at
once; the differing bits of two planes at a time go through a carry-save adder into vertical counters of three bits, whose overflow
stays set. As soon as the comparator finds every lane of a word beyond the radius the word is abandoned, and the loop ends when no
word is left. A block gives the edges of a spanning forest, at most one for each member, never its pairs; the forests of all blocks connect
exactly what the links connect, and components are found over them by alternating stars.

Defined results: null or wordless text has fingerprint zero and is linked like any other; fewer than 4 words make one shingle; very long
texts are taken whole, in parts of 4096 shingles; rows that share a doc_id are one document, which links what any of them links; a row
without doc_id links like any other but names no component, and its component_id is null if no row with a doc_id is reached; other
columns, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import common
from callscope.llm.neardup import components

SHINGLE, SEED, BITS = 4, 42, 64
#: Bits in which linked fingerprints differ at most; the vertical counters count to 7.
RADIUS, MOST = 4, 7
#: Most classes of a block before it is parted, and entries that are compared in one call and dealt to one task.
BLOCK, BATCH, TASK = 4096, 16_384, 100_000
#: Words of 64 lanes that are compared together, so that their counters stay in cache.
SLICE = 32_768
FULL = np.uint64(2**64 - 1)


def fingerprint(text: bytes) -> int:
    words = common.space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = list(zip(first[:n].tolist(), ends[-n:].tolist()))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + 4096]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = np.array([fingerprint(t) for t in common.binary_texts(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["node", "fp"])


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Row p holds bit p of each fingerprint, 64 fingerprints a word."""
    bits = np.zeros((-(-len(fp) // 64) * 64, BITS), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius."""
    equal = ~over
    for k in (2, 1, 0):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            over = over | (equal & counters[k])
            equal = equal & ~counters[k]
    return over


def close_pairs(fp: np.ndarray, end: np.ndarray, radius: int, last_planes: range = range(0)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a < b, of fingerprints within the radius; end: where the block of each position ends. last_planes: equal within blocks."""
    planes, at = planes_of(fp), np.arange(len(fp))
    order = [p for p in range(BITS) if p not in last_planes] + list(last_planes)
    first = (at + 1) // 64
    words = np.where(end > at + 1, (end - 1) // 64 - first + 1, 0)
    upto = np.cumsum(words)
    a = 0
    while a < len(fp):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, side="right")))
        q = np.repeat(at[a:b], words[a:b])
        w = np.arange(len(q)) - np.repeat(upto[a:b] - words[a:b] - (upto[a - 1] if a else 0), words[a:b]) + first[q]
        a = b
        low, high = np.maximum(q + 1 - 64 * w, 0), end[q] - 64 * w
        inside = (FULL << low.astype(np.uint64)) & np.where(high >= 64, FULL, (np.uint64(1) << np.clip(high, 0, 63).astype(np.uint64)) - np.uint64(1))
        over, c = ~inside, [np.zeros(len(q), np.uint64) for _ in range(3)]
        value = fp[q]
        for k in range(0, BITS, 2):
            x, y = (planes[p][w] ^ (np.uint64(0) - (value >> np.uint64(p) & np.uint64(1))) for p in order[k : k + 2])
            one = c[0] ^ x
            two = (c[0] & x) | (y & one)
            c[0] = one ^ y
            four = c[1] & two
            c[1] ^= two
            over |= c[2] & four
            c[2] ^= four
            if k >= 14 and k % 4 == 2:
                alive = beyond(c, over, radius) != FULL
                n = int(np.count_nonzero(alive))
                if not n:
                    q = q[:0]
                    break
                if n < 0.7 * len(alive):
                    q, w, value, over, c = q[alive], w[alive], value[alive], over[alive], [x[alive] for x in c]
        if len(q):
            hit = ~beyond(c, over, radius)
            row, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], 64 * w[row] + lane


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label: the smallest position known to be connected with each; the same after connecting a with b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def compared(key: np.ndarray, fp: np.ndarray, radius: int, last_planes: range = range(0)) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each block: fingerprints with the first of their tree. key: rows that are equal within a block, sorted."""
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    label = np.arange(len(fp))
    for a, b in close_pairs(fp, end, radius, last_planes):
        label = joined(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def chunks(bits: list[int], radius: int) -> list[list[int]]:
    """The bit positions in radius + 1 chunks of nearly equal width."""
    return [list(x) for x in np.array_split(bits, radius + 1)]


def scanner(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted, each whole in one task; several small ones are compared in one call."""
        kept: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            shared = chunks(list(range(BITS)), radius)[int(rows[0, 0]) % (radius + 1)]
            x, y = compared(rows[:, :2], np.ascontiguousarray(rows[:, 2]).view(np.uint64), radius, range(shared[0], shared[-1] + 1))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])

        for b in batches:
            kept.append(np.stack([c.to_numpy() for c in b.columns], axis=1))
            if sum(map(len, kept)) >= BATCH:
                rows = np.concatenate(kept)
                whole = len(rows) - np.argmax((rows[::-1, :2] != rows[-1, :2]).any(axis=1)) if (rows[0, :2] != rows[-1, :2]).any() else 0
                if whole:
                    yield edges(rows[:whole])
                kept = [rows[whole:]]
        rows = np.concatenate(kept) if kept else np.empty((0, 3), np.int64)
        if len(rows):
            yield edges(rows)

    return scan


def keyed(fp: Column, bits: list[int], radius: int) -> list[Column]:
    """The value of each chunk of the (contiguous) bits; fewer bits than chunks leave some chunks empty, which all share."""
    parts = chunks(bits, radius)
    return [F.shiftrightunsigned(fp, min(p)).bitwiseAND(F.lit((1 << len(p)) - 1)) if p else F.lit(0).cast("long") for p in parts]


def blocks(classes: DataFrame, radius: int = RADIUS, most: int = BLOCK) -> tuple[DataFrame, int]:
    """(block, part, fp), blocks of about `most` members: classes under each of their chunks, large blocks parted; and how many rows that makes.

    A block's number modulo radius + 1 is the chunk that its members share.
    """
    fp = F.col("fp")
    n = radius + 1
    top = [F.struct((v * n + k).alias("block"), F.lit(0).cast("long").alias("part")) for k, v in enumerate(keyed(fp, list(range(BITS)), radius))]
    entries = classes.select("fp", F.explode(F.array(*top)).alias("e")).select("e.block", "e.part", "fp")
    counts = common.materialize(entries.groupBy("block", "part").agg(F.count("*").alias("n")))
    total, large = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > most)).first()
    if not large:
        return entries, total
    heavy = counts.where(F.col("n") > most).select("block", "part")
    small = entries.join(heavy, ["block", "part"], "left_anti")
    # The bits outside the shared chunk, by chunks of their own.
    within = F.lit(None).cast("array<struct<part:bigint>>")
    for k, own in enumerate(chunks(list(range(BITS)), radius)):
        below, above = fp.bitwiseAND(F.lit((1 << min(own)) - 1)), F.shiftrightunsigned(fp, max(own) + 1)
        turned = below.bitwiseOR(F.shiftleft(above, min(own))) if max(own) < BITS - 1 else below
        rest = keyed(turned, list(range(BITS - len(own))), radius)
        within = F.when(F.pmod("block", F.lit(n)) == k, F.array(*(F.struct((v * n + j + 1).alias("part")) for j, v in enumerate(rest)))).otherwise(within)
    parted = entries.join(heavy, ["block", "part"], "left_semi").select("block", F.explode(within).alias("p"), "fp").select("block", "p.part", "fp")
    parted = common.materialize(parted)
    counts = common.materialize(parted.groupBy("block", "part").agg(F.count("*").alias("n")))
    wide = counts.where(F.col("n") > most).withColumn("tiles", F.ceil(F.col("n") / most))
    again = parted.join(wide.select("block", "part"), ["block", "part"], "left_anti")
    # Still large: members go to tiles by hash, and each pair of tiles is a block.
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: F.least(x, tile) * F.col("tiles") + F.greatest(x, tile))
    # Parts up to here are under 2^20, as chunks of chunks have few bits.
    tiled = parted.join(wide, ["block", "part"]).select("block", "part", F.explode(each).alias("pair"), "fp")
    tiled = tiled.select("block", (F.col("part") + (F.col("pair") + 1) * (1 << 20)).alias("part"), "fp")
    out = common.materialize(small.unionByName(again).unionByName(tiled))
    return out, out.count()


def links(classes: DataFrame, radius: int = RADIUS, most: int = BLOCK) -> DataFrame:
    """(x, y): edges between fingerprints that connect all those within the radius of each other."""
    if not 1 <= radius <= MOST:
        raise ValueError(f"the counters hold radii from 1 to {MOST}")
    entries, n = blocks(classes, radius, most)
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK))
    dealt = entries.select("block", "part", "fp").repartition(tasks, "block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(scanner(radius), "x long, y long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    rows = common.materialize(texts.mapInArrow(fingerprinted, "node long, fp long"))
    classes = common.materialize(rows.groupBy("fp").agg(F.min("node").alias("node")))
    found = links(classes, radius, most)
    # Several rows of one doc_id are one document.
    several = rows.where("node is not null").groupBy("node").agg(F.min("fp").alias("y"), F.max("fp").alias("z")).where("y <> z").select("node", "y")
    same = rows.join(several, "node").where("fp <> y").select(F.col("fp").alias("x"), "y")
    tree = components(found.unionByName(same))
    placed = classes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = placed.groupBy("root").agg(F.min("node").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select(F.col("node").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
