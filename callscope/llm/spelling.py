"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced character leaves one half of a word as it is. So the dictionary is sorted twice: by word, where words
with the same beginning lie together, and by reversed word, where words with the same ending do. A block is a range of such a dictionary:
the words of one length that agree on their first `a` and last `b` characters, alone (for replaced characters) or with the
words one longer that agree as well (for inserted ones). What may differ is the middle of the shorter word; halving the middle again
gives two blocks, one that agrees on more at the front and one that agrees on more at the back. A skewed block, of over `most` words, is
subdivided so, again and again: in the end only one character is open, and no alphabet fills such a block beyond its size. So each
block is scanned whole by one task, whatever its words, and no word is left out.

A pair belongs to one block only: where both halves agree it counts at the front. `bar` holds that rule: the two words of a pair must
part before this place. Blocks are dealt out by ranges of the sorted dictionaries and scanned in place; each pair of a block is verified
by direct comparison of characters, many pairs at once. Roots are found by pointer doubling over the forms, which at least grow
tenfold a step, so that a few rounds reach every end.

Defined results: null, empty and wordless texts have no words; very long texts and words are taken whole; a row without doc_id hashes as
`:<word>`; rows that share a doc_id each count; of near words equally frequent the first in code-point order is the form; other columns,
whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import common

LEAST_CHARS, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
#: Words of a block before it is subdivided: more than an alphabet of 90 letters can give the smallest blocks.
BLOCK = 200
#: Entries that are scanned in one call, characters compared in one step, words that a task counts before it passes them on, and entries of a task.
BATCH, SLICE, COUNTED, TASK = 20_000, 4_000_000, 200_000, 200_000
#: No place: a pair may part anywhere.
OPEN = 2**31 - 1
KEY = ["kind", "s", "a", "b", "bar"]


def counter(least_chars: int):
    """Counts of words: lower-cased runs of letters, of which about one in 31, drawn by document, has lost a character."""
    run = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), common.binary_texts(b.column(1))):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for w, n in Counter(run.findall(text.lower().decode())).items():
                    h = zlib.crc32(w.encode(), seed)
                    if h % EVERY == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least_chars:
                            continue
                    total[w] += n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    return counted


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least so many characters and occurrences over all texts."""
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("k"), F.col(f"`{text_col}`").alias("t"))
    n = texts.mapInArrow(counter(least_chars), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return n.where(F.col("n") >= least_count)


def halved(entries: DataFrame) -> DataFrame:
    """Each entry in the two blocks that its block is subdivided into; kind: 0 for a replaced, 1 for an inserted character."""
    s, a, b, bar = F.col("s"), F.col("a"), F.col("b"), F.col("bar")
    h = F.floor((s - a - b + F.col("kind")) / 2).cast("int")
    front = F.struct((a + h).alias("a"), b.alias("b"), bar.alias("bar"))
    back = F.struct(a.alias("a"), (b + h).alias("b"), F.least(bar, a + h).alias("bar"))
    out = entries.withColumn("half", F.explode(F.array(front, back))).select("kind", "s", "half.a", "half.b", "half.bar", "long", "word", "n")
    return out.where("a < bar")


def whole(dictionary: DataFrame, least_chars: int) -> DataFrame:
    """Each word with its equals in length, with words one longer, and as one of those."""
    size = F.length("word")
    role = lambda kind, s, long: F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), F.lit(long).alias("long"))
    roles = F.explode(F.array(role(0, size, False), role(1, size, False), role(1, size - 1, True)))
    out = dictionary.withColumn("r", roles).where(F.col("r.s") >= least_chars)
    return out.select("r.kind", "r.s", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(OPEN).alias("bar"), "r.long", "word", "n")


def ends() -> list[Column]:
    """What the words of a block agree on."""
    return [F.expr("substring(word, 1, a)"), F.expr("right(word, b)")]


def scanned_pairs(short: np.ndarray, long: np.ndarray, kind: int, bar: np.ndarray) -> np.ndarray:
    """Which rows of characters are one edit apart and part before `bar`. long: as wide as short if kind is 0, else one wider."""
    s = short.shape[1]
    apart = short != long[:, :s]
    part = np.where(apart.any(axis=1), apart.argmax(axis=1), s)
    if kind == 0:
        return (np.count_nonzero(apart, axis=1) == 1) & (part < bar)
    later = short != long[:, 1:]
    last = np.where(later.any(axis=1), s - 1 - later[:, ::-1].argmax(axis=1), -1)
    return (last < part) & (part < bar)


def near_in_blocks(kind: int, s: int, key: np.ndarray, bar: np.ndarray, long: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of near words that share a key, all of one kind and length; key: sorted, with the longer words of a block last."""
    n = len(text)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, n))
    end, at = np.repeat(starts + sizes, sizes), np.arange(n)
    if kind:
        first = np.repeat(starts + np.add.reduceat(~long, starts), sizes)
        partners = np.where(long, 0, end - first)
    else:
        first, partners = at + 1, end - at - 1
    chars = np.zeros((n, s + kind), np.uint8)
    for rows, width in ((np.flatnonzero(~long), s), (np.flatnonzero(long), s + 1)):
        if len(rows):
            chars[rows, :width] = np.frombuffer(b"".join(text[k] for k in rows), np.uint8).reshape(-1, width)
    upto, found, a, step = np.cumsum(partners), [], 0, max(1, SLICE // (s + 1))
    while a < n:
        before = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + step, side="right")))
        i = np.repeat(at[a:b], partners[a:b])
        j = np.arange(len(i)) - np.repeat(upto[a:b] - partners[a:b] - before, partners[a:b]) + first[i]
        keep = scanned_pairs(chars[i, :s], chars[j], kind, bar[i]) if len(i) else np.empty(0, bool)
        found.append((i[keep], j[keep]))
        a = b
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def block_numbers(t: pa.Table) -> np.ndarray:
    """Counts up where the words stop agreeing, over sorted rows."""
    keys = [(k, s, a, b, bar, w[:a], w[len(w) - b :]) for k, s, a, b, bar, w in zip(*(t.column(c).to_pylist() for c in (*KEY, "word")))]
    return np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:]))])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted, each whole in one task; all characters are below U+0100, one byte each."""

    def near(t: pa.Table) -> pa.RecordBatch:
        kind, s, bar, n = (t.column(c).to_numpy() for c in ("kind", "s", "bar", "n"))
        block, long, word = block_numbers(t), t.column("long").to_numpy(), t.column("word").combine_chunks()
        text = [w.encode("latin-1") for w in word.to_pylist()]
        cuts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (s[1:] != s[:-1])]))
        x, y = [], []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
            i, j = near_in_blocks(int(kind[a]), int(s[a]), block[a:b], bar[a:b], long[a:b], text[a:b])
            x.append(i + a)
            y.append(j + a)
        i, j = np.concatenate(x), np.concatenate(y)
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        return pa.RecordBatch.from_arrays([word.take(pa.array(i)), word.take(pa.array(j)), pa.array(n[j])], names=["word", "near", "near_n"])

    kept: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        kept.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < BATCH and size < 64 * BATCH:
            continue
        t = pa.Table.from_batches(kept)
        block = block_numbers(t)
        edge = int(np.searchsorted(block, block[-1]))
        if edge:
            yield near(t.slice(0, edge))
            t = t.slice(edge)
        kept, rows, size = t.combine_chunks().to_batches(), t.num_rows, t.nbytes
    if rows:
        yield near(pa.Table.from_batches(kept))


def near_words(dictionary: DataFrame, least_chars: int = LEAST_CHARS, most: int = BLOCK) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words one edit apart."""
    spark = dictionary.sparkSession
    entries, done, total = halved(whole(dictionary, least_chars)), [], 0
    while True:
        # Blocks whose hashes collide are counted together and subdivided a little sooner, nothing else.
        named = entries.withColumn("h", F.xxhash64(*KEY, *ends()))
        counts = common.materialize(named.groupBy("h").agg(F.count("*").alias("c"), F.max(F.expr("s - a - b > 1 - kind")).alias("open")))
        heavy = counts.where((F.col("c") > most) & F.col("open")).select("h")
        n, large = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if((F.col("c") > most) & F.col("open"))).first()
        total += n
        if not large:
            done.append(entries)
            break
        done.append(named.join(heavy, "h", "left_anti").drop("h"))
        entries = common.materialize(halved(named.join(heavy, "h", "left_semi").drop("h")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))
    order = [F.col(c) for c in KEY] + ends()
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "long")
    return dealt.mapInArrow(scan, "word string, near string, near_n long")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's forms end; each round doubles the steps taken."""
    reached = common.materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while reached.where("moved").limit(1).count():
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        reached = common.materialize(step)
    return reached.select("word", "root")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    most: int = BLOCK,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    dictionary = common.materialize(words(docs, id_col, text_col, least_chars, least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("o"), "near"))
    near = near_words(dictionary, least_chars, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    most_n = -F.col("best.o")
    formed = most_n >= times * F.col("n")
    out = dictionary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, most_n).alias("form_n")
    )
    out = common.materialize(out)
    roots = last_forms(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))
