"""Language-model scoring with a class-based bigram model (Brown classes by exchange).

Words are counted over all training documents by a shuffle. Exchange clustering runs over the CLUSTERED most frequent
words and, as stand-ins for all others, 256 groups by word ending; their bigram counts over the whole training text are
gathered as sums (at most the square of the items), and exchange moves one item at a time to the class that raises the
class-bigram likelihood most. Then every other word of the training text moves once, to the class that gives the classes
to its left and right the highest likelihood, with a start of PRIOR for the class of its ending: its neighbours are counted over the whole training text by a shuffle, at
most CLASSES squared counts a word. With CLUSTERED as large as the vocabulary, exchange is exact for all words.

A text's probability is the product of p(class | group before), interpolated with p(class), and p(word | class). The group
before is the class of the word before, or of its ending where that word isn't one of the CLUSTERED, so that a word's
probability needs no more than the word before, wherever that word's counts are kept. A clustered word has its share of the
class, any other an add-one share of it; an unseen word takes the class of its ending.

The HEAD most frequent words (a bounded table) are scored inside the pass over the texts; the rest meet their counts and
classes in a join, which no broadcast would bound.

Defined results: null and empty texts are the end token alone; repeated rows are each scored; of words with equal counts
the smaller is clustered first, and of classes with equal likelihood the first is taken; a text is scored as a whole,
however long; other columns, whatever their names, are carried along untouched; with no training text every score is
finite, from smoothing alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import compress
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

CLASSES = 48
PAIRS = CLASSES * CLASSES
#: Frequent words that exchange clusters on their own, and groups that stand in for the other words, by ending.
CLUSTERED, ENDINGS = 766, 256
#: Most words whose counts are broadcast.
HEAD = 250_000
ROUNDS = 6
#: Pseudo-counts for p(class | class).
MU = 20.0
#: What the class of its ending gains for a word, in powers of ten: a rare word leaves it only on evidence.
PRIOR = 2.0
#: Words that a task counts before it sends them on.
FLUSH = 200_000


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), summed as far as a task's memory goes."""
    counts: Counter = Counter()

    def sent() -> pa.RecordBatch:
        words, n = pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())
        counts.clear()
        return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    for b in batches:
        for text in common.binary_texts(b.column(0)):
            counts.update(common.space_words(text))
            if len(counts) > FLUSH:
                yield sent()
    yield sent()


class Endings(dict):
    """Items of words that aren't clustered, by their last three bytes."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, last: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        n = self[last] = self.first + ending(last)
        return n


class Items:
    """Items of words: the clustered words, the groups by ending, the end (and start)."""

    def __init__(self, item_of: dict[bytes, int]):
        self.get, self.first = item_of.get, len(item_of)
        self.end, self.by_ending = self.first + ENDINGS, Endings(self.first)

    def ended(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Start, the words' items, end; which words aren't clustered; and these."""
        get, by_ending = self.get, self.by_ending
        out = np.array([self.end, *[get(w, -1) for w in words], self.end], np.int64)
        open_ = out[1:-1] < 0
        rare = list(compress(words, open_.tolist()))
        out[1:-1][open_] = [by_ending[w[-3:]] for w in rare]
        return out, open_, rare


def pair_counter(item_of: dict[bytes, int]) -> Callable:
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(item_of)
        n_items = items.end + 1
        total, kept, held = np.zeros(n_items * n_items, np.int64), [], 0
        for b in batches:
            for text in common.binary_texts(b.column(0)):
                s, _, _ = items.ended(common.space_words(text))
                kept.append(s[:-1] * n_items + s[1:])
                held += len(s)
                if held > 10 * FLUSH:
                    total += np.bincount(np.concatenate(kept), minlength=len(total))
                    kept, held = [], 0
        if kept:
            total += np.bincount(np.concatenate(kept), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return paired


def neighbour_counter(shared) -> Callable:
    """(word, class before * CLASSES + class after, n) of the words that exchange hasn't clustered, summed as far as a task's memory goes."""

    def counted_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_of, of = shared.value
        items, met, kept, held = Items(item_of), {}, [], 0

        def sent() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(kept or [np.empty(0, np.int64)]), return_counts=True)
            words = pa.array(list(met), pa.binary()).cast(pa.string()).take(pa.array(keys // PAIRS))
            return pa.RecordBatch.from_arrays([words, pa.array(keys % PAIRS, pa.int32()), pa.array(n, pa.int64())], names=["word", "beside", "n"])

        for b in batches:
            for text in common.binary_texts(b.column(0)):
                item, open_, rare = items.ended(common.space_words(text))
                cls = of[item]
                # Words are numbered in order of their first appearance.
                number = met.setdefault
                at = np.array([number(w, len(met)) for w in rare], np.int64)
                kept.append(at * PAIRS + (cls[:-2] * CLASSES + cls[2:])[open_])
                held += len(at)
                if len(met) > FLUSH or held > 10 * FLUSH:
                    yield sent()
                    met, kept, held = {}, [], 0
        yield sent()

    return counted_beside


def chooser(shared) -> Callable:
    """From rows sorted by word: (word, n, class), and with a null word the class pairs (class before * CLASSES + class) that these make."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (like, of_ending), pairs, waiting = shared.value, np.zeros(PAIRS, np.int64), None

        def chosen(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            beside, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            words = rows.column(0).take(pa.array(starts))
            gains = np.add.reduceat(like[beside] * n[:, None], starts)
            gains[np.arange(len(starts)), [of_ending[ending(w)] for w in common.binary_texts(words)]] += PRIOR
            cls = gains.argmax(1)
            np.add.at(pairs, beside // CLASSES * CLASSES + np.repeat(cls, np.diff(np.append(starts, len(n)))), n)
            return output(words, np.add.reduceat(n, starts), cls)

        def output(words: pa.Array, n: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64()), pa.array(cls, pa.int32())], names=["word", "n", "class"])

        for b in batches:
            rows = b if waiting is None else pa.Table.from_batches([waiting, b]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            words = rows.column(0)
            starts = np.append(0, np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) + 1)
            # The last word may go on in the next batch; it has PAIRS rows at most.
            waiting = rows.slice(starts[-1])
            if len(starts) > 1:
                yield chosen(rows.slice(0, starts[-1]), starts[:-1])
        if waiting is not None:
            yield chosen(waiting, np.zeros(1, np.int64))
        at = np.flatnonzero(pairs)
        yield output(pa.nulls(len(at), pa.string()), pairs[at], at)

    return choose


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each item; the last item keeps a class of its own."""
    n = len(bigrams)
    left, right = bigrams.sum(1), bigrams.sum(0)
    of = np.empty(n, np.int64)
    order = np.argsort(-(left + right)[:-1], kind="stable")
    of[order] = np.arange(n - 1) % (classes - 1)
    of[n - 1] = classes - 1
    onehot = np.eye(classes)[of]
    cc = onehot.T @ bigrams @ onehot
    cl, cr = onehot.T @ left, onehot.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(rounds):
        moved = 0
        for w in order:
            if left[w] + right[w] == 0:
                continue
            old, self_n = of[w], bigrams[w, w]
            out = np.bincount(of, bigrams[w], classes)
            into = np.bincount(of, bigrams[:, w], classes)
            out[old] -= self_n
            into[old] -= self_n
            cc[old] -= out
            cc[:, old] -= into
            cc[old, old] -= self_n
            cl[old] -= left[w]
            cr[old] -= right[w]
            # Gain of adding w to class k: its row and column, the corner counted once, less the margins.
            fcc = f(cc)
            gain = (f(cc + out) - fcc).sum(1) + (f(cc + into[:, None]) - fcc).sum(0)
            d = np.diag(cc)
            gain += f(d + out + into + self_n) - f(d + out) - f(d + into) + f(d)
            gain -= f(cl + left[w]) - f(cl) + f(cr + right[w]) - f(cr)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            cc[new] += out
            cc[:, new] += into
            cc[new, new] += self_n
            cl[new] += left[w]
            cr[new] += right[w]
        if not moved:
            break
    return of


def steps(cc: np.ndarray) -> np.ndarray:
    """log10 p(class | class before) from counts of class pairs."""
    prior = cc.sum(0) + 1.0
    prior /= prior.sum()
    return np.log10((cc + MU * prior) / (cc.sum(1, keepdims=True) + MU))


def likelihoods(cc: np.ndarray) -> np.ndarray:
    """By class before * CLASSES + class after: what one token between them adds to the log likelihood of each class; the end's class is closed."""
    step = steps(cc)
    like = step[:, None, :] + step.T[None, :, :] - np.log10(cc.sum(0) + 1.0)
    like[:, :, -1] = -np.inf
    return like.reshape(PAIRS, CLASSES)


def scorer(shared) -> Callable:
    """Per text: n_tokens, tokens known from the head, base and model scores as far as the head goes, and the other words with their place among classes, scored as unseen."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        m = SimpleNamespace(**shared.value)
        gain = m.gain.ravel()

        def work(texts: pa.Array) -> list[pa.Array]:
            cols: list[list] = [[], [], [], [], [], [], []]
            by_ending, get = Endings(m.first), m.head.get
            for text in common.binary_texts(texts):
                words = common.space_words(text)
                row = np.array([get(w, -1) for w in words], np.int64)
                known = row >= 0
                unseen = list(compress(words, (~known).tolist()))
                item = m.item[row]
                item[~known] = [by_ending[w[-3:]] for w in unseen]
                of = m.of[item]
                before = np.concatenate(([CLASSES - 1], of))
                # Class of each word: a known word's own, else that of its ending.
                place = before[:-1] * CLASSES + np.where(known, m.cls[row], of)
                score = float(gain[place].sum() + m.own[row[known]].sum() + m.end_gain[before[-1]])
                base = float(np.log10(m.ends + 1.0)) - m.base * (len(words) + 1) + float(m.plain[row[known]].sum())
                rest = Counter(zip(unseen, place[~known].tolist()))
                found = (len(words) + 1, int(m.ends > 0) + int(known.sum()), base, score, [w for w, _ in rest], [k for _, k in rest], list(rest.values()))
                for col, v in zip(cols, found):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            out = [pa.array(c, k) for c, k in zip(cols, kinds)]
            return [*out[:4], out[4].cast(pa.list_(pa.string())), *out[5:]]

        return work

    return make


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("known", T.LongType()),
    T.StructField("base", T.DoubleType()),
    T.StructField("model", T.DoubleType()),
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("places", T.ArrayType(T.IntegerType())),
    T.StructField("times", T.ArrayType(T.LongType())),
]


def scored(docs: DataFrame, training: Column, text_col: str = "text", keep: list[str] | None = None, clustered: int = CLUSTERED, head: int = HEAD) -> DataFrame:
    """The columns `keep` (default: all) of each document and n_tokens, n_known, train_tokens, base_score, score; learns from rows where `training` holds.

    `clustered` words go through exchange one by one (its counts are gathered: at most (clustered + ENDINGS) squared), `head` words are broadcast.
    """
    sc = docs.sparkSession.sparkContext
    learn = docs.where(training).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = learn.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = {r.word.encode(): r.n for r in words.orderBy(F.desc("n"), "word").limit(clustered).collect()}
    item_of = {w: i for i, w in enumerate(own)}
    end = len(own) + ENDINGS
    bigrams = np.zeros((end + 1) ** 2)
    pairs = learn.mapInArrow(pair_counter(item_of), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    bigrams[pairs["pair"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.float64)
    bigrams = bigrams.reshape(end + 1, end + 1)
    ends = int(bigrams[end].sum())
    of = exchange(bigrams)
    onehot = np.eye(CLASSES)[of]
    beside = learn.mapInArrow(neighbour_counter(sc.broadcast((item_of, of))), "word string, beside int, n long")
    # Summed first by word and neighbours, so that a frequent word is spread; then a word has PAIRS rows at most.
    beside = beside.groupBy("word", "beside").agg(F.sum("n").alias("n")).repartition("word").sortWithinPartitions("word", "beside")
    like = sc.broadcast((likelihoods(onehot.T @ bigrams @ onehot), of[len(own) : end]))
    classed = common.materialize(beside.mapInArrow(chooser(like), "word string, n long, class int"))
    found = classed.where(F.col("word").isNotNull())
    # Pairs of a class before and the class of any word or the end, each word in its own class.
    cc = np.zeros(PAIRS)
    for r in classed.where(F.col("word").isNull()).groupBy("class").agg(F.sum("n").alias("n")).collect():
        cc[r["class"]] = r.n
    single = [*range(len(own)), end]
    cc = cc.reshape(CLASSES, CLASSES) + onehot.T @ bigrams[:, single] @ onehot[single]
    size = np.ones(CLASSES)
    tokens, types = sum(own.values()) + ends, len(own) + (ends > 0)
    for w, i in item_of.items():
        size[of[i]] += own[w]
    for r in found.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        size[r["class"]] += r.n + r.v
        tokens, types = tokens + r.n, types + r.v
    # The frequent words by bands of counts, as many whole bands as `head` words allow: no sort, and a gathered size that is checked.
    band = F.floor(F.log2("n") * 32).cast("int")
    sizes = sorted(((r.band, r["count"]) for r in found.groupBy(band.alias("band")).count().collect()), reverse=True)
    least, held = 2**31 - 1, len(own)
    for b, n in sizes:
        held += n
        if held > head:
            break
        least = b
    top = found.where(band >= least).toPandas()
    n = np.concatenate((np.array(list(own.values()), np.float64), top["n"].to_numpy(np.float64)))
    step = steps(cc)
    gain = step - np.log10(size)
    model = {
        "first": len(own),
        # The item of each frequent word; the last stands for no word.
        "item": np.concatenate((np.arange(len(own)), [len(own) + ending(w.encode()) for w in top["word"]], [0])).astype(np.int64),
        "of": of,
        "head": {w: i for i, w in enumerate([*own, *(w.encode() for w in top["word"])])},
        # The last class stands for no word.
        "cls": np.concatenate((of[: len(own)], top["class"].to_numpy(np.int64), [0])),
        "own": np.log10(n + (np.arange(len(n)) >= len(own))),
        "plain": np.log10(n + 1.0),
        "gain": gain,
        "end_gain": step[:, CLASSES - 1],
        "base": np.log10(tokens + types + 1.0),
        "ends": ends,
    }
    narrow = docs.select(*(keep or docs.columns), *([text_col] if text_col not in (keep or docs.columns) else []))
    first = common.map_text(narrow, text_col, scorer(sc.broadcast(model)), FIELDS)
    first = first.select(F.struct(*(F.col(f"row.`{c}`") for c in (keep or docs.columns))).alias("row"), *(f.name for f in FIELDS))
    first = common.materialize(first.withColumn("at", F.monotonically_increasing_id()))
    rest = first.select("at", F.explode(F.arrays_zip("words", "places", "times")).alias("w")).select("at", "w.*").withColumnRenamed("words", "word")
    if held > head:
        gains = F.lit(gain.ravel())
        at = lambda place: F.get(gains, place)
        place = (F.col("places") - F.col("places") % CLASSES + F.col("class")).cast("int")
        more = F.col("times") * (at(place) - at(F.col("places")) + F.log10(F.col("n") + 1.0))
        tail = rest.join(found.where(band < least), "word").groupBy("at")
        tail = tail.agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("plain"), F.sum(more).alias("gain"))
        first = first.join(tail, "at", "left")
    else:
        first = first.withColumns({"more": F.lit(0), "plain": F.lit(0.0), "gain": F.lit(0.0)})
    return first.select(
        "row",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plain", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    out = scored(docs.withColumn("held_out", remainder == 2), ~F.col("held_out"), keep=["doc_id", "held_out"])
    return out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
