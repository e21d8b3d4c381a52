"""Toxicity behind a noisy channel: texts are restored first, then scored.

The channel model says what a writer may have done to a word: leetspeak for letters, separators or
spaces between them, and repetition. A Viterbi search through the lattice of readings, under a
character trigram model counted over all documents, restores each suspicious token, of any length; a
token of plain letters none of which is doubled has one reading and is taken as it is. A run of spaced
single characters is read as one word and also, with word breaks in the lattice, as several. Restored
texts are scored by evidence weights of words and word beginnings, learned from labelled rows, and a
logistic curve over a text's evidence.

At most SAMPLE labelled rows are used for learning, chosen by hash of doc_id: three quarters for the
weights and the rest for the curve; of the weights, the LEXICON that speak most often for label 1 are
kept. Counting, restoring and scoring cover every document. The channel knows the letters of LETTERS;
words of other scripts are one letter class of the character model and carry no evidence.

Defined results: null, empty and wordless texts have no evidence and get the curve's base score; with
no usable labels every score is 0; a doc_id that is null is never a training row; repeated rows are
each scored, and count as one in learning; labels of 0 and 1 only are used, the largest if a doc_id has
several, the more frequent (1 on ties) if a text has; of equal readings the first found stands, in the order of the token; very long
texts are scored whole; other columns, whatever their names, stay in `row`; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

SAMPLE = 20_000
#: Most weights kept, and the least evidence that one needs (log odds, shrunk).
LEXICON, LEAST_WEIGHT = 5_000, 1.2
SHRINK = 12.0
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
CACHE = 300_000
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153]))
ALPHABET = len(LETTERS) + 1
CODES = np.zeros(0x250, np.int64)
CODES[[ord(x) for x in LETTERS]] = np.arange(1, ALPHABET)
#: Readings of symbols as letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = set(".-_*'~^/\\,:;")
#: log10 costs of what the channel may do.
READ, SEPARATED, REPEATED = -0.3, -0.3, -0.2
EDGES = re.compile(r"^[^\w@$!|(€]+|(?:!+|\${3,}|[^\w@$!|+(€])+$")
CLEAN = re.compile(f"[{LETTERS}]+")
DOUBLE = re.compile(r"(.)\1")
TRIPLE = re.compile(r"(.)\1\1")


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return CODES[np.where(points < len(CODES), points, 0)]


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**3, np.int64)

    def add(parts: list[np.ndarray]) -> None:
        c = np.concatenate(parts)
        total[:] += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=len(total))

    parts, size = [], 0
    for b in batches:
        for text in common.binary_texts(b.column(0)):
            parts += [np.zeros(2, np.int64), codes(text.decode())]
            size += len(text)
            if size > 1_000_000:
                add(parts)
                parts, size = [], 0
    add([*parts, np.zeros(2, np.int64)])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(counts: np.ndarray) -> np.ndarray:
    """log10 p(letter | two before), interpolated with shorter contexts."""
    c = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
    one = c.sum((0, 1)) + 1.0
    p = one / one.sum()
    two = c.sum(0)
    p = (two + 20 * p) / (two.sum(1, keepdims=True) + 20)
    return np.log10((c + 20 * p[None]) / (c.sum(2, keepdims=True) + 20)).astype(np.float32)


class Restorer:
    """Words of a text as its writer meant them."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.code = {x: i + 1 for i, x in enumerate(LETTERS)}
        self.cache: dict[str, tuple[str, ...]] = {}

    def readings(self, token: str, pairs: bool) -> Iterator[list[tuple[str, float]]]:
        """Of each character; with `pairs`, a doubled one may be one letter too."""
        run = 0
        for i, x in enumerate(token):
            run = run + 1 if i and token[i - 1] == x else 1
            some: list[tuple[str, float]] = []
            if x in self.code:
                some.append((x, 0.0))
            some += [(y, READ) for y in LEET.get(x, "")]
            if x in SEPARATORS or not some:
                some.append(("", SEPARATED))
            if run > 1 and (pairs or run > 2 or token[i + 1 : i + 2] == x):
                some.append(("", REPEATED))
                some = [(y, c + REPEATED if y and run > 2 else c) for y, c in some]
            yield some

    def decode(self, token: str, pairs: bool = False, breaks: bool = False) -> str:
        """The likeliest reading: Viterbi over the last two letters, with links back; with `breaks`, of several words."""
        code, model = self.code, self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for some in self.readings(token, pairs):
            if breaks:
                for (a, b), (p, done) in list(states.items()):
                    q = p + float(model[a, b, 0])
                    if b and ((b, 0) not in states or states[b, 0][0] < q):
                        states[b, 0] = (q, (done, " "))
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, done) in states.items():
                for x, cost in some:
                    if x:
                        k = code[x]
                        key, q = (b, k), p + cost + float(model[a, b, k])
                    else:
                        key, q = (a, b), p + cost - 0.6
                    if key not in after or after[key][0] < q:
                        after[key] = (q, (done, x) if x else done)
            states = after
        at = max(((p + float(model[a, b, 0]), at) for (a, b), (p, at) in states.items()), key=lambda s: s[0])[1]
        letters = []
        while at:
            at, x = at
            letters.append(x)
        return "".join(reversed(letters))

    def token(self, token: str) -> tuple[str, ...]:
        """Readings of a token, or of a run of characters with spaces between them."""
        found = self.cache.get(token)
        if found is not None:
            return found
        if " " in token:
            glued = token.replace(" ", "")
            out = tuple({*self.token(glued), *(w for pairs in {False, DOUBLE.search(glued) is not None} for w in self.decode(glued, pairs, breaks=True).split())})
        else:
            core = EDGES.sub("", token)
            double = DOUBLE.search(core) is not None
            words = {*CLEAN.findall(core)}
            if not CLEAN.fullmatch(core) or TRIPLE.search(core):
                if any(x in self.code or x in LEET for x in core):
                    words.add(self.decode(core))
            if double and any(x in self.code or x in LEET for x in core):
                words.add(self.decode(core, pairs=True))
            out = tuple(words - {""})
        if len(self.cache) > CACHE:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = out
        return out

    def tokens(self, text: str) -> list[str]:
        """Tokens; runs of three or more single characters (spaced-out words) also as one, its spaces kept."""
        tokens = text.lower().split()
        if sum(map((1).__eq__, map(len, tokens))) < 3:
            return tokens
        joined, run = [], []
        for t in [*tokens, ""]:
            if len(t) == 1:
                run.append(t)
                continue
            if len(run) >= 3:
                joined.append(" ".join(run))
            run = []
        return tokens + joined


def features(words: set[str]) -> set[str]:
    out = {w for w in words if len(w) > 2}
    for k in PREFIXES:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


def learner(model) -> Callable:
    """(feature, toxic, other): numbers of labelled texts with a feature."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.value)
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array(names), *(pa.array([s[x] for x in names], pa.int64()) for s in (seen[1], seen[0]))]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays(cols, names=["feature", "toxic", "other"])

        for b in batches:
            for text, y in zip(common.binary_texts(b.column(0)), b.column(1).to_pylist()):
                words = {w for t in set(restore.tokens(text.decode())) for w in restore.token(t)}
                seen[y].update(features(words))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield sent()
        yield sent()

    return counts


def weights_of(counts: DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Shrunk log odds of the features that speak for label 1."""
    rate = toxic / (toxic + other)
    odds = F.log((F.col("toxic") + SHRINK * rate) / (F.col("other") + SHRINK * (1 - rate))) - float(np.log(toxic / other))
    kept = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic >= 3").withColumn("w", odds)
    kept = kept.where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc(F.col("w") * F.col("toxic")), "feature").limit(LEXICON)
    return {r.feature: r.w for r in kept.select("feature", "w").collect()}


class Evidence:
    """(strongest weight, log of their sum, share of tokens that carry one) of a text."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.restore, self.weights = Restorer(model), weights
        self.cache: dict[str, float] = {}

    def weight(self, token: str) -> float:
        get, best = self.weights.get, 0.0
        for w in self.restore.token(token):
            best = max(best, get(w, 0.0), *(get(w[:k] + "*", 0.0) for k in PREFIXES))
        if len(self.cache) > CACHE:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = best
        return best

    def __call__(self, text: str) -> tuple[float, float, float]:
        tokens = self.restore.tokens(text)
        get, found = self.cache.get, []
        for t in tokens:
            w = get(t)
            if w is None:
                w = self.weight(t)
            if w:
                found.append(w)
        if not found:
            return 0.0, 0.0, 0.0
        return max(found), float(np.log1p(sum(found))), min(1.0, 10 * len(found) / len(tokens))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the penalized loss falls; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([*[0.05] * (len(w) - 1), 1e-3])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + w @ ridge @ w / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        while np.abs(step).max() >= 1e-7 and not loss(w + step) < loss(w):
            step = step / 2
        if np.abs(step).max() < 1e-7:
            break
        w += step
    return w


def evidence_of(docs: DataFrame, model, weights: dict[str, float]) -> DataFrame:
    """Columns `row` and the three of Evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        measure = Evidence(model.value, shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [measure(t.decode()) for t in common.binary_texts(texts)]
            return [pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]

        return work

    return common.map_text(docs, "text", make, [T.StructField(x, T.DoubleType()) for x in ("strongest", "total", "share")])


def fitted(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> tuple:
    """The character model (broadcast), the weights and the curve. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    texts = docs.select("text")
    grams = texts.mapInArrow(trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ALPHABET**3)
    counts[grams["gram"].to_numpy(np.int64)] = grams["n"]
    model = spark.sparkContext.broadcast(character_model(counts))
    usable = labels.where(training & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    # About `sample` rows of 12 bytes whatever the input: small enough to send to every task.
    chosen = docs.join(F.broadcast(usable), "doc_id").select("text", "toxic")
    chosen = common.materialize(chosen.groupBy("text").agg(F.round(F.avg("toxic")).cast("int").alias("toxic")).withColumn("fit", F.pmod(F.xxhash64("text"), F.lit(4)) > 0))
    sizes = {(r.fit, r.toxic): r["count"] for r in chosen.groupBy("fit", "toxic").count().collect()}
    toxic, other = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic or not other:
        return model, {}, np.array([0.0, 0.0, 0.0, -np.inf])
    weights = weights_of(chosen.where("fit").select("text", "toxic").mapInArrow(learner(model), "feature string, toxic long, other long"), toxic, other)
    part = "not fit" if sizes.get((False, 1), 0) >= 5 and sizes.get((False, 0), 0) >= 5 else "true"
    seen = evidence_of(chosen.where(part).select("text", "toxic"), model, weights).select("row.toxic", "strongest", "total", "share").toPandas()
    return model, weights, logistic(seen[["strongest", "total", "share"]].to_numpy(), seen["toxic"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame, training: Column, learn_from: DataFrame | None = None) -> DataFrame:
    """Columns `row` and score."""
    source = docs if learn_from is None else learn_from
    model, weights, curve = fitted(source.select("doc_id", "text"), labels.select("doc_id", "toxic"), training)
    raw = sum((F.col(c) * float(w) for c, w in zip(("strongest", "total", "share"), curve)), F.lit(float(curve[3])))
    return evidence_of(docs, model, weights).select("row", (1 / (1 + F.exp(-raw))).alias("score"))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold."""
    return scored(docs, labels, ~held_out(F.col("doc_id"))).where(F.col("score") < threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, common.table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return out.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
