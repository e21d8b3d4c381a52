"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of pieces of at most one sequence. In every round a source's deficit counter
grows by its quantum, its target share of the tokens, and serves the pieces that it covers; what it
can't use is carried on. With ever smaller quanta this serves pieces in the order of the place at which
their turn comes, divided by the share: a piece of places S to E of its queue has its turn at
S + phase * (E - S). The phase, by a hash of the source, is the source's first credit; it spreads the
pieces of many small sources over all rounds. So one prefix sum per source orders all pieces, with
deficits carried across sequences, windows and partitions alike. The sums are taken inside the
tokenizing tasks and joined over tasks by a small table of (task, source) totals.

A window is what is served while WINDOW_TOKENS are granted, and is packed by one task; at every place
within it, each source has got its share but for one piece. Pieces of a whole sequence are sequences
of their own; the others are laid end to end in the order served, cut where a sequence is full, so that
every sequence is a mixture and only a window's last one is padded. sequence_id is window * 2^20 +
place, so that ids follow the order of service.

By default the target shares are the corpus's own, so that all queues run dry together; with other
targets, the sources that last longest fill the final windows alone, and sources of share 0 come last.

Defined results: null and empty texts are the end token alone; very long texts are cut into pieces and
never gathered whole; special strings in a text get their own ids; a null source is a source of its
own; of equal turns the smaller source, then the earlier row comes first; repeated rows are each
packed; other columns, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm import common

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
WINDOW_TOKENS = 1 << 20
#: Number of the first window of sources whose share is 0.
LAST_WINDOWS = 1 << 40
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, task int, queue_end long, ids binary"
PLACED = PIECES + ", turn double, window long"
PACKED = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Longest run of white space that the fast encoder gets.
LONGEST = 100_000


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The tokenizer's pieces as bytes with their ids, and its special strings, if it is byte-level, its merges are done in the order of ids and nothing but special strings is added."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
        return None
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = spec["model"]["vocab"]
    merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(merges, merges[1:])):
        return None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(not t["special"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    return {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}, special


class Encoder:
    """Ids of whole texts as the tokenizer gives them.

    Where its pieces are byte-level and ranked by id, a faster library merges by the same ranks over the same
    pre-tokens; texts with extremely long runs of spaces, and other tokenizers, are encoded by the tokenizer itself. With `special`, special strings in a text get their ids, as the tokenizer
does by default; without, they are plain text.
    """

    def __init__(self, path: str, special: bool = False):
        self.path, self.special, self.tokenizer = path, special, None
        self.long = re.compile(r"\s{%d}" % LONGEST)
        self.fast = None
        if found := byte_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found[0], special_tokens=found[1] if special else {})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or (len(text) > LONGEST and self.long.search(text)):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
                self.tokenizer.encode_special_tokens = not self.special
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()) if self.special else self.fast.encode_ordinary(text), np.uint32)


def narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough: these travel to the windows."""
    return ids.astype("<u2" if int(ids.max()) < 1 << 16 else "<u4").tobytes()


def tokenizer_of(path: str, end_id: int) -> Callable:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = common.per_process(("encoder", path), lambda: Encoder(path, special=True)), TaskContext.get().partitionId()
        ends: dict[str | None, int] = defaultdict(int)
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            doc_ids, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc_id, source, text in zip(doc_ids, sources, common.binary_texts(b.column(2))):
                ids = np.append(encode(text.decode()), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), SEQUENCE):
                    part = ids[start : start + SEQUENCE].tobytes()
                    n = len(part) // 4
                    ends[source] += n
                    whole = n == SEQUENCE
                    row = (doc_id, source, start, n, zlib.crc32(part), len(ids), task, ends[source], None if whole else narrow(ids[start : start + SEQUENCE]))
                    for c, v in zip(rows, row):
                        c.append(v)
                if len(rows[0]) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return pieces


def filled(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs one window."""
    base = key[0].as_py() << 20
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["turn"], r["source"] is None, r["source"], r["task"], r["queue_end"]))
    out, used, open_at, at = [], 0, None, 0
    for r in rows:
        row, done, n = (r["doc_id"], r["source"]), 0, r["length"]
        if n == SEQUENCE:
            out.append((*row, r["start"], n, r["ids_crc32"], r["doc_tokens"], base + used, 0))
            used += 1
            continue
        while done < n:
            if open_at is None:
                open_at, at, used = used, 0, used + 1
            take = min(n - done, SEQUENCE - at)
            ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // n}")
            crc = r["ids_crc32"] if take == n else zlib.crc32(ids[done : done + take].astype("<u4").tobytes())
            out.append((*row, r["start"] + done, take, crc, r["doc_tokens"], base + open_at, at))
            done, at = done + take, at + take
            if at == SEQUENCE:
                open_at = None
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in PACKED.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shares: dict[str, float] | None = None,
    path: str | None = None,
    end_id: int = 0,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per piece; `shares` are the target token proportions by source (others: their own), by default the corpus's."""
    path = path or public_tokenizers.path(TOKENIZER)
    texts = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col))
    pieces = common.materialize(texts.mapInArrow(tokenizer_of(path, end_id), PIECES))
    # (task, source): tokens of the same source in earlier tasks, and the source's quantum.
    by_task = pieces.groupBy("task", "source").agg(F.sum("length").alias("n"))
    by_source = by_task.groupBy("source").agg(F.sum("n").alias("total"))
    tokens = by_task.agg(F.sum("n")).first()[0] or 1
    windows = max(1, -(-tokens // window_tokens))
    share: Column = F.col("total") / F.lit(tokens)
    for source, s in (shares or {}).items():
        share = F.when(F.col("source") == source, F.lit(float(s))).otherwise(share)
    phase = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(9)), F.lit(1 << 20)) / (1 << 20)
    quanta = by_source.select(F.col("source").alias("s"), (F.lit(tokens / windows) * share).alias("quantum"), phase.alias("phase"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select(F.col("task").alias("t"), F.col("source").alias("q"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = before.join(quanta, F.col("q").eqNullSafe(F.col("s")))
    placed = pieces.join(before, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("q")))
    place = F.col("before") + F.col("queue_end") - F.col("length") + F.col("phase") * F.col("length")
    # Windows of sources without a share come after all others.
    turn = F.when(F.col("quantum") > 0, F.try_divide(place, F.col("quantum"))).otherwise(place / window_tokens + LAST_WINDOWS)
    placed = placed.withColumn("turn", turn).withColumn("window", F.floor("turn").cast("long"))
    placed = placed.select(*(x.split()[0] for x in PLACED.split(", ")))
    return placed.groupBy("window").applyInArrow(filled, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
