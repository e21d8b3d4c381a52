"""Token counts by byte-pair merging with a heap and a linked list.

The merge table is read from the tokenizer's pieces: a piece's rank is its id, the lowest rank goes
first and ties go to the left. A text's count is its initial symbols minus the merges done; no
identifier is ever made. A piece has a space mark only at its start, so a text is cut before each
run of marks that follows something else, and also around characters without a piece, whose
symbols are their UTF-8 bytes; equal pieces of text are counted once per task and remembered.

Defined results: null or empty text has no tokens and no bytes; any other text gets one leading
space mark; strings of special tokens are ordinary text; very long texts are counted whole; of adjacent pairs of equal
rank the left one merges first; repeated rows are each counted; other columns, whatever their names, stay in `row`; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Counts that a task remembers, for speed only.
CACHE = 400_000
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


class MergeCounter:
    """Counts the tokens of a byte-fallback BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {
            model.id_to_piece(i): (-model.get_score(i), i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece with an inner space mark: texts can't be cut at words")
        self.cache: dict[str, int] = {}
        self.cut = re.compile(" *[^ ]+| +")

    def merged(self, text: str) -> int:
        """Tokens of one piece of text: initial symbols minus merges."""
        rank = self.rank
        symbols: list[str] = list(text)
        n = len(symbols)
        count = sum(1 if s in rank else len(s.encode()) for s in symbols)
        if n < 2:
            return count
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], i, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair], h, pair))
        return count

    def remembered(self, text: str) -> int:
        """A run of spaces and what follows it, up to the next space."""
        n = self.cache.get(text)
        if n is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            if "\n" in text and "\n" not in self.rank:  # no merge crosses it, and its one byte is a token
                lines = text.split("\n")
                return len(lines) - 1 + sum(self.remembered(x) for x in lines if x)
            n = self.merged(text.replace(" ", MARK))
            if len(text) <= 64:
                self.cache[text] = n
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = self.cut.findall(" " + text)
        else:
            parts = [" " + x for x in text.split(" ")]
        get, total = self.cache.get, 0
        for x in parts:
            n = get(x)
            total += self.remembered(x) if n is None else n
        return total


def counted(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Columns `row` (the document), n_bytes and n_tokens."""
    path = path or public_tokenizers.path(MODEL)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        count = common.per_process(("merges", path), lambda: MergeCounter(path))

        def work(texts: pa.Array) -> list[pa.Array]:
            n_bytes, n_tokens = [], []
            for text in common.binary_texts(texts):
                n_bytes.append(len(text))
                n_tokens.append(count(text.decode()))
            return [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]

        return work

    return common.map_text(docs, text_col, make, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs).select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
