"""Fill-in-middle transformation over run-length classes of characters.

A text is stored as its maximal runs of white space (space and \\x09-\\x0D) and of other characters: where each run starts and how
many units end up to its end. A cut after k units is found by a binary search over the cumulative counts; its offset inside the run
is arithmetic. With words as units, white space belongs to the word after it, so that a run of other characters is one unit, and
white space is one only at the text's end; with characters as units, a run of n characters is n units. All work is linear in the text,
and in the query nothing is shuffled.

Which texts are cut, where, and in which order their parts are written is drawn from sha256 of `<seed>:<doc_id>`: the same documents give
the same output however they are partitioned, and a lost task is simply run again.

Defined results: null text is empty; an empty text, or one that holds a mark, stays plain; white space alone is one word; very
long texts are cut whole; a row without doc_id draws as `<seed>:` without a number; rows that share a doc_id draw alike, each over its own text;
ids need not be numbers; other columns, whatever their names, are kept by `transform`, but for one named `fim`, which
gives way to the result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass
class Runs:
    """Runs of one class: byte offset of each start, whether it is white space, units that end up to its end, and units of its own."""

    start: np.ndarray
    space: np.ndarray
    upto: np.ndarray
    own: np.ndarray
    #: Byte offsets of the characters, if these are the units.
    chars: np.ndarray | None
    size: int

    @property
    def n(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offset(self, k: int) -> int:
        """The byte offset after the first k units."""
        if k <= 0:
            return 0
        run = int(np.searchsorted(self.upto, k))
        inside = k - int(self.upto[run] - self.own[run])
        if self.chars is not None:
            first = int(np.searchsorted(self.chars, self.start[run]))
            return int(self.chars[first + inside]) if first + inside < len(self.chars) else self.size
        return int(self.start[run + 1]) if run + 1 < len(self.start) else self.size


def runs_of(text: bytes, unit: str = "word") -> Runs:
    """The runs of a UTF-8 text; white space is ASCII, so that bytes and characters have the same runs."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        none = np.empty(0, np.int64)
        return Runs(none, none.astype(bool), none, none, none if unit == "char" else None, 0)
    space = SPACE[b]
    start = np.concatenate([[0], np.flatnonzero(space[1:] != space[:-1]) + 1])
    kind = space[start]
    if unit == "char":
        chars = np.flatnonzero((b & 0xC0) != 0x80)
        own = np.diff(np.append(np.searchsorted(chars, start), len(chars)))
        return Runs(start, kind, np.cumsum(own), own, chars, len(b))
    own = (~kind).astype(np.int64)
    own[-1] = 1
    return Runs(start, kind, np.cumsum(own), own, None, len(b))


def n_chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def cut(doc_id: str, text: bytes, seed: int, fim_percent: int, spm_percent: int, unit: str, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    runs = runs_of(text, unit)
    n = runs.n
    drawn = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in range(0, 32, 8))
    p, s, m = marks
    if not text or h3 % 100 >= fim_percent or any(x in text for x in marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = runs.offset(first), runs.offset(second)
    before, between, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        form, output = "spm", b"".join((s, after, p, before, m, between))
    else:
        form, output = "psm", b"".join((p, before, s, after, m, between))
    return n, form, n_chars(before), n_chars(between), output


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    unit: str = "word",
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """Each row with `fim`: n (units), form (plain, psm or spm), prefix_chars, middle_chars, output (the text to train on)."""
    if unit not in ("word", "char"):
        raise ValueError(f"unit is word or char, not {unit}")
    raw = tuple(x.encode() for x in marks)
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    arrow = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    ids = F.col(f"`{id_col}`").cast("string")
    name = next(c for c in (f"_fim_id{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        def work(column: pa.Array) -> list[pa.Array]:
            texts, keys = common.binary_texts(column.field(0)), column.field(1).to_pylist()
            rows = [cut(k or "", t, seed, fim_percent, spm_percent, unit, raw) for k, t in zip(keys, texts)]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(arrow)]
            output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
            return [pa.StructArray.from_arrays([*cols, output], names=list(kinds))]

        return work

    both = docs.withColumn(name, F.struct(F.col(f"`{text_col}`").alias("t"), ids.alias("i")))
    fim = T.StructField("fim", T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    out = common.map_text(both, name, make, [fim])
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "fim"), "fim")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from, out of the output and its form alone."""
    p, s, m = marks
    head, tail = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring(F.substring_index(head, s, 1), len(p) + 1, 2**31 - 1), tail, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), tail, F.substring(F.substring_index(head, p, 1), len(s) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document's output, and of the text rebuilt from it."""
    docs = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return docs.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        sha(F.col("fim.output")).alias("output_sha256"), sha(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
