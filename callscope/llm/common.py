"""What the text operators share: shared work tables, Arrow plumbing, byte-level word splitting."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.work import materialize

__all__ = ["binary_texts", "lower_az", "map_text", "materialize", "per_process", "space_words", "table", "word_list"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z; every other byte becomes a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def word_list(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, with A-Z lower-cased (bytes methods are ASCII-only)."""
    return text.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Texts as UTF-8 bytes, null as empty, one at a time."""
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker, which later tasks of the worker use again."""
    kept = sys.modules.setdefault("_callscope_kept", types.ModuleType("_callscope_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def map_text(
    df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: list[T.StructField]
) -> DataFrame:
    """Columns `row` (all of df's columns) and `fields`, which the function made by `make` in each task derives from the text."""
    schema = T.StructType([T.StructField("row", df.schema), *fields])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                row = b.column(0)
                out = work(row.field(at))
                yield pa.RecordBatch.from_arrays([row, *out], names=["row", *(f.name for f in fields)])

    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).mapInArrow(run, schema)
