"""Order-dependent folds over sorted partitions, with a bounded state for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Machine(Protocol):
    """Takes the rows of one key in order; gives rows as soon as they are settled, and the rest at the end."""

    def feed(self, *row: object) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def values(column: pa.Array) -> list:
    """As to_pylist, which makes an object of its own for each value first."""
    if pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and column.null_count == 0):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as the session's shuffles have. A number that is given stands: without one, adaptive execution deals the tasks
    of one parallelism out to all branches of a union and makes few large tasks of a branch."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], machine: Callable[[], Machine], result: T.StructType, apart: bool = False) -> DataFrame:
    """Keys and `result`: what a machine for each key makes of its rows, which pass by one after the other.

    One shuffle by key and one sort inside partitions, which spill; a worker holds a batch of rows and the state of one key, never
    the rows of a key. Columns of df are keys first, then what the machine is fed; `order` is among them. apart: by `spread`, for a branch of a union.
    """
    k = len(keys)
    schema = T.StructType([*(df.schema[c] for c in keys), *result])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: Machine | None = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for b in batches:
            out: list[tuple] = []
            for row in zip(*map(values, b.columns)):
                if state is None or row[:k] != now:
                    if state is not None:
                        out.extend(now + x for x in state.close())
                    now, state = row[:k], machine()
                out.extend(now + x for x in state.feed(*row[k:]))
            yield packed(out)
        if state is not None:
            yield packed([now + x for x in state.close()])

    return (spread(df, *keys) if apart else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
