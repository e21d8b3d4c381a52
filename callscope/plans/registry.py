"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, recursive: bool = False, doubles: str = "") -> Callable:
    """Registers f(view, ...): a DataFrame of the named views.

    sql: a SELECT over the same views, or further CTEs and a SELECT if it starts with a comma.
    doubles: columns that both engines round to six places, as sums of doubles depend on their order.
    """

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*(view(spark, sf_dir, v) for v in views))
            return out.withColumns({c: F.round(c, 6) for c in doubles.split()})

        QUERIES[name] = run
        if sql is not None:
            text = with_views(*views, recursive=recursive)
            text = (text + sql) if text.split() not in (["WITH"], ["WITH", "RECURSIVE"]) else sql if not sql.startswith(",") else text + sql[1:]
            if doubles:
                text = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({text})"
            ORACLES[name] = text
        return f

    return register
