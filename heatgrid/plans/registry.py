"""Query registry: one key per operator, with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.functions.cells import nudge
from heatgrid.plans.ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "", digits: int | None = 6):
    """Register `fn(spark, sf_dir)`; doubles of its result are rounded to `digits` (None: by `fn` itself).

    `ctes` names the shared views the SQL reads; they are put before it.
    """

    def wrap(fn):
        def run(spark, sf_dir):
            df = fn(spark, sf_dir)
            return df if digits is None else finish(df, digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_ctes(ctes.split(), settle_sql(sql))
        return fn

    return wrap


def settle_sql(sql: str) -> str:
    """`round(x, d)` of a query text, rounded the way `finish` does."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, None
        while depth:
            ch = sql[k]
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = settle_sql(sql[j + 6:comma]), int(sql[comma + 1:k - 1])
        out += f"{sql[i:j]}(round(({inner}) + {nudge(digits)!r}, {digits}) + 0)"
        i = k
    return out + sql[i:]


def finish(df: DataFrame, digits: int = 6, settled: Collection[str] = ()) -> DataFrame:
    """Round doubles, but those settled before, so that two engines' summation orders give equal values (and -0 is 0)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in settled:
            pass
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c + nudge(digits), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.FloatType):
            c = F.round(c.cast("double") + nudge(digits), digits) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)
