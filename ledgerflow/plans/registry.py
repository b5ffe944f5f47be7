"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Results are presented with plain types
(``present``): dates and timestamps as ISO text, decimals as doubles, so that the
Spark result and the oracle result compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
NOTES: dict[str, str] = {}


def query(name: str, sql: str | None = None, note: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (None: no SQL form)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        if note:
            NOTES[name] = note
        return fn

    return deco


def present(df: DataFrame) -> DataFrame:
    """Dates/timestamps → ISO strings, decimals/floats → double; other columns unchanged."""
    cols = []
    changed = False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cols.append(c.cast("string").alias(f.name))
            changed = True
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            cols.append(c.cast("double").alias(f.name))
            changed = True
        else:
            cols.append(c)
    return df.select(*cols) if changed else df


def load_all() -> None:
    """Import every plan module so that its queries register."""
    import importlib
    import pkgutil

    import ledgerflow.plans as plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"ledgerflow.plans.{mod}")
