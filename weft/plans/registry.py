"""Every query of the engine with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..frame import Frame, Series

FLAGSHIP = "pricing_summary"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Unique keys, which also order the rows.
KEYS = {"orders": ["o_orderkey"], "events": ["event_id"], "part": ["p_partkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"], "labels": ["doc_id"], "lineitem": []}
#: How results of each kind are made alike on both sides.
_SPARK = {"s": lambda c: c.cast("string"), "i": lambda c: c.cast("bigint"), "b": lambda c: c.cast("boolean"), "f": lambda c: F.round(c.cast("double"), 8), "t": lambda c: c.cast("timestamp_ntz"), "d": lambda c: c.cast("date")}
_DUCK = {"s": "CAST({} AS VARCHAR)", "i": "CAST({} AS BIGINT)", "b": "CAST({} AS BOOLEAN)", "f": "round(CAST({} AS DOUBLE), 8)", "t": "CAST({} AS TIMESTAMP)", "d": "CAST({} AS DATE)"}


def frame(spark: SparkSession, sf_dir: str, table: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{table}.parquet"), KEYS.get(table, []), KEYS.get(table, []))


def query(name: str, sql: str | None = None):
    """Register a function of (get a table's frame) that gives a frame or a DataFrame."""

    def keep(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda table: frame(spark, sf_dir, table))
            return out.df if isinstance(out, Frame) else out

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return keep


def column(name: str, table: str, kind: str, make: Callable[[Frame], Series], sql: str) -> None:
    """Register a query of a table's keys and one made column, ``r``."""
    keys = KEYS[table]

    def run(get: Callable[[str], Frame]) -> DataFrame:
        of = get(table)
        return of.df.select(*keys, _SPARK[kind](make(of).column).alias("r"))

    query(name, f"SELECT {', '.join(keys)}, {_DUCK[kind].format(sql)} AS r FROM {table}")(run)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def _load() -> None:
    from . import columns, frames, learned, more, wider  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
