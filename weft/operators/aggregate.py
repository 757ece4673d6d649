"""Reductions as columns: usable whole, by group and over windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DateType, DayTimeIntervalType, DoubleType, FloatType, IntegralType, TimestampNTZType, TimestampType


def kind_of(df: DataFrame, column: Column | str) -> DataType:
    """Type of a column or expression over ``df``."""
    return df.schema[column].dataType if isinstance(column, str) and column in df.columns else df.select((F.col(column) if isinstance(column, str) else column).alias("x")).schema[0].dataType


def sound(column: Column, kind: DataType) -> Column:
    """NaN is missing too: floating columns lose it."""
    return F.when(~F.isnan(column), column) if isinstance(kind, (DoubleType, FloatType)) else column


def sound_in(df: DataFrame, name: str) -> Column:
    return sound(F.col(f"`{name}`"), df.schema[name].dataType)


def _falling(c: Column, kind: DataType | None) -> Column:
    """Sorts the other way; whole numbers by their complement, which cannot overflow."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.bitwise_not(F.unix_micros(c.cast("timestamp")))
    if isinstance(kind, DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(kind, DayTimeIntervalType):
        return -c
    return F.bitwise_not(c) if isinstance(kind, IntegralType) else -c


def _ordered(order: list[str]) -> list[str]:
    if not order:
        raise ValueError("this needs an order of rows: Frame(df, order=[...])")
    return order


def _skew(c: Column, r) -> Column:
    """Adjusted for the sample: missing below three values."""
    n, g = r(F.count(c)).cast("double"), r(F.skewness(c.cast("double")))
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt(c: Column, r) -> Column:
    """Excess, adjusted for the sample: missing below four values."""
    n, g = r(F.count(c)).cast("double"), r(F.kurtosis(c.cast("double")))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


#: Name to a function of (column, what places an aggregate in a window, order).
REDUCTIONS = {
    "sum": lambda c, r, o: F.coalesce(r(F.sum(c)), F.lit(0)),
    "prod": lambda c, r, o: F.coalesce(r(F.product(c)), F.lit(1.0)),
    "mean": lambda c, r, o: r(F.avg(c)),
    "min": lambda c, r, o: r(F.min(c)),
    "max": lambda c, r, o: r(F.max(c)),
    "count": lambda c, r, o: r(F.count(c)),
    "size": lambda c, r, o: r(F.count(F.lit(1))),
    "nunique": lambda c, r, o: r(F.count_distinct(c)),
    "median": lambda c, r, o: r(F.percentile(c, 0.5)),
    "q25": lambda c, r, o: r(F.percentile(c, 0.25)),
    "q75": lambda c, r, o: r(F.percentile(c, 0.75)),
    "var": lambda c, r, o: r(F.var_samp(c)),
    "std": lambda c, r, o: r(F.stddev_samp(c)),
    "var_pop": lambda c, r, o: r(F.var_pop(c)),
    "std_pop": lambda c, r, o: r(F.stddev_pop(c)),
    "sem": lambda c, r, o: r(F.stddev_samp(c)) / F.sqrt(r(F.count(c)).cast("double")),
    "skew": lambda c, r, o: _skew(c, r),
    "kurt": lambda c, r, o: _kurt(c, r),
    "any": lambda c, r, o: F.coalesce(r(F.bool_or(c.cast("boolean"))), F.lit(False)),
    "all": lambda c, r, o: F.coalesce(r(F.bool_and(c.cast("boolean"))), F.lit(True)),
    "first": lambda c, r, o: r(F.min_by(c, F.when(c.isNotNull(), F.struct(*_ordered(o))))),
    "last": lambda c, r, o: r(F.max_by(c, F.when(c.isNotNull(), F.struct(*_ordered(o))))),
    "idxmin": lambda c, r, o: r(F.min_by(F.col(_ordered(o)[0]), F.when(c.isNotNull(), F.struct(c, *o)))),
    "idxmax": lambda c, r, o, kind=None: r(F.min_by(F.col(_ordered(o)[0]), F.when(c.isNotNull(), F.struct(_falling(c, kind), *o)))),
    "mode": lambda c, r, o: r(F.mode(c, deterministic=True)),
    "str_concat": lambda c, r, o: F.array_join(F.transform(F.array_sort(r(F.collect_list(F.when(c.isNotNull(), F.struct(*o, c.alias("__v")))))), lambda x: x["__v"]), ","),
}


def reduce(name: str, column: Column, order: list[str], over=None, min_count: int = 0, kind: DataType | None = None) -> Column:
    """A reduction of ``column``; its type, where given, tells whether NaN can be in it."""
    column = column if kind is None or name == "size" else sound(column, kind)
    more = {"kind": kind} if name == "idxmax" else {}
    out = REDUCTIONS[name](column, (lambda a: a) if over is None else (lambda a: a.over(over)), order, **more)
    if min_count:
        n = F.count(column) if over is None else F.count(column).over(over)
        out = F.when(n >= min_count, out)
    return out


def spec(df: DataFrame, by_column: dict[str, object] | None, named: dict[str, tuple], order: list[str]) -> list[Column]:
    """Columns ``column_how`` of {column: how or hows}, and of name=(column, how)."""
    out = []
    for c, hows in (by_column or {}).items():
        for how in [hows] if isinstance(hows, str) else hows:
            out.append(reduce(how, F.col(c), order, kind=kind_of(df, c)).alias(f"{c}_{how}"))
    for name, (c, how) in named.items():
        kind = kind_of(df, c)
        out.append((how(sound(F.col(c), kind)) if callable(how) else reduce(how, F.col(c), order, kind=kind)).alias(name))
    return out


#: A string literal, or a comparison that SQL writes in another way.
_TOKENS = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(==)|(!=)""")


def condition(text: str) -> str:
    """``==`` and ``!=`` outside of string literals as SQL writes them."""
    return _TOKENS.sub(lambda m: m[1] or ("=" if m[2] else "<>"), text)


def rank(c: Column, by: list[str], method: str, ascending: bool, pct: bool, order: list[str]) -> Column:
    """Ranks from 1; a missing value has none."""
    o = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(o)
    low = F.rank().over(w)
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    made = {
        "min": lambda: low,
        "max": lambda: low + same - 1,
        "average": lambda: low + (same - 1) / 2,
        "dense": lambda: F.dense_rank().over(w),
        "first": lambda: F.row_number().over(Window.partitionBy(*by).orderBy(o, *order)),
    }[method]()
    if pct:
        whole = Window.partitionBy(*by)
        made = made / (F.max(F.when(c.isNotNull(), F.dense_rank().over(w))).over(whole) if method == "dense" else F.count(c).over(whole))
    return F.when(c.isNotNull(), made.cast("double"))


def duplicated(df: DataFrame, subset: list[str], order: list[str], keep) -> DataFrame:
    """Adds ``duplicated``: all but the first or the last of equal rows, or with False all of them."""
    if keep is False:
        return df.withColumn("duplicated", F.count(F.lit(1)).over(Window.partitionBy(*subset)) > 1)
    ways = [F.col(o).asc() if keep == "first" else F.col(o).desc() for o in _ordered(order)]
    return df.withColumn("duplicated", F.row_number().over(Window.partitionBy(*subset).orderBy(*ways)) > 1)
