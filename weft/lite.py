"""Index-free frames of lower-cased columns: plain Spark plans with short names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .functions import elementwise as E
from .functions.datetimes import Dt
from .functions.nested import Dict, List, Struct
from .functions.strings import Str
from .operators import aggregate as A
from .operators.join import concat as _concat
from .operators.join import merge as _merge


def col(name: str) -> Column:
    return F.col(name.lower())


def _column(x) -> Column:
    return x.column if isinstance(x, Expr) else x if isinstance(x, Column) else F.lit(x)


class Expr:
    """A column that is still to be named: arithmetic, comparisons, accessors."""

    def __init__(self, column: Column | str) -> None:
        self.column = col(column) if isinstance(column, str) else column

    def __add__(self, o): return Expr(self.column + _column(o))
    def __sub__(self, o): return Expr(self.column - _column(o))
    def __mul__(self, o): return Expr(self.column * _column(o))
    def __truediv__(self, o): return Expr(F.try_divide(self.column.cast("double"), _column(o).cast("double")))
    def __floordiv__(self, o): return Expr(E.floordiv(self.column, _column(o)))
    def __mod__(self, o): return Expr(E.mod(self.column, _column(o)))
    def __pow__(self, o): return Expr(F.pow(self.column, _column(o)))
    def __radd__(self, o): return Expr(_column(o) + self.column)
    def __rsub__(self, o): return Expr(_column(o) - self.column)
    def __rmul__(self, o): return Expr(_column(o) * self.column)
    def __rtruediv__(self, o): return Expr(F.try_divide(_column(o).cast("double"), self.column.cast("double")))
    def __rfloordiv__(self, o): return Expr(E.floordiv(_column(o), self.column))
    def __rmod__(self, o): return Expr(E.mod(_column(o), self.column))
    def __rpow__(self, o): return Expr(F.pow(_column(o), self.column))
    def __eq__(self, o): return Expr(E.compare(self.column, "eq", _column(o)))
    def __ne__(self, o): return Expr(E.compare(self.column, "ne", _column(o)))
    def __lt__(self, o): return Expr(E.compare(self.column, "lt", _column(o)))
    def __le__(self, o): return Expr(E.compare(self.column, "le", _column(o)))
    def __gt__(self, o): return Expr(E.compare(self.column, "gt", _column(o)))
    def __ge__(self, o): return Expr(E.compare(self.column, "ge", _column(o)))
    __hash__ = None

    def __and__(self, o): return Expr(self.column & _column(o))
    def __or__(self, o): return Expr(self.column | _column(o))
    def __xor__(self, o): return Expr(self.column != _column(o))
    def __invert__(self): return Expr(~self.column)
    def __neg__(self): return Expr(-self.column)
    def sqrt(self): return Expr(F.when(self.column >= 0, F.sqrt(self.column)))
    def abs(self): return Expr(F.abs(self.column))
    def round(self, digits: int = 0): return Expr(F.bround(self.column, digits))
    def astype(self, kind: str): return Expr(self.column.cast(kind))
    def isin(self, values): return Expr(F.coalesce(self.column.isin(list(values)), F.lit(False)))
    def isna(self): return Expr(self.column.isNull())
    def fillna(self, value): return Expr(F.coalesce(self.column, _column(value)))
    def where(self, condition, other=None): return Expr(F.when(_column(condition), self.column).otherwise(_column(other)))
    def mask(self, condition, other=None): return Expr(F.when(_column(condition), _column(other)).otherwise(self.column))
    def alias(self, name: str) -> Column: return self.column.alias(name.lower())

    @property
    def str(self): return _Methods(Str(self.column))

    @property
    def dt(self): return _Methods(Dt(self.column))

    @property
    def dict(self): return _Methods(Dict(self.column))

    @property
    def list(self): return _Methods(List(self.column))

    @property
    def struct(self): return _Methods(Struct(self.column))


class _Methods:
    def __init__(self, of) -> None:
        self._of = of

    def __getattr__(self, name: str):
        made = getattr(self._of, name)
        return lambda *a, **kw: Expr(made(*[_column(x) if isinstance(x, Expr) else x for x in a], **kw))

    def __getitem__(self, key) -> Expr: return Expr(self._of[key])


class LiteFrame:
    def __init__(self, df: DataFrame) -> None:
        self.df = df.toDF(*[c.lower() for c in df.columns])

    @property
    def columns(self) -> list[str]: return self.df.columns
    def __getitem__(self, key):
        if isinstance(key, str):
            return Expr(key)
        return self.filter(key) if isinstance(key, (Column, Expr)) else self.select(*key)

    def __setitem__(self, name: str, value) -> None:
        self.df = self.df.withColumn(name.lower(), _column(value))

    def select(self, *columns) -> LiteFrame: return LiteFrame(self.df.select(*[c.column if isinstance(c, Expr) else c for c in columns]))
    def select_expr(self, *texts: str) -> LiteFrame: return LiteFrame(self.df.selectExpr(*texts))
    def filter(self, condition) -> LiteFrame: return LiteFrame(self.df.where(condition.column if isinstance(condition, Expr) else condition))
    def assign(self, **columns) -> LiteFrame: return LiteFrame(self.df.withColumns({k.lower(): _column(v) for k, v in columns.items()}))
    def drop(self, *columns: str) -> LiteFrame: return LiteFrame(self.df.drop(*[c.lower() for c in columns]))
    def rename(self, columns: dict[str, str]) -> LiteFrame: return LiteFrame(self.df.withColumnsRenamed({k.lower(): v for k, v in columns.items()}))
    def astype(self, kinds: dict[str, str]) -> LiteFrame: return LiteFrame(self.df.withColumns({c.lower(): col(c).cast(k) for c, k in kinds.items()}))
    def fillna(self, values) -> LiteFrame: return LiteFrame(self.df.fillna(values))
    def dropna(self, how="any", subset=None) -> LiteFrame: return LiteFrame(self.df.dropna(how, subset=subset))
    def isna(self) -> LiteFrame: return LiteFrame(self.df.select(*[A.sound_in(self.df, c).isNull().alias(c) for c in self.columns]))
    def replace(self, mapping: dict, columns: Sequence[str] | None = None) -> LiteFrame: return LiteFrame(self.df.withColumns({c: E.replace(F.col(c), mapping) for c in [x.lower() for x in columns or self.columns]}))
    def head(self, n: int = 5) -> LiteFrame: return LiteFrame(self.df.limit(n))
    def iloc(self, columns) -> LiteFrame:
        """Columns by place: a number, a slice or several numbers.  Rows have no places here."""
        names = self.columns[columns] if isinstance(columns, slice) else [self.columns[k] for k in ([columns] if isinstance(columns, int) else columns)]
        return LiteFrame(self.df.select(*names))

    def set_iloc(self, column: int, value) -> LiteFrame: return LiteFrame(self.df.withColumn(self.columns[column], _column(value)))
    def sort(self, by, ascending=True) -> LiteFrame:
        by = [by] if isinstance(by, str) else by
        ups = [ascending] * len(by) if isinstance(ascending, bool) else ascending
        return LiteFrame(self.df.orderBy(*[col(b).asc_nulls_last() if u else col(b).desc_nulls_last() for b, u in zip(by, ups)]))

    def merge(self, right: LiteFrame, on=None, how="inner", left_on=None, right_on=None, suffixes=("", "_y")) -> LiteFrame: return LiteFrame(_merge(self.df, right.df, on, how, left_on, right_on, suffixes))
    def concat(self, *others: LiteFrame, join: str = "outer") -> LiteFrame: return LiteFrame(_concat([self.df, *(o.df for o in others)], join))
    def agg(self, spec: dict) -> LiteFrame: return LiteFrame(self.df.agg(*A.spec(self.df, spec, {}, [])))
    def __getattr__(self, name: str):
        """A reduction's name: one row of it for the columns asked for, or all."""
        if name.startswith("_") or name not in A.REDUCTIONS:
            raise AttributeError(name)
        return lambda *columns: LiteFrame(self.df.agg(*[A.reduce(name, col(c), [], kind=A.kind_of(self.df, c.lower())).alias(c.lower()) for c in columns or self.columns]))

    def groupby(self, by, dropna: bool = True) -> LiteGroups: return LiteGroups(self, [by] if isinstance(by, str) else list(by), dropna)
    def to_spark(self) -> DataFrame: return self.df


class LiteGroups:
    """Columns of results are named column_how; rows come in no order."""

    def __init__(self, frame: LiteFrame, by: list[str], dropna: bool) -> None:
        self.df, self.by = frame.df.dropna(subset=by) if dropna else frame.df, by

    def agg(self, spec: dict | None = None, **named) -> LiteFrame: return LiteFrame(self.df.groupBy(*self.by).agg(*A.spec(self.df, spec, named, [])))
    def __getattr__(self, name: str):
        if name.startswith("_") or name not in A.REDUCTIONS:
            raise AttributeError(name)
        return lambda *columns: LiteFrame(self.df.groupBy(*self.by).agg(*[A.reduce(name, col(c), [], kind=A.kind_of(self.df, c.lower())).alias(c.lower()) for c in columns]))
