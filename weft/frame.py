"""Labelled, ordered frames that compile to Spark plans.

A ``Frame`` is a Spark DataFrame with the columns that give its rows their order and
those that are its index.  Nothing runs before ``execute``, ``fetch`` or a
sink, but for row numbers and running values over all rows, which write ranges once.  A
``Series`` is one column expression over a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .functions import elementwise as E
from .functions.datetimes import Dt
from .functions.nested import Dict, List, Struct
from .functions.strings import Str
from .operators import aggregate as A
from .operators import ranges as N
from .operators import reshape as R


def _col(x) -> Column:
    return x.column if isinstance(x, Series) else x if isinstance(x, Column) else F.lit(x)


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


class Series:
    """One column over a frame."""

    def __init__(self, frame: Frame, column: Column, name: str) -> None:
        self.frame, self.column, self.name = frame, column, name

    def _new(self, column: Column) -> Series:
        return Series(self.frame, column, self.name)

    @property
    def _kind(self): return A.kind_of(self.frame.df, self.column)

    @property
    def _sound(self) -> Column:
        """The column without NaN, which counts as missing."""
        return A.sound(self.column, self._kind)

    def _compare(self, o, how: str) -> Series:
        return self._new(E.compare(self._sound, how, o._sound if isinstance(o, Series) else _col(o)))

    def rename(self, name: str) -> Series: return Series(self.frame, self.column, name)
    def to_frame(self, name: str | None = None) -> Frame: return self.frame._with(self.frame.df.select(*self.frame._keys(), self.column.alias(name or self.name)))

    # arithmetic: missing if a side is, unless a fill is named
    def _binary(self, other, op: Callable, fill=None, flip: bool = False) -> Series:
        a, b = self.column, _col(other)
        if fill is not None:
            both = a.isNull() & b.isNull()
            a, b = (F.when(~both, F.coalesce(x, F.lit(fill))) for x in (a, b))
        return self._new(op(b, a) if flip else op(a, b))

    def add(self, o, fill_value=None): return self._binary(o, lambda a, b: a + b, fill_value)
    def sub(self, o, fill_value=None): return self._binary(o, lambda a, b: a - b, fill_value)
    def mul(self, o, fill_value=None): return self._binary(o, lambda a, b: a * b, fill_value)
    def truediv(self, o, fill_value=None): return self._binary(o, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), fill_value)
    def floordiv(self, o, fill_value=None): return self._binary(o, E.floordiv, fill_value)
    def mod(self, o, fill_value=None): return self._binary(o, E.mod, fill_value)
    def pow(self, o, fill_value=None): return self._binary(o, F.pow, fill_value)
    def radd(self, o): return self._binary(o, lambda a, b: a + b, flip=True)
    def rsub(self, o): return self._binary(o, lambda a, b: a - b, flip=True)
    def rmul(self, o): return self._binary(o, lambda a, b: a * b, flip=True)
    def rtruediv(self, o): return self._binary(o, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), flip=True)
    def rfloordiv(self, o): return self._binary(o, E.floordiv, flip=True)
    def rmod(self, o): return self._binary(o, E.mod, flip=True)
    def rpow(self, o): return self._binary(o, F.pow, flip=True)
    div, rdiv, subtract, multiply, divide = truediv, rtruediv, sub, mul, truediv
    rsubtract, rmultiply, rdivide, power, rpower = rsub, rmul, rtruediv, pow, rpow
    __add__, __sub__, __mul__, __truediv__, __floordiv__, __mod__, __pow__ = add, sub, mul, truediv, floordiv, mod, pow
    __radd__, __rsub__, __rmul__, __rtruediv__, __rfloordiv__, __rmod__, __rpow__ = radd, rsub, rmul, rtruediv, rfloordiv, rmod, rpow

    def eq(self, o): return self._compare(o, "eq")
    def ne(self, o): return self._compare(o, "ne")
    def lt(self, o): return self._compare(o, "lt")
    def le(self, o): return self._compare(o, "le")
    def gt(self, o): return self._compare(o, "gt")
    def ge(self, o): return self._compare(o, "ge")
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge
    __hash__ = None

    def _bits(self, o, op: str) -> Series:
        a, b = self.column, _col(o)
        whole = dict(self.frame.df.select(self.column.alias("x")).dtypes)["x"] != "boolean"
        if op == "xor":
            return self._new(a.bitwiseXOR(b) if whole else a != b)
        if op == "and":
            return self._new(a.bitwiseAND(b) if whole else a & b)
        return self._new(a.bitwiseOR(b) if whole else a | b)

    def __and__(self, o): return self._bits(o, "and")
    def __or__(self, o): return self._bits(o, "or")
    def __xor__(self, o): return self._bits(o, "xor")
    bitand, bitor, bitxor = __and__, __or__, __xor__
    rbitand, rbitor, rbitxor = __and__, __or__, __xor__
    def __invert__(self): return self._new(~self.column if dict(self.frame.df.select(self.column.alias("x")).dtypes)["x"] == "boolean" else F.bitwise_not(self.column))
    def __neg__(self): return self._new(-self.column)
    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def abs(self): return self._new(F.abs(self.column))
    def round(self, decimals: int = 0): return self._new(F.bround(self.column, decimals))
    def between(self, low, high, inclusive="both"): return self._new(E.between(self.column, low, high, inclusive))
    def isin(self, values): return self._new(F.coalesce(self.column.isin(list(values)), F.lit(False)))
    def isna(self): return self._new(self._sound.isNull())
    def notna(self): return self._new(self._sound.isNotNull())
    isnull, notnull = isna, notna
    def fillna(self, value): return self._new(F.coalesce(self._sound, _col(value)))
    def clip(self, lower=None, upper=None): return self._new(E.clip(self.column, lower, upper))
    def where(self, condition, other=None): return self._new(F.when(_col(condition), self.column).otherwise(_col(other)))
    def mask(self, condition, other=None): return self._new(F.when(_col(condition), _col(other)).otherwise(self.column))
    def case_when(self, pairs): return self._new(E.case_when([(_col(c), _col(v)) for c, v in pairs], self.column))
    def cut(self, bins, labels=None, right=True, include_lowest=False): return self._new(E.cut(self.column, bins, labels, right, include_lowest))
    def replace(self, mapping: dict): return self._new(E.replace(self.column, mapping))
    def astype(self, kind: str, errors: str = "raise"): return self._new(self.column.cast(kind) if errors == "raise" else self.column.try_cast(kind))
    def to_numeric(self, errors: str = "raise"): return self.astype("double", errors)

    def map(self, arg, na_action=None):
        """By a dict (what it lacks becomes missing), or by a function of a column."""
        if isinstance(arg, dict):
            return self._new(E.replace(F.lit(None), {}) if not arg else F.try_element_at(F.create_map(*[F.lit(x) for kv in arg.items() for x in kv]), self.column))
        return self._new(arg(self.column))

    apply = map

    # windows over the whole frame as expressions: one ordered sequence, so one task; the frame's own methods take many
    def _over(self, make: Callable[[Window], Column]) -> Series: return self._new(make(self.frame._window()))
    def shift(self, n: int = 1, fill=None): return self._over(lambda w: F.lag(self.column, n, fill).over(w))
    def diff(self, n: int = 1): return self._over(lambda w: self.column - F.lag(self.column, n).over(w))
    def pct_change(self, n: int = 1): return self._over(lambda w: F.try_divide(self.column, F.lag(self.column, n).over(w)) - 1)
    def _running(self, f: Callable):
        c = self._sound
        return self._over(lambda w: F.when(c.isNotNull(), f(c).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    def cumsum(self): return self._running(F.sum)
    def cummax(self): return self._running(F.max)
    def cummin(self): return self._running(F.min)
    def cumprod(self): return self._running(F.product)
    def cumcount(self): return self._over(lambda w: F.row_number().over(w) - 1)
    def ffill(self): return self._over(lambda w: F.last(self._sound, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    def bfill(self): return self._new(F.last(self._sound, True).over(self.frame._window(back=True).rowsBetween(Window.unboundedPreceding, 0)))
    def rank(self, method="average", ascending=True, pct=False): return self._new(A.rank(self._sound, [], method, ascending, pct, self.frame.order))
    def rolling(self, window: int, min_periods: int | None = None, center: bool = False) -> Moving: return Moving(self, window, window if min_periods is None else min_periods, center)
    def expanding(self, min_periods: int = 1) -> Moving: return Moving(self, None, min_periods, False)

    @property
    def str(self): return Accessor(self, Str)

    @property
    def dt(self): return Accessor(self, Dt)

    @property
    def dict(self): return Accessor(self, Dict)

    @property
    def list(self): return Accessor(self, List)

    @property
    def struct(self): return Accessor(self, Struct)

    # reductions: a frame of one row, or of a few
    def agg(self, *how: str) -> Frame:
        return Frame(self.frame.df.agg(*[A.reduce(h, self.column, self.frame.order, kind=self._kind).alias(h) for h in how]))

    def __getattr__(self, name: str):
        if name in A.REDUCTIONS:
            return lambda **kw: Frame(self.frame.df.agg(A.reduce(name, self.column, self.frame.order, kind=self._kind, **kw).alias(self.name)))
        raise AttributeError(name)

    def quantile(self, q=0.5) -> Frame:
        qs = q if isinstance(q, (list, tuple)) else [q]
        return Frame(N.quantiles(self.frame.df, self._sound, list(qs)).select("q", F.col("value").alias(self.name)), ["q"])

    def value_counts(self, normalize=False, dropna=True) -> Frame:
        df = self.frame.df.select(self._sound.alias(self.name))
        if dropna:
            df = df.where(F.col(self.name).isNotNull())
        counted = df.groupBy(self.name).agg(F.count("*").alias("count"))
        if normalize:
            total = df.agg(F.count("*").alias("__n"))
            counted = counted.join(F.broadcast(total)).select(self.name, (F.col("count") / F.col("__n")).alias("proportion"))
        return Frame(counted, [self.name])

    def unique(self) -> Frame: return Frame(self.frame.df.select(self._sound.alias(self.name)).distinct(), [self.name])
    def mode(self) -> Frame:
        counted = self.value_counts().df
        return Frame(counted.join(F.broadcast(counted.agg(F.max("count").alias("count"))), "count").select(self.name), [self.name])

    def is_unique(self) -> Frame: return Frame(self.frame.df.agg((F.count_distinct(self._sound) + F.count_if(self._sound.isNull()).cast("bigint") == F.count("*")).alias("is_unique")))

    def is_monotonic(self, decreasing=False) -> Frame:
        rows = self.frame.df.select(*self.frame.order, self._sound.alias("__x"))
        made = N.near(rows, A._ordered(self.frame.order), 1, 0, {"__y": lambda w: F.lag("__x").over(w)})
        bad = F.col("__x") > F.col("__y") if decreasing else F.col("__x") < F.col("__y")
        return Frame(made.agg((F.count_if(bad) == 0).alias("is_monotonic")))

    def is_monotonic_increasing(self) -> Frame: return self.is_monotonic()
    def is_monotonic_decreasing(self) -> Frame: return self.is_monotonic(True)
    def hasnans(self) -> Frame: return Frame(self.frame.df.agg(F.coalesce(F.bool_or(self._sound.isNull()), F.lit(False)).alias("hasnans")))
    def dot(self, other: Series) -> Frame: return Frame(self.frame.df.agg(F.sum(self._sound * other._sound).alias("dot")))
    rdot = dot
    def tshift(self, n: int, unit: str = "day") -> Series:
        """Times moved by ``n`` units; no row changes its place."""
        return self._new(self.column + F.make_dt_interval(**{f"{unit}s" if unit != "minute" else "mins": F.lit(n).cast("double") if unit == "second" else F.lit(n)}))

    def memory_usage(self) -> Frame: return self.frame.memory_usage([self.name])
    def to_tensor(self):
        """A vector by the frame's first order column."""
        from .operators.tensor import from_column

        return from_column(self.frame.df.withColumn("__t", self.column), A._ordered(self.frame.order)[0], "__t")

    def nlargest(self, n: int) -> Frame: return self.to_frame().nlargest(n, self.name)
    def nsmallest(self, n: int) -> Frame: return self.to_frame().nsmallest(n, self.name)
    def describe(self) -> Frame: return self.agg("count", "mean", "std", "min", "q25", "median", "q75", "max")
    def autocorr(self, lag: int = 1) -> Frame: return Frame(N.near(self.frame.df.select(*self.frame.order, self._sound.alias("__x")), A._ordered(self.frame.order), lag, 0, {"__y": lambda w: F.lag("__x", lag).over(w)}).agg(F.corr("__x", "__y").alias(self.name)))


class Accessor:
    """Methods of a column accessor give series; numbers of arguments are the accessor's own."""

    def __init__(self, series: Series, kind: type) -> None:
        self._series, self._of = series, kind(series.column)

    def __getattr__(self, name: str):
        made = getattr(self._of, name)
        return lambda *a, **kw: self._series._new(made(*[_col(x) if isinstance(x, Series) else x for x in a], **kw))

    def __getitem__(self, key):
        return self._series._new(self._of[key])


class Moving:
    """Rolling (a number of rows) or expanding windows, over the frame or within groups."""

    def __init__(self, series: Series, rows: int | None, least: int, center: bool, by: Sequence[str] = ()) -> None:
        w = series.frame._window(by)
        ahead = (rows - 1) // 2 if center and rows else 0
        self.w = w.rowsBetween(Window.unboundedPreceding if rows is None else -(rows - 1 - ahead), ahead)
        self.series, self.least = series, least

    def _make(self, f: Callable[[Column], Column]) -> Series:
        c = self.series._sound
        return self.series._new(F.when(F.count(c).over(self.w) >= self.least, f(c).over(self.w)))

    def sum(self): return self._make(F.sum)
    def mean(self): return self._make(F.avg)
    def min(self): return self._make(F.min)
    def max(self): return self._make(F.max)
    def std(self): return self._make(F.stddev_samp)
    def var(self): return self._make(F.var_samp)
    def count(self): return self.series._new(F.count(self.series._sound).over(self.w))
    def median(self): return self._make(lambda c: F.percentile(c, 0.5))
    def quantile(self, q): return self._make(lambda c: F.percentile(c, q))
    def sem(self): return self._make(lambda c: F.stddev_samp(c)) / self.series._new(F.sqrt(F.count(self.series._sound).over(self.w)))
    def agg(self, name: str): return getattr(self, name)()


class Frame:
    """Rows with columns, an order and perhaps an index."""

    def __init__(self, df: DataFrame, order: Sequence[str] = (), index: Sequence[str] = ()) -> None:
        self.df, self.order, self.index = df, list(order), list(index)

    def _with(self, df: DataFrame) -> Frame: return Frame(df, [o for o in self.order if o in df.columns], [i for i in self.index if i in df.columns])
    def _keys(self) -> list[str]: return list(dict.fromkeys([*self.index, *self.order]))
    def _window(self, by: Sequence[str] = (), back: bool = False):
        if not self.order:
            raise ValueError("this needs an order of rows: Frame(df, order=[...])")
        return Window.partitionBy(*by).orderBy(*[F.col(o).desc() for o in self.order] if back else self.order)

    @property
    def columns(self) -> list[str]: return self.df.columns

    @property
    def dtypes(self) -> dict[str, str]: return dict(self.df.dtypes)

    def copy(self) -> Frame: return self._with(self.df)
    def to_spark(self) -> DataFrame: return self.df
    def execute(self) -> Frame: return self._with(self.df.cache())
    def fetch(self): return (self.df.orderBy(*self.order) if self.order else self.df).toPandas()

    def __getitem__(self, key):
        if isinstance(key, str):
            return Series(self, F.col(f"`{key}`"), key)
        if isinstance(key, (Series, Column)):
            return self._with(self.df.where(_col(key)))
        return self._with(self.df.select(*dict.fromkeys([*key])))

    def __getattr__(self, name: str):
        if name.startswith("_") or name in ("df", "order", "index") or name not in self.df.columns:
            raise AttributeError(name)
        return self[name]

    # projection
    def assign(self, **columns) -> Frame: return self._with(self.df.withColumns({k: _col(v(self) if callable(v) and not isinstance(v, (Series, Column)) else v) for k, v in columns.items()}))
    def insert(self, at: int, name: str, value) -> Frame:
        left, right = self.columns[:at], self.columns[at:]
        return self._with(self.df.select(*left, _col(value).alias(name), *right))

    def drop(self, columns) -> Frame: return self._with(self.df.drop(*_names(columns)))
    def pop(self, name: str) -> tuple[Series, Frame]: return self[name], self.drop(name)
    def rename(self, columns: dict[str, str]) -> Frame: return Frame(self.df.withColumnsRenamed(columns), [columns.get(o, o) for o in self.order], [columns.get(i, i) for i in self.index])
    def set_axis(self, names: list[str]) -> Frame: return self.rename(dict(zip(self.columns, names)))
    def add_prefix(self, prefix: str) -> Frame: return self.rename({c: prefix + c for c in self.columns})
    def add_suffix(self, suffix: str) -> Frame: return self.rename({c: c + suffix for c in self.columns})
    def filter(self, items=None, like=None, regex=None) -> Frame:
        import re

        return self[[c for c in self.columns if (items is not None and c in items) or (like is not None and like in c) or (regex is not None and re.search(regex, c))]]

    def select_dtypes(self, include) -> Frame: return self[[c for c, t in self.df.dtypes if t in _names(include)]]
    def reindex(self, columns: list[str], fill_value=None) -> Frame: return self._with(self.df.select(*[F.col(f"`{c}`") if c in self.columns else F.lit(fill_value).alias(c) for c in columns]))
    def reindex_like(self, other: Frame) -> Frame: return self.reindex(other.columns)
    def set_index(self, keys) -> Frame: return Frame(self.df, self.order, _names(keys))
    def reset_index(self) -> Frame: return Frame(self.df, self.order)
    def rename_axis(self, names) -> Frame: return self.rename(dict(zip(self.index, _names(names))))
    def swaplevel(self, i: int = -2, j: int = -1) -> Frame:
        index = list(self.index)
        index[i], index[j] = index[j], index[i]
        return Frame(self.df, self.order, index)

    def reorder_levels(self, order: list[int]) -> Frame: return Frame(self.df, self.order, [self.index[k] for k in order])
    def droplevel(self, level: int) -> Frame: return Frame(self.df.drop(self.index[level]), self.order, [c for k, c in enumerate(self.index) if k != level])
    def get_level_values(self, level: int) -> Series: return self[self.index[level]]
    def astype(self, kinds: dict[str, str]) -> Frame: return self._with(self.df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}))
    def applymap(self, f: Callable[[Column], Column], columns: list[str]) -> Frame: return self._with(self.df.withColumns({c: f(F.col(c)) for c in columns}))
    def eval(self, text: str) -> Frame:
        name, _, right = text.partition("=")
        return self._with(self.df.withColumn(name.strip(), F.expr(right.strip())))

    # rows
    def query(self, condition: str) -> Frame: return self._with(self.df.where(A.condition(condition)))
    def loc(self, low=None, high=None, labels=None) -> Frame:
        """Labels of the index's first level: those listed, or a slice with both ends."""
        i = F.col(self.index[0])
        df = self.df.where(i.isin(list(labels))) if labels is not None else self.df
        df = df.where(i >= F.lit(low)) if low is not None else df
        return self._with(df.where(i <= F.lit(high)) if high is not None else df)

    def xs(self, key, level: int = 0) -> Frame: return self._with(self.df.where(F.col(self.index[level]) == F.lit(key)).drop(self.index[level]))
    def truncate(self, before=None, after=None) -> Frame: return self.loc(before, after)
    def iloc(self, start: int, stop: int) -> Frame: return self._with(self.df.orderBy(*self.order).offset(start).limit(max(0, stop - start)))
    def head(self, n: int = 5) -> Frame: return self._with(self.df.orderBy(*self.order).limit(n) if self.order else self.df.limit(n))
    def tail(self, n: int = 5) -> Frame: return self._with(self.df.orderBy(*[F.col(o).desc() for o in self.order]).limit(n))
    def take(self, places: list[int]) -> Frame:
        """Rows by place; the order must tell rows apart.  Only the order's columns are numbered."""
        keys = N.row_number(self.df.select(*self.order), self.order, "__at").where(F.col("__at").isin(places)).drop("__at")
        same = [F.col(f"r.`{o}`").eqNullSafe(F.col(f"k.`{o}`")) for o in self.order]
        return self._with(self.df.alias("r").join(F.broadcast(keys).alias("k"), same, "left_semi"))

    def at(self, label, column: str): return self.df.where(F.col(self.index[0]) == F.lit(label)).select(column).first()[0]
    def iat(self, row: int, column: int): return self.iloc(row, row + 1).df.select(self.columns[column]).first()[0]
    def sample(self, frac: float, seed: int = 0) -> Frame:
        """Rows by a hash of their order (of all columns where there is none): the same rows however they are dealt."""
        return self._with(self.df.where(F.pmod(F.xxhash64(*(self.order or self.columns), F.lit(seed)), F.lit(1 << 30)) < frac * (1 << 30)))

    def with_row_number(self, name: str) -> Frame:
        """Dense numbers from 0 in the frame's order, without one task for all rows: ranges first, then places within."""
        return self._with(N.row_number(self.df, self.order, name))

    def cumulative(self, column: str, how: str, to: str) -> Frame:
        """Running sum, prod, max, min or count of a column over all rows, in many tasks."""
        return self._with(N.cumulative(self.df, self.order, A.sound_in(self.df, column), how, to))

    # windows over all rows in many tasks: columns named by the caller
    def _near(self, column: str, before: int, after: int, to: str, make: Callable) -> Frame:
        c = A.sound_in(self.df, column)
        return self._with(N.near(self.df, A._ordered(self.order), before, after, {to: lambda w: make(c, w)}))

    def shifted(self, column: str, to: str, n: int = 1) -> Frame: return self._near(column, max(n, 0), max(-n, 0), to, lambda c, w: F.lag(c, n).over(w))
    def differences(self, column: str, to: str, n: int = 1) -> Frame: return self._near(column, max(n, 0), max(-n, 0), to, lambda c, w: c - F.lag(c, n).over(w))
    def changes(self, column: str, to: str, n: int = 1) -> Frame: return self._near(column, max(n, 0), max(-n, 0), to, lambda c, w: F.try_divide(c, F.lag(c, n).over(w)) - 1)
    def filled(self, column: str, to: str, back: bool = False) -> Frame:
        """The last known value up to each row, or with ``back`` the first from it on."""
        return self._with(N.running(self.df, A._ordered(self.order), A.sound_in(self.df, column), "first" if back else "last", to, back))

    def ranked(self, column: str, to: str, method="average", ascending=True, pct=False) -> Frame: return self._with(N.rank(self.df, A.sound_in(self.df, column), method, ascending, pct, self.order, to))
    def moving(self, column: str, rows: int, how: str, to: str, min_periods: int | None = None, center: bool = False) -> Frame:
        """``how`` of the last ``rows`` rows, as ``Moving`` has it."""
        ahead, least = (rows - 1) // 2 if center else 0, rows if min_periods is None else min_periods
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "median": lambda c: F.percentile(c, 0.5)}[how]

        def make(c: Column, w) -> Column:
            w = w.rowsBetween(-(rows - 1 - ahead), ahead)
            return F.when(F.count(c).over(w) >= least, f(c).over(w))

        return self._near(column, rows - 1 - ahead, ahead, to, make)

    def growing(self, column: str, how: str, to: str, min_periods: int = 1) -> Frame:
        """sum, mean, min, max or count of all rows up to each."""
        c = A.sound_in(self.df, column)
        made = N.running(self.df, A._ordered(self.order), c, "count", "__n")
        made = N.running(made, self.order, c, "sum" if how == "mean" else how, to) if how != "count" else made.withColumn(to, F.col("__n"))
        value = F.col(to) / F.col("__n") if how == "mean" else F.col(to)
        return self._with(made.withColumn(to, F.when(F.col("__n") >= min_periods, value)).drop("__n"))

    def where(self, condition, other=None, columns=None) -> Frame: return self._with(self.df.withColumns({c: F.when(_col(condition), F.col(c)).otherwise(_col(other)) for c in columns or self.columns}))
    def mask(self, condition, other=None, columns=None) -> Frame: return self._with(self.df.withColumns({c: F.when(_col(condition), _col(other)).otherwise(F.col(c)) for c in columns or self.columns}))
    def dropna(self, how: str = "any", thresh: int | None = None, subset=None) -> Frame: return self._with(self.df.dropna(how, thresh, subset))
    def fillna(self, values) -> Frame: return self._with(self.df.fillna(values))
    def replace(self, mapping: dict, columns: list[str]) -> Frame: return self._with(self.df.withColumns({c: E.replace(F.col(c), mapping) for c in columns}))
    def isna(self, columns=None) -> Frame: return self._with(self.df.select(*self._keys(), *[A.sound_in(self.df, c).isNull().alias(c) for c in columns or self.columns if c not in self._keys()]))
    def explode(self, column: str) -> Frame: return self._with(self.df.withColumn(column, F.explode_outer(column)))
    def repeat(self, n: int) -> Frame: return self._with(self.df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("__k"))
    def duplicated(self, subset=None, keep="first") -> Frame: return self._with(A.duplicated(self.df, subset or self.columns, self.order, keep))
    def drop_duplicates(self, subset=None, keep="first") -> Frame:
        if keep == "any":
            return self._with(self.df.dropDuplicates(subset))
        return self._with(self.duplicated(subset, keep).df.where("not duplicated").drop("duplicated"))

    def sort_values(self, by, ascending=True) -> Frame:
        by = _names(by)
        ups = [ascending] * len(by) if isinstance(ascending, bool) else ascending
        return Frame(self.df.orderBy(*[F.col(b).asc_nulls_last() if u else F.col(b).desc_nulls_last() for b, u in zip(by, ups)]), by, self.index)

    def sort_index(self, ascending=True) -> Frame: return self.sort_values(self.index, ascending)
    def nlargest(self, n: int, columns) -> Frame: return self._with(self.df.orderBy(*[F.col(c).desc_nulls_last() for c in _names(columns)], *self.order).limit(n))
    def nsmallest(self, n: int, columns) -> Frame: return self._with(self.df.orderBy(*[F.col(c).asc_nulls_last() for c in _names(columns)], *self.order).limit(n))
    def first_valid_index(self, column: str) -> Frame: return Frame(self.df.where(F.col(column).isNotNull()).agg(F.min(F.struct(*self.order)).alias("k")).select("k.*"))
    def last_valid_index(self, column: str) -> Frame: return Frame(self.df.where(F.col(column).isNotNull()).agg(F.max(F.struct(*self.order)).alias("k")).select("k.*"))
    def at_time(self, column: str, time: str) -> Frame: return self._with(self.df.where(F.date_format(column, "HH:mm:ss") == time))
    def between_time(self, column: str, start: str, end: str) -> Frame: return self._with(self.df.where(F.date_format(column, "HH:mm:ss").between(start, end)))

    # kinds, sizes and rows
    def convert_dtypes(self) -> Frame: return self._with(R.convert_dtypes(self.df))
    infer_objects = convert_dtypes
    def memory_usage(self, columns=None) -> Frame:
        """(column, bytes) of the values."""
        return Frame(R.memory_usage(self.df, columns or self.columns), ["column"])

    def rechunk(self, parts: int) -> Frame: return self._with(self.df.repartition(parts))
    def iterrows(self):
        """(index values, row as a dict), one partition at a time."""
        for r in (self.df.orderBy(*self.order) if self.order else self.df).toLocalIterator():
            yield tuple(r[i] for i in self.index), r.asDict()

    def itertuples(self):
        for _, row in self.iterrows():
            yield tuple(row.values())

    def to_tensor(self, columns: list[str]):
        """Numeric columns as a matrix by the first order column."""
        from .operators.tensor import from_columns

        return from_columns(self.df, A._ordered(self.order)[0], columns)

    @staticmethod
    def from_tensor(t, names: list[str]) -> Frame:
        from .operators.tensor import to_columns

        return Frame(to_columns(t, names), ["i0"], ["i0"])

    def cut(self, column: str, bins: int, name: str = "bucket", right: bool = True) -> Frame:
        """Number, from 0, of the part of the range between least and largest that holds a value; ends belong to the outer parts."""
        return self._with(R.cut_even(self.df, column, bins, name, right))

    # combination
    def merge(self, right: Frame, on=None, how="inner", left_on=None, right_on=None, suffixes=("_x", "_y"), indicator=False, validate: str | None = None) -> Frame:
        from .operators.join import merge, unique_keys

        for side, one, keys in ((self, "1:1 1:m", on or left_on), (right, "1:1 m:1", on or right_on)):
            if validate and validate in one.split():
                unique_keys(side.df, _names(keys), validate)
        return Frame(merge(self.df, right.df, on, how, left_on, right_on, suffixes, indicator), self.order)

    def join(self, right: Frame, how="left", lsuffix="", rsuffix="") -> Frame: return self.merge(right, on=self.index, how=how, suffixes=(lsuffix, rsuffix))
    def append(self, other: Frame) -> Frame: return self._with(self.df.unionByName(other.df, allowMissingColumns=True))
    def combine_first(self, other: Frame) -> Frame:
        from .operators.join import combine_first

        return Frame(combine_first(self.df, other.df, self.index), self.order, self.index)

    def update(self, other: Frame) -> Frame:
        from .operators.join import update

        return Frame(update(self.df, other.df, self.index), self.order, self.index)

    def compare(self, other: Frame) -> Frame:
        from .operators.join import compare

        return Frame(compare(self.df, other.df, self.index), self.index, self.index)

    def align(self, other: Frame, how="outer") -> tuple[Frame, Frame]:
        from .operators.join import align

        return tuple(Frame(d, self.index, self.index) for d in align(self.df, other.df, self.index, how))

    # groups and reductions
    def groupby(self, by, dropna=True, sort=True) -> GroupBy: return GroupBy(self, _names(by), dropna, sort)
    def agg(self, spec: dict[str, object] | None = None, **named) -> Frame: return Frame(self.df.agg(*A.spec(self.df, spec, named, self.order)))
    def corr(self, columns: list[str]) -> Frame: return Frame(R.pairs(self.df, columns, F.corr, "corr"), ["a", "b"])
    def cov(self, columns: list[str]) -> Frame: return Frame(R.pairs(self.df, columns, F.covar_samp, "cov"), ["a", "b"])
    def corrwith(self, other: str, columns: list[str]) -> Frame: return Frame(self.df.agg(*[F.corr(c, other).alias(c) for c in columns]))
    def describe(self, columns: list[str]) -> Frame: return Frame(R.describe(self.df, columns), ["column"])
    def melt(self, id_vars, value_vars, var_name="variable", value_name="value") -> Frame: return Frame(self.df.unpivot(_names(id_vars), value_vars, var_name, value_name), [*_names(id_vars), var_name])
    def pivot_table(self, index, columns: str, values: str, aggfunc="mean", headings=None, margins=False) -> Frame: return Frame(R.pivot_table(self.df, _names(index), columns, values, aggfunc, headings, margins), _names(index))
    def pivot(self, index, columns: str, values: str, headings=None) -> Frame: return self.pivot_table(index, columns, values, "first", headings)
    def stack(self, columns: list[str]) -> Frame: return Frame(self.df.unpivot(self.index, columns, "level", "value").where(F.col("value").isNotNull()), [*self.index, "level"])
    def unstack(self, level: str, value: str, headings=None) -> Frame: return self.pivot_table([i for i in self.index if i != level], level, value, "first", headings)
    def get_dummies(self, column: str, values: list | None = None, prefix: str | None = None) -> Frame: return self._with(R.get_dummies(self.df, column, values, prefix))
    def factorize(self, column: str, name: str = "code") -> Frame: return self._with(R.factorize(self.df, column, name, self.order))
    def qcut(self, column: str, q: int, name: str = "bucket") -> Frame: return self._with(R.qcut(self.df, column, q, name))
    def transpose(self, by: str) -> Frame: return Frame(self.df.transpose(F.col(by)))
    def ewm(self, column: str, alpha: float | None = None, by: Sequence[str] = (), name: str = "ewm", *, com: float | None = None, span: float | None = None, halflife: float | None = None, min_periods: int = 0, adjust: bool = True, ignore_na: bool = False, how: str = "mean") -> Frame:
        """mean, var or std; decay by one of alpha, com, span and halflife."""
        from .operators.dataflow import ewm

        given = [x for x in (alpha, com, span, halflife) if x is not None]
        if len(given) != 1:
            raise ValueError("name one of alpha, com, span and halflife")
        alpha = alpha if alpha is not None else 1 / (1 + com) if com is not None else 2 / (span + 1) if span is not None else 1 - 0.5 ** (1 / halflife)
        return self._with(ewm(self.df, column, alpha, list(by), self.order, name, {"min_periods": min_periods, "adjust": adjust, "ignore_na": ignore_na}, how))

    @property
    def mf(self):
        from .operators.dataflow import Dataflow

        return Dataflow(self)


class GroupBy:
    """Groups of a frame; missing keys are left out unless asked for."""

    def __init__(self, frame: Frame, by: list[str], dropna: bool = True, sort: bool = True) -> None:
        df = frame.df
        if dropna:
            df = df.dropna(subset=by)
        self.frame, self.by, self.sort = Frame(df, frame.order, frame.index), by, sort

    def agg(self, spec: dict[str, object] | None = None, **named) -> Frame:
        out = self.frame.df.groupBy(*self.by).agg(*A.spec(self.frame.df, spec, named, self.frame.order))
        return Frame(out, self.by, self.by)

    def size(self) -> Frame: return Frame(self.frame.df.groupBy(*self.by).agg(F.count("*").alias("size")), self.by, self.by)
    def __getattr__(self, name: str):
        if name in A.REDUCTIONS:
            return lambda *columns: self.agg({c: name for c in columns}).rename({f"{c}_{name}": c for c in columns})
        raise AttributeError(name)

    def _over(self, name: str, to: str, make: Callable) -> Frame: return self.frame._with(self.frame.df.withColumn(to, make(A.sound_in(self.frame.df, name), self.frame._window(self.by))))
    def transform(self, name: str, how: str, to: str) -> Frame: return self.frame._with(self.frame.df.withColumn(to, A.reduce(how, F.col(name), self.frame.order, over=Window.partitionBy(*self.by), kind=A.kind_of(self.frame.df, name))))
    def shift(self, name: str, to: str, n: int = 1) -> Frame: return self._over(name, to, lambda c, w: F.lag(c, n).over(w))
    def diff(self, name: str, to: str, n: int = 1) -> Frame: return self._over(name, to, lambda c, w: c - F.lag(c, n).over(w))
    def _running(self, f, name, to): return self._over(name, to, lambda c, w: F.when(c.isNotNull(), f(c).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    def cumsum(self, name: str, to: str) -> Frame: return self._running(F.sum, name, to)
    def cummax(self, name: str, to: str) -> Frame: return self._running(F.max, name, to)
    def cummin(self, name: str, to: str) -> Frame: return self._running(F.min, name, to)
    def cumprod(self, name: str, to: str) -> Frame: return self._running(F.product, name, to)
    def cumcount(self, to: str = "cumcount", ascending: bool = True) -> Frame:
        order = self.frame.order if ascending else [F.col(o).desc() for o in self.frame.order]
        return self.frame._with(self.frame.df.withColumn(to, F.row_number().over(Window.partitionBy(*self.by).orderBy(*order)) - 1))

    def ffill(self, name: str, to: str) -> Frame: return self._over(name, to, lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    def bfill(self, name: str, to: str) -> Frame: return self.frame._with(self.frame.df.withColumn(to, F.last(A.sound_in(self.frame.df, name), True).over(self.frame._window(self.by, back=True).rowsBetween(Window.unboundedPreceding, 0))))
    def rank(self, name: str, to: str, method="average", ascending=True, pct=False) -> Frame: return self.frame._with(self.frame.df.withColumn(to, A.rank(A.sound_in(self.frame.df, name), self.by, method, ascending, pct, self.frame.order)))
    def head(self, n: int = 5) -> Frame: return self.frame._with(self.cumcount("__k").df.where(F.col("__k") < n).drop("__k"))
    def tail(self, n: int = 5) -> Frame: return self.frame._with(self.cumcount("__k", False).df.where(F.col("__k") < n).drop("__k"))
    def nth(self, n: int) -> Frame: return self.frame._with(self.cumcount("__k").df.where(F.col("__k") == n).drop("__k"))
    def sample(self, n: int, seed: int = 0) -> Frame:
        w = Window.partitionBy(*self.by).orderBy(F.xxhash64(*self.frame.order, F.lit(seed)))
        return self.frame._with(self.frame.df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k"))

    def rolling(self, name: str, window: int, how: str, to: str, min_periods: int | None = None) -> Frame:
        return self.frame._with(self.frame.df.withColumn(to, getattr(Moving(self.frame[name], window, window if min_periods is None else min_periods, False, self.by), how)().column))

    def rolling_time(self, name: str, at: str, seconds: float, how: str, to: str, min_periods: int = 1, closed: str = "right") -> Frame:
        """Rows of the last ``seconds`` before each; ``closed`` says which ends belong."""
        low = -int(seconds * 1_000_000)
        w = Window.partitionBy(*self.by).orderBy(F.unix_micros(F.col(at).cast("timestamp")))
        w = w.rangeBetween(low if closed in ("left", "both") else low + 1, 0 if closed in ("right", "both") else -1)
        c = A.sound_in(self.frame.df, name)
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}[how]
        return self.frame._with(self.frame.df.withColumn(to, F.when(F.count(c).over(w) >= min_periods, f(c).over(w))))

    def expanding(self, name: str, how: str, to: str, min_periods: int = 1) -> Frame:
        return self.frame._with(self.frame.df.withColumn(to, getattr(Moving(self.frame[name], None, min_periods, False, self.by), how)().column))

    def apply(self, f: Callable, schema: str) -> Frame: return Frame(self.frame.df.groupBy(*self.by).applyInPandas(f, schema), self.by)

    @property
    def mf(self):
        from .operators.dataflow import GroupFlow

        return GroupFlow(self)
