"""Arrays of numbers in coordinate form, and rows of vectors.

A tensor is a frame of coordinates i0, i1, ... and a value v.  Element-wise work is
column work; reductions group by the axes that stay; contractions are joins on the
axes that go.  What is missing in a sparse tensor is zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_REDUCE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "prod": F.product, "var": F.var_pop, "std": F.stddev_pop, "count": F.count, "any": lambda v: F.bool_or(v != 0), "all": lambda v: F.bool_and(v != 0), "count_nonzero": lambda v: F.sum((v != 0).cast("bigint")), "median": lambda v: F.percentile(v, 0.5), "ptp": lambda v: F.max(v) - F.min(v)}


class Tensor:
    def __init__(self, df: DataFrame, ndim: int) -> None:
        self.df, self.ndim = df, ndim

    @property
    def axes(self) -> list[str]: return [f"i{k}" for k in range(self.ndim)]

    @classmethod
    def from_vectors(cls, df: DataFrame, row: str, vector: str) -> Tensor: return cls(df.select(F.col(row).alias("i0"), F.posexplode(vector).alias("i1", "v")).withColumn("v", F.col("v").cast("double")), 2)

    @classmethod
    def arange(cls, spark: SparkSession, n: int) -> Tensor: return cls(spark.range(n).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("v")), 1)

    @classmethod
    def full(cls, spark: SparkSession, shape: tuple[int, ...], value: float) -> Tensor:
        df = spark.range(shape[0]).select(F.col("id").alias("i0"))
        for k, n in enumerate(shape[1:], 1):
            df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return cls(df.withColumn("v", F.lit(float(value))), len(shape))

    @classmethod
    def eye(cls, spark: SparkSession, n: int) -> Tensor: return cls(spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), 2)

    @classmethod
    def linspace(cls, spark: SparkSession, low: float, high: float, n: int) -> Tensor: return cls(spark.range(n).select(F.col("id").alias("i0"), (F.lit(low) + F.col("id") * ((high - low) / max(1, n - 1))).alias("v")), 1)

    def map(self, f: Callable[[Column], Column]) -> Tensor: return Tensor(self.df.withColumn("v", f(F.col("v"))), self.ndim)

    def zip(self, other: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
        """Of equal shapes; where one has no value it is zero."""
        j = self.df.join(other.df.withColumnRenamed("v", "w"), self.axes, "full")
        return Tensor(j.select(*self.axes, f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).alias("v")), self.ndim)

    def __add__(self, o): return self.zip(o, lambda a, b: a + b) if isinstance(o, Tensor) else self.map(lambda v: v + o)
    def __sub__(self, o): return self.zip(o, lambda a, b: a - b) if isinstance(o, Tensor) else self.map(lambda v: v - o)
    def __mul__(self, o): return self.zip(o, lambda a, b: a * b) if isinstance(o, Tensor) else self.map(lambda v: v * o)
    def __truediv__(self, o): return self.zip(o, F.try_divide) if isinstance(o, Tensor) else self.map(lambda v: v / o)

    def reduce(self, how: str, axis: int | None = None) -> Tensor:
        stay = [a for k, a in enumerate(self.axes) if axis is not None and k != axis]
        made = _REDUCE[how](F.col("v")).cast("double").alias("v")
        df = self.df.groupBy(*stay).agg(made) if stay else self.df.agg(made)
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def arg(self, how: str, axis: int) -> Tensor:
        stay = [a for k, a in enumerate(self.axes) if k != axis]
        key = F.struct(F.col("v") if how == "min" else -F.col("v"), F.col(f"i{axis}"))
        df = self.df.groupBy(*stay).agg(F.min_by(F.col(f"i{axis}"), key).cast("double").alias("v"))
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def cum(self, how: str, axis: int) -> Tensor:
        w = Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis]).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
        return Tensor(self.df.withColumn("v", _REDUCE[how]("v").over(w)), self.ndim)

    def diff(self, axis: int) -> Tensor:
        w = Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis]).orderBy(f"i{axis}")
        df = self.df.withColumn("v", F.col("v") - F.lag("v").over(w)).where("v is not null").withColumn(f"i{axis}", F.col(f"i{axis}") - 1)
        return Tensor(df, self.ndim)

    def transpose(self, order: list[int] | None = None) -> Tensor:
        order = order or list(range(self.ndim))[::-1]
        return Tensor(self.df.select(*[F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)], "v"), self.ndim)

    def flip(self, axis: int, size: int) -> Tensor: return Tensor(self.df.withColumn(f"i{axis}", F.lit(size - 1) - F.col(f"i{axis}")), self.ndim)
    def roll(self, axis: int, by: int, size: int) -> Tensor: return Tensor(self.df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + by, F.lit(size))), self.ndim)
    def slice(self, axis: int, start: int, stop: int, step: int = 1) -> Tensor:
        a = F.col(f"i{axis}")
        return Tensor(self.df.where((a >= start) & (a < stop) & ((a - start) % step == 0)).withColumn(f"i{axis}", F.floor((a - start) / step)), self.ndim)

    def reshape(self, old: tuple[int, ...], new: tuple[int, ...]) -> Tensor:
        flat = F.lit(0).cast("bigint")
        for k, n in enumerate(old):
            flat = flat * n + F.col(f"i{k}")
        df = self.df.withColumn("__f", flat)
        rest, cols = F.col("__f"), []
        for k in range(len(new) - 1, -1, -1):
            cols.append(F.pmod(rest, F.lit(new[k])).alias(f"i{k}"))
            rest = F.floor(rest / new[k])
        return Tensor(df.select(*cols[::-1], "v"), len(new))

    def concat(self, other: Tensor, axis: int, size: int) -> Tensor: return Tensor(self.df.unionByName(other.df.withColumn(f"i{axis}", F.col(f"i{axis}") + size)), self.ndim)
    def where(self, f: Callable[[Column], Column], other: float = 0.0) -> Tensor: return self.map(lambda v: F.when(f(v), v).otherwise(F.lit(other)))
    def nonzero(self) -> DataFrame: return self.df.where("v <> 0").select(*self.axes)
    def unique(self) -> DataFrame: return self.df.groupBy("v").agg(F.count("*").alias("n"))
    def diag(self) -> Tensor: return Tensor(self.df.where("i0 = i1").select("i0", "v"), 1)
    def trace(self) -> Tensor: return self.diag().reduce("sum")
    def tril(self) -> Tensor: return Tensor(self.df.where("i0 >= i1"), 2)
    def triu(self) -> Tensor: return Tensor(self.df.where("i0 <= i1"), 2)

    def matmul(self, other: Tensor) -> Tensor:
        """Contraction of the last axis with the other's first: a join and a sum with partial sums."""
        last = f"i{self.ndim - 1}"
        left = self.df.withColumnRenamed(last, "__k")
        right = other.df.select(F.col("i0").alias("__k"), *[F.col(a).alias(f"j{k}") for k, a in enumerate(other.axes[1:])], F.col("v").alias("w"))
        stay = [*[a for a in self.axes if a != last], *[f"j{k}" for k in range(other.ndim - 1)]]
        df = left.join(right, "__k").groupBy(*stay).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def expand_dims(self, axis: int) -> Tensor:
        df = self.df.select(*[F.col(f"i{k}").alias(f"i{k + (k >= axis)}") for k in range(self.ndim)], F.lit(0).alias(f"i{axis}"), "v")
        return Tensor(df.select(*[f"i{k}" for k in range(self.ndim + 1)], "v"), self.ndim + 1)

    def squeeze(self, axis: int) -> Tensor: return Tensor(self.df.select(*[F.col(a).alias(f"i{k - (k > axis)}") for k, a in enumerate(self.axes) if k != axis], "v"), self.ndim - 1)
    def swapaxes(self, a: int, b: int) -> Tensor:
        order = list(range(self.ndim))
        order[a], order[b] = b, a
        return self.transpose(order)

    def moveaxis(self, source: int, to: int) -> Tensor:
        order = [k for k in range(self.ndim) if k != source]
        order.insert(to, source)
        return self.transpose(order)

    def ravel(self, shape: tuple[int, ...]) -> Tensor:
        size = 1
        for n in shape:
            size *= n
        return self.reshape(shape, (size,))

    def repeat(self, n: int, axis: int) -> Tensor: return Tensor(self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(f"i{axis}", F.col(f"i{axis}") * n + F.col("__k")).drop("__k"), self.ndim)
    def tile(self, n: int, axis: int, size: int) -> Tensor: return Tensor(self.df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("__k") * size).drop("__k"), self.ndim)
    def delete(self, places: list[int], axis: int) -> Tensor:
        a = F.col(f"i{axis}")
        before = F.lit(0)
        for p in places:
            before = before + (a > p).cast("int")
        return Tensor(self.df.where(~a.isin(places)).withColumn(f"i{axis}", a - before), self.ndim)

    def take(self, places: list[int], axis: int) -> Tensor:
        """In the order of ``places``, which may repeat."""
        where = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for k, p in enumerate(places)])
        df = self.df.withColumn("__t", F.explode(F.filter(where, lambda x: x["p"] == F.col(f"i{axis}")))).withColumn(f"i{axis}", F.col("__t.k")).drop("__t")
        return Tensor(df, self.ndim)

    def compress(self, keep: list[bool], axis: int) -> Tensor: return self.take([k for k, x in enumerate(keep) if x], axis)
    def split(self, sections: int, axis: int, size: int) -> list[Tensor]:
        step = size // sections
        return [self.slice(axis, k * step, (k + 1) * step) for k in range(sections)]

    @staticmethod
    def stack(tensors: list[Tensor], axis: int = 0) -> Tensor:
        out = None
        for k, t in enumerate(tensors):
            one = t.expand_dims(axis).df.withColumn(f"i{axis}", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return Tensor(out, tensors[0].ndim + 1)

    def sort(self, axis: int = -1) -> Tensor:
        axis %= self.ndim
        w = Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis]).orderBy("v")
        return Tensor(self.df.withColumn(f"i{axis}", F.row_number().over(w) - 1), self.ndim)

    def argsort(self, axis: int = -1) -> Tensor:
        axis %= self.ndim
        w = Window.partitionBy(*[a for k, a in enumerate(self.axes) if k != axis]).orderBy("v", f"i{axis}")
        made = self.df.withColumn("__r", F.row_number().over(w) - 1)
        return Tensor(made.select(*[F.col("__r").alias(a) if k == axis else F.col(a) for k, a in enumerate(self.axes)], F.col(f"i{axis}").cast("double").alias("v")), self.ndim)

    partition, argpartition = sort, argsort
    def topk(self, k: int, axis: int = -1) -> Tensor:
        """The largest of each line, largest first."""
        axis %= self.ndim
        w = Window.partitionBy(*[a for j, a in enumerate(self.axes) if j != axis]).orderBy(F.desc("v"), f"i{axis}")
        return Tensor(self.df.withColumn("__r", F.row_number().over(w) - 1).where(F.col("__r") < k).withColumn(f"i{axis}", F.col("__r")).drop("__r"), self.ndim)

    def percentile(self, q: float, axis: int | None = None) -> Tensor:
        stay = [a for k, a in enumerate(self.axes) if axis is not None and k != axis]
        df = self.df.groupBy(*stay).agg(F.percentile("v", q / 100).alias("v"))
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def average(self, weights: Tensor, axis: int) -> Tensor:
        """``weights`` is a vector along the axis."""
        w = weights.df.select(F.col("i0").alias(f"i{axis}"), F.col("v").alias("w"))
        stay = [a for k, a in enumerate(self.axes) if k != axis]
        df = self.df.join(w, f"i{axis}").groupBy(*stay).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def cov(self) -> Tensor:
        """Of columns of a matrix without gaps."""
        b = self.df.select("i0", F.col("i1").alias("j"), F.col("v").alias("w"))
        return Tensor(self.df.join(b, "i0").groupBy("i1", "j").agg(F.covar_samp("v", "w").alias("v")).select(F.col("i1").alias("i0"), F.col("j").alias("i1"), "v"), 2)

    def corrcoef(self) -> Tensor:
        b = self.df.select("i0", F.col("i1").alias("j"), F.col("v").alias("w"))
        return Tensor(self.df.join(b, "i0").groupBy("i1", "j").agg(F.corr("v", "w").alias("v")).select(F.col("i1").alias("i0"), F.col("j").alias("i1"), "v"), 2)

    def trapezoid(self, axis: int = -1, dx: float = 1.0) -> Tensor:
        axis %= self.ndim
        stay = [a for k, a in enumerate(self.axes) if k != axis]
        w = Window.partitionBy(*stay).orderBy(f"i{axis}")
        df = self.df.withColumn("v", (F.col("v") + F.lag("v").over(w)) * (dx / 2)).groupBy(*stay).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
        return Tensor(df.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(stay)], "v"), len(stay))

    def isin(self, values: list[float]) -> Tensor: return self.map(lambda v: v.isin(values).cast("double"))
    def flatnonzero(self, shape: tuple[int, ...]) -> DataFrame: return self.ravel(shape).df.where("v <> 0").select("i0")
    def fill_diagonal(self, value: float) -> Tensor: return Tensor(self.df.withColumn("v", F.when(F.col("i0") == F.col("i1"), F.lit(float(value))).otherwise(F.col("v"))), self.ndim)
    def diagflat(self) -> Tensor: return Tensor(self.df.select("i0", F.col("i0").alias("i1"), "v"), 2)
    def allclose(self, other: Tensor, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
        return self.zip(other, lambda a, b: (F.abs(a - b) <= atol + rtol * F.abs(b)).cast("double")).df.agg((F.min("v") == 1).alias("allclose"))

    def array_equal(self, other: Tensor) -> DataFrame: return self.allclose(other, 0.0, 0.0).withColumnRenamed("allclose", "array_equal")
    def setdiff1d(self, other: Tensor) -> DataFrame: return self.df.select("v").distinct().join(other.df.select("v").distinct(), "v", "left_anti")
    def inner(self, other: Tensor) -> Tensor: return self.matmul(other.transpose())
    def vdot(self, other: Tensor) -> Tensor: return self.zip(other, lambda a, b: a * b).reduce("sum")

    def norm(self) -> Tensor: return Tensor(self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v")), 0)


# ---- made from shapes
def zeros(spark: SparkSession, shape: tuple[int, ...]) -> Tensor: return Tensor.full(spark, shape, 0.0)
def ones(spark: SparkSession, shape: tuple[int, ...]) -> Tensor: return Tensor.full(spark, shape, 1.0)
def identity(spark: SparkSession, n: int) -> Tensor: return Tensor.eye(spark, n)
def full_like(t: Tensor, value: float) -> Tensor: return t.map(lambda v: F.lit(float(value)))
def zeros_like(t: Tensor) -> Tensor: return full_like(t, 0.0)
def ones_like(t: Tensor) -> Tensor: return full_like(t, 1.0)
def scalar(spark: SparkSession, value: float) -> Tensor: return Tensor(spark.range(1).select(F.lit(float(value)).alias("v")), 0)
def from_columns(df: DataFrame, row: str, columns: list[str]) -> Tensor:
    """Numeric columns of a frame as a matrix: ``row`` holds places of rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("i1"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    return Tensor(df.select(F.col(row).alias("i0"), F.explode(cells).alias("c")).select("i0", "c.i1", "c.v"), 2)


def from_column(df: DataFrame, row: str, column: str) -> Tensor: return Tensor(df.select(F.col(row).alias("i0"), F.col(column).cast("double").alias("v")), 1)
def to_columns(t: Tensor, names: list[str]) -> DataFrame:
    """A matrix as a frame: a row for each i0, a column for each name."""
    return t.df.groupBy("i0").agg(*[F.max(F.when(F.col("i1") == k, F.col("v"))).alias(n) for k, n in enumerate(names)])


def from_dense(df: DataFrame, row: str, vector: str) -> Tensor: return Tensor(Tensor.from_vectors(df, row, vector).df.where("v <> 0"), 2)
def indices(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    """The place along each axis: one more axis in front."""
    grid = Tensor.full(spark, shape, 0.0)
    return Tensor.stack([Tensor(grid.df.withColumn("v", F.col(a).cast("double")), grid.ndim) for a in grid.axes])


def meshgrid(x: Tensor, y: Tensor) -> tuple[Tensor, Tensor]:
    """Two matrices, rows by y and columns by x, of two vectors."""
    both = x.df.select(F.col("i0").alias("i1"), F.col("v").alias("x")).crossJoin(y.df.select("i0", F.col("v").alias("y")))
    return Tensor(both.select("i0", "i1", F.col("x").alias("v")), 2), Tensor(both.select("i0", "i1", F.col("y").alias("v")), 2)


# ---- joined, split, with other axes
def atleast(t: Tensor, ndim: int) -> Tensor:
    """Axes of one place are added: in front up to two axes, the third behind."""
    while t.ndim < min(ndim, 2):
        t = t.expand_dims(0)
    return t.expand_dims(2) if t.ndim < ndim else t


def _joined(tensors: list[Tensor], axis: int, sizes: list[int]) -> Tensor:
    out, at = tensors[0], 0
    for t, n in zip(tensors[1:], sizes):
        at += n
        out = out.concat(t, axis, at)
    return out


def vstack(tensors: list[Tensor], sizes: list[int]) -> Tensor: return _joined([atleast(t, 2) for t in tensors], 0, sizes)
def hstack(tensors: list[Tensor], sizes: list[int]) -> Tensor: return _joined(tensors, 0 if tensors[0].ndim == 1 else 1, sizes)
def dstack(tensors: list[Tensor], sizes: list[int]) -> Tensor: return _joined([atleast(t, 3) for t in tensors], 2, sizes)
def column_stack(vectors: list[Tensor]) -> Tensor: return Tensor.stack(vectors, 1)
def array_split(t: Tensor, sections: int, axis: int, size: int) -> list[Tensor]:
    """The first parts are one longer where the size leaves a rest."""
    step, more = divmod(size, sections)
    cuts = [k * step + min(k, more) for k in range(sections + 1)]
    return [t.slice(axis, a, b) for a, b in zip(cuts, cuts[1:])]


def vsplit(t: Tensor, sections: int, size: int) -> list[Tensor]: return t.split(sections, 0, size)
def hsplit(t: Tensor, sections: int, size: int) -> list[Tensor]: return t.split(sections, 1 if t.ndim > 1 else 0, size)
def dsplit(t: Tensor, sections: int, size: int) -> list[Tensor]: return t.split(sections, 2, size)
def broadcast_to(t: Tensor, old: tuple[int, ...], new: tuple[int, ...]) -> Tensor:
    for _ in range(len(new) - len(old)):
        t, old = t.expand_dims(0), (1, *old)
    for k, (a, b) in enumerate(zip(old, new)):
        if a != b:
            if a != 1:
                raise ValueError(f"{old} does not broadcast to {new}")
            t = t.tile(b, k, 1)
    return t


def flipud(t: Tensor, rows: int) -> Tensor: return t.flip(0, rows)
def fliplr(t: Tensor, columns: int) -> Tensor: return t.flip(1, columns)
def rollaxis(t: Tensor, axis: int, start: int = 0) -> Tensor: return t.moveaxis(axis, start - (start > axis))
def flatten(t: Tensor, shape: tuple[int, ...]) -> Tensor: return t.ravel(shape)
def ediff1d(t: Tensor) -> Tensor: return t.diff(0)
def argwhere(t: Tensor) -> DataFrame: return t.nonzero()
def in1d(t: Tensor, values: list[float]) -> Tensor: return t.isin(values)
def shape(t: Tensor) -> DataFrame: return t.df.agg(*[(F.max(a) + 1).cast("bigint").alias(a) for a in t.axes])
def copyto(to: Tensor, source: Tensor, where: Callable[[Column], Column]) -> Tensor: return to.zip(source, lambda a, b: F.when(where(b), b).otherwise(a))
def choose(t: Tensor, choices: list[Tensor]) -> Tensor:
    """Where ``t`` is k, the value of the k-th choice."""
    out = t.df.withColumnRenamed("v", "__k")
    for k, c in enumerate(choices):
        out = out.join(c.df.withColumnRenamed("v", f"__{k}"), t.axes, "left")
    value = F.element_at(F.array(*[F.coalesce(f"__{k}", F.lit(0.0)) for k in range(len(choices))]), F.col("__k").cast("int") + 1)
    return Tensor(out.select(*t.axes, value.alias("v")), t.ndim)


def unravel_index(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    out, rest = [], flat.cast("bigint")
    for n in shape[::-1]:
        out.append(F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    return out[::-1]


# ---- NaN left out
def nan_reduce(t: Tensor, how: str, axis: int | None = None) -> Tensor: return Tensor(t.df.where("not isnan(v)"), t.ndim).reduce(how, axis)
def nan_arg(t: Tensor, how: str, axis: int) -> Tensor: return Tensor(t.df.where("not isnan(v)"), t.ndim).arg(how, axis)
def nan_cum(t: Tensor, how: str, axis: int) -> Tensor:
    """A NaN counts as what changes nothing."""
    return t.map(lambda v: F.when(F.isnan(v), F.lit({"sum": 0.0, "prod": 1.0}[how])).otherwise(v)).cum(how, axis)


# ---- contractions and distances
def tensordot(a: Tensor, b: Tensor, axes: tuple[list[int], list[int]]) -> Tensor:
    """Contraction of pairs of axes: one join, and a sum with partial sums."""
    left = a.df.select(*[F.col(x).alias(f"__k{axes[0].index(k)}" if k in axes[0] else f"__a{k}") for k, x in enumerate(a.axes)], "v")
    right = b.df.select(*[F.col(x).alias(f"__k{axes[1].index(k)}" if k in axes[1] else f"__b{k}") for k, x in enumerate(b.axes)], F.col("v").alias("w"))
    stay = [c for c in (*left.columns, *right.columns) if c[:3] in ("__a", "__b")]
    df = left.join(right, [f"__k{k}" for k in range(len(axes[0]))]).groupBy(*stay).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Tensor(df.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(stay)], "v"), len(stay))


def vector_norm(t: Tensor, order: float = 2, axis: int | None = None) -> Tensor:
    if order == float("inf"):
        return t.map(F.abs).reduce("max", axis)
    return t.map(lambda v: F.pow(F.abs(v), F.lit(float(order)))).reduce("sum", axis).map(lambda v: F.pow(v, F.lit(1.0 / order)))


def matrix_norm(t: Tensor, order="fro") -> Tensor:
    """fro, or the largest sum of absolute values of a column (1) or a row (inf)."""
    if order == "fro":
        return t.norm()
    return t.map(F.abs).reduce("sum", 0 if order == 1 else 1).reduce("max")


def cdist(a: Tensor, b: Tensor, metric: str = "euclidean") -> Tensor:
    """Distances of rows: the smaller matrix meets the other along columns, so no row travels whole."""
    right = b.df.select(F.col("i0").alias("__j"), "i1", F.col("v").alias("w"))
    gap = {"euclidean": F.pow(F.col("v") - F.col("w"), F.lit(2.0)), "sqeuclidean": F.pow(F.col("v") - F.col("w"), F.lit(2.0)), "cityblock": F.abs(F.col("v") - F.col("w"))}[metric]
    made = F.sqrt(F.sum(gap)) if metric == "euclidean" else F.sum(gap)
    df = a.df.join(right, "i1").groupBy("i0", "__j").agg(made.alias("v"))
    return Tensor(df.select("i0", F.col("__j").alias("i1"), "v"), 2)


def pdist(t: Tensor, n: int, metric: str = "euclidean") -> Tensor:
    """Distances of pairs of the ``n`` rows, in the order of rows: a vector."""
    i, j = F.col("i0").cast("bigint"), F.col("i1").cast("bigint")
    place = i * n - F.floor(i * (i + 1) / 2) + j - i - 1
    return Tensor(cdist(t, t, metric).df.where("i0 < i1").select(place.alias("i0"), "v"), 1)


def squareform(t: Tensor, n: int) -> Tensor:
    """The symmetric matrix of a vector of pairs; its diagonal is zero, so it has no cells."""
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("i"), (k * n - F.floor(k * (k + 1) / 2)).alias("b"))))
    starts = t.df.sparkSession.range(1).select(pairs.alias("p")).select("p.i", F.col("p.b").alias("b"))
    hit = (F.col("i0") >= F.col("b")) & (F.col("i0") < F.col("b") + (n - 1) - F.col("i"))
    cells = t.df.join(F.broadcast(starts), hit).select(F.col("i").cast("bigint").alias("x"), (F.col("i0") - F.col("b") + F.col("i") + 1).cast("bigint").alias("y"), "v")
    return Tensor(cells.select(F.explode(F.array(F.struct(F.col("x").alias("i0"), F.col("y").alias("i1")), F.struct(F.col("y").alias("i0"), F.col("x").alias("i1")))).alias("c"), "v").select("c.i0", "c.i1", "v"), 2)


# ---- Fourier transforms along an axis, numpy's of whole lines
def _turned(re: np.ndarray, im: np.ndarray, sign: int, norm: float) -> np.ndarray:
    """Sums of (re + i im) times cosines and sines of each frequency, for a line whose values aren't all finite."""
    n = len(re)
    out = np.empty(n, complex)
    with np.errstate(invalid="ignore"):
        for f in range(n):
            t = np.arange(n) * f % n * (2 * math.pi / n)
            out[f] = complex((re * np.cos(t) - sign * im * np.sin(t)).sum() * norm, (sign * re * np.sin(t) + im * np.cos(t)).sum() * norm)
    return out


def fft(t: Tensor, axis: int, size: int, inverse: bool = False, imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    """(real, imaginary) parts of the transform along an axis of ``size`` places.

    A line's cells come together and one task transforms it; parts that one transform made need no join.
    """
    a = f"i{axis}"
    made = getattr(t, "parts", None)
    if imag is None:
        both = t.df.withColumnRenamed("v", "re").withColumn("im", F.lit(0.0))
    elif made is not None and made is getattr(imag, "parts", None) and (t.part, imag.part) == ("re", "im"):
        both = made.fillna(0.0, ["re", "im"])
    else:
        both = t.df.withColumnRenamed("v", "re").join(imag.df.withColumnRenamed("v", "im"), t.axes, "full").fillna(0.0, ["re", "im"])
    stay = [c for c in t.axes if c != a]
    cell = F.struct(F.col(a).cast("bigint").alias("i"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    lines = both.groupBy(*stay).agg(F.collect_list(cell).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n, cells = batch.num_rows, batch.column("cells")
                # where an index or a value is missing the cell adds nothing
                flat = pa.RecordBatch.from_struct_array(cells.flatten())
                line = np.repeat(np.arange(n), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
                ok = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in flat.columns])
                i, re, im = (c.to_numpy(zero_copy_only=False)[ok] for c in flat.columns)
                place = line[ok] * size + i.astype(np.int64) % size
                grid = [np.zeros(n * size) for _ in "ri"]
                for g, v in zip(grid, (re, im)):
                    np.add.at(g, place, v)
                re, im = (g.reshape(n, size) for g in grid)
                with np.errstate(invalid="ignore"):
                    out = np.fft.ifft(re + 1j * im, axis=1) if inverse else np.fft.fft(re + 1j * im, axis=1)
                for k in np.flatnonzero(~np.isfinite(re).all(1) | ~np.isfinite(im).all(1)):
                    out[k] = _turned(re[k], im[k], *((1, 1.0 / size) if inverse else (-1, 1.0)))
                none = np.repeat(np.bincount(line[ok], minlength=n) == 0, size)
                kept = [batch.column(c).take(pa.array(np.repeat(np.arange(n), size))) for c in stay]
                yield pa.record_batch([*kept, pa.array(np.tile(np.arange(size, dtype=np.int32), n)), *(pa.array(x.ravel(), mask=none) for x in (out.real, out.imag))], names=[*stay, a, "re", "im"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    made = lines.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in stay), f"{a} int, re double, im double"]))
    parts = tuple(Tensor(made.select(*t.axes, F.col(c).alias("v")), t.ndim) for c in ("re", "im"))
    for x, c in zip(parts, ("re", "im")):
        x.parts, x.part = made, c
    return parts


def ifft(re: Tensor, im: Tensor | None, axis: int, size: int) -> tuple[Tensor, Tensor]: return fft(re, axis, size, True, im)
def fftn(t: Tensor, sizes: dict[int, int], inverse: bool = False, imag: Tensor | None = None) -> tuple[Tensor, Tensor]:
    """Along several axes, {axis: size}, one after the other."""
    re, im = t, imag
    for axis, size in sizes.items():
        re, im = fft(re, axis, size, inverse, im)
    return re, im


def fft2(t: Tensor, rows: int, columns: int) -> tuple[Tensor, Tensor]: return fftn(t, {0: rows, 1: columns})
def ifft2(re: Tensor, im: Tensor | None, rows: int, columns: int) -> tuple[Tensor, Tensor]: return fftn(re, {0: rows, 1: columns}, True, im)
def ifftn(re: Tensor, im: Tensor | None, sizes: dict[int, int]) -> tuple[Tensor, Tensor]: return fftn(re, sizes, True, im)
def rfft(t: Tensor, axis: int, size: int) -> tuple[Tensor, Tensor]: return tuple(x.slice(axis, 0, size // 2 + 1) for x in fft(t, axis, size))
def rfftn(t: Tensor, sizes: dict[int, int]) -> tuple[Tensor, Tensor]:
    """The last axis named is the one that is halved."""
    axis = list(sizes)[-1]
    return tuple(x.slice(axis, 0, sizes[axis] // 2 + 1) for x in fftn(t, sizes))


def rfft2(t: Tensor, rows: int, columns: int) -> tuple[Tensor, Tensor]: return rfftn(t, {0: rows, 1: columns})
def _whole(re: Tensor, im: Tensor, axis: int, size: int) -> tuple[Tensor, Tensor]:
    """The conjugate half that a real signal's transform leaves out, for one axis."""
    a = F.col(f"i{axis}")
    again = (a > 0) & (a < size - a)
    parts = []
    for t, sign in ((re, 1.0), (im, -1.0)):
        more = t.df.where(again).withColumn(f"i{axis}", (F.lit(size) - a).cast("bigint")).withColumn("v", F.col("v") * sign)
        parts.append(Tensor(t.df.unionByName(more), t.ndim))
    return tuple(parts)


def irfft(re: Tensor, im: Tensor, axis: int, size: int) -> Tensor: return fft(*((w := _whole(re, im, axis, size))[:1]), axis, size, True, w[1])[0]
def hfft(re: Tensor, im: Tensor, axis: int, size: int) -> Tensor:
    """Of a signal with Hermitian symmetry, given by its first half: real."""
    return irfft(re, im.map(lambda v: -v), axis, size).map(lambda v: v * size)


def ihfft(t: Tensor, axis: int, size: int) -> tuple[Tensor, Tensor]:
    re, im = rfft(t, axis, size)
    return re.map(lambda v: v / size), im.map(lambda v: -v / size)


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Tensor:
    k = F.col("id")
    return Tensor(spark.range(n).select(k.alias("i0"), (F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * d)).alias("v")), 1)


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> Tensor: return Tensor(spark.range(n // 2 + 1).select(F.col("id").alias("i0"), (F.col("id") / (n * d)).alias("v")), 1)
def fftshift(t: Tensor, axis: int, size: int) -> Tensor: return t.roll(axis, size // 2, size)
def ifftshift(t: Tensor, axis: int, size: int) -> Tensor: return t.roll(axis, -(size // 2), size)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): the last bin holds its right end."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return df.where(F.col(column).between(low, high)).groupBy(k.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def bincount(df: DataFrame, column: str, weights: str | None = None) -> DataFrame:
    return df.groupBy(F.col(column).cast("bigint").alias("k")).agg((F.sum(weights) if weights else F.count("*")).alias("n"))


def searchsorted(column: Column, edges: list[float], side: str = "left") -> Column:
    return F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (e < column if side == "left" else e <= column).cast("int"))


def digitize(column: Column, bins: list[float], right: bool = False) -> Column:
    """Number of the bin, 0 below the first edge; edges rise."""
    return searchsorted(column, bins, "left" if right else "right")


def histogram_bin_edges(low: float, high: float, bins: int) -> list[float]: return [low + k * (high - low) / bins for k in range(bins + 1)]
