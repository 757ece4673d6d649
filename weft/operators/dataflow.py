"""User code over batches and groups, and the flow operators around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters of text that a mapper or combiner gets at once, about, where no number of rows is given.
TEXT = 1 << 20


class Dataflow:
    """``frame.mf``: operators that run user code, with declared schemas."""

    def __init__(self, frame) -> None:
        self.frame = frame

    def _new(self, df: DataFrame):
        return self.frame._with(df)

    def apply_chunk(self, f: Callable, schema: str, batch_rows: int | None = None):
        """``f`` of each batch of rows as a pandas frame."""
        def run(batches):
            for b in batches:
                for k in range(0, len(b), batch_rows or max(1, len(b))):
                    yield f(b.iloc[k : k + batch_rows] if batch_rows else b)

        return self._new(self.frame.df.mapInPandas(run, schema))

    def flatmap(self, f: Callable, schema: str):
        """``f`` of each row, as a dict, yields any number of rows."""
        def run(batches):
            for b in batches:
                rows = [r for row in b.to_dict("records") for r in f(row)]
                if rows:
                    yield pd.DataFrame(rows)

        return self._new(self.frame.df.mapInPandas(run, schema))

    def map_reduce(self, mapper: Callable | None, reducer: Callable, group_cols: list[str], schema: str, mapped: str | None = None, *, combiner: Callable | None = None, order_cols: list[str] = (), ascending=True, batch_rows: int | None = None, whole_groups: bool = False):
        """``mapper`` of batches, then ``reducer`` of the rows of each group in order.

        A mapper or a combiner is a function of a pandas frame, or a class whose instance is
        called with batches and ``end``; what a combiner gives has the mapper's schema and is
        made before rows are dealt, so a hot group shrinks where it is.  A reducer is called
        for each group, in batches of ``batch_rows`` where that is given; with
        ``whole_groups`` once for many groups, each whole, standing one after the other.
        """
        df = self.frame.df
        if mapper:
            df = df.mapInPandas(lambda batches: _stream(mapper, batches, batch_rows), mapped)
        if combiner:
            df = df.mapInPandas(lambda batches: _stream(combiner, batches, None), df.schema)
        return self._new(_by_group(df, reducer, group_cols, schema, order_cols, ascending, batch_rows, whole_groups))

    def cartesian_chunk(self, right, f: Callable, schema: str, blocks: int = 8):
        """``f`` of every pair of a block of rows of each side; blocks are dealt by hash."""
        a, b = self.frame.df, right.df
        left = a.withColumn("__i", F.pmod(F.xxhash64(*a.columns), F.lit(blocks))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        other = b.withColumn("__j", F.pmod(F.xxhash64(*b.columns), F.lit(blocks))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["__i", "__j"]
        made = left.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(lambda x, y: f(x.drop(columns=keys), y.drop(columns=keys)), schema)
        return self._new(made)

    def reshuffle(self, group_by: list[str] | None = None, sort_by: list[str] | None = None):
        if sort_by and not group_by:
            raise ValueError("sort_by needs group_by")
        df = self.frame.df.repartition(*group_by) if group_by else self.frame.df.repartition(F.rand(7))
        return self._new(df.sortWithinPartitions(*group_by, *sort_by) if sort_by else df)

    def rebalance(self, factor: float | None = None, num_partitions: int | None = None):
        if (factor is None) == (num_partitions is None):
            raise ValueError("name either factor or num_partitions")
        n = num_partitions or max(1, round(factor * self.frame.df.rdd.getNumPartitions()))
        return self._new(self.frame.df.repartition(n))

    def collect_kv(self, columns: list[str], item: str = ",", pair: str = "=", name: str = "kv"):
        from ..functions.nested import collect_kv

        return self._new(self.frame.df.withColumn(name, collect_kv({c: F.col(c) for c in columns}, item, pair)))

    def extract_kv(self, column: str, keys: list[str], item: str = ",", pair: str = "="):
        from ..functions.nested import extract_kv

        return self._new(self.frame.df.select("*", *extract_kv(F.col(column), keys, item, pair)))

    def flatjson(self, column: str, paths: dict[str, str], kinds: dict[str, str] | None = None):
        from ..functions.nested import flatjson

        return self._new(self.frame.df.select("*", *flatjson(F.col(column), paths, kinds)))


class GroupFlow:
    """``frame.groupby(...).mf``: user code over the rows of groups."""

    def __init__(self, groups) -> None:
        self.groups = groups

    def apply_chunk(self, f: Callable, schema: str, batch_rows: int | None = None, *, order_cols: list[str] = (), ascending=True):
        """``f`` (a function, or a class whose instance is called with batches and ``end``) of each group's rows in order."""
        return self.groups.frame._with(_by_group(self.groups.frame.df, f, self.groups.by, schema, order_cols, ascending, batch_rows, False))


def _calls(f: Callable) -> Callable:
    """A function of (batch, whether it is the last): of a class by an instance of its own, closed after the last."""
    if not isinstance(f, type):
        return lambda batch, end: f(batch)
    made = f()

    def call(batch: pd.DataFrame, end: bool):
        out = made(batch, end=end)
        if end and hasattr(made, "close"):
            made.close()
        return out

    return call


def _pieces(b: pd.DataFrame, rows: int | None) -> Iterator[pd.DataFrame]:
    """A batch in pieces of ``rows``, or else of about ``TEXT`` characters; a longer row comes alone."""
    if rows:
        cuts = list(range(0, len(b), rows))
    else:
        size = np.zeros(len(b), dtype=np.int64)
        for k in np.flatnonzero(b.dtypes == object):
            size += np.fromiter((len(v) if isinstance(v, (str, bytes)) else 0 for v in b.iloc[:, k]), np.int64, len(b))
        total, cuts = np.cumsum(size), [0] if len(b) else []
        while cuts and total[-1] - (total[cuts[-1] - 1] if cuts[-1] else 0) > TEXT:
            end = max(cuts[-1] + 1, int(np.searchsorted(total, (total[cuts[-1] - 1] if cuts[-1] else 0) + TEXT, "right")))
            if end >= len(b):
                break
            cuts.append(end)
    for i, j in zip(cuts, [*cuts[1:], len(b)]):
        yield b.iloc[i:j] if (i, j) != (0, len(b)) else b


def _stream(f: Callable, batches: Iterator[pd.DataFrame], rows: int | None) -> Iterator[pd.DataFrame]:
    """``f`` over a partition's batches; the last one is known only when the next doesn't come."""
    call, held = _calls(f), None
    for b in batches:
        for piece in _pieces(b, rows):
            if held is not None and (out := call(held, False)) is not None:
                yield out
            held = piece
    if held is not None and (out := call(held, True)) is not None:
        yield out


def _runs(b: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where rows begin whose keys differ from the row's before; missing keys are equal."""
    before = b[keys].shift()
    new = ((b[keys] != before) & ~(b[keys].isna() & before.isna())).any(axis=1).to_numpy()
    new[:1] = True
    return new.nonzero()[0].tolist()


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(whether a group begins, rows of one group) of sorted batches."""
    last = None
    for b in batches:
        if not len(b):
            continue
        cuts = _runs(b, keys)
        for k, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(b)])):
            part = b.iloc[i:j]
            yield last is None or k > 0 or len(_runs(pd.concat([last, part.iloc[:1]]), keys)) > 1, part
        last = b.iloc[-1:]


def _by_group(df: DataFrame, f: Callable, keys: list[str], schema: str, order: list[str], ascending, rows: int | None, whole: bool) -> DataFrame:
    """Rows dealt by ``keys`` and sorted, groups handed on without a job or a task for each."""
    keys = list(keys)
    ups = [ascending] * len(order) if isinstance(ascending, bool) else list(ascending)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc() if up else F.col(c).desc() for c, up in zip(order, ups)])

    def each(batches):
        group: list[pd.DataFrame] = []
        call = None
        for begins, part in _groups(batches, keys):
            if begins:
                if group and (out := call(group.pop(), True)) is not None:
                    yield out
                call = _calls(f)
            if rows is None:  # a function of the whole group
                group[:] = [pd.concat([*group, part])]
                continue
            for k in range(0, len(part), rows):
                if group and (out := call(group.pop(), False)) is not None:
                    yield out
                group.append(part.iloc[k : k + rows])
        if group and (out := call(group.pop(), True)) is not None:
            yield out

    def many(batches):
        held: list[pd.DataFrame] = []  # the group that may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            cut = _runs(b, keys)[-1]
            if cut or len(held) > 1 and len(_runs(pd.concat([held[-2].iloc[-1:], b.iloc[:1]]), keys)) > 1:
                yield f(pd.concat([*held[:-1], b.iloc[:cut]]))
                held = [b.iloc[cut:]]
        if held:
            yield f(pd.concat(held))

    return dealt.mapInPandas(many if whole else each, schema)


def ewm(df: DataFrame, column: str, alpha: float, by: list[str], order: list[str], name: str, options: dict | None = None, how: str = "mean") -> DataFrame:
    """Exponentially weighted mean, var or std; a missing value keeps the last one and ages it.

    A group's rows go through one task in order, a pandas frame for each group.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(**{name: getattr(group[column].ewm(alpha=alpha, **(options or {})), how)()})

    schema = StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, DoubleType())])
    return df.groupBy(*by).applyInPandas(run, schema)
