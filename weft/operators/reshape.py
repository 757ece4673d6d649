"""Reshaping, ranges of row numbers and tables of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .aggregate import kind_of, reduce, sound_in
from .ranges import quantiles, row_number


def pairs(df: DataFrame, columns: list[str], f, name: str) -> DataFrame:
    """(a, b, value) of every pair of columns, one pass over the rows."""
    made = df.agg(*[f(sound_in(df, a), sound_in(df, b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias(name)) for i, a in enumerate(columns) for j, b in enumerate(columns)])
    return made.select(F.explode(rows).alias("r")).select("r.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles from counts of values in order, each column in its turn; all else in one pass."""
    hows = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    some = [h for h in hows if h not in ("q25", "median", "q75")]
    made = df.agg(*[reduce(h, F.col(c), [], kind=kind_of(df, c)).cast("double").alias(f"{c}__{h}") for c in columns for h in some])
    for c in columns:
        q = quantiles(df, sound_in(df, c), [0.25, 0.5, 0.75])
        made = made.join(F.broadcast(q.agg(*[F.max(F.when(F.col("q") == x, F.col("value"))).alias(f"{c}__{h}") for x, h in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{h}").alias(h) for h in hows]) for c in columns])
    return made.select(F.explode(rows).alias("r")).select("r.*")


def pivot_table(df: DataFrame, index: list[str], columns: str, values: str, how: str, headings: list | None, margins: bool) -> DataFrame:
    """Without ``headings`` a job finds the distinct ones first."""
    how_of = (lambda c: F.first(c, True)) if how == "first" else (lambda c: reduce(how, c, [], kind=kind_of(df, values)))
    made = df.groupBy(*index).pivot(columns, headings).agg(how_of(F.col(values)))
    if margins:
        made = made.join(df.groupBy(*index).agg(how_of(F.col(values)).alias("All")), index)
    return made


def crosstab(df: DataFrame, row: str, column: str, headings: list | None = None) -> DataFrame:
    return df.groupBy(row).pivot(column, headings).agg(F.count(F.lit(1))).fillna(0)


def get_dummies(df: DataFrame, column: str, values: list | None, prefix: str | None) -> DataFrame:
    """A column of 0 and 1 for each value; without ``values`` a job finds the distinct ones."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values}).drop(column)


def factorize(df: DataFrame, column: str, name: str, order: list[str]) -> DataFrame:
    """Codes by first appearance in the order, -1 for missing.  Numbers distinct values, not rows."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__at"))
    codes = row_number(firsts, ["__at"], name).drop("__at")
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def qcut(df: DataFrame, column: str, q: int, name: str) -> DataFrame:
    """Number, from 0, of the quantile bucket, right-closed with the least value included."""
    edges = quantiles(df, sound_in(df, column), [k / q for k in range(q + 1)]).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"]).alias("__e"))
    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(q - 1)), F.lit(0), lambda n, k: n + F.when(F.col(column) > F.get("__e", k), 1).otherwise(0))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), bucket)).drop("__e")


def cut_even(df: DataFrame, column: str, bins: int, name: str, right: bool) -> DataFrame:
    """Bins of one width, found by one pass, so that a value on an edge falls as ``right`` says."""
    c = sound_in(df, column).cast("double")
    ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.ceil((c - F.col("__lo")) / width) - 1 if right else F.floor((c - F.col("__lo")) / width)
    made = F.when(width == 0, F.lit(bins // 2)).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)))
    return df.join(F.broadcast(ends)).withColumn(name, F.when(c.isNotNull(), made.cast("int"))).drop("__lo", "__hi")


def convert_dtypes(df: DataFrame) -> DataFrame:
    """Strings that all read as whole numbers, numbers, truth values or times become such; doubles without fractions become whole. One pass decides."""
    kinds = ["bigint", "double", "boolean", "timestamp"]
    strings = [c for c, t in df.dtypes if t == "string"]
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    if not strings and not floats:
        return df
    tests = [F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast(k).isNotNull() | F.col(f"`{c}`").isNull()), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(strings) for k in kinds]
    known = [(F.count(f"`{c}`") > 0).alias(f"{i}_known") for i, c in enumerate(strings)]
    whole = [F.coalesce(F.bool_and(sound_in(df, c) == F.floor(sound_in(df, c))), F.lit(False)).alias(f"f{i}") for i, c in enumerate(floats)]
    got = df.agg(*tests, *known, *whole).first()
    made = {c: F.col(f"`{c}`").cast(next(k for k in kinds if got[f"{i}_{k}"])) for i, c in enumerate(strings) if got[f"{i}_known"] and any(got[f"{i}_{k}"] for k in kinds)}
    made |= {c: sound_in(df, c).cast("bigint") for i, c in enumerate(floats) if got[f"f{i}"]}
    return df.withColumns(made)


def memory_usage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, bytes): of strings and bytes what they hold, of others the width of their type for each row."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
    kinds = dict(df.dtypes)

    def size(c: str):
        if kinds[c] in ("string", "binary"):
            return F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)).cast("bigint")
        if kinds[c].startswith("array"):
            return (F.coalesce(F.sum(F.size(f"`{c}`")), F.lit(0)) * widths.get(kinds[c][6:-1], 8)).cast("bigint")
        return F.count("*") * widths.get(kinds[c], 8)

    made = df.agg(*[size(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("bytes")) for k, c in enumerate(columns)])).alias("r")).select("r.*")
