"""Joins with pandas' rules: missing keys match each other, clashing names get suffixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}

#: Rows of a block at most, and parts that a key's rows are dealt to before they are cut into blocks.
_BLOCK, _PARTS = 512, 8
#: Tasks that pairs of blocks are dealt to, for each core.
_TASKS = 32


def meet(left: DataFrame, right: DataFrame, condition) -> DataFrame:
    """Inner join where every task reads one part of each side again: both sides are written once however many pairs they make."""
    parts = math.isqrt(_TASKS * left.sparkSession.sparkContext.defaultParallelism - 1) + 1
    return left.repartition(parts).hint("shuffle_replicate_nl").join(right.repartition(parts), condition)


def _blocks(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list]:
    """Rows of equal keys in arrays ``name`` of bounded length beside the keys ``name_0``, ``name_1``, ...; and how to read the columns of a row."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # grouping takes some unlike values for equal: -0.0 and 0.0, strings of a collation
    own = [c for c in df.columns if c not in keys or any(w in kinds[c] for w in ("double", "float", "collate"))]
    part = F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in own if "map<" not in kinds[c]]), F.lit(_PARTS))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)] or [F.lit(0).alias("c0")])
    rows = df.groupBy(*[F.col(f"`{c}`").alias(f"{name}_{k}") for k, c in enumerate(keys)], part.alias("__part")).agg(F.collect_list(row).alias("__rows"))
    starts = F.explode(F.sequence(F.lit(1), F.size("__rows"), F.lit(_BLOCK)))
    cut = rows.withColumn("__at", starts).withColumn(name, F.slice("__rows", F.col("__at"), F.lit(_BLOCK))).drop("__part", "__rows", "__at")
    return cut, [F.col(f"{name}.c{own.index(c)}" if c in own else f"{name}_{keys.index(c)}").alias(c) for c in df.columns]


def _by_blocks(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str]) -> DataFrame:
    """Inner join where blocks of rows meet in evenly dealt tasks: a task makes the rows of one pair of blocks at a time, and no pair of blocks is written."""
    (x, x_columns), (y, y_columns) = _blocks(left, lk, "__x"), _blocks(right, rk, "__y")
    condition = F.lit(True)
    for k in range(len(lk)):
        condition &= F.col(f"__x_{k}").eqNullSafe(F.col(f"__y_{k}"))
    return meet(x, y, condition).withColumn("__x", F.explode("__x")).withColumn("__y", F.explode("__y")).select(*x_columns, *y_columns)


def merge(left: DataFrame, right: DataFrame, on=None, how="inner", left_on=None, right_on=None, suffixes=("_x", "_y"), indicator=False, many=False) -> DataFrame:
    """``many`` is for inner joins whose keys repeat often on both sides: the same rows, but the rows of a key are made in many tasks."""
    lk = [on] if isinstance(on, str) else list(on or ([left_on] if isinstance(left_on, str) else left_on or []))
    rk = lk if on is not None else ([right_on] if isinstance(right_on, str) else list(right_on or []))
    if how == "cross":
        lk = rk = []
    shared = on is not None and how != "cross"
    clash = [c for c in left.columns if c in right.columns and not (shared and c in lk)]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    if not many:
        a, b = a.withColumn("__l", F.lit(1)), b.withColumn("__r", F.lit(1))
    lk = [c + suffixes[0] if c in clash else c for c in lk]
    rk = [c + suffixes[1] if c in clash else c for c in rk]
    if how == "cross":
        return a.crossJoin(b).drop("__l", "__r")
    if shared:
        b = b.withColumnsRenamed({c: f"__k_{c}" for c in rk})
        rk = [f"__k_{c}" for c in rk]
    condition = None
    for x, y in zip(lk, rk):
        one = F.col(x).eqNullSafe(F.col(y))
        condition = one if condition is None else condition & one
    if many and (how != "inner" or not lk):
        raise ValueError("many is for inner joins on keys")
    out = _by_blocks(a, b, lk, rk) if many else a.join(b, condition, _HOW[how])
    if how in ("semi", "anti"):
        return out.drop("__l")
    if shared and how in ("right", "outer"):
        out = out.withColumns({x: F.when(F.col("__l").isNotNull(), F.col(x)).otherwise(F.col(y)) for x, y in zip(lk, rk)})
    if indicator and many:
        out = out.withColumn("_merge", F.lit("both"))
    elif indicator:
        out = out.withColumn("_merge", F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both"))
    return out.drop("__l", "__r", *([y for y in rk] if shared else []))


def unique_keys(df: DataFrame, keys: list[str], rule: str) -> None:
    """An error where two rows share their keys."""
    if not df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).isEmpty():
        raise ValueError(f"keys {keys} repeat, against validate={rule!r}")


def concat(frames: list[DataFrame], join: str = "outer") -> DataFrame:
    """Rows of all, by column name; with ``inner`` only the columns that all have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(common) if join == "inner" else frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.select(common) if join == "inner" else f, allowMissingColumns=True)
    return out


def _pair(left: DataFrame, right: DataFrame, index: list[str], how: str) -> tuple[DataFrame, list[str], list[str]]:
    mine = [c for c in left.columns if c not in index]
    theirs = [c for c in right.columns if c not in index]
    return left.join(right.withColumnsRenamed({c: f"__o_{c}" for c in theirs}), index, how), mine, theirs


def combine_first(left: DataFrame, right: DataFrame, index: list[str]) -> DataFrame:
    both, mine, theirs = _pair(left, right, index, "full")
    cols = [F.coalesce(c, f"__o_{c}").alias(c) if c in theirs else F.col(c) for c in mine] + [F.col(f"__o_{c}").alias(c) for c in theirs if c not in mine]
    return both.select(*index, *cols)


def combine(left: DataFrame, right: DataFrame, index: list[str], f, fill=None) -> DataFrame:
    """``f`` of both sides' columns of a name, after filling what is missing."""
    both, mine, theirs = _pair(left, right, index, "full")
    fix = lambda c: F.coalesce(F.col(c), F.lit(fill)) if fill is not None else F.col(c)
    return both.select(*index, *[f(fix(c), fix(f"__o_{c}")).alias(c) for c in mine if c in theirs])


def update(left: DataFrame, right: DataFrame, index: list[str]) -> DataFrame:
    both, mine, theirs = _pair(left, right, index, "left")
    return both.select(*index, *[F.coalesce(f"__o_{c}", c).alias(c) if c in theirs else F.col(c) for c in mine])


def compare(left: DataFrame, right: DataFrame, index: list[str]) -> DataFrame:
    """Rows that differ: ``c_self`` and ``c_other`` where a column differs, else missing."""
    both, mine, theirs = _pair(left, right, index, "inner")
    cols = [c for c in mine if c in theirs]
    differs = {c: ~F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in cols}
    any_ = None
    for d in differs.values():
        any_ = d if any_ is None else any_ | d
    return both.where(any_).select(*index, *[x for c in cols for x in (F.when(differs[c], F.col(c)).alias(f"{c}_self"), F.when(differs[c], F.col(f"__o_{c}")).alias(f"{c}_other"))])


def align(left: DataFrame, right: DataFrame, index: list[str], how: str = "outer") -> tuple[DataFrame, DataFrame]:
    keys = left.select(index).join(right.select(index), index, _HOW[how]).distinct()
    return keys.join(left, index, "left"), keys.join(right, index, "left")
