"""Whole-frame windows, ranks and quantiles in many tasks.

Rows are dealt by range of the order and written once with the number of their range;
what a range needs from others is a few rows at its edges, or one value of each earlier
range.  Tables of one row for each range are broadcast: as many as shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..session import cut


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by range of the order, ``__p`` the number of the range.

    Written once: two reads of a range shuffle need not draw the same bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def _numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the range ``__p`` and dense numbers from 0, (``__p``, number of the range's first row))."""
    dealt = ranged(df, order)
    local = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1)
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    return local.join(F.broadcast(starts), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__i", "__b"), starts


def row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0."""
    return _numbered(df, order, name)[0].drop("__p")


def near(df: DataFrame, order: list[str], before: int, after: int, made: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Columns of windows that reach ``before`` rows back and ``after`` ahead: each range borrows those rows."""
    rows, starts = _numbered(df, order, "__g")
    count = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    edges = starts.join(count, "__p").select(F.col("__p").alias("__q"), F.col("__b").alias("__s"), (F.col("__b") + F.col("__n")).alias("__e"))
    lent = (F.col("__p") != F.col("__q")) & (F.col("__g") >= F.col("__s") - before) & (F.col("__g") < F.col("__e") + after)
    both = rows.withColumn("__q", F.col("__p")).unionByName(rows.join(F.broadcast(edges), lent).drop("__s", "__e"))
    w = Window.partitionBy("__q").orderBy("__g")
    return both.withColumns({name: make(w) for name, make in made.items()}).where("__p = __q").drop("__p", "__q", "__g")


_CUMULATE = {
    "sum": (F.sum, lambda a, b: a + b), "prod": (F.product, lambda a, b: a * b), "max": (F.max, F.greatest), "min": (F.min, F.least), "count": (F.count, lambda a, b: a + b),
    "last": (lambda c: F.last(c, True), lambda a, b: b), "first": (lambda c: F.first(c, True), lambda a, b: b),
}


def running(df: DataFrame, order: list[str], column: Column, how: str, name: str, back: bool = False) -> DataFrame:
    """``how`` (sum, prod, max, min, count, last or first known) of all rows up to each, or with ``back`` from each on."""
    f, join = _CUMULATE[how]
    if how == ("last" if back else "first"):  # what lies farthest
        join = lambda a, b: a
    dealt = ranged(df.withColumn("__v", column), order)
    # backward from the end of the order: Spark makes each frame that ends there anew
    turned = (lambda c: F.col(c).desc()) if back else F.col
    over = _CUMULATE[{"first": "last", "last": "first"}.get(how, how) if back else how][0]
    local = dealt.withColumn("__c", over("__v").over(Window.partitionBy("__p").orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0)))
    whole = dealt.groupBy("__p").agg((F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))) if how == "last" else F.min_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))) if how == "first" else f("__v")).alias("__t"))
    more = (F.sum if how == "count" else over)("__t").over(Window.orderBy(turned("__p")).rowsBetween(Window.unboundedPreceding, -1))
    made = F.when(F.col("__b").isNull(), F.col("__c")).when(F.col("__c").isNull(), F.col("__b")).otherwise(join(F.col("__b"), F.col("__c")))
    return local.join(F.broadcast(whole.select("__p", more.alias("__b"))), "__p").withColumn(name, made).drop("__p", "__c", "__b", "__v")


def cumulative(df: DataFrame, order: list[str], column: Column, how: str, name: str) -> DataFrame:
    """``running``, missing where the row's own value is."""
    return running(df.withColumn("__o", column), order, F.col("__o"), how, name).withColumn(name, F.when(F.col("__o").isNotNull(), F.col(name))).drop("__o")


def _counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, before): how often each known value occurs, and how many rows lie below it."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, ["value"], F.col("n"), "sum", "upto").select("value", "n", (F.col("upto") - F.col("n")).alias("before"))


def rank(df: DataFrame, column: Column, method: str, ascending: bool, pct: bool, order: list[str], name: str) -> DataFrame:
    """Ranks from 1, missing where the value is; from counts of values, so only distinct values are ordered."""
    df = df.withColumn("__r", column)
    if method == "first":
        known = df.where(F.col("__r").isNotNull())
        if ascending:
            made = row_number(known, ["__r", *order], name).withColumn(name, F.col(name) + 1.0)
        else:  # places from the end of the values, ties by the order
            whole = rank(known.withColumn("__x", F.col("__r")), F.col("__x"), "max", True, False, order, "__m")
            total = F.broadcast(known.agg(F.count("*").alias("__n")))
            within = F.row_number().over(Window.partitionBy("__x").orderBy(*order)) - 1
            made = whole.join(total).withColumn(name, (F.col("__n") - F.col("__m") + 1 + within).cast("double")).drop("__m", "__n", "__x")
        out = made.unionByName(df.where(F.col("__r").isNull()).withColumn(name, F.lit(None).cast("double")), allowMissingColumns=True)
        n = F.broadcast(known.agg(F.count("*").alias("__all")))
        return (out.join(n).withColumn(name, F.col(name) / F.col("__all")).drop("__all") if pct else out).drop("__r")
    counts = _counts(df, "__r")
    if method == "dense":
        counts = row_number(counts, ["value"], "__k")
    total = counts.agg(F.sum("n").alias("__all"), F.count("*").alias("__values"))
    counts = counts.join(F.broadcast(total))
    low = F.col("before") + 1 if ascending else F.col("__all") - F.col("before") - F.col("n") + 1
    made = {"min": low, "max": low + F.col("n") - 1, "average": low + (F.col("n") - 1) / 2}.get(method)
    if method == "dense":
        made = F.col("__k") + 1 if ascending else F.col("__values") - F.col("__k")
    made = made.cast("double")
    if pct:
        made = made / F.col("__values" if method == "dense" else "__all")
    return df.join(counts.select(F.col("value").alias("__r"), made.alias(name)), "__r", "left").drop("__r")


def quantiles(df: DataFrame, column: Column, qs: list[float]) -> DataFrame:
    """(q, value): exact, between neighbours by their distance; one row for each q, missing without known values."""
    counts = _counts(df.select(column.cast("double").alias("__v")), "__v")
    total = counts.agg(F.sum("n").alias("__all"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    places = total.select("__all", wanted.alias("q")).withColumn("__h", F.col("q") * (F.col("__all") - 1))
    met = counts.join(F.broadcast(places), (F.col("before") <= F.ceil("__h")) & (F.col("before") + F.col("n") > F.floor("__h")))
    low = F.max(F.when(F.col("before") <= F.floor("__h"), F.col("value")))
    high = F.max(F.when(F.col("before") <= F.ceil("__h"), F.col("value")))
    found = met.groupBy("q").agg(low.alias("__l"), high.alias("__u"), F.first("__h").alias("__h"))
    found = found.select("q", (F.col("__l") + (F.col("__u") - F.col("__l")) * (F.col("__h") - F.floor("__h"))).alias("value"))
    return places.select("q").join(F.broadcast(found), "q", "left")
