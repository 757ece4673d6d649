"""Sources: files, tables, SQL, and frames made from values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OPS = {"=": "==", "==": "==", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def predicate(filters: list) -> Column:
    """Of [(column, op, value), ...], all of which hold, or of a list of such lists, one of which does."""
    groups = filters if filters and isinstance(filters[0], list) else [filters]
    out = None
    for group in groups:
        every = F.lit(True)
        for name, op, value in group:
            c = F.col(name)
            one = c.isin(list(value)) if op == "in" else ~c.isin(list(value)) if op == "not in" else {"==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[_OPS[op]]
            every = every & one
        out = every if out is None else out | every
    return out


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(predicate(filters)) if filters else df
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None, usecols: list[str] | None = None, nrows: int | None = None, na_values: str = "", **options) -> DataFrame:
    """Without a schema, types are inferred by a pass over the files."""
    reader = spark.read.options(sep=sep, header=header, nullValue=na_values, **options)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    df = df.select(*usecols) if usecols else df
    return df.limit(nrows) if nrows is not None else df


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.options(multiLine=not lines, **options)
    return (reader.schema(schema) if schema else reader).json(path)


def read_orc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.orc(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, name: str, partitions: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    df = spark.table(name)
    for k, v in (partitions or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    return df.select(*columns) if columns else df


def read_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Frames named in braces stand for themselves."""
    return spark.sql(query, **frames)


def read_lance(spark: SparkSession, path: str, version: int | None = None, columns: list[str] | None = None, filters: str | None = None) -> DataFrame:
    """Through the Lance connector where it is on the class path."""
    reader = spark.read.format("lance")
    df = (reader.option("version", version) if version is not None else reader).load(path)
    df = df.where(filters) if filters else df
    return df.select(*columns) if columns else df


def from_pandas(spark: SparkSession, pdf, schema=None) -> DataFrame:
    return spark.createDataFrame(pdf, schema)


def from_dict(spark: SparkSession, data: dict, orient: str = "columns", columns: list[str] | None = None, schema=None) -> DataFrame:
    if orient == "columns":
        names, rows = list(data), list(zip(*data.values()))
    else:
        names, rows = ["index", *(columns or [])], [(k, *v) for k, v in data.items()]
    return spark.createDataFrame(rows, schema or names)


def from_records(spark: SparkSession, records: list, columns: list[str] | None = None, schema=None) -> DataFrame:
    return spark.createDataFrame(records, schema or columns)


def date_range(spark: SparkSession, start: str, end: str | None = None, freq: str = "1 day", periods: int | None = None, name: str = "date") -> DataFrame:
    """Times from ``start`` to ``end`` with both ends, or so many of them."""
    low = f"timestamp_ntz'{start}'"
    high = f"timestamp_ntz'{end}'" if end else f"{low} + {int(periods) - 1} * interval {freq}"
    return spark.range(1).select(F.explode(F.expr(f"sequence({low}, {high}, interval {freq})")).alias(name))
