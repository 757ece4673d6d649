"""Sinks: files, tables, and values for the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F


def to_parquet(df: DataFrame, path: str, partition_cols: list[str] | None = None, compression: str = "snappy", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def to_csv(df: DataFrame, path: str, sep: str = ",", na_rep: str = "", header: bool = True, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(sep=sep, nullValue=na_rep, header=header, **options).csv(path)


def to_json(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    df.write.mode(mode).options(**options).json(path)


def to_orc(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).orc(path)


def to_table(df: DataFrame, name: str, partition: dict | None = None, partition_cols: list[str] | None = None, overwrite: bool = False) -> None:
    """A static ``partition`` becomes columns of one value."""
    for k, v in (partition or {}).items():
        df = df.withColumn(k, F.lit(v))
    by = [*(partition or {}), *(partition_cols or [])]
    writer = df.write.mode("overwrite" if overwrite else "append")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def to_lance(df: DataFrame, path: str, mode: str = "append") -> None:
    """Through the Lance connector where it is on the class path."""
    df.write.format("lance").mode(mode).save(path)


def to_list(df: DataFrame, column: str) -> Iterator:
    return (r[0] for r in df.select(column).toLocalIterator())


def to_dict(df: DataFrame, orient: str = "list") -> dict | list:
    return df.toPandas().to_dict(orient)


def to_json_text(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
