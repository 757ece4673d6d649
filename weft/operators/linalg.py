"""Dense linear algebra on tall tables: sums over rows on the cluster, small square work on the driver.

A table of n rows of d numbers has a d x d Gram matrix, whatever n; d is checked
against ``MOST``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .tensor import Tensor

#: Most columns whose Gram matrix the driver takes.
MOST = 4096


def gram(t: Tensor, d: int) -> np.ndarray:
    if d > MOST:
        raise ValueError(f"more than {MOST} columns")
    out = np.zeros((d, d))
    for r in t.transpose().matmul(t).df.toLocalIterator():
        out[r.i0, r.i1] = r.v
    return out


def column_means(t: Tensor, d: int) -> np.ndarray:
    out = np.zeros(d)
    for r in t.reduce("mean", 0).df.toLocalIterator():
        out[r.i0] = r.v
    return out


def _rows_times(df: DataFrame, vector: str, m: np.ndarray, to: str) -> DataFrame:
    """Each row's vector times a small matrix, in one expression."""
    cols = []
    for j in range(m.shape[1]):
        w = F.array(*[F.lit(float(x)) for x in m[:, j]])
        cols.append(F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x))
    return df.withColumn(to, F.array(*cols))


def svd_values(t: Tensor, d: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.linalg.eigvalsh(gram(t, d))[::-1], 0))


def svd(df: DataFrame, row: str, vector: str, d: int, k: int, to: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with their part of U, singular values, V) of the first ``k``; each V column's largest entry is positive."""
    values, vectors = np.linalg.eigh(gram(Tensor.from_vectors(df, row, vector), d))
    s, v = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return _rows_times(df, vector, v / np.where(s > 0, s, 1), to), s, v


def qr(df: DataFrame, row: str, vector: str, d: int, to: str = "q") -> tuple[DataFrame, np.ndarray]:
    """(rows with their part of Q, R) by Cholesky of the Gram matrix; R's diagonal is positive."""
    r = np.linalg.cholesky(gram(Tensor.from_vectors(df, row, vector), d)).T
    return _rows_times(df, vector, np.linalg.inv(r), to), r


def pca(df: DataFrame, row: str, vector: str, d: int, k: int, to: str = "pc") -> tuple[DataFrame, np.ndarray]:
    """(rows with their components, share of variance of each)."""
    t = Tensor.from_vectors(df, row, vector)
    n, mean = df.count(), column_means(t, d)
    cov = (gram(t, d) - n * np.outer(mean, mean)) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    centred = df.withColumn("__c", F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a.cast("double") - b))
    return _rows_times(centred, "__c", v, to).drop("__c"), values[::-1][:k] / values.sum()


def lstsq(df: DataFrame, row: str, vector: str, target: str, d: int) -> np.ndarray:
    t = Tensor.from_vectors(df, row, vector)
    right = np.zeros(d)
    y = Tensor(df.select(F.col(row).alias("i0"), F.col(target).cast("double").alias("v")), 1)
    for r in t.transpose().matmul(y).df.toLocalIterator():
        right[r.i0] = r.v
    return np.linalg.lstsq(gram(t, d), right, rcond=None)[0]


def einsum(spec: str, *tensors: Tensor) -> Tensor:
    """Letters shared by operands are joined on; those not in the output are summed over."""
    inputs, out = spec.replace(" ", "").split("->")
    df, seen = None, []
    for letters, t in zip(inputs.split(","), tensors):
        own = t.df.select(*[F.col(f"i{k}").alias(c) for k, c in enumerate(letters)], F.col("v").alias("w"))
        if df is None:
            df, seen = own.withColumnRenamed("w", "v"), list(letters)
        else:
            shared = [c for c in letters if c in seen]
            df = (df.join(own, shared) if shared else df.crossJoin(own)).withColumn("v", F.col("v") * F.col("w")).drop("w")
            seen += [c for c in letters if c not in seen]
    made = df.groupBy(*out).agg(F.sum("v").alias("v")) if out else df.agg(F.sum("v").alias("v"))
    return Tensor(made.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(out)], "v"), len(out))


def outer(a: Tensor, b: Tensor) -> Tensor:
    """Of two vectors; as large as its result, so meant for short ones."""
    return einsum("i,j->ij", a, b)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray: return np.linalg.solve(a, b)
def inv(a: np.ndarray) -> np.ndarray: return np.linalg.inv(a)
def cholesky(a: np.ndarray) -> np.ndarray: return np.linalg.cholesky(a)


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) with partial pivots."""
    u, n = a.astype(float).copy(), len(a)
    l_, p = np.eye(n), np.eye(n)
    for k in range(n):
        r = k + int(np.abs(u[k:, k]).argmax())
        u[[k, r]], p[[k, r]] = u[[r, k]], p[[r, k]]
        l_[[k, r], :k] = l_[[r, k], :k]
        if u[k, k]:
            f = u[k + 1 :, k] / u[k, k]
            l_[k + 1 :, k] = f
            u[k + 1 :] -= f[:, None] * u[k]
    return p.T, l_, u


def row_fft(vector: Column, kind: str = "fft") -> Column:
    """Interleaved real and imaginary parts of a row's transform, through Arrow batches."""
    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        made = [getattr(np.fft, kind)(np.asarray(r, float)) for r in rows]
        return pd.Series([np.stack([m.real, m.imag], 1).ravel().tolist() for m in made])

    return run(vector)
