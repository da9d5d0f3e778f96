"""Dense-vector column expressions over ``array<double>``.

All built-in higher-order functions: they run on the executors' JVMs with no
Python hop. Centres enter as constants (``centers_literal``), which Catalyst
folds into one literal, so distances to every centre need no join.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def normalize(a: Column) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine_distance(a: Column, b: Column, a_norm: Column | None = None,
                    b_norm: Column | None = None) -> Column:
    """1 - cos(a, b); a zero vector has distance 1 to everything."""
    an = norm(a) if a_norm is None else a_norm
    bn = norm(b) if b_norm is None else b_norm
    return F.when((an > 0) & (bn > 0), F.lit(1.0) - dot(a, b) / (an * bn)).otherwise(F.lit(1.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, v: acc + v))


def sq_euclidean_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def weighted_sq_distance(a: Column, c: Column, w: Column) -> Column:
    """sum_i w_i (a_i - c_i)^2: the mahalanobis form for a diagonal precision, O(d)."""
    return F.aggregate(F.zip_with(F.zip_with(a, c, lambda x, y: x - y), w, lambda d, p: d * d * p),
                       F.lit(0.0), lambda acc, v: acc + v)


def distance(metric: str, x: Column, c: Column, x_norm: Column | None = None,
             c_norm: Column | None = None, vd: Column | None = None) -> Column:
    if metric == "cosine":
        return cosine_distance(x, c, x_norm, c_norm)
    if metric == "euclidean":
        return euclidean_distance(x, c)
    if metric == "sqeuclidean":
        return sq_euclidean_distance(x, c)
    if metric == "mahalanobis":
        if vd is None:
            raise ValueError("mahalanobis needs precision matrices")
        return F.sqrt(F.greatest(F.lit(0.0), weighted_sq_distance(x, c, vd)))
    raise ValueError(f"unknown metric {metric!r}")


def constant(value, ddl: str) -> Column:
    """A (possibly large) constant of type ``ddl`` from Python data.

    Built as one JSON string parsed by ``from_json``; the parse is foldable,
    so Catalyst evaluates it once while optimising and the plan carries a
    single literal instead of an expression per number.
    """
    return F.from_json(F.lit(json.dumps(value)), ddl)


CENTER_DDL = "array<struct<label:int,center:array<double>,cnorm:double>>"
CENTER_VD_DDL = "array<struct<label:int,center:array<double>,cnorm:double,vd:array<double>>>"


def is_diagonal(m) -> bool:
    return all(v == 0.0 for i, row in enumerate(m) for j, v in enumerate(row) if i != j)


def centers_literal(centers: list[tuple], precisions: dict | None = None) -> Column:
    """Constant ``array<struct<label, center, cnorm[, vd]>>`` from collected centres.

    ``centers`` is a list of ``(label, vector)``: k x d numbers, set by the model
    and not by the number of rows. ``precisions`` maps label to a diagonal
    d x d matrix (list of rows); full matrices go by ``mahalanobis_udf``.
    """
    items = []
    for label, vec in centers:
        vec = [float(v) for v in vec]
        item = {"label": int(label), "center": vec, "cnorm": math.sqrt(sum(v * v for v in vec))}
        if precisions:
            item["vd"] = [float(row[i]) for i, row in enumerate(precisions[label])]
        items.append(item)
    return constant(items, CENTER_VD_DDL if precisions else CENTER_DDL)


def rows_of(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length, without nulls, as the rows of a matrix."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors differ in length")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(size), -1 if len(size) and size[0] else 0)


def center_distances(X: np.ndarray, C: np.ndarray, metric: str) -> np.ndarray:
    """``distance`` of every row of ``X`` to every row of ``C``."""
    if metric == "cosine":
        length = np.sqrt((X * X).sum(axis=1))[:, None] * np.sqrt((C * C).sum(axis=1))
        return 1.0 - np.divide(X @ C.T, length, out=np.zeros((len(X), len(C))), where=~(length == 0))
    out = np.empty((len(X), len(C)))
    for j, c in enumerate(C):
        diff = X - c
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(out) if metric == "euclidean" else out


def nearest_rows(X: np.ndarray, centers: list[tuple], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Label and distance of the centre nearest to each row, the lowest label on ties."""
    centers = sorted(centers, key=lambda c: c[0])
    D = center_distances(X, np.array([c for _, c in centers], dtype=float), metric)
    at = D.argmin(axis=1)
    return np.array([label for label, _ in centers], dtype=np.int32)[at], D[np.arange(len(X)), at]


def mahalanobis_udf(spark: SparkSession, centers: list[tuple], precisions: dict):
    """Function of a vector column: its distances to all centres, in their order.

    The k centres and k full d x d matrices are one broadcast variable (too
    many numbers for a literal at embedding widths); each Arrow batch is
    multiplied with them in numpy. A null vector gives null.
    """
    model = spark.sparkContext.broadcast(
        [(np.array(c, dtype=float), np.array(precisions[label], dtype=float)) for label, c in centers])

    @F.pandas_udf("array<double>")
    def all_centers(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna().to_numpy())
        if len(there):
            rows = np.stack([np.asarray(v, dtype=float) for v in x.iloc[there]])
            dist = np.empty((len(rows), len(model.value)))
            for j, (c, vi) in enumerate(model.value):
                diff = rows - c
                dist[:, j] = np.sqrt(np.maximum(np.einsum("ij,ij->i", diff @ vi.T, diff), 0.0))
            for i, d in zip(there, dist):
                out[i] = d
        return out

    return all_centers


def own_mahalanobis_udf(spark: SparkSession, centers: list[tuple], precisions: dict):
    """Function of a label and a vector column: the vector's distance to that label's centre alone.

    The rows of each label in an Arrow batch are multiplied together. A null
    vector, and a label without a centre, give null.
    """
    model = spark.sparkContext.broadcast(
        {label: (np.array(c, dtype=float), np.array(precisions[label], dtype=float)) for label, c in centers})

    @F.pandas_udf("double")
    def own(labels: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        for label, at in labels[x.notna()].groupby(labels).groups.items():
            if label in model.value:
                c, vi = model.value[label]
                diff = np.stack([np.asarray(v, dtype=float) for v in x[at]]) - c
                out[at] = np.sqrt(np.maximum(np.einsum("ij,ij->i", diff @ vi.T, diff), 0.0))
        return out.astype("float64")

    return own
