"""Toxicity: a character n-gram classifier with naive Bayes features.

Features are the distinct 4- and 6-byte strings of a text (ASCII lower case),
hashed into ``2**BITS`` cells. Over all labelled training rows the texts of each
class that hold a cell are counted; a cell's feature value is its naive Bayes
log-count ratio (add-one smoothed). A logistic regression is trained on these
features (MLlib, which sums gradients over the cluster), and a text's score is
its probability.

Bounds, all parameters: the counts are two tables of ``2**BITS`` cells; the
classifier sees the ``FEATURES`` cells whose shares in the two classes differ
most (by z-score) and, per class, the ``SAMPLE`` training rows with the smallest
hash of the id, weighted back to the class's size.

Null texts count as empty; an empty text gets the score of no feature. Rows
without an id or a 0/1 label are not learned from. With only one class in the
training rows its share is the score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

BITS, SIZES = 20, (4, 6)
FEATURES, SAMPLE = 1024, 15_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
_SLICE = 1 << 13


def _cells(data: np.ndarray, n: int) -> np.ndarray:
    """The cell of the n bytes from each position on."""
    return ((C.gram_hashes(C._FOLD[data], n, n) >> np.uint64(64 - BITS))).astype(np.uint32)


def _counter(batches):
    counts = np.zeros((2, 1 << BITS), np.uint32)
    for b in batches:
        data, offs = C.string_buffers(pa.Table.from_batches([b])["text"])
        for i, y in enumerate(b.column("y").to_pylist()):
            row = data[offs[i]:offs[i + 1]]
            counts[y, np.unique(np.concatenate([_cells(row, n) for n in SIZES]))] += 1
    at = range(0, 1 << BITS, _SLICE)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([counts[:, i:i + _SLICE].tobytes() for i in at], pa.binary())], names=["i", "cells"])


def _sum_cells(tab: pa.Table) -> pa.Table:
    total = np.zeros(2 * _SLICE, np.uint64)
    for b in tab["cells"]:
        total += np.frombuffer(b.as_py(), np.uint32)
    return pa.table({"i": tab["i"][:1], "cells": pa.array([total.tobytes()], pa.binary())})


def ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every cell, and the chosen cells, from all rows (text, y)."""
    parts = rows.mapInArrow(_counter, "i int, cells binary").groupBy("i").applyInArrow(_sum_cells, "i int, cells binary").collect()
    count = np.zeros((2, 1 << BITS))
    for r in parts:  # a table of fixed size
        count[:, r["i"]:r["i"] + _SLICE] = np.frombuffer(r["cells"], np.uint64).reshape(2, -1)
    share = (count + 1) / (count.sum(1, keepdims=True) + (1 << BITS))
    ratio = np.log(share[1] / share[0])
    total = np.maximum(count.sum(1), 1)
    mean = count.sum(0) / total.sum()
    z = np.abs(count[1] / total[1] - count[0] / total[0]) / np.sqrt(np.maximum(mean, 1e-12) * (1 / total[0] + 1 / total[1]))
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    return ratio, np.sort(chosen[z[chosen] > 0])


def _featurise(index_of):
    def features(text: pd.Series) -> pd.Series:
        index = index_of.value
        data, offs = C.string_buffers(pa.chunked_array([pa.array(text, pa.large_string())]))
        out = []
        for a, b in zip(offs[:-1], offs[1:]):
            got = np.concatenate([index[_cells(data[a:b], n)] for n in SIZES])
            out.append(np.unique(got[got >= 0]).astype(np.int32))
        return pd.Series(out)
    return F.pandas_udf(features, "array<int>")


def train(docs: DataFrame, labels: DataFrame | None = None) -> tuple[np.ndarray, float]:
    """(weight of each cell, intercept) from ``docs`` (doc_id, text) and ``labels`` (doc_id, y), or from docs that hold y.

    Texts are shuffled once, to their labels, for the counts; the sample is
    chosen by ids and hashes alone and sent to the documents.
    """
    spark = docs.sparkSession
    C.prepare(spark)

    def labelled(rows: DataFrame) -> DataFrame:
        return (rows if labels is None else rows.join(labels.hint("merge"), "doc_id")).where("doc_id is not null and y in (0, 1)")

    hashed = docs.withColumn("h", F.xxhash64("text"))
    keys = C.keep(labelled(hashed.drop("text")).select("doc_id", "y", "h"))
    sizes = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        only = 1.0 if 1 in sizes else 0.0
        return np.zeros(1 << BITS, np.float32), float(np.log((only + 1e-6) / (1 - only + 1e-6)))
    ratio, chosen = ratios(labelled(docs).select("text", "y"))
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    top = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = C.keep(keys.withColumn("k", F.row_number().over(top)).where(F.col("k") <= SAMPLE).drop("k").distinct())
    # at most SAMPLE ids a class: a bounded broadcast, so that no text moves for it
    sample = hashed.join(F.broadcast(ids), ["doc_id", "h"] if labels is not None else ["doc_id", "h", "y"])
    weight = F.when(F.col("y") == 1, sizes[1] / min(sizes[1], SAMPLE)).otherwise(sizes[0] / min(sizes[0], SAMPLE))
    found = C.keep(sample.select(F.col("y").cast("double").alias("label"), weight.alias("w"), _featurise(spark.sparkContext.broadcast(index))("text").alias("f")))
    values = ratio[chosen]
    scaled = spark.sparkContext.broadcast(values)
    n = len(chosen)
    vector = F.udf(lambda f: SparseVector(n, f, scaled.value[f].tolist()), VectorUDT())
    points = found.select("label", "w", vector("f").alias("features"))
    model = LogisticRegression(maxIter=40, regParam=0.002, standardization=False, weightCol="w").fit(points)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = model.coefficients.toArray() * values
    return weights, float(model.intercept)


def _scorer(weights_of, intercept: float):
    def score(text: pd.Series) -> pd.Series:
        w = weights_of.value
        out = np.empty(len(text))
        data, offs = C.string_buffers(pa.chunked_array([pa.array(text, pa.large_string())]))
        for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
            cells = np.concatenate([_cells(data[a:b], n) for n in SIZES])
            cells = np.unique(cells[w[cells] != 0])
            out[i] = w[cells].sum(dtype=np.float64) + intercept
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))
    return F.pandas_udf(score, "double")


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``, the probability that a text is toxic."""
    spark = docs.sparkSession
    C.prepare(spark)
    return docs.withColumn(out, _scorer(spark.sparkContext.broadcast(model[0]), model[1])(F.col(text_col).cast("string")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, learned from the labels that are not held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    labels = C.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("y")).where(fold != HELD_OUT)
    model = train(docs, labels)
    return score(docs, model, out="score").select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
