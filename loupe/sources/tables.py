"""Readers for the review corpus and the other input tables.

Readers select only the columns they need, so the Parquet scan's
``ReadSchema`` is pruned and filters placed after them reach
``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.text import correct_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer input splits than task slots.

    A Parquet row group is never split, so a small corpus stored as one row
    group is read by a single task and all per-row text or vector work would
    run on one core. Only then is the scan round-robin repartitioned to the
    default parallelism. A large input has far more splits than slots and is
    left untouched (no shuffle of the corpus).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Any Spark-readable source projected to ``(review_id, text)``."""
    reader = spark.read.format(fmt)
    if fmt in ("csv",):
        reader = reader.option("header", "true")
    return spread(reader.load(path).select(F.col(id_col).cast("bigint").alias("review_id"),
                                           F.col(text_col).alias("text")))


def reviews(spark: SparkSession, sf_dir: str, corrected: bool = True, extra=()) -> DataFrame:
    """``documents`` as reviews: ``(review_id, text, weight, *extra)``, weight = n_chars."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", *extra))
    text = correct_text("text") if corrected else F.col("text")
    return d.select(F.col("doc_id").alias("review_id"), text.alias("text"),
                    F.col("n_chars").cast("double").alias("weight"), *extra)


def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as cluster labels: ``(review_id, label, sentiment)``."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("review_id"), F.col("quality").alias("label"),
                      F.col("toxic").cast("double").alias("sentiment"))


def labelled_reviews(spark: SparkSession, sf_dir: str, corrected: bool = True) -> DataFrame:
    """Reviews joined to their labels at review level (before any explode).

    The text is corrected after the join, so unlabelled reviews cost nothing.
    """
    rv = reviews(spark, sf_dir, corrected=False).join(review_labels(spark, sf_dir), "review_id", "inner")
    return rv.withColumn("text", correct_text("text")) if corrected else rv


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``(review_id, embedding array<double>, label)``."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return e.select(F.col("vec_id").alias("review_id"),
                    F.col("embedding").cast("array<double>").alias("embedding"),
                    F.col("label"))
