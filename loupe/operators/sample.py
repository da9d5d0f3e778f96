"""Seeded sampling of at most k reviews per label, without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_key(seed: int, key_col: str = "review_id"):
    """Seeded pseudo-random order key: md5 of ``'<seed>-<id>'``.

    It depends only on the seed and the id, never on partitioning or row
    order, so the sample is the same on any cluster layout.
    """
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key_col).cast("string")))


def sample_reviews(df: DataFrame, k: int, seed: int = 0, label_col: str = "label",
                   key_col: str = "review_id") -> DataFrame:
    """Up to ``k`` rows per label; clusters smaller than k give all their rows.

    ``row_number() <= k`` with a literal k plans as a partial
    WindowGroupLimit, so each task ships at most k rows per label even when
    one label holds most of the data.
    """
    w = Window.partitionBy(label_col).orderBy(sample_key(seed, key_col), F.col(key_col))
    return (df.withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= k)
            .withColumn("sample_rank", F.col("sample_rank").cast("bigint")))
