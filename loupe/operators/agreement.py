"""Adjusted mutual information between two labellings, on the cluster.

Contingency counts and marginals are partial aggregations. The expected mutual
information of two clusters depends on their sizes alone, so clusters of equal
size are merged with their multiplicity: n rows have at most sqrt(2n) different
sizes on either side, whatever the number of clusters. For each pair of sizes the
hypergeometric probabilities follow from their ratios, in one row of one task;
no row is made for an overlap and no table of marginals reaches the driver but the
different sizes of the second labelling. Rows with a null label are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.session import ship_package

EPS = 2.220446049250313e-16  # float64 machine epsilon
SIGMAS, MORE = 40, 60  # beyond this many deviations and overlaps from the mode a probability is below the smallest float


def expected_term(a: int, b: int, n: int) -> float:
    """What two clusters of sizes a and b add to the expected mutual information of n rows."""
    low, high = max(0, a + b - n), min(a, b)
    mode = (a + 1) * (b + 1) // (n + 2)
    width = int(SIGMAS * np.sqrt(a * b / n * (1 - a / n) * (1 - b / n))) + MORE
    low, high = max(low, mode - width), min(high, mode + width)
    x = np.arange(low, high + 1, dtype=np.float64)
    log_p = np.zeros(len(x))
    log_p[1:] = np.cumsum(np.log((a - x[:-1]) * (b - x[:-1])) - np.log((x[:-1] + 1) * (n - a - b + x[:-1] + 1)))
    p = np.exp(log_p - log_p.max())
    some = x > 0
    return float(np.sum(p[some] * (x[some] / n) * np.log(n / a * x[some] / b)) / p.sum())


def _marginal(cont: DataFrame, side: str) -> DataFrame:
    return cont.groupBy(side).agg(F.sum("nij").alias(f"size_{side}"))


def _sizes(marginal: DataFrame, side: str) -> DataFrame:
    """Different cluster sizes and how many clusters have each."""
    return marginal.groupBy(F.col(f"size_{side}").alias("size")).agg(F.count(F.lit(1)).alias("clusters"))


def expected_mutual_info(sizes_u: DataFrame, sizes_v: list, n: int) -> float:
    """E[MI] under the hypergeometric model of random labellings; ``sizes_v`` are (size, clusters) rows."""
    ship_package(sizes_u.sparkSession)
    other = sizes_u.sparkSession.sparkContext.broadcast([(r["size"], r["clusters"]) for r in sizes_v])

    @F.pandas_udf("double")
    def against_all(size: pd.Series) -> pd.Series:
        return pd.Series([sum(m * expected_term(int(a), b, n) for b, m in other.value) for a in size], dtype="float64")

    # dealt by the size, as one size is the work of all others
    return float(sizes_u.repartition("size").agg(F.sum(F.col("clusters") * against_all("size"))).first()[0] or 0.0)


def adjusted_mutual_info(df: DataFrame, u: str, v: str) -> float:
    """AMI with the arithmetic mean of the entropies as normaliser."""
    pairs = df.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    cont = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("nij")).persist()
    try:
        a, b = _marginal(cont, "u"), _marginal(cont, "v")
        total = cont.agg(F.sum("nij")).first()[0] or 0
        entropy = lambda m, side: m.agg(F.count(F.lit(1)), -F.sum(F.col(f"size_{side}") / total * F.log(F.col(f"size_{side}") / total))).first()
        (n_u, h_u), (n_v, h_v) = entropy(a, "u"), entropy(b, "v")
        if n_u == n_v and n_u <= 1:
            return 1.0
        share = F.col("nij") / total * (F.log("nij") + F.log(F.lit(total)) - F.log("size_u") - F.log("size_v"))
        mi = max(float(cont.join(a, "u").join(b, "v").agg(F.sum(share)).first()[0]), 0.0)
        emi = expected_mutual_info(_sizes(a, "u"), _sizes(b, "v").collect(), int(total))  # at most sqrt(2 n) sizes
    finally:
        cont.unpersist()
    denom = 0.5 * (h_u + h_v) - emi
    denom = min(denom, -EPS) if denom < 0 else max(denom, EPS)
    return (mi - emi) / denom
