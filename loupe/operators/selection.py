"""Model selection and benchmarking: C4, C5, C8, C9, C11.

The grid loops run on the driver over a handful of parameter cells; every
fit inside is a distributed job, and benchmark cells can run side by side. Seeds are ``base_seed + cell index`` and
are recorded in the result tables (C11).
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators import agreement, cluster, mixture
from loupe.operators import geometry as G

KEY = "review_id"


def parameter_grid(spark: SparkSession, names, values) -> DataFrame:
    """Cartesian product of parameter values, last name varying fastest.

    The values are a few driver-side settings, so the product is formed on
    the driver and returned as a DataFrame of rows.
    """
    rows = [tuple(c) for c in itertools.product(*values)]
    return spark.createDataFrame(rows, list(names))


def parameter_dicts(names, values) -> list[dict]:
    return [dict(zip(names, c)) for c in itertools.product(*values)]


def em_selection(df: DataFrame, n_components_range, seed: int = 0, criterion: str = "BIC",
                 max_iter: int = 100, n_runs: int = 1, cv_types=("spherical", "tied", "diag", "full")):
    """C4: information criterion over covariance type x components x runs.

    Returns (best model, best labels, per-run table, mean table).
    """
    if criterion not in ("AIC", "BIC"):
        raise ValueError("criterion must be AIC or BIC")
    spark = df.sparkSession
    rows, best = [], None
    n_combs = len(cv_types) * len(n_components_range)
    for run in range(n_runs):
        for i, ct in enumerate(cv_types):
            for j, k in enumerate(n_components_range):
                s = seed + run * n_combs + i * len(n_components_range) + j
                model, labels = mixture.gaussian_mixture(df, int(k), ct, max_iter=max_iter, seed=s)
                m = model.bic() if criterion == "BIC" else model.aic()
                rows.append((ct, int(k), run, s, float(m)))
                if best is None or m < best[0]:
                    best = (m, model, labels)
    runs = spark.createDataFrame(rows, "cov_type string, k int, run int, seed bigint, measure double")
    means = runs.groupBy("cov_type", "k").agg(F.avg("measure").alias("measure"))
    return best[1], best[2], runs, means


def measure_pivot(means: DataFrame, ks) -> DataFrame:
    """C4 table layout: one row per covariance type, one column per k."""
    return means.groupBy("cov_type").pivot("k", [int(k) for k in ks]).agg(F.first("measure"))


def kmeans_selection(df: DataFrame, n_components_range, n_runs: int = 1, seed: int = 0,
                     metric: str = "cosine", vec_col: str = "embedding"):
    """Inertia and silhouette per k, averaged over runs.

    Silhouettes use the closed forms (cosine, or squared Euclidean for the
    Euclidean runs). Returns (per-run table, mean table).
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    spark = df.sparkSession
    rows = []
    for run in range(n_runs):
        for j, k in enumerate(n_components_range):
            s = seed + run * len(n_components_range) + j
            if metric == "cosine":
                res = cluster.spherical_kmeans(df, int(k), seed=s, vec_col=vec_col)
                sil_metric = "cosine"
            else:
                res = cluster.kmeans(df, int(k), seed=s, vec_col=vec_col)
                sil_metric = "sqeuclidean"
            lab = cluster.joined_back(res.rows)
            sil = G.silhouette_score(lab, "label", cluster.VEC, sil_metric)
            rows.append((int(k), run, s, float(res.inertia), float(sil)))
    runs = spark.createDataFrame(rows, "k int, run int, seed bigint, inertia double, silhouette double")
    means = runs.groupBy("k").agg(F.avg("inertia").alias("inertia"), F.avg("silhouette").alias("silhouette"))
    return runs, means


def _fit_labels(model, df: DataFrame, params: dict, seed: int) -> DataFrame:
    """Labels of a fit: of a named model, or of an estimator that ``model(seed=..., **params)`` makes."""
    if callable(model):
        fitted = model(seed=seed, **params).fit(df)
        return fitted.transform(df).select(KEY, F.col(fitted.getPredictionCol()).alias("label"))
    if model == "spherical_kmeans":
        return cluster.spherical_kmeans(df, seed=seed, **params).labels
    if model == "kmeans":
        return cluster.kmeans(df, seed=seed, **params).labels
    if model == "gaussian_mixture":
        return mixture.gaussian_mixture(df, seed=seed, **params)[1]
    raise ValueError(f"unknown model {model!r}")


def ami(joined: DataFrame) -> float:
    return agreement.adjusted_mutual_info(joined, "label", "true_label")


def clustering_benchmark(embeddings: dict, models: dict, true_labels: DataFrame, seed: int = 0, n_runs: int = 1, true_col: str = "true_label",
                         criterion: Callable[[DataFrame], float] = ami, parallel: int = 1) -> DataFrame:
    """Score every (embedding, model, parameters, run) cell against true labels.

    ``embeddings`` maps a name to a ``(review_id, embedding)`` DataFrame; ``models``
    maps a name to a list of parameter dicts, or to a pair of an estimator class
    (or factory) and such a list. ``criterion`` scores a DataFrame of (label,
    true_label), by default the adjusted mutual information. ``parallel`` cells run
    at a time, each under a job tag of its own; a failing cell cancels its own
    jobs, scores null and leaves its reason in ``error``.
    """
    spark = true_labels.sparkSession
    cells = []
    for run in range(n_runs):
        for ename, edf in embeddings.items():
            for mname, given in models.items():
                model, plist = given if isinstance(given, tuple) else (mname, given)
                cells += [(ename, edf, mname, model, params, run) for params in plist]

    def work(at: int) -> tuple:
        ename, edf, mname, model, params, run = cells[at]
        sc, tag, score, error = spark.sparkContext, f"benchmark-{id(cells)}-{at}", None, None
        sc.addJobTag(tag)
        try:
            lab = _fit_labels(model, edf, params, seed + at)
            score = float(criterion(lab.join(true_labels.select(KEY, F.col(true_col).alias("true_label")), KEY).select("label", "true_label")))
        except Exception as e:  # noqa: BLE001 - a failed cell is recorded, not raised
            sc.cancelJobsWithTag(tag)  # what the cell may have left running
            error = f"{type(e).__name__}: {e}".splitlines()[0]
        finally:
            sc.removeJobTag(tag)
        return ename, mname, json.dumps(params, sort_keys=True), run, seed + at, score, error

    with ThreadPoolExecutor(max(1, parallel)) as pool:  # each cell gets local properties, and so tags, of its own
        started = [pool.submit(inheritable_thread_target(spark)(functools.partial(work, at))) for at in range(len(cells))]
        rows = [s.result() for s in started]
    return spark.createDataFrame(
        rows, "embedding string, model string, params string, run int, seed bigint, score double, error string")
