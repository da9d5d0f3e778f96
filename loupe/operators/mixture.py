"""Gaussian mixtures by EM with full, tied, diag or spherical covariances.

E-step and sufficient statistics run per partition in numpy
(``mapInArrow``): each task emits one frame per component (responsibility
sum, weighted sum, weighted second moments; of symmetric matrices the upper
triangle). Spark sums those rows; the M-step runs on the driver over the k
components, as the model itself holds k x d x d numbers. Rows never leave the
executors. Initialisation: hard responsibilities from seeded Euclidean
k-means, as is customary for mixture fits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.vectors import rows_of
from loupe.operators.cluster import joined_back, kmeans
from loupe.session import ship_package

COV_TYPES = ("spherical", "tied", "diag", "full")
KEY = "review_id"
VEC = "embedding"
STATS_SCHEMA = "component int, nk double, sx array<double>, sxx array<double>, ll double"


@dataclass
class MixtureModel:
    covariance_type: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    n: int = 0
    d: int = 0
    log_likelihood: float = float("nan")   # mean per row
    n_iter: int = 0
    converged: bool = False
    seed: int | None = None
    history: list = field(default_factory=list)

    # ---- derived quantities
    def precisions(self) -> np.ndarray:
        """Precision in the reference's native shape for the covariance type."""
        if self.covariance_type in ("full", "tied"):
            return np.linalg.inv(self.covariances)
        return 1.0 / self.covariances

    def n_parameters(self) -> int:
        k, d = self.means.shape
        cov = {"full": k * d * (d + 1) / 2, "diag": k * d, "tied": d * (d + 1) / 2,
               "spherical": k}[self.covariance_type]
        return int(cov + k * d + k - 1)

    def bic(self) -> float:
        return -2.0 * self.log_likelihood * self.n + self.n_parameters() * math.log(self.n)

    def aic(self) -> float:
        return -2.0 * self.log_likelihood * self.n + 2.0 * self.n_parameters()


def _prec_chol(cov_type, cov):
    """Per-component terms needed by the E-step: (kind, arrays, log det)."""
    if cov_type == "full":
        pcs, ld = [], []
        for c in cov:
            lc = np.linalg.cholesky(c)
            pc = np.linalg.inv(lc).T
            pcs.append(pc)
            ld.append(np.sum(np.log(np.diag(pc))))
        return np.array(pcs), np.array(ld)
    if cov_type == "tied":
        lc = np.linalg.cholesky(cov)
        pc = np.linalg.inv(lc).T
        return pc, np.sum(np.log(np.diag(pc)))
    if cov_type == "diag":
        p = 1.0 / np.sqrt(cov)
        return p, np.sum(np.log(p), axis=1)
    p = 1.0 / np.sqrt(cov)
    return p, None


def log_prob(X: np.ndarray, cov_type: str, means: np.ndarray, chol, logdet, log_w) -> np.ndarray:
    """(m, k) weighted log densities log pi_k + log N(x | mu_k, Sigma_k)."""
    m, d = X.shape
    k = means.shape[0]
    out = np.empty((m, k))
    if cov_type == "full":
        for j in range(k):
            y = (X - means[j]) @ chol[j]
            out[:, j] = np.sum(y * y, axis=1)
        ld = logdet
    elif cov_type == "tied":
        turned = X @ chol
        for j in range(k):
            y = turned - means[j] @ chol
            out[:, j] = np.sum(y * y, axis=1)
        ld = np.full(k, logdet)
    elif cov_type == "diag":
        p2 = chol ** 2
        out = (np.sum(means ** 2 * p2, 1) - 2.0 * X @ (means * p2).T + (X ** 2) @ p2.T)
        ld = logdet
    else:
        p2 = chol ** 2
        out = (np.sum(means ** 2, 1) * p2 - 2.0 * (X @ means.T) * p2 + np.outer(np.sum(X ** 2, 1), p2))
        ld = d * np.log(chol)
    return -0.5 * (d * np.log(2 * np.pi) + out) + ld + log_w


def _stats_fn(cov_type, d, k, params=None, hard=False):
    """Partition function: per-component sufficient statistics."""
    second = "outer" if cov_type in ("full", "tied") else "square"

    def fn(batches):
        nk = np.zeros(k)
        sx = np.zeros((k, d))
        sxx = np.zeros((k, d, d)) if second == "outer" else np.zeros((k, d))
        ll = 0.0
        for b in batches:
            if len(b) == 0:
                continue
            X = rows_of(b.column(0))
            if hard:
                R = np.zeros((len(X), k))
                R[np.arange(len(X)), b.column(1).to_numpy().astype(int)] = 1.0
            else:
                means, chol, logdet, log_w = params
                lp = log_prob(X, cov_type, means, chol, logdet, log_w)
                mx = lp.max(axis=1, keepdims=True)
                lse = mx[:, 0] + np.log(np.exp(lp - mx).sum(axis=1))
                R = np.exp(lp - lse[:, None])
                ll += float(lse.sum())
            nk += R.sum(axis=0)
            sx += R.T @ X
            if cov_type == "tied":  # only the sum over components counts
                sxx[0] += (X * R.sum(axis=1)[:, None]).T @ X
            elif second == "outer":
                for j in range(k):
                    sxx[j] += (X * R[:, j:j + 1]).T @ X
            else:
                sxx += R.T @ (X * X)
        for j in range(k):
            moments = sxx[j][np.triu_indices(d)] if second == "outer" else sxx[j]
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array(nk[j:j + 1]), pa.array([sx[j]], pa.list_(pa.float64())),
                                              pa.array([moments], pa.list_(pa.float64())), pa.array([ll if j == 0 else 0.0])], names=["component", "nk", "sx", "sxx", "ll"])
    return fn


def _collect_stats(data: DataFrame, fn, k, d, cov_type):
    ship_package(data.sparkSession)
    per_part = data.mapInArrow(fn, STATS_SCHEMA)
    agg = (per_part.groupBy("component").agg(
               F.sum("nk").alias("nk"),
               vector_to_array(Summarizer.sum(array_to_vector("sx"))).alias("sx"),
               vector_to_array(Summarizer.sum(array_to_vector("sxx"))).alias("sxx"),
               F.sum("ll").alias("ll"))
           .collect())
    agg = sorted(agg, key=lambda r: r["component"])  # k rows: sorted on the driver, no extra stage
    nk = np.array([r["nk"] for r in agg])
    sx = np.array([r["sx"] for r in agg])
    sxx = np.array([r["sxx"] for r in agg])
    if cov_type in ("full", "tied"):
        upper, sxx = sxx, np.zeros((k, d, d))
        rows, cols = np.triu_indices(d)
        sxx[:, rows, cols] = sxx[:, cols, rows] = upper
    ll = float(sum(r["ll"] for r in agg))
    return nk, sx, sxx, ll


def m_step(cov_type, nk, sx, sxx, n, reg):
    nk = nk + 10 * np.finfo(float).eps
    means = sx / nk[:, None]
    weights = nk / n
    d = means.shape[1]
    if cov_type == "full":
        cov = sxx / nk[:, None, None] - np.einsum("ki,kj->kij", means, means)
        cov[:, np.arange(d), np.arange(d)] += reg
    elif cov_type == "tied":
        cov = (sxx.sum(axis=0) - np.einsum("k,ki,kj->ij", nk, means, means)) / nk.sum()
        cov[np.arange(d), np.arange(d)] += reg
    elif cov_type == "diag":
        cov = sxx / nk[:, None] - means ** 2 + reg
    else:
        cov = (sxx / nk[:, None] - means ** 2 + reg).mean(axis=1)
    return weights, means, cov


def gaussian_mixture(df: DataFrame, n_components: int, covariance_type: str = "full",
                     max_iter: int = 100, tol: float = 1e-3, reg_covar: float = 1e-6,
                     seed: int = 0, vec_col: str = VEC, key: str = KEY) -> tuple[MixtureModel, DataFrame]:
    """Fit by EM; returns the model and hard labels ``(review_id, label)``."""
    if covariance_type not in COV_TYPES:
        raise ValueError(f"covariance_type must be one of {COV_TYPES}")
    k = n_components
    data = df.select(F.col(key), F.col(vec_col).cast("array<double>").alias(VEC)).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        init = joined_back(kmeans(data, k=k, n_init=1, seed=seed, max_iter=300, key=key).rows, key)
        model = from_labels(init, covariance_type, k, reg_covar)
        model.seed, prev = seed, -np.inf
        for it in range(1, max_iter + 1):
            step, lower = em_step(model, data, reg_covar)
            model.weights, model.means, model.covariances = step.weights, step.means, step.covariances
            model.history.append(lower)
            model.n_iter = it
            if abs(lower - prev) < tol:
                model.converged = True
                break
            prev = lower
        model.log_likelihood = score(model, data)
    finally:
        data.unpersist()  # labels are read from the source: grids of fits leave no copies behind
    return model, predict(model, data, key)


def from_labels(df: DataFrame, covariance_type: str, k: int | None = None, reg_covar: float = 1e-6, vec_col: str = VEC, label_col: str = "label") -> MixtureModel:
    """The mixture whose components are the given clusters 0..k-1: their shares, means and covariances."""
    data = df.select(F.col(vec_col).cast("array<double>").alias(VEC), F.col(label_col).cast("int").alias("label")).where(F.col(VEC).isNotNull() & F.col("label").isNotNull())
    size = data.agg(F.max("label"), F.max(F.size(VEC))).first()
    if size[0] is None:
        raise ValueError("no labelled vectors")
    k, d = k or size[0] + 1, size[1]
    nk, sx, sxx, _ = _collect_stats(data, _stats_fn(covariance_type, d, k, hard=True), k, d, covariance_type)
    n = int(round(nk.sum()))
    return MixtureModel(covariance_type, *m_step(covariance_type, nk, sx, sxx, n, reg_covar), n=n, d=d)


def em_step(model: MixtureModel, data: DataFrame, reg_covar: float = 1e-6) -> tuple[MixtureModel, float]:
    """One E- and M-step: the next model, and the mean log-likelihood of the rows under the one given."""
    kind, k = model.covariance_type, len(model.weights)
    nk, sx, sxx, ll = _collect_stats(data.select(VEC), _stats_fn(kind, model.d, k, e_step_params(model)), k, model.d, kind)
    n = int(round(nk.sum()))
    return MixtureModel(kind, *m_step(kind, nk, sx, sxx, n, reg_covar), n=n, d=model.d), ll / max(n, 1)


def e_step_params(model: MixtureModel):
    chol, logdet = _prec_chol(model.covariance_type, model.covariances)
    return model.means, chol, logdet, np.log(model.weights)


def precision_matrices(model: MixtureModel) -> dict[int, list[list[float]]]:
    """One d x d precision matrix for each component, of any covariance type (Cholesky inverses)."""
    chol, _ = _prec_chol(model.covariance_type, model.covariances)
    of = {"full": lambda j: chol[j] @ chol[j].T, "tied": lambda j: chol @ chol.T,
          "diag": lambda j: np.diag(chol[j] ** 2), "spherical": lambda j: np.eye(model.d) * chol[j] ** 2}[model.covariance_type]
    return {j: of(j).tolist() for j in range(len(model.weights))}


def score(model: MixtureModel, data: DataFrame) -> float:
    """Mean log-likelihood per row under the model."""
    return em_step(model, data)[1]


def predict(model: MixtureModel, data: DataFrame, key: str = KEY) -> DataFrame:
    """Hard labels: component of highest responsibility (lowest index on ties)."""
    ship_package(data.sparkSession)
    params = e_step_params(model)
    ct = model.covariance_type

    def fn(batches):
        for pdf in batches:
            X = np.stack(pdf[VEC].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, model.d))
            lab = log_prob(X, ct, *params).argmax(axis=1) if len(X) else np.zeros(0, dtype=int)
            yield pdf[[key]].assign(label=lab.astype(np.int32))
    return data.select(key, VEC).mapInPandas(fn, f"{key} bigint, label int")
