"""C1-C3 as ``pyspark.ml`` estimators, S6 as their models' writers and readers.

``CenterClustering`` fits spherical or Euclidean k-means, ``MixtureClustering``
Gaussian mixtures of all four covariance types. Models hold k centres or
components, add a label column to any table of vectors, and are saved and loaded
by the usual ``write().overwrite().save(path)`` and ``load(path)``: parameters as
JSON, numbers as Parquet. Both fit into ``Pipeline``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasPredictionCol, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.operators import cluster, mixture
from loupe.operators import geometry as G
from loupe.session import ship_package


class _Columns(HasPredictionCol):
    vecCol = Param(Params._dummy(), "vecCol", "column of vectors, array<double>", typeConverter=TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "column that tells rows apart", typeConverter=TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(vecCol="embedding", keyCol="review_id", predictionCol="label")

    def getVecCol(self) -> str:
        return self.getOrDefault(self.vecCol)

    def getKeyCol(self) -> str:
        return self.getOrDefault(self.keyCol)


class _Fit(_Columns, HasSeed, HasMaxIter, HasTol):
    k = Param(Params._dummy(), "k", "number of clusters", typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(k=5, seed=0, maxIter=100)

    def getK(self) -> int:
        return self.getOrDefault(self.k)

    def _columns_to(self, model):
        return model._set(vecCol=self.getVecCol(), keyCol=self.getKeyCol(), predictionCol=self.getPredictionCol())


# ---------------------------------------------------------------- centres

class _Metric(Params):
    metric = Param(Params._dummy(), "metric", "cosine or euclidean", typeConverter=TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(metric="cosine")

    def getMetric(self) -> str:
        return self.getOrDefault(self.metric)


class CenterClustering(_Fit, _Metric, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """K-means by cosine (spherical) or Euclidean distance, the best of ``nInit`` seeded runs."""

    nInit = Param(Params._dummy(), "nInit", "number of seeded runs", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=5, metric="cosine", nInit=1, maxIter=100, tol=1e-4, seed=0, vecCol="embedding", keyCol="review_id", predictionCol="label"):
        super().__init__()
        self._setDefault(nInit=1, tol=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "CentersModel":
        if self.getMetric() not in ("cosine", "euclidean"):
            raise ValueError("metric must be cosine or euclidean")
        fit = cluster.spherical_kmeans if self.getMetric() == "cosine" else cluster.kmeans
        found = fit(dataset, self.getK(), self.getOrDefault(self.nInit), self.getMaxIter(), self.getTol(), self.getSeed(), self.getVecCol(), self.getKeyCol())
        return self._columns_to(CentersModel(found.centers, found.inertia))._set(metric=self.getMetric())


class CentersModel(_Columns, _Metric, Model, MLReadable, MLWritable):
    """``centers`` [(label, vector)] and, if fitted, ``inertia``. A row's label is that of its nearest centre, the lowest on ties."""

    def __init__(self, centers=None, inertia: float | None = None):
        super().__init__()
        self.centers = G.collect_centers(centers or [])
        self.inertia = inertia

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.col(self.getVecCol()).cast("array<double>")
        label = G.nearest(self.centers, x, self.getMetric())["label"]
        return dataset.withColumn(self.getPredictionCol(), F.when(x.isNotNull(), label))

    def write(self) -> MLWriter:
        return _CentersWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CentersReader()


class _CentersWriter(MLWriter):
    def __init__(self, model: CentersModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"inertia": self.model.inertia})
        self.sparkSession.createDataFrame(self.model.centers, "label int, center array<double>").write.parquet(f"{path.rstrip('/')}/centers")


class _CentersReader(MLReader):
    def load(self, path: str) -> CentersModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CentersModel(self.sparkSession.read.parquet(f"{path.rstrip('/')}/centers"), meta["inertia"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


# ---------------------------------------------------------------- mixtures

class MixtureClustering(_Fit, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian mixture by EM with ``full``, ``tied``, ``diag`` or ``spherical`` covariances."""

    covarianceType = Param(Params._dummy(), "covarianceType", "full, tied, diag or spherical", typeConverter=TypeConverters.toString)
    regCovar = Param(Params._dummy(), "regCovar", "added to variances", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, k=5, covarianceType="full", regCovar=1e-6, maxIter=100, tol=1e-3, seed=0, vecCol="embedding", keyCol="review_id", predictionCol="label"):
        super().__init__()
        self._setDefault(covarianceType="full", regCovar=1e-6, tol=1e-3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MixtureClusters":
        fitted, _ = mixture.gaussian_mixture(dataset, self.getK(), self.getOrDefault(self.covarianceType), self.getMaxIter(), self.getTol(),
                                             self.getOrDefault(self.regCovar), self.getSeed(), self.getVecCol(), self.getKeyCol())
        return self._columns_to(MixtureClusters(fitted))


class MixtureClusters(_Columns, Model, MLReadable, MLWritable):
    """A fitted mixture (``mixture.MixtureModel``). A row's label is the component of highest responsibility."""

    def __init__(self, fitted: mixture.MixtureModel | None = None):
        super().__init__()
        self.fitted = fitted

    @property
    def centers(self) -> list[tuple[int, list[float]]]:
        return [(j, [float(v) for v in mean]) for j, mean in enumerate(self.fitted.means)]

    @property
    def precisions(self) -> dict[int, list[list[float]]]:
        """One d x d precision matrix for each component."""
        return mixture.precision_matrices(self.fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        spread = dataset.sparkSession.sparkContext.broadcast((self.fitted.covariance_type, mixture.e_step_params(self.fitted)))

        @F.pandas_udf("int")
        def label(x: pd.Series) -> pd.Series:
            kind, params = spread.value
            out, there = pd.Series([None] * len(x), dtype="Int32"), x.notna().to_numpy()
            if there.any():
                rows = np.stack([np.asarray(v, dtype=float) for v in x[there]])
                out[there] = mixture.log_prob(rows, kind, *params).argmax(axis=1)
            return out

        return dataset.withColumn(self.getPredictionCol(), label(F.col(self.getVecCol()).cast("array<double>")))

    def write(self) -> MLWriter:
        return _MixtureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MixtureReader()


_FITTED = ("covariance_type", "n", "d", "log_likelihood", "n_iter", "converged", "seed", "history")


class _MixtureWriter(MLWriter):
    def __init__(self, model: MixtureClusters):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model.fitted
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"fitted": {name: getattr(m, name) for name in _FITTED}})
        # a tied covariance is one matrix for all: it goes with the first component
        own = [m.covariances if j == 0 else [] for j in range(len(m.weights))] if m.covariance_type == "tied" else m.covariances
        rows = [(j, float(w), [float(v) for v in mean], [float(v) for v in np.ravel(c)]) for j, (w, mean, c) in enumerate(zip(m.weights, m.means, own))]
        self.sparkSession.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<double>").write.parquet(f"{path.rstrip('/')}/components")


class _MixtureReader(MLReader):
    def load(self, path: str) -> MixtureClusters:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = sorted(self.sparkSession.read.parquet(f"{path.rstrip('/')}/components").collect(), key=lambda r: r["component"])  # k rows
        fitted, k = meta["fitted"], len(rows)
        d = fitted["d"]
        shape = {"full": (k, d, d), "tied": (d, d), "diag": (k, d), "spherical": (k,)}[fitted["covariance_type"]]
        cov = np.concatenate([np.array(r["covariance"], float) for r in rows]).reshape(shape)
        model = MixtureClusters(mixture.MixtureModel(weights=np.array([r["weight"] for r in rows]), means=np.array([r["mean"] for r in rows]), covariances=cov, **fitted))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
