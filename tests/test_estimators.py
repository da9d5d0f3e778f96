"""Estimators and models: fit, transform, save and load (C1-C3, S6), EM steps and precisions."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from loupe.operators import cluster, mixture
from loupe.operators.estimators import CenterClustering, CentersModel, MixtureClusters, MixtureClustering


def _blobs(spark, n=40):
    rng = np.random.default_rng(8)
    X = np.concatenate([rng.normal(c, 0.3, (n, 3)) for c in ([3, 0, 0], [0, 4, 0], [1, 1, 5])])
    rows = [(i, x.tolist(), i // n) for i, x in enumerate(X)]
    return X, spark.createDataFrame(rows, "review_id bigint, embedding array<double>, truth int").repartition(5)


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "m")


def _labels(model, df, col="label"):
    return {r["review_id"]: r[col] for r in model.transform(df).collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_centers_survive_saving(spark, metric):
    X, df = _blobs(spark)
    model = CenterClustering(k=3, metric=metric, nInit=2, seed=4, predictionCol="cluster").fit(df)
    path = _path()
    model.write().save(path)
    again = CentersModel.load(path)
    assert again.centers == model.centers and again.inertia == model.inertia and again.uid == model.uid
    assert (again.getMetric(), again.getPredictionCol()) == (metric, "cluster")
    got = _labels(again, df, "cluster")
    assert got == _labels(model, df, "cluster")
    C = np.array([c for _, c in model.centers])
    D = 1 - (X / np.linalg.norm(X, axis=1, keepdims=True)) @ C.T if metric == "cosine" else np.linalg.norm(X[:, None] - C, axis=2)
    assert [got[i] for i in range(len(X))] == D.argmin(1).tolist()
    with pytest.raises(Exception):
        model.write().save(path)  # refuses to overwrite
    model.write().overwrite().save(path)


@pytest.mark.parametrize("kind", mixture.COV_TYPES)
def test_mixtures_survive_saving(spark, kind):
    X, df = _blobs(spark)
    model = MixtureClustering(k=3, covarianceType=kind, seed=5).fit(df)
    path = _path()
    model.write().save(path)
    again = MixtureClusters.load(path)
    for name in ("weights", "means", "covariances"):
        assert np.array_equal(getattr(again.fitted, name), getattr(model.fitted, name))
    assert again.fitted.bic() == model.fitted.bic() and again.fitted.history == model.fitted.history
    got = _labels(again, df)
    assert got == _labels(model, df) and len(set(got.values())) == 3
    cov = {"full": lambda j: model.fitted.covariances[j], "tied": lambda j: model.fitted.covariances,
           "diag": lambda j: np.diag(model.fitted.covariances[j]), "spherical": lambda j: np.eye(3) * model.fitted.covariances[j]}[kind]
    assert all(np.allclose(np.array(p) @ cov(j), np.eye(3)) for j, p in again.precisions.items())


def test_in_a_pipeline_with_other_columns_and_nulls(spark):
    _, df = _blobs(spark)
    fitted = Pipeline(stages=[CenterClustering(k=3, seed=1, vecCol="v", keyCol="id", predictionCol="c"),
                              MixtureClustering(k=3, covarianceType="diag", seed=1, vecCol="v", keyCol="id", predictionCol="m")]).fit(
        df.selectExpr("review_id AS id", "embedding AS v"))
    path = _path()
    fitted.write().save(path)
    odd = df.selectExpr("review_id AS id", "CASE WHEN review_id > 2 THEN embedding END AS v", "'x' AS distance", "1 AS label")
    out = PipelineModel.load(path).transform(odd)
    assert out.columns == ["id", "v", "distance", "label", "c", "m"]
    for r in out.collect():
        assert (r["c"] is None) == (r["m"] is None) == (r["v"] is None)
    assert fitted.transform(odd.limit(0)).collect() == []


@pytest.mark.parametrize("kind", mixture.COV_TYPES)
def test_mixture_of_given_clusters_and_one_step(spark, kind):
    X, df = _blobs(spark)
    y = np.arange(len(X)) // 40
    start = mixture.from_labels(df, kind, label_col="truth", reg_covar=1e-3)
    own = [np.cov(X[y == j].T, bias=True) for j in range(3)]
    want = {"full": np.array(own), "tied": sum(own) / 3, "diag": np.array([np.diag(c) for c in own]), "spherical": np.array([np.diag(c).mean() for c in own])}[kind]
    reg = 1e-3 if kind in ("diag", "spherical") else 1e-3 * np.eye(3)
    assert np.allclose(start.covariances, want + reg) and np.allclose(start.weights, 1 / 3) and np.allclose(start.means, [X[y == j].mean(0) for j in range(3)])
    step, ll = mixture.em_step(start, df, 1e-3)
    lp = mixture.log_prob(X, kind, *mixture.e_step_params(start))
    total = np.log(np.exp(lp).sum(1))
    R = np.exp(lp - total[:, None])
    assert abs(ll - total.mean()) < 1e-9
    assert np.allclose(step.weights, R.mean(0)) and np.allclose(step.means, (R.T @ X) / R.sum(0)[:, None])


def test_lloyd_results_belong_together(spark):
    X, df = _blobs(spark)
    for max_iter in (1, 2, 20):
        res = cluster.lloyd(df, [(0, [1.0, 0, 0]), (1, [0, 1.0, 0.2]), (2, [0, 0, 1.0]), (3, [-1.0, -1.0, -1.0])], max_iter=max_iter)
        C = np.array([c for _, c in res.centers])
        D = 1 - (X / np.linalg.norm(X, axis=1, keepdims=True)) @ C.T
        got = {r.review_id: (r.label, r.distance) for r in res.labels.collect()}
        assert [label for label, _ in res.centers] == sorted({got[i][0] for i in got})
        assert all(res.centers[D[i].argmin()][0] == got[i][0] and abs(D[i].min() - got[i][1]) < 1e-9 for i in got)
        assert abs(res.inertia - D.min(1).sum()) < 1e-9
    assert not spark.sparkContext._jsc.getPersistentRDDs()
