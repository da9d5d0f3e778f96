"""Clustering fits, selection, benchmark and AMI."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.functions import vectors as V
from loupe.operators import agreement, cluster, mixture, selection
from loupe.operators import geometry as G


def _vec(spark, X, labels=None):
    rows = [(i, [float(v) for v in x], None if labels is None else int(labels[i])) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "review_id bigint, embedding array<double>, label int")


def _circle(seed=98):
    """FIXTURES A13 with our own seeded noise."""
    rng = np.random.default_rng(seed)
    means = [0.5 * np.pi, np.pi, 1.5 * np.pi, 2 * np.pi]
    rad = np.repeat(means, 100) + rng.normal(size=400) * 0.01
    X = np.stack([np.sin(rad), np.cos(rad)], axis=1)
    for s in (0, 100, 200):
        X[s:s + 50] *= 10
    return X, np.repeat(np.arange(4), 100)


def _ami_reference(u, v):
    """Adjusted mutual information straight from its definition (numpy)."""
    u, v = np.asarray(u), np.asarray(v)
    n = len(u)
    cu, cv = np.unique(u), np.unique(v)
    a = np.array([(u == x).sum() for x in cu], float)
    b = np.array([(v == y).sum() for y in cv], float)
    mi = 0.0
    for i, x in enumerate(cu):
        for j, y in enumerate(cv):
            nij = ((u == x) & (v == y)).sum()
            if nij:
                mi += nij / n * math.log(n * nij / (a[i] * b[j]))
    hu = -np.sum(a / n * np.log(a / n))
    hv = -np.sum(b / n * np.log(b / n))
    lf = lambda k: math.lgamma(k + 1)
    emi = 0.0
    for ai in a:
        for bj in b:
            for nij in range(int(max(1, ai + bj - n)), int(min(ai, bj)) + 1):
                emi += (nij / n * math.log(n * nij / (ai * bj)) * math.exp(
                    lf(ai) + lf(bj) + lf(n - ai) + lf(n - bj) - lf(n) - lf(nij) - lf(ai - nij)
                    - lf(bj - nij) - lf(n - ai - bj + nij)))
    return (mi - emi) / ((hu + hv) / 2 - emi)


def test_ami_matches_definition(spark):
    rng = np.random.default_rng(0)
    u = rng.integers(0, 4, 300)
    v = (u + (rng.random(300) < 0.3) * rng.integers(0, 3, 300)) % 5
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(u, v)], "u int, v int")
    assert abs(agreement.adjusted_mutual_info(df, "u", "v") - _ami_reference(u, v)) < 1e-9
    same = spark.createDataFrame([(int(x), int(x)) for x in u], "u int, v int")
    assert abs(agreement.adjusted_mutual_info(same, "u", "v") - 1.0) < 1e-9


def test_expected_term_by_definition():
    lf = lambda k: math.lgamma(k + 1)
    for a, b, n in ((1, 1, 1), (1, 5, 9), (7, 9, 12), (40, 60, 100), (300, 20, 1000), (999, 999, 1000), (5, 5, 10**6)):
        want = sum(k / n * math.log(n * k / (a * b)) * math.exp(lf(a) + lf(b) + lf(n - a) + lf(n - b) - lf(n) - lf(k) - lf(a - k) - lf(b - k) - lf(n - a - b + k))
                   for k in range(max(1, a + b - n), min(a, b) + 1))
        assert abs(agreement.expected_term(a, b, n) - want) <= 1e-9 * abs(want) + 1e-15
    # a third of 10**9 rows on both sides: independent, so about 1 / (2 n) is expected for each of four cells
    assert 0 < agreement.expected_term(3 * 10**8, 3 * 10**8, 10**9) < 1


def test_ami_of_very_many_clusters(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("u"), (F.xxhash64("id") % 100_000).alias("v"), "id")
    assert abs(agreement.adjusted_mutual_info(df, "u", "v")) < 0.01
    assert abs(agreement.adjusted_mutual_info(df.withColumn("v", F.col("u") * 7), "u", "v") - 1) < 1e-9


def test_ami_leaves_out_null_labels(spark):
    rows = [(0, 0), (0, 0), (1, 1), (1, 0), (2, 2), (None, 1), (2, None), (None, None)]
    ami = lambda r: agreement.adjusted_mutual_info(spark.createDataFrame(r, "u int, v int"), "u", "v")
    assert ami(rows) == ami(rows[:5]) and ami([]) == 1.0


def test_own_seeding_is_the_same_on_any_partitioning(spark):
    X, truth = _circle(12)
    df = _vec(spark, np.concatenate([X, np.zeros((2, 2))]))
    seeds = [cluster.parallel_seeds(df.repartition(n), 4, seed=3) for n in (1, 5, 9)]
    assert all(len(s) == 4 and np.allclose([c for _, c in s], [c for _, c in seeds[0]]) for s in seeds)
    assert not np.allclose([c for _, c in seeds[0]], [c for _, c in cluster.parallel_seeds(df, 4, seed=4)])
    res = cluster.seeded_kmeans(_vec(spark, X), 4, n_init=3, seed=3)
    lab = res.labels.join(_vec(spark, X, truth).select("review_id", F.col("label").alias("t")), "review_id")
    assert abs(agreement.adjusted_mutual_info(lab, "label", "t") - 1) < 0.01 and res.inertia == min(res.inertias)
    few = _vec(spark, np.array([[1.0, 0], [1.0, 0], [0, 2.0]]))
    assert len(cluster.parallel_seeds(few, 5)) == 2 and cluster.parallel_seeds(few.limit(0), 5) == []


def test_benchmark_of_a_user_model_and_criterion(spark):
    from pyspark.ml import Estimator

    from loupe.operators.estimators import CenterClustering

    class Broken(Estimator):
        def __init__(self, seed, k):
            super().__init__()

        def _fit(self, dataset):
            dataset.select(F.raise_error(F.lit("no fit"))).collect()

    X, truth = _circle(7)
    df = _vec(spark, X, truth)
    purity = lambda j: j.groupBy("label", "true_label").count().groupBy("label").agg(F.max("count").alias("m")).agg(F.sum("m")).first()[0] / 400
    out = selection.clustering_benchmark({"x": df.drop("label")}, {"own": (CenterClustering, [{"k": 4}, {"k": 2}]), "broken": (Broken, [{"k": 2}]), "kmeans": [{"k": 4}]},
                                         df.select("review_id", F.col("label").alias("t")), seed=5, true_col="t", criterion=purity, parallel=4).collect()
    assert [(r.model, r.params, r.seed) for r in out] == [("own", '{"k": 4}', 5), ("own", '{"k": 2}', 6), ("broken", '{"k": 2}', 7), ("kmeans", '{"k": 4}', 8)]
    assert out[0].score > 0.99 and out[1].score == 0.5 and out[3].score is not None
    assert out[2].score is None and "no fit" in out[2].error


def test_spherical_kmeans_circle(spark):
    X, truth = _circle()
    df = _vec(spark, X, truth)
    res = cluster.spherical_kmeans(df.drop("label"), k=4, n_init=10, max_iter=100, seed=42)
    lab = res.labels.join(df.select("review_id", F.col("label").alias("t")), "review_id")
    assert abs(agreement.adjusted_mutual_info(lab, "label", "t") - 1) < 0.01
    C = np.array([c for _, c in res.centers])
    assert np.allclose(np.linalg.norm(C, axis=1), 1.0)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    true_c = np.array([U[truth == g].mean(0) for g in range(4)])
    true_c /= np.linalg.norm(true_c, axis=1, keepdims=True)
    d = np.linalg.norm(C[:, None, :] - true_c[None], axis=2).min(axis=1)
    assert d.sum() < 0.01
    # MLlib's training cost is the summed cosine distance to the centres
    own = G.own_center_distance(df.drop("label").join(res.labels, "review_id"), res.centers, "cosine")
    assert abs(own.agg(F.sum("distance")).first()[0] - res.inertia) < 1e-6
    assert len(res.inertias) == 10 and res.inertia == min(res.inertias)


def test_lloyd_fixed_init(spark):
    X, truth = _circle(5)
    df = _vec(spark, X)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    init = [(g, list(U[truth == g][0])) for g in range(4)]
    res = cluster.lloyd(df, init, max_iter=50, tol=1e-4)
    lab = res.labels.join(_vec(spark, X, truth).select("review_id", F.col("label").alias("t")), "review_id")
    assert agreement.adjusted_mutual_info(lab, "label", "t") > 0.99
    assert np.allclose([np.linalg.norm(c) for _, c in res.centers], 1.0)
    # numpy reference of the same loop
    C = np.array([c for _, c in init])
    prev = np.inf
    for _ in range(50):
        Dm = 1 - U @ (C / np.linalg.norm(C, axis=1, keepdims=True)).T
        lab_np = Dm.argmin(1)
        cur = Dm[np.arange(len(U)), lab_np].sum()
        C = np.array([U[lab_np == g].mean(0) for g in sorted(set(lab_np))])
        if prev - cur < 1e-4:
            break
        prev = cur
    assert abs(res.inertia - cur) < 1e-9


def test_kmeans_euclidean_recovers_blobs(spark):
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(loc=c, scale=0.05, size=(30, 2)) for c in ([0, 0], [5, 5], [0, 5])])
    truth = np.repeat(np.arange(3), 30)
    df = _vec(spark, X, truth)
    res = cluster.kmeans(df.drop("label"), k=3, n_init=2, seed=1)
    lab = res.labels.join(df.select("review_id", F.col("label").alias("t")), "review_id")
    assert abs(agreement.adjusted_mutual_info(lab, "label", "t") - 1) < 1e-9


def _np_loglik(X, model):
    from loupe.operators.mixture import _prec_chol, log_prob
    chol, logdet = _prec_chol(model.covariance_type, model.covariances)
    lp = log_prob(X, model.covariance_type, model.means, chol, logdet, np.log(model.weights))
    mx = lp.max(1, keepdims=True)
    return float(np.mean(mx[:, 0] + np.log(np.exp(lp - mx).sum(1))))


@pytest.mark.parametrize("cov_type", ["spherical", "diag", "tied", "full"])
def test_gaussian_mixture(spark, cov_type):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(loc=c, scale=s, size=(60, 2))
                        for c, s in (([0, 0], 0.3), ([4, 4], 0.5), ([0, 4], 0.4))])
    truth = np.repeat(np.arange(3), 60)
    df = _vec(spark, X, truth)
    model, lab = mixture.gaussian_mixture(df.drop("label"), 3, cov_type, seed=3)
    j = lab.join(df.select("review_id", F.col("label").alias("t")), "review_id")
    assert agreement.adjusted_mutual_info(j, "label", "t") > 0.95
    assert abs(model.weights.sum() - 1) < 1e-9
    # the reported likelihood is the numpy likelihood of the fitted model
    assert abs(model.log_likelihood - _np_loglik(X, model)) < 1e-9
    # EM never decreases the likelihood
    h = model.history
    assert all(b >= a - 1e-9 for a, b in zip(h, h[1:]))
    p = {"full": 3 * 3 + 6 + 2, "diag": 6 + 6 + 2, "tied": 3 + 6 + 2, "spherical": 3 + 6 + 2}[cov_type]
    assert model.n_parameters() == p
    assert abs(model.bic() - (-2 * model.log_likelihood * 180 + p * math.log(180))) < 1e-9


def test_parameter_grid(spark):
    g = selection.parameter_grid(spark, ["n_clusters", "n_init"], [[5, 6], [3]]).collect()
    assert [tuple(r) for r in g] == [(5, 3), (6, 3)]
    assert selection.parameter_dicts(["a", "b"], [[1, 2], [3]]) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_selection_and_benchmark(spark):
    X, truth = _circle(7)
    df = _vec(spark, X, truth)
    runs, means = selection.kmeans_selection(df.drop("label"), [3, 4], n_runs=2, seed=1)
    assert runs.count() == 4 and means.count() == 2
    best_k = means.orderBy(F.desc("silhouette")).first().k
    assert best_k == 4
    best, best_lab, eruns, emeans = selection.em_selection(df.drop("label"), [2, 4], seed=0,
                                                           cv_types=("spherical", "diag"), max_iter=50)
    assert eruns.count() == 4 and emeans.count() == 4
    assert best.bic() == min(r.measure for r in eruns.collect())
    piv = {r.cov_type: (r["2"], r["4"]) for r in selection.measure_pivot(emeans, [2, 4]).collect()}
    means = {(r.cov_type, r.k): r.measure for r in emeans.collect()}
    assert piv == {ct: (means[(ct, 2)], means[(ct, 4)]) for ct in ("spherical", "diag")}
    truth_df = df.select("review_id", F.col("label").alias("true_label"))
    bench = selection.clustering_benchmark(
        {"x": df.drop("label")}, {"spherical_kmeans": [{"k": 4}], "kmeans": [{"k": "bad"}]}, truth_df, seed=5)
    rows = {r.model: r for r in bench.collect()}
    assert rows["spherical_kmeans"].score > 0.99 and rows["spherical_kmeans"].seed == 5
    assert rows["kmeans"].score is None  # a failing cell is recorded, not raised


def test_skmeans_recomputed_centers(spark):
    X, truth = _circle(11)
    df = _vec(spark, X)
    res = cluster.skmeans(df, k=4, n_init=3, seed=2)
    lab = {r.review_id: r.label for r in res.labels.collect()}
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    for label, c in res.centers:
        m = U[[i for i in range(len(U)) if lab[i] == label]].mean(0)
        assert np.allclose(c, m / np.linalg.norm(m))


def test_labels_are_joined_back_without_moving_vectors(spark):
    rows = [(i, [float(i), 1.0], i % 3) for i in range(20)]
    schema = "review_id bigint, embedding array<double>, label int"
    own = cluster.joined_back(spark.createDataFrame(rows, schema))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString() and sorted(map(str, own.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, schema).collect())
    df = spark.createDataFrame(rows + [(4, [9.0, 9.0], 2), (4, [8.0, 9.0], 2), (None, [1.0, 2.0], 0)], schema)
    want = df.select("review_id", "embedding").join(df.select("review_id", "label"), "review_id")
    assert sorted(map(str, cluster.joined_back(df).collect())) == sorted(map(str, want.collect()))


def test_nearest_in_arrays_is_nearest_in_columns(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(size=(60, 4)), np.zeros((1, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "review_id bigint, embedding array<double>")
    centers = [(3, [1.0, 0, 0, 0]), (1, [0.0, 0, 0, 0]), (2, [1.0, 0, 0, 0]), (0, [0.0, 1, 1, 0])]
    for metric in ("cosine", "euclidean", "sqeuclidean"):
        want = {r.review_id: (r.label, r.distance) for r in G.assign(df, centers, metric).collect()}
        label, distance = V.nearest_rows(X, centers, metric)
        assert all(want[i][0] == label[i] and abs(want[i][1] - distance[i]) < 1e-9 for i in range(len(X)))
        sums = cluster._member_sums(cluster.packed(df), centers, metric)
        assert [r.label for r in sums] == sorted(set(label.tolist())) and all(np.allclose(r.sx, X[label == r.label].sum(0)) and r.n == (label == r.label).sum() for r in sums)
