"""G1-G11, C1a, C1d-f, C6 against the fixtures and numpy brute force."""

import math

import numpy as np
import pytest

from loupe.guards import bounded_broadcast
from loupe.operators import geometry as G
from loupe.operators import report


def _vec(spark, X, labels=None):
    rows = [(i, [float(v) for v in x], None if labels is None else int(labels[i])) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "review_id bigint, embedding array<double>, label int")


def _centers(df):
    return {r.label: list(r.center) for r in df.collect()}


def test_centers_fixture(spark):
    X = [[i, i] for i in range(1, 7)]
    df = _vec(spark, X, [0, 0, 0, 1, 1, 1])
    assert _centers(G.centers(df)) == {0: [2.0, 2.0], 1: [5.0, 5.0]}
    cn = _centers(G.centers(df, normalize=True))
    for v in cn.values():
        assert np.allclose(v, [math.sqrt(0.5)] * 2)


def test_central_reviews_fixture(spark):
    X = [[i, i] for i in range(1, 7)]
    df = _vec(spark, X, [0, 0, 0, 1, 1, 1])
    texts = spark.createDataFrame(list(enumerate(["this", "is", "just", "a", "test", "file"])),
                                  "review_id bigint, text string")
    out = {r.label: (r.review_id, r.text, r.distance)
           for r in G.central_reviews(df, G.centers(df), 1, texts, "euclidean").collect()}
    assert out == {0: (1, "is", 0.0), 1: (4, "test", 0.0)}


def test_central_indices_fixture(spark):
    D = [[1, 8], [2, 7], [3, 6], [4, 5]]
    rows = [(i, c, float(D[i][c])) for i in range(4) for c in range(2)]
    dist = spark.createDataFrame(rows, "review_id bigint, center_label int, distance double")
    sizes = spark.createDataFrame([(0, 2), (1, 2)], "label int, n bigint")
    out = {r.label: (r.review_id, r.distance) for r in G.central_indices(dist, 1, sizes).collect()}
    assert out == {0: (0, 1.0), 1: (3, 5.0)}
    # k is capped by the cluster size, candidates are all rows
    small = spark.createDataFrame([(0, 1), (1, 3)], "label int, n bigint")
    got = sorted((r.label, r.rank) for r in G.central_indices(dist, 3, small).collect())
    assert got == [(0, 1), (1, 1), (1, 2), (1, 3)]


@pytest.mark.parametrize("metric,all_d,own_d", [
    ("cosine", [[0, 1], [0, 1]], [0, 1]),
    ("euclidean", [[0, math.sqrt(2)], [1, math.sqrt(5)]], [0, math.sqrt(5)]),
    ("mahalanobis", [[0, math.sqrt(4)], [1, math.sqrt(10)]], [0, math.sqrt(10)]),
])
def test_distances_fixture(spark, metric, all_d, own_d):
    df = _vec(spark, [[0, 1], [0, 2]], [0, 1])
    centers = [(0, [0.0, 1.0]), (1, [1.0, 0.0])]
    prec = {0: [[1.0, 0.0], [0.0, 1.0]], 1: [[2.0, 0.0], [0.0, 2.0]]} if metric == "mahalanobis" else None
    got = {(r.review_id, r.center_label): r.distance for r in G.distances(df, centers, metric, prec).collect()}
    for i in range(2):
        for c in range(2):
            assert abs(got[(i, c)] - all_d[i][c]) < 1e-9
    own = {r.review_id: r.distance for r in G.own_center_distance(df, centers, metric, prec).collect()}
    assert abs(own[0] - own_d[0]) < 1e-9 and abs(own[1] - own_d[1]) < 1e-9


def test_zero_vector_cosine_distance_is_one(spark):
    df = _vec(spark, [[0, 0]], [0])
    assert G.distances(df, [(0, [1.0, 0.0])], "cosine").first().distance == 1.0


def test_precision_shapes(spark):
    sph = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "label int, value double")
    got = {r.label: [list(x) for x in r.vi] for r in G.format_precisions(sph, "spherical", 2).collect()}
    assert got == {0: [[1, 0], [0, 1]], 1: [[2, 0], [0, 2]], 2: [[3, 0], [0, 3]]}
    dg = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 3.0])], "label int, value array<double>")
    got = {r.label: [list(x) for x in r.vi] for r in G.format_precisions(dg, "diag", 2).collect()}
    assert got == {0: [[1, 0], [0, 2]], 1: [[2, 0], [0, 3]]}
    tied = spark.createDataFrame([([[0.0, 1.0], [2.0, 3.0]],)], "vi array<array<double>>")
    got = {r.label: [list(x) for x in r.vi] for r in G.format_precisions(tied, "tied", 2, [0, 1, 2]).collect()}
    assert got == {i: [[0, 1], [2, 3]] for i in range(3)}
    full = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0]])], "label int, vi array<array<double>>")
    assert [list(x) for x in G.format_precisions(full, "full", 2).first().vi] == [[1, 2], [3, 4]]


def _brute_silhouette(X, lab, metric):
    X = np.asarray(X, float)
    if metric == "cosine":
        U = X / np.linalg.norm(X, axis=1, keepdims=True)
        D = 1 - U @ U.T
    else:
        D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    out = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = D[i, own & (np.arange(len(X)) != i)].mean()
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_silhouettes_match_pairwise_definition(spark, metric):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 5))
    lab = rng.integers(0, 4, size=60)
    lab[0] = 4  # a singleton cluster scores 0
    df = _vec(spark, X, lab)
    got = {r.review_id: r.silhouette for r in G.silhouette_samples(df, metric=metric).collect()}
    ref = _brute_silhouette(X, lab, metric)
    assert np.allclose([got[i] for i in range(60)], ref, atol=1e-9)
    assert abs(G.silhouette_score(df, metric=metric) - ref.mean()) < 1e-9


def test_assign_update_inertia(spark):
    X = np.array([[1, 0.1], [0.9, 0], [0, 1], [0.1, 1.2]])
    df = _vec(spark, X)
    cen = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    a = G.assign(df, cen, "cosine")
    assert [r.label for r in a.orderBy("review_id").collect()] == [0, 0, 1, 1]
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    assert abs(G.inertia(a) - float(np.sum(1 - np.max(U @ np.eye(2), axis=1)))) < 1e-12
    new = _centers(G.update_centers(a))
    assert np.allclose(new[0], U[:2].mean(0)) and np.allclose(new[1], U[2:].mean(0))
    # ties go to the lowest label
    tie = G.assign(_vec(spark, [[1, 1]]), [(3, [1.0, 0.0]), (1, [0.0, 1.0])], "cosine").first()
    assert tie.label == 1


def test_merge_fixture(spark):
    X = [[0, 0], [1, 1], [2, 2], [2, 2], [3, 3]]
    df = _vec(spark, X, [0, 1, 0, 2, 1])
    m = G.merge_clusters(df, [1, 2])
    assert [r.label for r in m.orderBy("review_id").collect()] == [0, 1, 0, 1, 1]
    assert _centers(G.centers(m)) == {0: [1.0, 1.0], 1: [2.0, 2.0]}
    assert G.merge_map([0, 1, 2], [2, 0]) == {0: 1, 1: 0, 2: 1}
    with pytest.raises(ValueError):
        G.merge_map([0, 1, 2], [[0, 1], [1, 2]])


def test_center_matrix_and_density(spark):
    X = np.random.default_rng(1).normal(size=(40, 3))
    lab = np.array([0] * 20 + [1] * 20)
    df = _vec(spark, X, lab)
    c = G.centers(df)
    m = {(r.label, r.center_label): r.distance for r in G.center_distance_matrix(c, "euclidean").collect()}
    C = np.array([X[lab == 0].mean(0), X[lab == 1].mean(0)])
    assert abs(m[(0, 1)] - np.linalg.norm(C[0] - C[1])) < 1e-9 and m[(0, 0)] == 0.0
    own = G.own_center_distance(df, c, "euclidean")
    dens = G.center_distance_density(own, 5).collect()
    d = np.linalg.norm(X - C[lab], axis=1)
    lo, hi = d.min(), d.max()
    for r in dens:
        v = d[lab == r.label]
        h = v.std(ddof=1) * len(v) ** -0.2
        x = lo + (hi - lo) * r.grid / 4
        ref = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (h * len(v) * math.sqrt(2 * math.pi))
        assert abs(r.density - ref) < 1e-9


def test_silhouette_bands_and_stacked_bar(spark):
    sil = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.1), (2, 1, 0.3)], "review_id bigint, label int, silhouette double")
    y = {r.review_id: r.y for r in report.silhouette_bands(sil).collect()}
    assert y == {1: 10, 0: 11, 2: 22}
    bars = spark.createDataFrame([(0, "x", 2), (1, "x", 3), (0, "y", 1)], "s int, c string, v int")
    got = sorted((r.category, r.series, r.base, r.height) for r in report.stacked_bar(bars, "s", "c", "v").collect())
    assert got == [("x", 0, 0.0, 2.0), ("x", 1, 2.0, 3.0), ("y", 0, 0.0, 1.0)]


def test_boxplot_stats(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(0, v) for v in vals], "g int, v double")
    r = report.boxplot_stats(df, "g", "v").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (r.q1, r.median, r.q3) == (q1, med, q3)
    assert (r.whisker_low, r.whisker_high, r.outliers) == (1.0, 4.0, 1)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    sizes = {0: 1, 1: 2, 2: 7, 3: 300}
    rows = [(g, float(v)) for g, n in sizes.items() for v in rng.normal(size=n).round(3)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.p): r.value for r in report.exact_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in sizes:
        vals = np.array([v for gg, v in rows if gg == g])
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert abs(got[(g, p)] - np.quantile(vals, p)) < 1e-12


def test_quantiles_of_values_that_many_rows_share(spark):
    rows = [(0, 5.0)] * 500 + [(0, float(i)) for i in range(99)] + [(1, 2.0)] * 7 + [(None, 1.0), (None, 4.0), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(6)
    counts = report.value_counts(df, "g", "v").collect()
    assert len(counts) == 99 + 1 + 2 and {(r["_g"], r["_n"]) for r in counts} == {(0, 599), (1, 7), (None, 2)}
    got = {(r.g, r.p): r.value for r in report.exact_quantiles(df, "g", "v", [0.0, 0.1, 0.5, 0.93, 1.0]).collect()}
    for g in (0, 1, None):
        vals = [v for gg, v in rows if gg == g and v is not None]
        assert all(abs(got[g, p] - np.quantile(vals, p)) < 1e-12 for p in (0.0, 0.1, 0.5, 0.93, 1.0))
    box = {r.g: r for r in report.boxplot_stats(df, "g", "v").collect()}
    assert (box[0].q1, box[0].median, box[0].q3, box[0].whisker_low, box[0].outliers) == (5.0, 5.0, 5.0, 5.0, 98)


def test_full_mahalanobis_at_embedding_width(spark):
    rng = np.random.default_rng(5)
    d, k = 768, 10
    x, c = rng.normal(size=(20, d)), rng.normal(size=(k, d))
    half = rng.normal(size=(k, d, d)) / d
    vi = half @ half.transpose(0, 2, 1) + np.eye(d)
    df = spark.createDataFrame([(i, i % k, row.tolist()) for i, row in enumerate(x)] + [(99, 0, None), (98, 77, x[0].tolist())],
                               "review_id long, label int, embedding array<double>")
    centers = [(j, row.tolist()) for j, row in enumerate(c)]
    prec = {j: vi[j].tolist() for j in range(k)}
    diff = x[:, None, :] - c[None]
    want = np.sqrt(np.einsum("nkd,kde,nke->nk", diff, vi, diff))
    got = {(r.review_id, r.center_label): r.distance for r in G.distances(df, centers, "mahalanobis", prec).collect()}
    assert all(abs(got[i, j] - want[i, j]) < 1e-8 for i in range(20) for j in range(k))
    own = {r.review_id: r.distance for r in G.own_center_distance(df, centers, "mahalanobis", prec).collect()}
    assert all(abs(own[i] - want[i, i % k]) < 1e-8 for i in range(20))
    assert own[99] is None and own[98] is None  # no vector; no such centre


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(5)
    plan = lambda bound: spark.range(9).join(bounded_broadcast(df, bound), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)
    few_wide = spark.createDataFrame([(i, "x" * 1000) for i in range(5)], "id long, t string")
    plan = lambda size: spark.range(9).join(bounded_broadcast(few_wide, max_bytes=size), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(10_000) and "broadcast" not in plan(5_000)


def test_central_reviews_of_members_only(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0], 0), (1, [0.0, 2.0], 0), (2, [0.1, 0.1], 1), (3, [9.0, 9.0], 1), (4, None, 1)], "review_id bigint, embedding array<double>, label int")
    texts = df.selectExpr("review_id", "concat('t', review_id) AS text")
    centers = [(0, [0.0, 0.0]), (1, [5.0, 5.0])]
    near = lambda m: sorted((r.label, r["rank"], r.review_id, r.text) for r in G.central_reviews(df, centers, 2, texts, "euclidean", members_only=m).collect())
    assert near(True) == [(0, 1, 0, "t0"), (0, 2, 1, "t1"), (1, 1, 3, "t3"), (1, 2, 2, "t2")]
    assert near(False)[0] == (0, 1, 2, "t2")
