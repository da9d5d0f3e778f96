"""Registered model-fitting queries (C1, C2, C3, C4, C5, C9, E1, P7 over runs).

Whole iterative fits have no SQL equivalent: the driver's check is rows-only and
the value checks (AMI on the circle fixture, cost identities, agreement with
MLlib) live in ``tests/``. Their parts have: mixtures of given clusters, one EM
step from them, their likelihood and criteria, and labels by saved and loaded
models are compared with SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loupe.functions.text import words
from loupe.operators import cluster, embed, estimators, mixture, report, selection
from loupe.operators import geometry as G
from loupe.plans.vector_queries import _E, _w
from loupe.session import checkpoint_dir
from loupe.sources import tables

K = 10
SEED = 42
REG = 1e-6
P = 6  # rounding places
LLOYD_MOST, LLOYD_TOL = 5, 1.0


def _vec(spark, sf_dir):
    return tables.vectors(spark, sf_dir)


def spherical_kmeans(spark, sf_dir):
    res = cluster.spherical_kmeans(_vec(spark, sf_dir), k=K, n_init=3, seed=SEED)
    return res.labels


def kmeans_euclidean(spark, sf_dir):
    return cluster.kmeans(_vec(spark, sf_dir), k=K, n_init=2, seed=SEED).labels


def gaussian_mixture(spark, sf_dir):
    return mixture.gaussian_mixture(_vec(spark, sf_dir), K, "full", seed=SEED)[1]


def gaussian_mixture_diag(spark, sf_dir):
    return mixture.gaussian_mixture(_vec(spark, sf_dir), K, "diag", seed=SEED)[1]


def em_selection(spark, sf_dir):
    _, _, _, means = selection.em_selection(_vec(spark, sf_dir), [8, 10], seed=SEED)
    return means


def kmeans_selection(spark, sf_dir):
    return selection.kmeans_selection(_vec(spark, sf_dir), [8, 10, 12], n_runs=2, seed=SEED)[1]


def kmeans_selection_boxplot(spark, sf_dir):
    runs, _ = selection.kmeans_selection(_vec(spark, sf_dir), [8, 10], n_runs=3, seed=SEED)
    return report.boxplot_stats(runs, "k", "inertia")


def clustering_benchmark(spark, sf_dir):
    v = _vec(spark, sf_dir)
    truth = v.select("review_id", F.col("label").alias("true_label"))
    models = {"spherical_kmeans": [{"k": 8}, {"k": 10}],
              "estimator": (estimators.CenterClustering, [{"k": 10}]),
              "kmeans": [{"k": 10}],
              "gaussian_mixture": [{"n_components": 10, "covariance_type": "diag"}]}
    return selection.clustering_benchmark({"embeddings": v.drop("label")}, models, truth, seed=SEED, parallel=2)


def embed_tfidf(spark, sf_dir):
    rv = tables.reviews(spark, sf_dir).select("review_id", words("text").alias("words"))
    return embed.tfidf_embeddings(rv, num_features=256)


def _saved_and_loaded(spark, model):
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def mixture_roundtrip(spark, sf_dir):
    """Labels by the diagonal mixture of the given clusters, after saving and loading it."""
    v = _vec(spark, sf_dir)
    model = _saved_and_loaded(spark, estimators.MixtureClusters(mixture.from_labels(v, "diag", reg_covar=REG)))
    return model.transform(v.drop("label")).select("review_id", "label")


def em_step_diag(spark, sf_dir):
    """Weights, means and variances after one EM step from the given clusters."""
    v = _vec(spark, sf_dir)
    model, _ = mixture.em_step(mixture.from_labels(v, "diag", reg_covar=REG), v, REG)
    rows = [(j, float(w), [float(x) for x in m], [float(x) for x in c]) for j, (w, m, c) in enumerate(zip(model.weights, model.means, model.covariances))]
    df = spark.createDataFrame(rows, "component int, weight double, mean array<double>, variance array<double>")
    long = df.select("component", "weight", F.posexplode(F.arrays_zip("mean", "variance")).alias("dim", "z"))
    return long.select("component", "dim", *[F.round(c, P).alias(n) for c, n in (("weight", "weight"), ("z.mean", "mean"), ("z.variance", "variance"))])


def mixture_criteria(spark, sf_dir):
    """Mean log-likelihood, AIC and BIC of the mixtures of the given clusters."""
    v = _vec(spark, sf_dir)
    rows = []
    for kind in ("diag", "spherical"):
        model = mixture.from_labels(v, kind, reg_covar=REG)
        model.log_likelihood = mixture.score(model, v)
        rows.append((kind, model.n_parameters(), round(model.log_likelihood, P), round(model.aic(), 3), round(model.bic(), 3)))
    return spark.createDataFrame(rows, "cov_type string, n_parameters int, log_likelihood double, aic double, bic double")


def _first_seed(v):
    """The vector whose key draws the least number, as ``cluster.parallel_seeds`` begins."""
    first = v.agg(F.min_by("embedding", F.struct(cluster.draw(SEED, 0, "review_id"), F.col("review_id")))).first()[0]
    return [(0, list(first))]


def seeding_round(spark, sf_dir):
    """Candidates of the first round of own seeding: rows drawn by their distance from the first one."""
    v = G.normalize_rows(_vec(spark, sf_dir))
    drawn = cluster.seeding_round(v, _first_seed(v), 2.0 * K, SEED, 1)
    return drawn.select("review_id", F.round("cost", P).alias("cost"))


def lloyd_converged(spark, sf_dir):
    """Labels when the inertia of iterations from the given clusters' unit centres improves by less than ``LLOYD_TOL``."""
    v = _vec(spark, sf_dir)
    return cluster.lloyd(v.drop("label"), G.centers(v, normalize=True), max_iter=LLOYD_MOST, tol=LLOYD_TOL).labels.select("review_id", "label")


def seeded_kmeans(spark, sf_dir):
    return cluster.seeded_kmeans(_vec(spark, sf_dir), k=K, n_init=2, seed=SEED).labels.select("review_id", "label")


QUERIES = {
    "seeding_round": seeding_round,
    "lloyd_converged": lloyd_converged,
    "seeded_kmeans": seeded_kmeans,
    "mixture_roundtrip": mixture_roundtrip,
    "em_step_diag": em_step_diag,
    "mixture_criteria": mixture_criteria,
    "spherical_kmeans": spherical_kmeans,
    "kmeans_euclidean": kmeans_euclidean,
    "gaussian_mixture": gaussian_mixture,
    "gaussian_mixture_diag": gaussian_mixture_diag,
    "em_selection": em_selection,
    "kmeans_selection": kmeans_selection,
    "kmeans_selection_boxplot": kmeans_selection_boxplot,
    "clustering_benchmark": clustering_benchmark,
    "embed_tfidf": embed_tfidf,
}

# weighted log densities of all rows under the mixture of the given clusters
_DENSITIES = (
    f"par AS (SELECT label, dim, avg(v) AS m, var_pop(v) + {REG} AS s, count(*) AS n FROM el GROUP BY ALL)",
    "tot AS (SELECT count(*)::DOUBLE AS n FROM e)",
)
_LP = """lp AS (SELECT el.review_id, p.label, ln(any_value(p.n) / any_value(tot.n)) - 0.5 * sum(ln(2 * pi()) + ln(p.s) + (el.v - p.m) ** 2 / p.s) AS lp
  FROM el JOIN {par} p ON p.dim = el.dim, tot GROUP BY ALL)"""
_RESP = """mx AS (SELECT review_id, max(lp) AS top FROM lp GROUP BY ALL),
ll AS (SELECT review_id, any_value(top) + ln(sum(exp(lp - top))) AS ll FROM lp JOIN mx USING (review_id) GROUP BY ALL),
resp AS (SELECT review_id, label, exp(lp - ll) AS r FROM lp JOIN ll USING (review_id))"""
_SPHERICAL = "par_s AS (SELECT label, dim, m, avg(s) OVER (PARTITION BY label) AS s, n FROM par)"


def _criteria(kind: str, par: str, covariances: str) -> str:
    size = "(SELECT count(DISTINCT label) FROM e) AS k, (SELECT len(any_value(x)) FROM e) AS d, (SELECT n FROM tot) AS n"
    return (f"SELECT '{kind}' AS cov_type, ({covariances} + k * d + k - 1)::INTEGER AS p, n, ll FROM (SELECT {size}), "
            f"(WITH {_LP.format(par=par)}, {_RESP} SELECT avg(ll) AS ll FROM ll)")


def _draw(turn: int) -> str:
    return f"CAST('0x' || substr(md5('{SEED}-{turn}-' || review_id), 1, 13) AS BIGINT) / 16 ** 13"


def _lloyd_steps() -> str:
    """Assignments a1.. from the unit centres of the given clusters, and their inertias i1.."""
    steps = ["m0 AS (SELECT label, list(c ORDER BY dim) AS cx FROM cen GROUP BY label)"]
    for t in range(1, LLOYD_MOST + 1):
        steps += [
            f"""a{t} AS MATERIALIZED (SELECT review_id, label, d FROM (SELECT e.review_id, m.label, 1 - list_cosine_similarity(e.x, m.cx) AS d,
  row_number() OVER (PARTITION BY e.review_id ORDER BY 1 - list_cosine_similarity(e.x, m.cx), m.label) AS rn FROM e, m{t - 1} m) WHERE rn = 1)""",
            f"i{t} AS (SELECT sum(d) AS i FROM a{t})",
            f"""m{t} AS MATERIALIZED (SELECT label, list(c ORDER BY dim) AS cx FROM (SELECT a.label, eln.dim, avg(eln.v) AS c
  FROM eln JOIN a{t} a USING (review_id) GROUP BY a.label, eln.dim) GROUP BY label)"""]
    stops = " ".join(f"WHEN (SELECT i FROM i{t - 1}) - (SELECT i FROM i{t}) < {LLOYD_TOL} THEN {t}" for t in range(2, LLOYD_MOST))
    steps.append(f"stop AS (SELECT CASE {stops} ELSE {LLOYD_MOST} END AS t)")
    steps.append("runs AS (" + " UNION ALL ".join(f"SELECT {t} AS t, review_id, label FROM a{t}" for t in range(1, LLOYD_MOST + 1)) + ")")
    return ",\n".join(steps)


SQL: dict[str, str] = {
    "seeding_round": _w(
        _E, f"first AS (SELECT x FROM e ORDER BY {_draw(0)}, review_id LIMIT 1)",
        "c AS (SELECT e.review_id, 1 - list_cosine_similarity(e.x, first.x) AS cost FROM e, first)",
    ) + f"SELECT review_id, round(cost, {P}) AS cost FROM c WHERE {_draw(1)} < {2.0 * K} * cost / (SELECT sum(cost) FROM c)",
    "lloyd_converged": _w(_E, _lloyd_steps()) + "SELECT review_id, label FROM runs JOIN stop USING (t)",
    "mixture_roundtrip": _w(_E, *_DENSITIES, _LP.format(par="par")) + "SELECT review_id, arg_max(label, lp) AS label FROM lp GROUP BY review_id",
    "em_step_diag": _w(_E, *_DENSITIES, _LP.format(par="par"), _RESP) + (
        f"SELECT r.label AS component, el.dim, round(sum(r.r) / any_value(tot.n), {P}) AS weight, round(sum(r.r * el.v) / sum(r.r), {P}) AS mean, "
        f"round(sum(r.r * el.v * el.v) / sum(r.r) - (sum(r.r * el.v) / sum(r.r)) ** 2 + {REG}, {P}) AS variance "
        "FROM resp r JOIN el USING (review_id), tot GROUP BY r.label, el.dim"),
    "mixture_criteria": _w(_E, *_DENSITIES, _SPHERICAL) + (
        f"SELECT cov_type, p AS n_parameters, round(ll, {P}) AS log_likelihood, round(-2 * ll * n + 2 * p, 3) AS aic, round(-2 * ll * n + p * ln(n), 3) AS bic "
        f"FROM ({_criteria('diag', 'par', 'k * d')} UNION ALL {_criteria('spherical', 'par_s', 'k')})"),
}
