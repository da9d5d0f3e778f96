"""Registered geometry queries (G1-G7, G9-G11, C1a, C1c-f, C6, C10, E2-E4, P5-P7).

Data binding: ``embeddings`` are the review vectors (``vec_id`` key, 64
dimensions) with ``label`` as cluster label; ``vec_id = doc_id`` links a
vector to its review text. Floating outputs are rounded to 6 places in both
engines for comparison; vectors and matrices are reported in long form.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from loupe.operators import agreement, cluster, embed, geometry as G, mixture, report
from loupe.sources import tables

P = 6  # rounding places
P_INVERSE = 4  # of what inverse matrices enter
CENTRAL_K = 5
REG = 1e-6
REG_FULL = 1e-2  # clusters have fewer rows than dimensions
MERGE = [[1, 2], [5, 3, 7]]
LLOYD_STEPS = 2
DENSITY_GRID = 100


def _r(c):
    return F.round(c, P)


def _vec(spark, sf_dir):
    return tables.vectors(spark, sf_dir)


def _long(df, key, col):
    return df.select(key, F.posexplode(col).alias("dim", "value")).withColumn("value", _r(F.col("value")))


def _dist_out(df, places=P):
    return df.withColumn("distance", F.round("distance", places))


def normalize_rows(spark, sf_dir):
    return _long(G.normalize_rows(_vec(spark, sf_dir)), "review_id", "embedding")


def centers(spark, sf_dir):
    return _long(G.centers(_vec(spark, sf_dir)), "label", "center")


def centers_normalized(spark, sf_dir):
    return _long(G.centers(_vec(spark, sf_dir), normalize=True), "label", "center")


def distances_cosine(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _dist_out(G.distances(v, G.centers(v), "cosine"))


def distances_euclidean(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _dist_out(G.distances(v, G.centers(v), "euclidean"))


def _label_stats(v):
    """Per-label mean, population variance and count (one partial aggregation)."""
    s = v.groupBy("label").agg(
        vector_to_array(Summarizer.variance(array_to_vector(F.col("embedding")))).alias("var"),
        F.count(F.lit(1)).alias("n"))
    # Summarizer's variance has ddof 1
    return s.select("label", "n", F.transform("var", lambda x: x * (F.col("n") - 1) / F.col("n")).alias("var"))


def _diag_precisions(v):
    st = _label_stats(v)
    return st.select("label", F.transform("var", lambda x: F.lit(1.0) / (x + F.lit(REG))).alias("value"))


def distances_mahalanobis(spark, sf_dir):
    v = _vec(spark, sf_dir)
    prec = G.format_precisions(_diag_precisions(v), "diag", 64)
    return _dist_out(G.distances(v, G.centers(v), "mahalanobis", precisions=prec))


def _full_precisions(v):
    """Inverse of each cluster's covariance matrix."""
    prec = mixture.precision_matrices(mixture.from_labels(v, "full", reg_covar=REG_FULL))
    return v.sparkSession.createDataFrame(sorted(prec.items()), "label int, vi array<array<double>>")


def distances_mahalanobis_full(spark, sf_dir):
    v = _vec(spark, sf_dir)
    prec = G.format_precisions(_full_precisions(v), "full", 64)
    return _dist_out(G.distances(v, G.centers(v), "mahalanobis", precisions=prec), P_INVERSE)


def own_center_distance_mahalanobis(spark, sf_dir):
    v = _vec(spark, sf_dir)
    prec = G.format_precisions(_full_precisions(v), "full", 64)
    return _dist_out(G.own_center_distance(v, G.centers(v), "mahalanobis", precisions=prec), P_INVERSE)


def own_center_distance(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _dist_out(G.own_center_distance(v, G.centers(v), "cosine"))


def _prec_long(df, places=P):
    return G.matrix_long(df).withColumn("value", F.round("value", places))


def precisions_diag(spark, sf_dir):
    return _prec_long(G.format_precisions(_diag_precisions(_vec(spark, sf_dir)), "diag", 64))


def precisions_spherical(spark, sf_dir):
    st = _label_stats(_vec(spark, sf_dir))
    sph = st.select("label", (F.lit(1.0) / (F.aggregate("var", F.lit(0.0), lambda a, x: a + x) / F.size("var")
                                            + F.lit(REG))).alias("value"))
    return _prec_long(G.format_precisions(sph, "spherical", 64))


def precisions_tied(spark, sf_dir):
    v = _vec(spark, sf_dir)
    st = _label_stats(v)
    labels = [r[0] for r in st.select("label").orderBy("label").collect()]
    # pooled within-label variance per dimension
    pooled = st.select(F.posexplode(F.transform("var", lambda x: x * F.col("n"))).alias("dim", "w"), "n") \
        .groupBy("dim").agg((F.sum("w") / F.sum("n")).alias("pv"))
    d = 64
    tied = pooled.agg(F.sort_array(F.collect_list(F.struct("dim", "pv"))).alias("s")).select(
        F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.transform(
            F.sequence(F.lit(0), F.lit(d - 1)),
            lambda j: F.when(i == j, F.lit(1.0) / (F.col("s")[i]["pv"] + F.lit(REG))).otherwise(F.lit(0.0))))
        .alias("vi"))
    return _prec_long(G.format_precisions(tied, "tied", d, labels))


def precisions_full(spark, sf_dir):
    return _prec_long(G.format_precisions(_full_precisions(_vec(spark, sf_dir)), "full", 64), P_INVERSE)


def central_indices(spark, sf_dir):
    v = _vec(spark, sf_dir)
    cl, sizes = G.collect_sized_centers(G.centers(v))
    return _dist_out(G.central_indices(G.distances(v, cl, "cosine"), CENTRAL_K, sizes))


def central_reviews(spark, sf_dir):
    v = _vec(spark, sf_dir)
    texts = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return _dist_out(G.central_reviews(v, G.centers(v), CENTRAL_K, texts, "cosine"))


def central_reviews_members(spark, sf_dir):
    v = _vec(spark, sf_dir)
    texts = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return _dist_out(G.central_reviews(v, G.centers(v), CENTRAL_K, texts, "cosine", members_only=True))


def center_distance_matrix(spark, sf_dir):
    return _dist_out(G.center_distance_matrix(G.centers(_vec(spark, sf_dir)), "cosine"))


def center_distance_density(spark, sf_dir):
    v = _vec(spark, sf_dir)
    own = G.own_center_distance(v, G.centers(v), "cosine")
    d = G.center_distance_density(own, DENSITY_GRID)
    return d.select("label", "grid", _r(F.col("x")).alias("x"), _r(F.col("density")).alias("density"))


def silhouette_samples(spark, sf_dir):
    s = G.silhouette_samples(_vec(spark, sf_dir), metric="cosine")
    return s.withColumn("silhouette", _r(F.col("silhouette")))


def silhouette_sqeuclidean(spark, sf_dir):
    s = G.silhouette_samples(_vec(spark, sf_dir), metric="sqeuclidean")
    return s.withColumn("silhouette", _r(F.col("silhouette")))


def silhouette_score(spark, sf_dir):
    s = G.silhouette_samples(_vec(spark, sf_dir), metric="cosine")
    return s.agg(_r(F.avg("silhouette")).alias("silhouette"))


def silhouette_bands(spark, sf_dir):
    s = G.silhouette_samples(_vec(spark, sf_dir), metric="cosine")
    return report.silhouette_bands(s).withColumn("silhouette", _r(F.col("silhouette")))


def assign_cosine(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return _dist_out(G.assign(v, G.centers(v, normalize=True), "cosine")).select("review_id", "label", "distance")


def update_centers(spark, sf_dir):
    v = _vec(spark, sf_dir)
    a = G.assign(v.drop("label"), G.centers(v, normalize=True), "cosine")
    return _long(G.update_centers(a), "label", "center")


def inertia_cosine(spark, sf_dir):
    v = _vec(spark, sf_dir)
    a = G.assign(v.drop("label"), G.centers(v, normalize=True), "cosine")
    return a.agg(_r(F.sum("distance")).alias("inertia"))


def lloyd_fixed_init(spark, sf_dir):
    v = _vec(spark, sf_dir)
    init = G.collect_centers(G.centers(v, normalize=True))
    res = cluster.lloyd(v.drop("label"), init, max_iter=LLOYD_STEPS, tol=-1.0)
    return res.labels.select("review_id", "label")


def merge_clusters(spark, sf_dir):
    return G.merge_clusters(_vec(spark, sf_dir), MERGE).select("review_id", "label")


def merge_cluster_centers(spark, sf_dir):
    return _long(G.centers(G.merge_clusters(_vec(spark, sf_dir), MERGE)), "label", "center")


def stacked_bar(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "lang")
    counts = d.join(tables.review_labels(spark, sf_dir), "review_id").groupBy("label", "lang").count()
    return report.stacked_bar(counts, "label", "lang", "count")


def selection_boxplot(spark, sf_dir):
    """P7 box-plot statistics (exact quartiles, whiskers, outliers), applied
    per label to the own-centre cosine distances; the run-level version over
    model-selection runs is ``kmeans_selection_boxplot``."""
    v = _vec(spark, sf_dir)
    own = G.own_center_distance(v, G.centers(v), "cosine")
    b = report.boxplot_stats(own, "label", "distance")
    return b.select("label", *[_r(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "outliers")


def _pool(spark, sf_dir, mode):
    v = _vec(spark, sf_dir).withColumnRenamed("review_id", "idx")
    return _long(embed.pool(v, mode, group_col="label"), "label", "embedding")


def pool_mean(spark, sf_dir):
    return _pool(spark, sf_dir, "mean")


def pool_first(spark, sf_dir):
    return _pool(spark, sf_dir, "cls")


def pool_max(spark, sf_dir):
    return _pool(spark, sf_dir, "max")


def pool_mean_sqrt_len(spark, sf_dir):
    return _pool(spark, sf_dir, "mean_sqrt_len")


def adjusted_mutual_info(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("lang", "source")
    ami = agreement.adjusted_mutual_info(d, "lang", "source")
    return spark.createDataFrame([(round(ami, P),)], "ami double")


QUERIES = {
    "normalize_rows": normalize_rows,
    "centers": centers,
    "centers_normalized": centers_normalized,
    "distances_cosine": distances_cosine,
    "distances_euclidean": distances_euclidean,
    "distances_mahalanobis": distances_mahalanobis,
    "distances_mahalanobis_full": distances_mahalanobis_full,
    "own_center_distance_mahalanobis": own_center_distance_mahalanobis,
    "own_center_distance": own_center_distance,
    "precisions_spherical": precisions_spherical,
    "precisions_diag": precisions_diag,
    "precisions_tied": precisions_tied,
    "precisions_full": precisions_full,
    "central_indices": central_indices,
    "central_reviews": central_reviews,
    "central_reviews_members": central_reviews_members,
    "center_distance_matrix": center_distance_matrix,
    "center_distance_density": center_distance_density,
    "silhouette_samples": silhouette_samples,
    "silhouette_sqeuclidean": silhouette_sqeuclidean,
    "silhouette_score": silhouette_score,
    "silhouette_bands": silhouette_bands,
    "assign_cosine": assign_cosine,
    "update_centers": update_centers,
    "inertia_cosine": inertia_cosine,
    "lloyd_fixed_init": lloyd_fixed_init,
    "merge_clusters": merge_clusters,
    "merge_cluster_centers": merge_cluster_centers,
    "stacked_bar": stacked_bar,
    "selection_boxplot": selection_boxplot,
    "pool_mean": pool_mean,
    "pool_first": pool_first,
    "pool_max": pool_max,
    "pool_mean_sqrt_len": pool_mean_sqrt_len,
    "adjusted_mutual_info": adjusted_mutual_info,
}

# --------------------------------------------------------------------------
# DuckDB SQL

_E = """e AS (SELECT vec_id AS review_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
el AS (SELECT review_id, label, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, unnest(x) AS v FROM e),
cen AS (SELECT label, dim, AVG(v) AS c FROM el GROUP BY ALL),
cv AS (SELECT label, list(c ORDER BY dim) AS cx FROM cen GROUP BY label),
nrm AS (SELECT review_id, sqrt(list_sum(list_transform(x, lambda w: w * w))) AS nx FROM e),
eln AS (SELECT el.review_id, el.label, el.dim, el.v / nrm.nx AS v FROM el JOIN nrm USING (review_id)),
en AS (SELECT e.review_id, e.label, list_transform(e.x, lambda w: w / nrm.nx) AS x FROM e JOIN nrm USING (review_id)),
var AS (SELECT label, dim, var_pop(v) AS vp, COUNT(*) AS n FROM el GROUP BY ALL),
dprec AS (SELECT label, dim, 1.0 / (vp + 1e-6) AS p FROM var)"""


def _w(*parts):
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _long_sql(src, key, col):
    return (f"SELECT {key}, CAST(generate_subscripts({col}, 1) - 1 AS INTEGER) AS dim, "
            f"round(unnest({col}), {P}) AS value FROM {src}")


def _diag_long(prec_cte):
    return (f"SELECT p.label, CAST(p.dim AS INTEGER) AS row, CAST(j AS INTEGER) AS col, "
            f"round(CASE WHEN p.dim = j THEN p.p ELSE 0.0 END, {P}) AS value "
            f"FROM {prec_cte} p, range(64) t(j)")


_COS_ALL = "SELECT e.review_id, cv.label AS center_label, 1 - list_cosine_similarity(e.x, cv.cx) AS distance FROM e, cv"
_OWN = "own AS (SELECT e.review_id, e.label, 1 - list_cosine_similarity(e.x, cv.cx) AS distance FROM e JOIN cv USING (label))"
_SIL = """pr AS (SELECT a.review_id, a.label AS la, b.label AS lb, 1 - list_cosine_similarity(a.x, b.x) AS d
         FROM e a JOIN e b ON a.review_id <> b.review_id),
mm AS (SELECT review_id, la, lb, AVG(d) AS md FROM pr GROUP BY ALL),
ab AS (SELECT review_id, la AS label, MAX(CASE WHEN la = lb THEN md END) AS a, MIN(CASE WHEN la <> lb THEN md END) AS b
       FROM mm GROUP BY ALL),
sil AS (SELECT review_id, label, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""
_ASSIGN0 = """c0 AS (SELECT label, list_transform(cx, lambda w: w / sqrt(list_sum(list_transform(cx, lambda z: z * z)))) AS cx FROM cv),
a1 AS (SELECT review_id, label, distance FROM (
         SELECT e.review_id, c0.label, 1 - list_cosine_similarity(e.x, c0.cx) AS distance,
                row_number() OVER (PARTITION BY e.review_id ORDER BY 1 - list_cosine_similarity(e.x, c0.cx), c0.label) AS rn
         FROM e, c0) WHERE rn = 1)"""
_UPD1 = """c1l AS (SELECT a1.label, eln.dim, AVG(eln.v) AS c FROM eln JOIN a1 USING (review_id) GROUP BY ALL),
c1 AS (SELECT label, list(c ORDER BY dim) AS cx FROM c1l GROUP BY label)"""
# covariances and their inverses: Newton-Schulz steps from 1 / trace, all of whose matrices are symmetric and commute
NEWTON_STEPS = 13  # from here on rounding grows


def _newton(k: int) -> str:
    return (f"s{k} AS MATERIALIZED (SELECT a.label, a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r FROM covr a JOIN x{k} b USING (label) GROUP BY a.label, a.i),\n"
            f"x{k + 1} AS MATERIALIZED (SELECT a.label, a.i, list(2 * a.r[b.i + 1] - list_dot_product(a.r, b.r) ORDER BY b.i) AS r FROM x{k} a JOIN s{k} b USING (label) GROUP BY a.label, a.i)")


_INVERSE = ",\n".join([
    f"""cov AS (SELECT a.label, a.dim AS i, b.dim AS j, AVG(a.v * b.v) - AVG(a.v) * AVG(b.v) + CASE WHEN a.dim = b.dim THEN {REG_FULL} ELSE 0 END AS c
  FROM el a JOIN el b USING (review_id) GROUP BY a.label, a.dim, b.dim)""",
    "covr AS MATERIALIZED (SELECT label, i, list(c ORDER BY j) AS r FROM cov GROUP BY ALL)",
    "x0 AS MATERIALIZED (SELECT c.label, c.i, list_transform(c.r, lambda v, p: CASE WHEN p = c.i + 1 THEN 1 / t.t ELSE 0::DOUBLE END) AS r "
    "FROM covr c JOIN (SELECT label, SUM(c) AS t FROM cov WHERE i = j GROUP BY label) t USING (label))",
    *map(_newton, range(NEWTON_STEPS)),
    f"vi AS MATERIALIZED (SELECT label, list(r ORDER BY i) AS m FROM x{NEWTON_STEPS} GROUP BY label)"])
_DIFF = "list_transform(list_zip(e.x, cv.cx), lambda z: z[1] - z[2])"
_FULL = f"round(sqrt(list_dot_product({_DIFF}, list_transform(vi.m, lambda r: list_dot_product(r, {_DIFF})))), {P_INVERSE})"
_MERGE_CASE = "CASE WHEN label IN (2) THEN 1 WHEN label IN (3, 7) THEN 5 ELSE label END"
_MERGED = f"mg AS (SELECT review_id, CAST(dense_rank() OVER (ORDER BY {_MERGE_CASE}) - 1 AS INTEGER) AS label, x FROM e)"

SQL = {
    "normalize_rows": _w(_E) + _long_sql("en", "review_id", "x"),
    "centers": _w(_E) + f"SELECT label, dim, round(c, {P}) AS value FROM cen",
    "centers_normalized": _w(_E) + (
        f"SELECT label, dim, round(c / sqrt(SUM(c * c) OVER (PARTITION BY label)), {P}) AS value FROM cen"),
    "distances_cosine": _w(_E) + f"SELECT review_id, center_label, round(distance, {P}) AS distance FROM ({_COS_ALL})",
    "distances_euclidean": _w(_E) + (
        f"SELECT e.review_id, cv.label AS center_label, round(list_distance(e.x, cv.cx), {P}) AS distance FROM e, cv"),
    "distances_mahalanobis": _w(_E) + (
        "SELECT el.review_id, cen.label AS center_label, round(sqrt(SUM((el.v - cen.c) * (el.v - cen.c) * dprec.p)), "
        f"{P}) AS distance FROM el JOIN cen ON el.dim = cen.dim JOIN dprec ON dprec.label = cen.label AND dprec.dim = cen.dim "
        "GROUP BY ALL"),
    "distances_mahalanobis_full": _w(_E, _INVERSE) + f"SELECT e.review_id, cv.label AS center_label, {_FULL} AS distance FROM e, cv JOIN vi USING (label)",
    "own_center_distance_mahalanobis": _w(_E, _INVERSE) + f"SELECT e.review_id, e.label, {_FULL} AS distance FROM e JOIN cv USING (label) JOIN vi USING (label)",
    "own_center_distance": _w(_E, _OWN) + f"SELECT review_id, label, round(distance, {P}) AS distance FROM own",
    "precisions_diag": _w(_E) + _diag_long("dprec"),
    "precisions_full": _w(_E, _INVERSE) + (
        f"SELECT label, CAST(i AS INTEGER) AS row, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS col, round(unnest(r), {P_INVERSE}) AS value FROM x{NEWTON_STEPS}"),
    "precisions_spherical": _w(_E, "sp AS (SELECT label, 1.0 / (AVG(vp) + 1e-6) AS p FROM var GROUP BY label)",
                               "spd AS (SELECT sp.label, CAST(i AS INTEGER) AS dim, sp.p FROM sp, range(64) t(i))") + _diag_long("spd"),
    "precisions_tied": _w(_E, "pool AS (SELECT dim, SUM(vp * n) / SUM(n) AS pv FROM var GROUP BY dim)",
                          "td AS (SELECT l.label, pool.dim, 1.0 / (pool.pv + 1e-6) AS p FROM pool, (SELECT DISTINCT label FROM e) l)")
    + _diag_long("td"),
    "central_indices": _w(_E) + (
        f"SELECT label, review_id, round(distance, {P}) AS distance, rank FROM ("
        "SELECT d.center_label AS label, d.review_id, d.distance, "
        "CAST(row_number() OVER (PARTITION BY d.center_label ORDER BY d.distance, d.review_id) AS BIGINT) AS rank, s.n "
        f"FROM ({_COS_ALL}) d JOIN (SELECT label, COUNT(*) AS n FROM e GROUP BY label) s ON s.label = d.center_label) "
        f"WHERE rank <= {CENTRAL_K} AND rank <= n"),
    "central_reviews": _w(_E) + (
        f"SELECT q.label, q.review_id, round(q.distance, {P}) AS distance, q.rank, doc.text FROM ("
        "SELECT d.center_label AS label, d.review_id, d.distance, "
        "CAST(row_number() OVER (PARTITION BY d.center_label ORDER BY d.distance, d.review_id) AS BIGINT) AS rank, s.n "
        f"FROM ({_COS_ALL}) d JOIN (SELECT label, COUNT(*) AS n FROM e GROUP BY label) s ON s.label = d.center_label) q "
        f"LEFT JOIN documents doc ON doc.doc_id = q.review_id WHERE q.rank <= {CENTRAL_K} AND q.rank <= q.n"),
    "central_reviews_members": _w(_E, _OWN) + (
        f"SELECT q.label, q.review_id, round(q.distance, {P}) AS distance, q.rank, doc.text FROM (SELECT *, "
        "CAST(row_number() OVER (PARTITION BY label ORDER BY distance, review_id) AS BIGINT) AS rank FROM own) q "
        f"LEFT JOIN documents doc ON doc.doc_id = q.review_id WHERE q.rank <= {CENTRAL_K}"),
    "center_distance_matrix": _w(_E) + (
        f"SELECT a.label, b.label AS center_label, round(1 - list_cosine_similarity(a.cx, b.cx), {P}) AS distance FROM cv a, cv b"),
    "center_distance_density": _w(
        _E, _OWN,
        "st AS (SELECT label, COUNT(*) AS n, stddev_samp(distance) AS sd FROM own GROUP BY label)",
        "bd AS (SELECT MIN(distance) AS lo, MAX(distance) AS hi FROM own)",
        f"g AS (SELECT CAST(i AS INTEGER) AS grid, lo + (hi - lo) * i / {DENSITY_GRID - 1} AS x FROM bd, range({DENSITY_GRID}) t(i))",
    ) + (
        f"SELECT own.label, g.grid, round(g.x, {P}) AS x, round(SUM(exp(-0.5 * pow((g.x - own.distance) / (st.sd * pow(st.n, -0.2)), 2)) "
        f"/ ((st.sd * pow(st.n, -0.2)) * st.n * sqrt(2 * pi()))), {P}) AS density "
        "FROM own JOIN st USING (label), g WHERE st.n > 1 GROUP BY own.label, g.grid, g.x"),
    "silhouette_samples": _w(_E, _SIL) + f"SELECT review_id, label, round(silhouette, {P}) AS silhouette FROM sil",
    "silhouette_sqeuclidean": _w(_E, _SIL.replace("1 - list_cosine_similarity(a.x, b.x)", "pow(list_distance(a.x, b.x), 2)"))
    + f"SELECT review_id, label, round(silhouette, {P}) AS silhouette FROM sil",
    "silhouette_score": _w(_E, _SIL) + f"SELECT round(AVG(silhouette), {P}) AS silhouette FROM sil",
    "silhouette_bands": _w(_E, _SIL,
                           "sz AS (SELECT label, COUNT(*) AS size FROM sil GROUP BY label)",
                           "off AS (SELECT label, COALESCE(SUM(size) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
                           "+ 10 * row_number() OVER (ORDER BY label) AS y_lower FROM sz)") + (
        f"SELECT s.review_id, s.label, round(s.silhouette, {P}) AS silhouette, "
        "CAST(off.y_lower + row_number() OVER (PARTITION BY s.label ORDER BY s.silhouette, s.review_id) - 1 AS BIGINT) AS y "
        "FROM sil s JOIN off USING (label)"),
    "assign_cosine": _w(_E, _ASSIGN0) + f"SELECT review_id, label, round(distance, {P}) AS distance FROM a1",
    "update_centers": _w(_E, _ASSIGN0, _UPD1) + f"SELECT label, dim, round(c, {P}) AS value FROM c1l",
    "inertia_cosine": _w(_E, _ASSIGN0) + f"SELECT round(SUM(distance), {P}) AS inertia FROM a1",
    "lloyd_fixed_init": _w(_E, _ASSIGN0, _UPD1) + (
        "SELECT review_id, label FROM (SELECT e.review_id, c1.label, row_number() OVER (PARTITION BY e.review_id "
        "ORDER BY 1 - list_cosine_similarity(e.x, c1.cx), c1.label) AS rn FROM e, c1) WHERE rn = 1"),
    "merge_clusters": _w(_E, _MERGED) + "SELECT review_id, label FROM mg",
    "merge_cluster_centers": _w(_E, _MERGED) + (
        f"SELECT label, dim, round(AVG(v), {P}) AS value FROM (SELECT label, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, "
        "unnest(x) AS v FROM mg) GROUP BY ALL"),
    "stacked_bar": (
        "WITH c AS (SELECT l.quality AS series, d.lang AS category, CAST(COUNT(*) AS DOUBLE) AS height "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL), "
        "p AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT category FROM c)) "
        "SELECT c.category, c.series, c.height, COALESCE(SUM(c.height) OVER (PARTITION BY c.category ORDER BY c.series "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base, p.position FROM c JOIN p USING (category)"),
    "selection_boxplot": _w(_E, _OWN,
                            "q AS (SELECT label, quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.5) AS median, "
                            "quantile_cont(distance, 0.75) AS q3 FROM own GROUP BY label)") + (
        f"SELECT label, round(q1, {P}) AS q1, round(median, {P}) AS median, round(q3, {P}) AS q3, "
        f"round(MIN(CASE WHEN inside THEN distance END), {P}) AS whisker_low, "
        f"round(MAX(CASE WHEN inside THEN distance END), {P}) AS whisker_high, "
        "CAST(SUM(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM ("
        "SELECT own.label, own.distance, q.q1, q.median, q.q3, "
        "(own.distance >= q.q1 - 1.5 * (q.q3 - q.q1) AND own.distance <= q.q3 + 1.5 * (q.q3 - q.q1)) AS inside "
        "FROM own JOIN q USING (label)) GROUP BY label, q1, median, q3"),
    "pool_mean": _w(_E) + f"SELECT label, dim, round(c, {P}) AS value FROM cen",
    "pool_first": _w(_E) + _long_sql("(SELECT label, arg_min(x, review_id) AS x FROM e GROUP BY label)", "label", "x"),
    "pool_max": _w(_E) + f"SELECT label, dim, round(MAX(v), {P}) AS value FROM el GROUP BY ALL",
    "pool_mean_sqrt_len": _w(_E) + f"SELECT label, dim, round(SUM(v) / sqrt(COUNT(*)), {P}) AS value FROM el GROUP BY ALL",
    "adjusted_mutual_info": """WITH c AS (SELECT lang AS u, source AS v, COUNT(*) AS nij FROM documents GROUP BY ALL),
a AS (SELECT u, SUM(nij) AS a FROM c GROUP BY u),
b AS (SELECT v, SUM(nij) AS b FROM c GROUP BY v),
t AS (SELECT CAST(SUM(nij) AS DOUBLE) AS n FROM c),
mi AS (SELECT greatest(SUM((c.nij / t.n) * (ln(c.nij) + ln(t.n) - ln(a.a) - ln(b.b))), 0) AS mi FROM c JOIN a USING (u) JOIN b USING (v), t),
hu AS (SELECT -SUM((a / t.n) * ln(a / t.n)) AS hu FROM a, t),
hv AS (SELECT -SUM((b / t.n) * ln(b / t.n)) AS hv FROM b, t),
ij AS (SELECT CAST(a.a AS DOUBLE) AS a, CAST(b.b AS DOUBLE) AS b, t.n,
              unnest(range(CAST(greatest(1, a.a + b.b - t.n) AS BIGINT), CAST(least(a.a, b.b) AS BIGINT) + 1)) AS nij FROM a, b, t),
emi AS (SELECT SUM((nij / n) * (ln(n * nij) - ln(a) - ln(b)) * exp(
          lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(nij + 1)
          - lgamma(a - nij + 1) - lgamma(b - nij + 1) - lgamma(n - a - b + nij + 1))) AS emi FROM ij)
SELECT round((mi - emi) / CASE WHEN (hu + hv) / 2 - emi < 0 THEN least((hu + hv) / 2 - emi, -2.220446049250313e-16)
                               ELSE greatest((hu + hv) / 2 - emi, 2.220446049250313e-16) END, 6) AS ami
FROM mi, hu, hv, emi""",
}
