"""Cluster geometry: centres, distances, central reviews, silhouettes, merge.

Per-row work is a projection against centres inlined as a constant (k x d
numbers; full precision matrices are a broadcast variable); per-cluster statistics are partial aggregations
(``Summarizer`` on MLlib vectors), so a cluster holding most rows still
combines map-side. Nothing collects rows; only k-sized tables reach the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions import vectors as V
from loupe.guards import bounded_broadcast, collect_bounded

KEY = "review_id"
VEC = "embedding"


# ---------------------------------------------------------------- centres

def centers(df: DataFrame, label_col: str = "label", vec_col: str = VEC,
            normalize: bool = False) -> DataFrame:
    """G1: ``(label, center array<double>, n)``; optionally unit length."""
    agg = df.groupBy(F.col(label_col).alias("label")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col)))).alias("center"),
        F.count(F.lit(1)).alias("n"))
    if normalize:
        agg = agg.withColumn("center", V.normalize(F.col("center")))
    return agg


def collect_centers(c) -> list[tuple[int, list[float]]]:
    """Bring a centre table (k rows) to the driver, sorted by label.

    Accepts a DataFrame with ``label, center`` or a list of ``(label, vector)``.
    """
    if isinstance(c, DataFrame):
        rows = sorted(collect_bounded(c.select("label", "center"), "centre table"), key=lambda r: r["label"])
        return [(int(r["label"]), [float(v) for v in r["center"]]) for r in rows]
    return [(int(lbl), [float(v) for v in vec]) for lbl, vec in c]


def collect_sized_centers(c: DataFrame) -> tuple[list[tuple[int, list[float]]], dict[int, int]]:
    """The centres of ``c`` (label, center, n) and the size of each cluster, in one job."""
    rows = collect_bounded(c.select("label", "center", "n"), "centre table")
    return collect_centers([(r["label"], r["center"]) for r in sorted(rows, key=lambda r: r["label"])]), {
        int(r["label"]): int(r["n"]) for r in rows}


def centers_long(c: DataFrame, value_col: str = "center") -> DataFrame:
    """Centre table as ``(label, dim, value)`` rows (dim 0-based)."""
    return c.select("label", F.posexplode(value_col).alias("dim", "value"))


def normalize_rows(df: DataFrame, vec_col: str = VEC) -> DataFrame:
    """Rows scaled to unit L2 length (zero rows stay zero)."""
    return df.withColumn(vec_col, V.normalize(F.col(vec_col)))


# ---------------------------------------------------------------- distances

def precision_matrices(precisions) -> dict | None:
    """Label -> matrix (list of rows) of a ``(label, vi)`` table or a mapping."""
    if precisions is None:
        return None
    if isinstance(precisions, DataFrame):
        return {int(r["label"]): [list(map(float, row)) for row in r["vi"]]
                for r in collect_bounded(precisions.select("label", "vi"), "precision table")}
    return {int(k): [list(map(float, row)) for row in m] for k, m in precisions.items()}


def _diagonal(precisions: dict) -> bool:
    return all(V.is_diagonal(m) for m in precisions.values())


def distances(df: DataFrame, centers_, metric: str = "cosine", precisions=None,
              vec_col: str = VEC, key: str = KEY, keep=()) -> DataFrame:
    """Distance of every row to every centre, ``(key, center_label, distance)``.

    The k centres are one constant array; each row expands to k rows with
    ``inline`` - no join, no shuffle. Full precision matrices are a broadcast
    variable that a pandas UDF reads.
    """
    cl = collect_centers(centers_)
    pm = precision_matrices(precisions) if metric == "mahalanobis" else None
    x = F.col(vec_col)
    if pm and not _diagonal(pm):
        names = V.constant([label for label, _ in cl], "array<int>")
        all_centers = V.mahalanobis_udf(df.sparkSession, cl, pm)(x.cast("array<double>"))
        return df.select(F.col(key), *keep, all_centers.alias("_d")).select(F.col(key), *keep, F.inline(F.zip_with(
            names, "_d", lambda n, d: F.struct(n.alias("center_label"), d.alias("distance")))))
    C = V.centers_literal(cl, pm)
    base = df.select(F.col(key), *keep, x.alias("_x"), V.norm(x).alias("_xn"))
    dist = F.transform(C, lambda c: F.struct(
        c["label"].alias("center_label"),
        V.distance(metric, F.col("_x"), c["center"], F.col("_xn"), c["cnorm"], c["vd"] if pm else None).alias("distance")))
    return base.select(F.col(key), *keep, F.inline(dist))


def own_center_distance(df: DataFrame, centers_, metric: str = "cosine", precisions=None,
                        label_col: str = "label", vec_col: str = VEC, key: str = KEY) -> DataFrame:
    """Distance to the row's own centre, ``(key, label, distance)``.

    The centre is looked up in a constant map keyed by label: a projection.
    """
    cl = collect_centers(centers_)
    pm = precision_matrices(precisions) if metric == "mahalanobis" else None
    x = F.col(vec_col)
    if pm and not _diagonal(pm):
        own = V.own_mahalanobis_udf(df.sparkSession, cl, pm)(F.col(label_col).cast("int"), x.cast("array<double>"))
        return df.select(F.col(key), F.col(label_col).alias("label"), own.alias("distance"))
    C = V.centers_literal(cl, pm)
    lookup = F.map_from_arrays(F.transform(C, lambda c: c["label"]), C)
    own = F.element_at(lookup, F.col(label_col))
    d = V.distance(metric, x, own["center"], None, own["cnorm"], own["vd"] if pm else None)
    return df.select(F.col(key), F.col(label_col).alias("label"), d.alias("distance"))


def format_precisions(prec: DataFrame, covariance_type: str, n_features: int,
                      labels: Sequence[int] | None = None) -> DataFrame:
    """One d x d precision matrix per label, ``(label, vi)``.

    Input shapes by ``covariance_type``: ``full`` (label, matrix);
    ``spherical`` (label, value); ``diag`` (label, array); ``tied`` one row
    (matrix) repeated for each of ``labels``.
    """
    d = n_features
    idx = F.sequence(F.lit(0), F.lit(d - 1))

    def diag(values: Column) -> Column:
        return F.transform(idx, lambda i: F.transform(
            idx, lambda j: F.when(i == j, values[i]).otherwise(F.lit(0.0))))

    if covariance_type == "full":
        return prec.select("label", F.col("vi"))
    if covariance_type == "spherical":
        return prec.select("label", diag(F.array_repeat(F.col("value").cast("double"), d)).alias("vi"))
    if covariance_type == "diag":
        return prec.select("label", diag(F.col("value").cast("array<double>")).alias("vi"))
    if covariance_type == "tied":
        if labels is None:
            raise ValueError("tied precisions need the label list")
        lab = F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias("label")
        return prec.select(lab, F.col("vi"))
    raise ValueError(f"unknown covariance type {covariance_type!r}")


def matrix_long(df: DataFrame, col: str = "vi") -> DataFrame:
    """``(label, row, col, value)`` rows of a per-label matrix column."""
    r = df.select("label", F.posexplode(col).alias("row", "_r"))
    return r.select("label", "row", F.posexplode("_r").alias("col", "value"))


# ---------------------------------------------------------------- central reviews

def cluster_sizes(labels: DataFrame, label_col: str = "label") -> DataFrame:
    return labels.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def central_indices(dist: DataFrame, k: int, sizes: DataFrame | dict[int, int], key: str = KEY) -> DataFrame:
    """The k rows nearest each centre, capped by the cluster's size.

    Candidates are all rows, not only members. ``row_number() <= k`` with a
    literal k plans as a partial WindowGroupLimit (k rows per task and
    centre before the shuffle); the size cap is applied after, against the
    cluster sizes (a ``{label: n}`` of the centres, or a table).
    """
    w = Window.partitionBy("center_label").orderBy(F.col("distance"), F.col(key))
    top = dist.where("distance IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if isinstance(sizes, dict):
        pairs = V.constant([{"l": label, "n": n} for label, n in sorted(sizes.items())], "array<struct<l:int,n:bigint>>")
        capped = top.withColumn("n", F.try_element_at(F.map_from_entries(pairs), F.col("center_label")))
    else:
        capped = top.join(bounded_broadcast(sizes.select(F.col("label").alias("center_label"), "n")), "center_label")
    return (capped.where(F.col("rank") <= F.col("n"))
            .select(F.col("center_label").alias("label"), F.col(key), "distance",
                    F.col("rank").cast("bigint").alias("rank")))


def central_reviews(df: DataFrame, centers_, k: int, texts: DataFrame, metric: str = "cosine",
                    precisions=None, label_col: str = "label", vec_col: str = VEC,
                    key: str = KEY, members_only: bool = False) -> DataFrame:
    """Central ids per label with their distance and text.

    Candidates are all rows, with ``members_only`` those of the centre's own label.
    At most ``k`` x (number of centres) rows carry a text, so the text
    table is only scanned and filtered against those broadcast ids. Cluster
    sizes are the ``n`` of a centre table, else counted over the labels.
    """
    if isinstance(centers_, DataFrame) and "n" in centers_.columns:
        cl, sizes = collect_sized_centers(centers_)
    else:
        cl, sizes = collect_centers(centers_), cluster_sizes(df, label_col)
    if members_only:
        dist = own_center_distance(df, cl, metric, precisions, label_col, vec_col, key).withColumnRenamed("label", "center_label")
    else:
        dist = distances(df, cl, metric, precisions, vec_col, key)
    top = central_indices(dist, k, sizes, key)
    # the top table has at most k x (number of centres) rows, a proven bound:
    # broadcast its ids so the text table is filtered where it is scanned
    # (never shuffled), then attach the few texts
    ids = F.broadcast(top.select(key).distinct())
    found = texts.select(F.col(key), F.col("text")).join(ids, key, "left_semi")
    return top.join(found, key, "left")


def center_distance_matrix(centers_, metric: str = "cosine", precisions=None,
                           spark=None) -> DataFrame:
    """Centre x centre distances ``(label, center_label, distance)``."""
    if isinstance(centers_, DataFrame):
        cdf = centers_.select(F.col("label").alias(KEY), F.col("center").alias(VEC))
    else:
        cdf = spark.createDataFrame([(int(lbl), [float(v) for v in vec]) for lbl, vec in centers_],
                                    f"{KEY} int, {VEC} array<double>")
    out = distances(cdf, centers_, metric, precisions, vec_col=VEC, key=KEY)
    return out.withColumnRenamed(KEY, "label")


# ---------------------------------------------------------------- densities

def center_distance_density(own: DataFrame, n_grid: int = 100) -> DataFrame:
    """Gaussian kernel density of own-centre distances per label.

    Evaluated on ``n_grid`` points spanning the global min..max distance,
    bandwidth by Scott's rule (std with ddof 1 times n^-1/5). One
    aggregation for the per-label statistics (k rows), then every distance is
    one vector of kernels at the grid points, summed map-side.
    """
    stats = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                     F.stddev_samp("distance").alias("sd"))
    bounds = own.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).first()
    lo, hi = float(bounds["lo"]), float(bounds["hi"])
    grid = [lo + (hi - lo) * i / (n_grid - 1) for i in range(n_grid)] if n_grid > 1 else [lo]
    g = F.array(*[F.lit(v) for v in grid])
    j = own.join(bounded_broadcast(stats), "label")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    kernels = F.transform(g, lambda x: F.exp(-0.5 * F.pow((x - F.col("distance")) / h, 2)) / (h * F.col("n") * F.lit(math.sqrt(2 * math.pi))))
    # a label of one row, or of equal distances, has no bandwidth and so no density
    sums = (j.where((F.col("n") > 1) & (F.col("sd") > 0) & F.col("distance").isNotNull()).groupBy("label")
            .agg(vector_to_array(Summarizer.sum(array_to_vector(kernels))).alias("d")))
    return sums.select("label", F.posexplode("d").alias("grid", "density")).select("label", "grid", F.element_at(g, F.col("grid") + 1).alias("x"), "density")


# ---------------------------------------------------------------- silhouettes

def silhouette_samples(df: DataFrame, label_col: str = "label", vec_col: str = VEC,
                       metric: str = "cosine", key: str = KEY) -> DataFrame:
    """Silhouette of every row in O(n*k*d), no pairs.

    cosine: with unit rows u, cluster sums S_c and sizes n_c the mean
    distance to another cluster is 1 - u.S_c/n_c, to the own cluster (self
    excluded) ((n_c - 1) - (u.S_c - u.u))/(n_c - 1).
    sqeuclidean: with S_c and Q_c = sum |y|^2 the summed squared distance to
    cluster c is n_c|x|^2 - 2 x.S_c + Q_c.
    Rows of singleton clusters score 0, and so do rows at distance 0 from both.
    """
    if metric not in ("cosine", "sqeuclidean"):
        raise ValueError("closed-form silhouettes exist for cosine and sqeuclidean")
    x = V.normalize(F.col(vec_col)) if metric == "cosine" else F.col(vec_col)
    base = df.select(F.col(key), F.col(label_col).alias("label"), x.alias("_u"))
    stats = base.groupBy("label").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_u")))).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.sum(V.sq_norm(F.col("_u"))).alias("q"))
    stats = sorted(collect_bounded(stats, "per-label sums"), key=lambda r: r["label"])
    C = V.constant([{"label": int(r["label"]), "s": [float(v) for v in r["s"]], "n": float(r["n"]), "q": float(r["q"])} for r in stats],
                   "array<struct<label:int,s:array<double>,n:double,q:double>>")
    u = F.col("_u")
    uu = V.sq_norm(u)

    def summed(c):  # summed distance from the row to all members of c
        if metric == "cosine":
            return c["n"] - V.dot(u, c["s"])
        return c["n"] * uu - 2.0 * V.dot(u, c["s"]) + c["q"]

    per = F.transform(C, lambda c: F.struct(c["label"].alias("l"), c["n"].alias("n"),
                                            summed(c).alias("t")))
    with_per = base.select(key, "label", uu.alias("_uu"), per.alias("_per"))
    own = F.filter(F.col("_per"), lambda p: p["l"] == F.col("label"))[0]
    others = F.filter(F.col("_per"), lambda p: p["l"] != F.col("label"))
    # the self term: cosine 1 - u.u, squared euclidean 0
    self_term = (F.lit(1.0) - F.col("_uu")) if metric == "cosine" else F.lit(0.0)
    a = F.try_divide(own["t"] - self_term, own["n"] - 1)
    b = F.array_min(F.transform(others, lambda p: p["t"] / p["n"]))
    s = F.when((own["n"] <= 1) | (F.greatest(a, b) == 0), F.lit(0.0)).otherwise(
        F.try_divide(b - a, F.greatest(a, b)))
    return with_per.select(key, "label", F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def silhouette_score(df: DataFrame, label_col: str = "label", vec_col: str = VEC,
                     metric: str = "cosine") -> float:
    """Mean silhouette (same metric as the rows, unlike the reference)."""
    s = silhouette_samples(df, label_col, vec_col, metric)
    return float(s.agg(F.avg("silhouette")).first()[0])


# ---------------------------------------------------------------- assignment

def nearest(centers_: list, x: Column, metric: str = "cosine", x_norm: Column | None = None) -> Column:
    """Struct (distance, label) of the centre nearest to ``x``, the lowest label on ties."""
    return F.array_min(F.transform(V.centers_literal(centers_), lambda c: F.struct(
        V.distance(metric, x, c["center"], x_norm, c["cnorm"]).alias("distance"), c["label"].alias("label"))))


def assign(df: DataFrame, centers_, metric: str = "cosine", vec_col: str = VEC,
           key: str = KEY, keep=()) -> DataFrame:
    """C1d: nearest centre per row, lowest label on ties: ``(key, label, distance)``."""
    x = F.col(vec_col)
    base = df.select(F.col(key), *keep, x.alias("_x"), V.norm(x).alias("_xn"))
    best = nearest(collect_centers(centers_), F.col("_x"), metric, F.col("_xn"))
    return base.select(F.col(key), *keep, F.col("_x").alias(vec_col),
                       best["label"].alias("label"), best["distance"].alias("distance"))


def update_centers(assigned: DataFrame, vec_col: str = VEC) -> DataFrame:
    """C1e: mean of the *normalised* members; emptied clusters vanish."""
    return centers(normalize_rows(assigned, vec_col), "label", vec_col)


def inertia(assigned: DataFrame) -> float:
    """C1f: sum of distances to the assigned centre."""
    return float(assigned.agg(F.sum("distance")).first()[0] or 0.0)


# ---------------------------------------------------------------- merge

def merge_map(labels: Sequence[int], which) -> dict[int, int]:
    """Old label -> new label for a merge.

    ``which`` is a list of label lists, or one flat list for a single merge.
    Each group joins its first label; new labels number the surviving
    representatives densely in ascending order.
    """
    if not isinstance(which, list) or not which:
        raise ValueError("which must be a non-empty list")
    if all(isinstance(x, int) for x in which):
        which = [which]
    if not all(isinstance(g, list) and g and all(isinstance(x, int) for x in g) for g in which):
        raise ValueError("which must be a list of ints or a list of int lists")
    flat = [x for g in which for x in g]
    if len(set(flat)) != len(flat):
        raise ValueError("a label may appear in one merge group only")
    rep = {int(x): int(x) for x in labels}
    for g in which:
        for x in g[1:]:
            rep[x] = g[0]
    order = sorted(set(rep.values()))
    dense = {r: i for i, r in enumerate(order)}
    return {old: dense[r] for old, r in rep.items()}


def merge_clusters(df: DataFrame, which, label_col: str = "label") -> DataFrame:
    """Relabel rows after merging clusters (a projection via a constant map)."""
    labels = [int(r[0]) for r in collect_bounded(df.select(label_col).distinct(), "label set")]
    m = merge_map(labels, which)
    mapping = F.create_map(*[v for kv in sorted(m.items()) for v in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(label_col, F.element_at(mapping, F.col(label_col)))
