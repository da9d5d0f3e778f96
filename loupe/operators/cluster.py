"""Clustering: spherical / Euclidean k-means, fixed-start Lloyd iterations.

Each iteration is one distributed job: rows are assigned against centres
inlined as a constant, per-label sums combine map-side, and only the k x d
centre table returns to the driver. Iterations therefore never grow the
lineage; the input vectors are cached (recomputable from the scan if an
executor is lost).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions import vectors as V
from loupe.guards import bounded_broadcast, collect_bounded
from loupe.operators import geometry as G
from loupe.session import ship_package

KEY = "review_id"
VEC = "embedding"


@dataclass
class ClusterResult:
    labels: DataFrame                       # (review_id, label[, distance])
    centers: list                           # [(label, vector)], unit length for cosine
    inertia: float
    inertias: list = field(default_factory=list)
    n_iter: int = 0
    seeds: list = field(default_factory=list)
    rows: DataFrame | None = None           # (review_id, embedding, label): the labels joined back to the vectors by key (MLlib fits)
    dropped_zero_rows: int = 0              # zero vectors, left out of the fit and given the lowest label


def lloyd(df: DataFrame, init_centers, max_iter: int = 100, tol: float = 1e-4,
          metric: str = "cosine", vec_col: str = VEC, key: str = KEY) -> ClusterResult:
    """C1c-C1g: Lloyd iterations from given centres.

    Per iteration, over blocks of vectors that are packed once: assign each row
    to its nearest centre (lowest label on ties), sum the distances (inertia), recompute centres as the mean of the
    normalised members (cosine) or of the members (euclidean); clusters that
    empty vanish and keep no label. Stops when the inertia improves by less
    than ``tol`` or after ``max_iter`` iterations. Labels, inertia and centres
    returned belong together: each label is that of the nearest returned
    centre, and the inertia is the sum of those distances. Cosine centres are
    returned unit length. Null vectors are left out.
    """
    if max_iter < 1:
        raise ValueError("max_iter must be 1 or more")
    data = df.select(F.col(key), F.col(vec_col).alias(VEC)).where(F.col(VEC).isNotNull())
    if metric == "cosine":
        data = G.normalize_rows(data)
    source, data = data, packed(data).persist(StorageLevel.MEMORY_AND_DISK)
    centers = G.collect_centers(init_centers)
    dist = "cosine" if metric == "cosine" else "euclidean"
    prev, history = float("inf"), []
    try:
        for it in range(1, max_iter + 1):
            used = centers
            assigned = G.assign(source, used, dist, VEC, key)
            stats = _member_sums(data, used, dist)
            cur = float(sum(r["s"] for r in stats))
            history.append(cur)
            centers = [(int(r["label"]), [float(v) / r["n"] for v in r["sx"]]) for r in stats]
            if prev - cur < tol:
                break
            prev = cur
    finally:
        data.unpersist()  # labels are read from the source again
    kept = {label for label, _ in centers}
    final = [(label, _unit(vec) if metric == "cosine" else vec) for label, vec in used if label in kept]
    return ClusterResult(labels=assigned.select(key, "label", "distance"), centers=final,
                         inertia=cur, inertias=history, n_iter=it)


def packed(data: DataFrame) -> DataFrame:
    """The vectors of ``data``, an Arrow batch of them as one row ``(n, x)`` of packed doubles, for passes over all of them."""
    ship_package(data.sparkSession)

    def pack(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32()), pa.array([V.rows_of(b.column(0)).tobytes()], pa.binary())], names=["n", "x"])
    return data.select(VEC).mapInArrow(pack, "n int, x binary")


def matrices(batches):
    """The matrix of each row of ``packed``."""
    for b in batches:
        for n, x in zip(b.column(0), b.column(1)):
            yield np.frombuffer(x.as_buffer(), np.float64).reshape(n.as_py(), -1)


def _member_sums(blocks: DataFrame, centers: list, metric: str) -> list:
    """Rows (label, s, n, sx) by label: summed distance, number and vector sum of the members of each centre."""
    def sums(batches):
        found = {}
        for X in matrices(batches):
            label, distance = V.nearest_rows(X, centers, metric)
            for c in np.unique(label).tolist():
                on = label == c
                s, n, sx = found.get(c, (0.0, 0, 0.0))
                found[c] = s + float(distance[on].sum()), n + int(on.sum()), sx + X[on].sum(axis=0)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array([f[i] for f in found.values()], t) for i, t in enumerate(
                (pa.float64(), pa.int64(), pa.list_(pa.float64())))]], names=["label", "s", "n", "sx"])
    parts = blocks.mapInArrow(sums, "label int, s double, n long, sx array<double>")
    rows = parts.groupBy("label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sx"))).alias("sx")).collect()
    return sorted(rows, key=lambda r: r["label"])  # k rows, sorted on the driver


def _unit(vec):
    n = sum(v * v for v in vec) ** 0.5
    return [v / n for v in vec] if n > 0 else list(vec)


def joined_back(rows: DataFrame, key: str = KEY) -> DataFrame:
    """``rows`` (key, embedding, label) as joining the labels to the vectors by key gives them, without a shuffle of vectors.

    Rows of a key of their own stay as they are, null keys meet none; those of a
    repeated key are joined, so each meets the labels of all.
    """
    rows = rows.select(key, VEC, "label").where(F.col(key).isNotNull())
    again = rows.groupBy(key).count().where("count > 1").select(key)
    if again.isEmpty():
        return rows
    again = bounded_broadcast(again)
    several = rows.join(again, key, "left_semi")
    return rows.join(again, key, "left_anti").unionByName(several.select(key, VEC).join(several.select(key, "label"), key))


def _mllib_kmeans(df: DataFrame, k: int, n_init: int, max_iter: int, tol: float, seed: int,
                  measure: str, vec_col: str, key: str) -> ClusterResult:
    vec = F.col(vec_col).alias(VEC)
    data = df.select(F.col(key), vec, array_to_vector(F.col(vec_col)).alias("features"))
    dropped = 0
    if measure == "cosine":
        # MLlib takes no zero vectors; at distance 1 from every centre they get the lowest label
        nz = V.sq_norm(vector_to_array(F.col("features")))
        zero = data.where(nz == 0).select(key, VEC, F.lit(0).alias("label"))
        dropped = zero.count()
        data = data.where(nz > 0)
    cached = data.select(key, "features").persist(StorageLevel.MEMORY_AND_DISK)
    best = None
    inertias, seeds = [], []
    try:
        for run in range(n_init):
            s = seed + run
            model = KMeans(k=k, maxIter=max_iter, tol=tol, seed=s, distanceMeasure=measure,
                           featuresCol="features", predictionCol="label").fit(cached)
            cost = float(model.summary.trainingCost) + dropped
            inertias.append(cost)
            seeds.append(s)
            if best is None or cost < best[0]:
                best = (cost, model)
    finally:
        cached.unpersist()
    cost, model = best
    rows = model.transform(data).select(F.col(key), VEC, F.col("label"))
    if dropped:
        rows = rows.unionByName(zero)
    centers = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    if measure == "cosine":
        centers = [(i, _unit(c)) for i, c in centers]
    return ClusterResult(labels=rows.select(key, "label"), rows=rows, centers=centers, inertia=cost, inertias=inertias,
                         n_iter=int(model.summary.numIter), seeds=seeds, dropped_zero_rows=dropped)


# ---------------------------------------------------------------- own seeding

def draw(seed: int, turn: int, key: str) -> Column:
    """A number in [0, 1) for each key: 52 bits of an MD5, the same on any partitioning."""
    text = F.concat_ws("-", F.lit(str(seed)), F.lit(str(turn)), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _costs(data: DataFrame, centers: list, metric: str, key: str) -> DataFrame:
    """``(key, embedding, cost)``: each vector's distance to the centre nearest to it; a null vector's is 1 by cosine, else null."""
    ship_package(data.sparkSession)
    measure = "cosine" if metric == "cosine" else "sqeuclidean"

    def cost(batches):
        for b in batches:
            there = b.column(1).is_valid()
            known = there.to_numpy(zero_copy_only=False)
            out = np.ones(len(b))
            out[known] = V.nearest_rows(V.rows_of(b.column(1).filter(there)), centers, measure)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~known if measure != "cosine" else None)], names=[key, VEC, "cost"])
    schema = data.select(key, VEC).schema.add("cost", "double")
    return data.select(key, VEC).mapInArrow(cost, schema)


def seeding_round(data: DataFrame, centers: list, wanted: float, seed: int, turn: int, metric: str = "cosine", key: str = KEY,
                  blocks: DataFrame | None = None) -> DataFrame:
    """C1b, one round of k-means||: rows ``(key, embedding, cost)`` drawn with probability ``wanted * cost / total cost``.

    ``blocks`` are the packed vectors, where a caller has them and none is null.
    """
    costs = _costs(data, centers, metric, key)
    if blocks is None:
        total = costs.agg(F.sum("cost")).first()[0] or 0.0
    else:
        total = sum(r["s"] for r in _member_sums(blocks, centers, "cosine" if metric == "cosine" else "sqeuclidean"))
    return costs.where(draw(seed, turn, key) < F.lit(float(wanted)) * F.try_divide(F.col("cost"), F.lit(float(total))))


def parallel_seeds(df: DataFrame, k: int, seed: int = 0, metric: str = "cosine", rounds: int = 5, oversample: float = 2.0,
                   vec_col: str = VEC, key: str = KEY) -> list[tuple[int, list[float]]]:
    """Starting centres by k-means|| with draws keyed by row, so a seed gives the same ones on any partitioning.

    About ``rounds * oversample * k`` candidates are drawn by their cost, weighted
    by the rows nearest to each, and reduced to ``k`` by seeded k-means++. Fewer
    come back where there are fewer different vectors. Null vectors, and for cosine
    zero ones, are no candidates.
    """
    data = df.select(F.col(key), F.col(vec_col).cast("array<double>").alias(VEC)).where(F.col(VEC).isNotNull())
    if metric == "cosine":
        data = G.normalize_rows(data.where(V.sq_norm(F.col(VEC)) > 0))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    blocks = packed(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = data.agg(F.min_by(VEC, F.struct(draw(seed, 0, key), F.col(key)))).first()[0]
        if first is None:
            return []
        points = [list(first)]
        for turn in range(1, rounds + 1):
            drawn = collect_bounded(seeding_round(data, list(enumerate(points)), oversample * k, seed, turn, metric, key, blocks), "drawn candidates")
            known = set(map(tuple, points))
            points += [list(v) for v in sorted({tuple(r[VEC]) for r in drawn} - known)]
        counts = {r["label"]: r["n"] for r in _member_sums(blocks, list(enumerate(points)), "cosine" if metric == "cosine" else "sqeuclidean")}
    finally:
        blocks.unpersist()
        data.unpersist()
    return _reduced(np.array(points), np.array([counts.get(i, 0) for i in range(len(points))], float), k, seed, metric)


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int, metric: str) -> list[tuple[int, list[float]]]:
    """``k`` of the weighted candidates by k-means++, on the driver."""
    rng, chosen, cost = np.random.default_rng(seed), [], np.ones(len(points))
    while len(chosen) < min(k, len(points)) and (weights * cost).sum() > 0:
        at = int(np.searchsorted(np.cumsum(weights * cost), rng.random() * (weights * cost).sum(), "right"))
        chosen.append(min(at, len(points) - 1))
        diff = points - points[chosen[-1]]
        new = 1 - points @ points[chosen[-1]] if metric == "cosine" else (diff * diff).sum(1)
        new[chosen[-1]] = 0
        cost = np.maximum(new, 0) if len(chosen) == 1 else np.minimum(cost, np.maximum(new, 0))
    return [(i, points[at].tolist()) for i, at in enumerate(chosen)]


def seeded_kmeans(df: DataFrame, k: int = 5, n_init: int = 1, max_iter: int = 100, tol: float = 1e-4, seed: int = 0,
                  metric: str = "cosine", vec_col: str = VEC, key: str = KEY) -> ClusterResult:
    """C1 with own seeding and Lloyd iterations: the best of ``n_init`` runs by inertia."""
    runs = [lloyd(df, parallel_seeds(df, k, seed + run, metric, vec_col=vec_col, key=key), max_iter, tol, metric, vec_col, key) for run in range(n_init)]
    best = min(runs, key=lambda r: r.inertia)
    best.inertias, best.seeds = [r.inertia for r in runs], [seed + run for run in range(n_init)]
    return best


def spherical_kmeans(df: DataFrame, k: int = 5, n_init: int = 1, max_iter: int = 100,
                     tol: float = 1e-4, seed: int = 0, vec_col: str = VEC, key: str = KEY,
                     init=None) -> ClusterResult:
    """Spherical k-means, best of ``n_init`` seeded runs by inertia.

    MLlib's cosine k-means (k-means|| seeding, one seed per run); its
    training cost is the summed cosine distance. With ``init`` centres the
    own Lloyd loop runs instead (MLlib takes no starting model).
    """
    if init is not None:
        return lloyd(df, init, max_iter, tol, "cosine", vec_col, key)
    return _mllib_kmeans(df, k, n_init, max_iter, tol, seed, "cosine", vec_col, key)


def kmeans(df: DataFrame, k: int = 8, n_init: int = 1, max_iter: int = 300, tol: float = 1e-4,
           seed: int = 0, vec_col: str = VEC, key: str = KEY) -> ClusterResult:
    """Euclidean k-means (MLlib), best of ``n_init`` runs."""
    return _mllib_kmeans(df, k, n_init, max_iter, tol, seed, "euclidean", vec_col, key)


def skmeans(df: DataFrame, vec_col: str = VEC, key: str = KEY, **kwargs) -> ClusterResult:
    """Spherical k-means kept for older results, with unit centres
    recomputed as the normalised mean of the normalised member rows (G1)."""
    res = spherical_kmeans(df, vec_col=vec_col, key=key, **kwargs)
    rows = G.normalize_rows(df.select(F.col(key), F.col(vec_col).alias(VEC))).join(res.labels.select(key, "label"), key)
    res.centers = G.collect_centers(G.centers(rows, "label", VEC, normalize=True))
    return res
