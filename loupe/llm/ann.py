"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and
a fast Hadamard transform) and assigns each to the nearest signed axis. A query
looks in the ``PROBES`` best axes of each of ``TABLES`` tables; what it finds
is ranked exactly, by inner product in double precision on the vectors as
given. Every vector is indexed. Vectors of unlike norm are kept in bands of
about the same norm, so that direction alone decides within a bucket; a query
probes all bands.

The probes reach ``REACH`` of the vectors up to some angle (measured on random
pairs). The best found so far tell how wide an angle may matter in a band: where
a vector beyond the reach could still be among the best ``k``, as in bands of
larger norm, and in all bands for a query with fewer than ``k`` found, the query
is compared with the whole band.

Buckets are split into cells of about ``CELL`` vectors and queries into sets of
about ``CELL`` queries (by their counted sizes), so a bucket that holds a third
of all vectors is many cells, and a cell gives each query its best ``k`` only.

Vectors that are null, zero, or hold a null or non-finite component take no
part. Shorter vectors count as filled up with zeros. Equal scores go to the
smaller id. Equal rows are one row; unlike rows that repeat an id are kept apart
in the index. A query never finds rows of its own id, and of rows with one id
the best counts, before anything is cut to ``k``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

TABLES, PROBES, CELL = 8, 16, 4096
K, EVERY = 20, 20
REACH = 0.95
_BAND = np.log(1.25)


def _valid(vec: str):
    x = F.col(vec)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(x, lambda v: v != 0), F.lit(False))


def _rotate(x: np.ndarray, table: int) -> np.ndarray:
    n = x.shape[1]
    signs = np.random.Generator(np.random.Philox(77 + table)).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x, h = x * s, 1
        while h < n:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(1, keepdims=True)
    norm = np.linalg.norm(x / top, axis=1, keepdims=True)
    return x / top / norm, (np.log(top) + np.log(norm))[:, 0]


def _axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    r = _rotate(unit, table)
    both = np.concatenate([r, -r], 1)
    if probes == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, 1, kind="stable")[:, :probes]


def _addresses(width: int, tables: int, probes: int):
    def find(vectors: pd.Series) -> pd.DataFrame:
        unit, ln = _unit(_matrix(vectors, width)) if len(vectors) else (np.empty((0, width)), np.empty(0))
        at = np.concatenate([_axes(unit, t, probes) + t * 2 * width for t in range(tables)], 1) if len(unit) else np.empty((0, tables), int)
        return pd.DataFrame({"band": np.floor(ln / _BAND + 0.5).astype(np.int64), "ln": ln, "at": list(at.astype(np.int32))})
    return F.pandas_udf(find, "band int, ln double, at array<int>")


def _reach(size: int, width: int, tables: int, probes: int) -> float:
    """The cosine from which on the probes find ``REACH`` of the vectors, measured on random pairs."""
    if probes >= 2 * width:
        return 0.0
    rng = np.random.Generator(np.random.Philox(5))
    x, y = np.zeros((2, 1000, width))
    x[:, :size], y[:, :size] = rng.standard_normal((2, 1000, size))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    low, high = 0.0, 1.0
    for _ in range(7):
        c = (low + high) / 2
        q = c * x + np.sqrt(1 - c * c) * y
        hit = np.zeros(len(x), bool)
        for t in range(tables):
            hit |= (_axes(q, t, probes) == _axes(x, t, 1)).any(1)
        low, high = (low, c) if hit.mean() >= REACH else (c, high)
    return high


def _top(k: int, own, ids: np.ndarray, scores: np.ndarray):
    """(ids, scores) of the ``k`` best different ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    keep = order[np.sort(first)[:k]]
    return np.full(len(keep), own), ids[keep], scores[keep]


def _best(k: int, width: int):
    def best(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            p = p.sort_values("id", kind="stable")
            x, ids = _matrix(p["vec"], width), p["id"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for a in range(0, len(q), 256):
                y = _matrix(q["vec"][a:a + 256], width)
                s = y @ x.T
                for i, own in enumerate(q["id"][a:a + 256]):
                    row = np.where(ids == own, -np.inf, s[i])
                    each = np.maximum.reduceat(row, starts) if len(starts) < len(row) else row  # the best of each id
                    edge = np.partition(each, len(each) - k)[len(each) - k] if len(each) > k else -np.inf
                    # all that may be among the best k; then their products summed in one fixed order
                    near = np.flatnonzero((row >= edge - 1e-9 * max(1.0, abs(edge))) & (ids != own)) if edge > -np.inf else np.flatnonzero(ids != own)
                    out.append(_top(k, own, ids[near], (x[near] * y[i]).sum(1)))
        return _found(out)
    return best


def _found(parts) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0) for c, v in zip(("query_id", "vec_id", "score"), list(zip(*parts)) or [()] * 3)})


def _fewer(k: int, rows: int = 1_000_000):
    """Cuts a partition's finds to the ``k`` best different ids of each query, before they are shuffled."""
    def cut(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return df[df.groupby("query_id").cumcount() < k]

    def fewer(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= rows:
                one = cut(pd.concat(held))
                if len(one) > rows // 2:  # little is saved by holding on to them
                    yield one
                    one = one[:0]
                held, size = [one], len(one)
        if held:
            yield cut(pd.concat(held))
    return fewer


def _compare(points: DataFrame, queries: DataFrame, on: list[str], k: int, size: int, cell: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best of each bucket (band, at) of ``points`` for the queries that meet it ``on`` its columns."""
    # a row per bucket: sizes that the parameters bound
    held = points.groupBy("band", "at").agg(F.count(F.lit(1)).alias("np"))
    want = queries.groupBy(*on).agg(F.count(F.lit(1)).alias("nq"))
    cells = C.keep(held.join(want, on).select("band", "at", F.ceil(F.col("np") / cell).cast("int").alias("np"),
                                              F.ceil(F.col("nq") / cell).cast("int").alias("nq")))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["band", "at", "i", "j"]
    p = points.join(cells, ["band", "at"]).withColumn("i", F.pmod(F.xxhash64("id", "vec"), F.col("np")).cast("int")).withColumn("j", copies("nq"))
    q = queries.join(cells, on).withColumn("j", F.pmod(F.xxhash64("id", "vec"), F.col("nq")).cast("int")).withColumn("i", copies("np"))
    found = q.select(*key, "id", "vec").groupBy(*key).cogroup(p.select(*key, "id", "vec").groupBy(*key)).applyInPandas(
        _best(k, size), "query_id long, vec_id long, score double")
    return found.mapInPandas(_fewer(k), found.schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score, rank)``: the best of each id, then the best ``k``."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
           tables: int = TABLES, probes: int = PROBES, cell: int = CELL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` neighbours found per row for which ``is_query`` holds."""
    C.prepare(vectors.sparkSession)
    # single precision is carried as it is, half the bytes; every sum is in double precision
    kind = vectors.schema[vec_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & _valid("vec"))
    size = base.agg(F.max(F.size("vec"))).first()[0] or 1
    width = 1 << max(1, (size - 1).bit_length())
    probes = min(probes, 2 * width)
    # one row per different vector of an id is written; its copies are made on the way to the cells
    base = base.groupBy("id", "vec").agg(F.max("q").alias("q"))
    placed = C.keep(base.select("id", "vec", "q", _addresses(width, tables, 1)("vec").alias("a")).select("id", "vec", "q", "a.band", "a.ln", "a.at"))
    asked = C.keep(placed.where("q").select("id", "vec", "ln", _addresses(width, tables, probes)("vec")["at"].alias("at")))
    first = C.keep(_compare(placed.withColumn("at", F.explode("at")), asked.withColumn("at", F.explode("at")), ["at"], k, size, cell))
    # the bands (a few for each factor of ten between the norms) that may hold better vectors out of the probes' reach
    bands = placed.groupBy("band").agg(F.max("ln").alias("ln")).collect()
    least = _ranked(first, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    ln_reach = float(np.log(max(_reach(size, width, tables, probes), 1e-300)))
    if not bands:
        return _ranked(first, k).select("query_id", "rank", "vec_id", "score")
    open_bands = F.filter(F.array(*[F.struct(F.lit(b["band"]).alias("band"), F.lit(b["ln"]).alias("ln")) for b in bands]),
                          lambda b: F.col("least").isNull() | (F.col("least") <= 0) | (F.log("least") < F.col("ln") + b["ln"] + ln_reach))
    again = C.keep(asked.join(least, asked["id"] == least["query_id"], "left")
                   .select("id", "vec", F.explode(open_bands).alias("b")).select("id", "vec", "b.band"))
    second = _compare(placed.withColumn("at", F.lit(-1)), again, ["band"], k, size, cell)
    return _ranked(first.union(second), k).select("query_id", "rank", "vec_id", "score")


def op1_cross_polytope(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    return search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
