"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (all words of a shorter text). A shingle weighs
its count in the text times an inverse document frequency in [1, 2]. Document
frequencies are counted per shingle (48 bits of its hash) over all documents:
groups of documents ask the ranges of the hash for those of their shingles, so
no task holds the whole table. Improved consistent weighted sampling (Ioffe 2010)
draws ``BANDS * ROWS`` samples per text; two texts agree in a sample with the
probability of their weighted Jaccard similarity. Texts that agree in a band are
candidates, and a candidate is a link only if its exact weighted Jaccard
similarity is ``threshold`` or more. Total weights bound it, so pairs of too
unlike totals are never compared.

Buckets are never expanded into pairs. Texts with equal words are one unit. In a
bucket, all units are compared with one leader; whole buckets whose units are
then in one class are done. Buckets with up to ``PAIRS`` pairs of different classes
and ``WEIGHT`` shingles are settled pair by pair in one task each. A larger one is
dealt anew, in ``CHAINS`` ways, by ``STEP`` further samples of its units: texts of
similarity s stay together in one way with probability s ** STEP, unlike ones part.
Parts get leaders of their own and are settled in the same way, which finds most
links of a large bucket for ``CHAINS`` comparisons a unit. The dealing drops pairs, so
what is left is exact: in every large bucket all pairs of units of different classes
are taken, block against block of about ``WEIGHT`` shingles in a task each. There a
pair is compared if it shares one of the rarest shingles that hold more than 1 -
``threshold`` of a text's weight, as all links do. Classes are connected components.

Texts that are null or have no word are classes of their own. The class id is
the smallest ``doc_id`` of the class; a class without any id, or whose smallest id
another class has too (rows may repeat ids), has a negative number made from a hash
of its least row instead, unless that row's hash is the least of those classes.
Each row gives one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

WORDS, THRESHOLD = 5, 0.8
SLACK = 1e-4  # float32 weights: totals are trusted to this
BANDS, ROWS = 9, 3
SHINGLE_BITS = 48
PAIRS, WEIGHT = 100_000, 400_000  # what one task compares of a bucket, and holds of its texts
BLOCK = 2000  # units of a block at most
STEP, CHAINS = 6, 6
DEALS = 1  # of large buckets before the exact comparison of the rest
SMALL, EDGES = 60_000, 100_000  # rows (of one or two units each) that are broadcast, and links that one task connects


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, count) of the distinct shingles of each row, sorted by both; and the word hashes' row bounds."""
    h, row = C.word_hashes(data, offs)
    bounds = np.searchsorted(row, np.arange(len(offs)))
    size = np.diff(bounds)
    n = np.where(size >= WORDS, size - WORDS + 1, np.minimum(size, 1))
    r = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    width = np.minimum(size, WORDS)[r]
    s = np.full(len(r), 7, np.uint64)
    for i in range(WORDS):
        on = width > i
        s[on] = C.mix(s[on] * C.M1 + h[at[on] + i])
    # rows come in order, so one sort of (row, 48 bits of the shingle) does; a slice has fewer than 2**16 rows
    key = np.sort((r.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (s >> np.uint64(64 - SHINGLE_BITS)))
    s, r = key & np.uint64((1 << SHINGLE_BITS) - 1), (key >> np.uint64(SHINGLE_BITS)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])) if len(s) else np.empty(0, np.int64)
    return s[new], r[new], np.diff(np.append(new, len(s))), (h, bounds)


def _slices(tab: pa.Table, size: int = 500_000):
    """Parts of a table of about ``size`` bytes of text."""
    ends = C.string_buffers(tab["text"])[1][1:]
    a = 0
    while a < len(tab):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        b = min(b, a + (1 << 15))
        yield tab.slice(a, b - a)
        a = b


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency, 1 to 2, of shingles that ``df`` of ``n`` rows hold."""
    return (1 + np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32)


def _held(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a group, and how many of its rows hold each."""
    parts = [shingles(*C.string_buffers(t["text"]))[0] for t in _slices(tab)]
    return np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)


def _asker(n_ranges: int):
    def ask(tab: pa.Table) -> pa.Table:
        keys, counts = _held(tab)
        parts = C.asks(keys, n_ranges)
        return pa.table({"g": pa.array([tab["g"][0].as_py()] * len(parts), pa.int32()), "r": pa.array([p[0] for p in parts], pa.int32()),
                         "keys": pa.array([C.pack(keys[i:j], SHINGLE_BITS // 8) for _, i, j in parts], pa.binary()),
                         "counts": pa.array([C.numbers(counts[i:j]) for _, i, j in parts], pa.binary())})
    return ask


def _sum_counts(tab: pa.Table) -> pa.Table:
    keys = [C.unpack(b.as_py(), SHINGLE_BITS // 8) for b in tab["keys"]]
    counts = [C.from_numbers(b.as_py(), len(k)) for b, k in zip(tab["counts"], keys)]
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(uniq), np.int64)
    np.add.at(sums, inv, np.concatenate(counts))
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({"g": tab["g"], "r": tab["r"], "totals": pa.array([C.numbers(sums[inv[e - len(k):e]]) for k, e in zip(keys, ends)], pa.binary())})


def _tables(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c (both of Gamma(2, 1)) and beta of sample k, for 2**16 values of a shingle's hash."""
    rng = np.random.Generator(np.random.Philox(1000 + k))
    r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
    return np.maximum(r, 1e-4), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16, np.float32)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def band_hashes(s: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, first: int = 0, bands: int = BANDS, size: int = ROWS) -> np.ndarray:
    """(n_rows, bands) hashes of ``size`` ICWS samples each, numbered from ``first``; rows without shingles get 0."""
    out = np.zeros((n_rows, bands), np.uint64)
    if not len(s):
        return out
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    log_w = np.log(weight).astype(np.float32)
    for i in range(bands * size):
        k = first + i
        if k < BANDS * ROWS + CHAINS * STEP and k not in _TABLES:  # kept for the samples that every text, or every text of a large bucket, needs
            _TABLES[k] = _tables(k)
        r, ln_c, beta = _TABLES[k] if k in _TABLES else _tables(k)
        mixed = (s ^ np.uint64(k * 0x9E37)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x10001)
        at = (mixed >> np.uint64(48)).astype(np.int64)
        rs = r[at]
        t = np.floor(log_w / rs + beta[at])
        ln_a = ln_c[at] - rs * (t - beta[at] + 1)
        bits = ln_a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))  # floats in order as integers
        name = (mixed ^ (mixed >> np.uint64(20)) ^ (t.astype(np.int64).view(np.uint64) * C.M2)) & np.uint64(0xFFFFFFFF)
        least = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
        band = i // size
        out[row[starts], band] = C.mix(out[row[starts], band] * C.M1 + least + np.uint64(band + 1))
    return out


def _signer(n: int, n_ranges: int):
    def sign(tab: pa.Table, replies: pa.Table) -> pa.Table:
        keys, _ = _held(tab)
        found = dict(zip(replies["r"].to_pylist(), replies["totals"].to_pylist()))
        df = np.zeros(len(keys), np.int64)
        for r, i, j in C.asks(keys, n_ranges):
            df[i:j] = C.from_numbers(found[r], j - i)
        out = []
        for part in _slices(tab):
            data, offs = C.string_buffers(part["text"])
            s, row, count, (h, bounds) = shingles(data, offs)
            of = df[np.searchsorted(keys, s)]
            weight = (count * _idf(of, n)).astype(np.float32)
            bands = band_hashes(s, row, weight, len(part)).view(np.int64)
            total = np.bincount(row, weight, len(part)) if len(row) else np.zeros(len(part))
            units = [xxhash.xxh3_128_hexdigest(h[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
            at = np.searchsorted(row, np.arange(len(part) + 1))
            out.append(pa.table({"doc_id": part["doc_id"], "rid": part["rid"], "unit": pa.array(units, pa.string()),
                                 "bands": pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.reshape(-1)),
                                 "total": pa.array(total), "df": pa.array([C.numbers(of[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())}))
        return pa.concat_tables(out)
    return sign


def _signed(rows: DataFrame, group_bytes: int = 4_000_000, range_keys: int = 400_000) -> tuple[DataFrame, int]:
    """``(doc_id, rid, unit, bands, total, df)`` per row, and the number of rows; ``df`` has the document frequencies of the row's shingles in order."""
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n_bytes, n = int(size[0] or 0), int(size[1])
    n_groups, n_ranges = C.n_parts(n_bytes, group_bytes), C.n_parts(n_bytes / 6, range_keys)
    by_g = C.grouped(rows, n_groups, "rid").groupBy("g")
    asked = by_g.applyInArrow(_asker(n_ranges), "g int, r int, keys binary, counts binary")
    replies = asked.groupBy("r").applyInArrow(_sum_counts, "g int, r int, totals binary")
    ids = rows.schema["doc_id"].dataType.simpleString()
    return C.keep(by_g.cogroup(replies.groupBy("g")).applyInArrow(
        _signer(n, n_ranges), f"doc_id {ids}, rid long, unit string, bands array<long>, total double, df binary")), n


def _vectors(texts: pd.Series, dfs: pd.Series, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offs = C.string_buffers(pa.chunked_array([pa.array(texts, pa.large_string())]))
    s, row, count, _ = shingles(data, offs)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(s[a:b], (count[a:b] * _idf(C.from_numbers(d, b - a), n)).astype(np.float32)) for a, b, d in zip(at[:-1], at[1:], dfs)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    j = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][j] == a[0])
    shared = np.minimum(a[1][i], b[1][j[i]]).sum(dtype=np.float64)
    union = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared
    return float(shared / union) if union else 0.0


class _Group:
    """Texts whose shingles lie in one array, so that one text is compared with many at once."""

    def __init__(self, vec: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(s) for s, _ in vec], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.total = np.array([w.sum(dtype=np.float64) for _, w in vec])
        keys, self.at = np.unique(np.concatenate([s for s, _ in vec]), return_inverse=True)
        self.weight = np.concatenate([w for _, w in vec])
        self.mine = np.zeros(len(keys), np.float32)

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """``weighted_jaccard`` of text ``i`` with each of ``others``."""
        own = slice(self.start[i], self.start[i] + self.size[i])
        self.mine[self.at[own]] = self.weight[own]
        n = self.size[others]
        place = np.arange(n.sum()) + np.repeat(self.start[others] - (np.cumsum(n) - n), n)
        both = np.minimum(self.mine[self.at[place]], self.weight[place])
        shared = np.bincount(np.repeat(np.arange(len(others)), n), both, len(others))
        self.mine[self.at[own]] = 0
        union = self.total[i] + self.total[others] - shared
        return np.divide(shared, union, out=np.zeros(len(others)), where=union > 0)


def _distinct_vectors(texts: pd.Series, dfs: pd.Series, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_vectors`` of each text, made once for equal ones."""
    codes = pd.factorize(texts)[0]
    first = np.unique(codes, return_index=True)[1]
    vec = _vectors(texts.iloc[first], dfs.iloc[first], n)
    return [vec[c] for c in codes]


def _similarity(n: int):
    def similar(a: pd.Series, df_a: pd.Series, b: pd.Series, df_b: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(a), 200):
            va, vb = _distinct_vectors(a[i:i + 200], df_a[i:i + 200], n), _distinct_vectors(b[i:i + 200], df_b[i:i + 200], n)
            out += [weighted_jaccard(x, y) for x, y in zip(va, vb)]
        return pd.Series(out, dtype="float64")
    return F.pandas_udf(similar, "double")


def _compare(pairs: DataFrame, texts: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of units whose texts are similar enough."""
    ta, tb = (texts.select(F.col("unit").alias(c), F.col("text").alias(f"text_{c}"), F.col("df").alias(f"df_{c}")) for c in "ab")
    # sort-merge at every size: no side is bounded, and frequent leaders are split as skewed partitions
    both = pairs.join(ta.hint("merge"), "a").join(tb.hint("merge"), "b")
    return C.keep(both.withColumn("sim", _similarity(n_rows)("text_a", "df_a", "text_b", "df_b")).where(F.col("sim") >= threshold).select("a", "b"))


def _small(kept: DataFrame) -> DataFrame:
    """A kept table of units, to be broadcast if its rows are few; else the join is left to Spark."""
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def _least(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The units of edges (a, b) in order, and the place of the least that each is connected with."""
    names, code = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
    a, b = code[:len(pdf)], code[len(pdf):]
    least, was = np.arange(len(names)), None
    while was is None or (least != was).any():
        was, least = least, least.copy()
        low = np.minimum(was[a], was[b])
        for x in (a, b, was[a], was[b]):
            np.minimum.at(least, x, low)
        least = least[least]
    return names, least


def _stars(batches):
    """Edges (a, b) that connect the same units as those of each batch: every unit with the least it is connected with there."""
    for pdf in batches:
        names, least = _least(pdf)
        on = np.flatnonzero(least != np.arange(len(names)))
        yield pd.DataFrame({"a": names[on], "b": names[least[on]]})


def _connected(batches):
    """``components`` of all batches together."""
    if parts := [pdf for pdf in batches if len(pdf)]:
        names, least = _least(pd.concat(parts))
        yield pd.DataFrame({"unit": names, "cls": names[least]})


def components(edges: DataFrame) -> DataFrame:
    """``(unit, cls)`` for the units of ``edges`` (a, b), a kept table: the least unit each is connected with.

    Up to ``EDGES`` edges are connected in one task. Of more, chains within a batch of rows become
    stars first, which leaves fewer edges and shortens the rounds that follow.
    """
    connected = lambda few: C.keep(few.coalesce(1).mapInPandas(_connected, "unit string, cls string"))
    edges = edges.select("a", "b")
    if edges.count() <= EDGES:
        return connected(edges)
    edges = C.keep(edges.mapInPandas(_stars, "a string, b string").distinct())
    if edges.count() <= EDGES:
        return connected(edges)
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = C.keep(both.groupBy(F.col("a").alias("unit")).agg(F.least(F.min("b"), F.first("a")).alias("cls")))
    while True:
        near = both.join(labels, both["b"] == labels["unit"]).groupBy("a").agg(F.min("cls").alias("other"))
        hop = labels.join(near, labels["unit"] == near["a"], "left").select("unit", F.col("cls").alias("was"), F.least("cls", "other").alias("cls"))
        up = labels.select(F.col("unit").alias("u"), F.col("cls").alias("up"))
        new = C.keep(hop.join(up, F.col("cls") == F.col("u"), "left").select("unit", "was", F.least("cls", "up").alias("cls")))
        labels = new.select("unit", "cls")
        if new.where("cls <> was").isEmpty():
            return labels


def _within(n_rows: int, threshold: float):
    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group, unit, out = _Group(_vectors(pdf["text"], pdf["df"], n_rows)), pdf["unit"].tolist(), []
        cls = np.unique(pdf["cls"], return_inverse=True)[1]
        order = np.argsort(-group.total, kind="stable")
        # no text is linked with one lighter than this
        ends = np.searchsorted(-group.total[order], -group.total[order] * (threshold - SLACK), "right")
        for n, i in enumerate(order.tolist()):
            near = order[n + 1:ends[n]]
            _link(group, i, near, unit, cls, threshold, out)
        return pd.DataFrame(out, columns=["a", "b"])
    return within


def _link(group: _Group, i: int, near: np.ndarray, unit: list, cls: np.ndarray, threshold: float, out: list) -> None:
    """Compares text ``i`` with those of ``near`` that are in other classes; links join classes and go to ``out``."""
    near = near[cls[near] != cls[i]]
    if not len(near):
        return
    for j in near[group.similarities(i, near) >= threshold].tolist():
        if cls[i] != cls[j]:
            out.append((unit[i], unit[j]))
            cls[cls == cls[j]] = cls[i]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, class_size, is_first, rid)`` per row of ``docs``.

    ``rid`` tells rows apart: a hash of id and text. ``is_first`` marks one row of
    each class, one with the smallest id.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    signed, n_rows = _signed(rows)
    units = signed.where("unit is not null").groupBy("unit").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands"), F.first("total").alias("total"))
    members = _parts(units.select("unit", "rid", "total", F.posexplode("bands").alias("band", "cell")))
    wanted = C.keep(members.select("unit", "rid").distinct())
    dfs = signed.select("rid", "df").join(_small(wanted), "rid").dropDuplicates(["rid"])
    texts = C.keep(rows.select("rid", "text").join(dfs.hint("merge"), "rid").dropDuplicates(["rid"]).select("unit", "text", "df"))
    edges, rest = _settled(members, None, texts, n_rows, threshold)
    labels = _merge(wanted.select("unit", F.col("unit").alias("cls")), edges, True)
    if not rest.isEmpty():
        large = rest
        for deals in range(DEALS):
            members = _parts(_dealt(large, texts, n_rows, deals), deals + 1)
            edges, large = _settled(members, labels, texts, n_rows, threshold)
            labels = _merge(labels, edges)
        labels = _merge(labels, _blocks(rest.select("band", "cell", "unit", "total"), labels, texts, n_rows, threshold))
    return _result(signed, labels)


def _near(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.greatest(a, b) * (threshold - SLACK)


def _settled(members: DataFrame, labels: DataFrame | None, texts: DataFrame, n_rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found in the buckets of ``members``, and the rows of the buckets that are too large to settle.

    Units of another class than their bucket's leader are compared with it. Where
    classes are left, all pairs of different ones are compared in the bucket's
    task, taking those linked with the leader for its class. ``labels`` (unit, cls)
    are the classes so far; none: each unit is its own.
    """
    if labels is None:
        of = members.withColumn("cls", F.col("unit")).withColumn("leader_cls", F.col("leader"))
    else:
        own = _small(labels)
        of = C.keep(members.join(own, "unit").join(own.select(F.col("unit").alias("leader"), F.col("cls").alias("leader_cls")), "leader"))
    asked = of.where(F.col("cls") != F.col("leader_cls")).where(_near("total", "leader_total", threshold))
    # dealt by unit, which serves the join with its text too
    links = _compare(asked.select(F.col("unit").alias("a"), F.col("leader").alias("b")).repartition("a").distinct(), texts, n_rows, threshold)
    linked = _small(links).select(F.col("a").alias("unit"), F.col("b").alias("leader"), F.lit(True).alias("linked"))
    of = of.where("n > 2").join(linked, ["unit", "leader"], "left")
    of = C.keep(of.select("band", "cell", "unit", "total", F.when(F.col("linked"), F.col("leader_cls")).otherwise(F.col("cls")).alias("cls")))
    sizes = of.groupBy("band", "cell", "cls").agg(F.count(F.lit(1)).alias("k"), F.sum("total").alias("w")).groupBy("band", "cell").agg(
        ((F.pow(F.sum("k"), 2) - F.sum(F.pow("k", F.lit(2)))) / 2).alias("pairs"), F.sum("w").alias("weight"))
    todo = C.keep(of.join(sizes.where("pairs > 0"), ["band", "cell"]))
    small = (F.col("pairs") <= PAIRS) & (F.col("weight") <= WEIGHT)
    groups = todo.where(small).groupBy("band", "cell").agg(F.sort_array(F.collect_list(F.struct("unit", "cls"))).alias("m")).dropDuplicates(["m"])
    each = groups.select("band", "cell", F.inline("m")).join(texts.hint("merge"), "unit")
    edges = C.keep(each.groupBy("band", "cell").applyInPandas(_within(n_rows, threshold), "a string, b string"))
    return links.union(edges), todo.where(~small)


def _prefix(s: np.ndarray, w: np.ndarray, df: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a text, so many that the others weigh less than ``threshold`` of it.

    A link shares at least ``threshold`` of the heavier text, so two linked texts
    have one of these in common: all take shingles in one order (df, shingle).
    """
    order = np.lexsort((s, df))
    left = w.sum(dtype=np.float64) - np.cumsum(w[order], dtype=np.float64)
    return s[order[:int(np.searchsorted(-left, -(threshold - SLACK) * w.sum(dtype=np.float64), "right")) + 1]]


def _between(n_rows: int, threshold: float):
    """Links of different classes between the units of two blocks, or of one."""
    def between(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vec = _vectors(pdf["text"], pdf["df"], n_rows)
        group, unit, out = _Group(vec), pdf["unit"].tolist(), []
        cls = np.unique(pdf["cls"], return_inverse=True)[1]
        block = pdf["block"].to_numpy()
        one = block.min() == block.max()
        total = group.total
        least = [_prefix(s, w, C.from_numbers(d, len(s)), threshold) for (s, w), d in zip(vec, pdf["df"])]
        keys, at = np.concatenate(least), np.repeat(np.arange(len(vec)), [len(x) for x in least])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        for i in range(len(vec)):
            if not one and block[i] != block.min():
                continue
            lo, hi = np.searchsorted(keys, least[i]), np.searchsorted(keys, least[i], "right")
            near = np.unique(np.concatenate([at[a:b] for a, b in zip(lo, hi)]))
            near = near[near > i] if one else near[block[near] != block[i]]
            near = near[np.minimum(total[near], total[i]) >= np.maximum(total[near], total[i]) * (threshold - SLACK)]
            _link(group, i, near, unit, cls, threshold, out)
        return pd.DataFrame(out, columns=["a", "b"])
    return between


def _blocks(rest: DataFrame, labels: DataFrame, texts: DataFrame, n_rows: int, threshold: float) -> DataFrame:
    """All links (a, b) that join classes within the buckets ``rest`` (band, cell, unit, total)."""
    of = C.keep(rest.join(_small(labels), "unit"))
    buckets = of.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("unit")).alias("x"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("y"),
                                             F.sum("total").alias("weight"), F.min("cls").alias("one"), F.max("cls").alias("other"))
    blocks = F.greatest(F.ceil(2 * F.col("weight") / WEIGHT), F.ceil(F.col("n") / BLOCK)).cast("int")
    # buckets of the same units are compared once
    buckets = buckets.where("one <> other").dropDuplicates(["n", "x", "y"]).select("band", "cell", blocks.alias("blocks"))
    placed = of.join(buckets, ["band", "cell"]).withColumn("block", F.pmod(F.xxhash64("unit", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = placed.select("band", "cell", "unit", "cls", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    dealt = dealt.withColumn("p", F.least("block", "k")).withColumn("q", F.greatest("block", "k")).drop("k")
    pairs = dealt.join(texts.select("unit", "text", "df").hint("merge"), "unit").groupBy("band", "cell", "p", "q")
    return C.keep(pairs.applyInPandas(_between(n_rows, threshold), "a string, b string"))


def _samples(n_rows: int, first: int):
    """Hashes of STEP samples for each chain, numbered from ``first``."""
    def samples(texts: pd.Series, dfs: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), 200):
            vec = _vectors(texts[i:i + 200], dfs[i:i + 200], n_rows)
            row = np.repeat(np.arange(len(vec)), [len(v[0]) for v in vec])
            s, w = (np.concatenate([v[j] for v in vec]) for j in (0, 1))
            out += band_hashes(s, row, w, len(vec), first, CHAINS, STEP).view(np.int64).tolist()
        return pd.Series(out, dtype=object)
    # called so, it runs once: else the filter that Spark infers for posexplode runs it again, in a second worker a task
    return F.pandas_udf(samples, "array<long>").asNondeterministic()


def _dealt(large: DataFrame, texts: DataFrame, n_rows: int, deals: int) -> DataFrame:
    """Units of large buckets (band, cell, unit, total) in the parts that further samples make of each; the first deal is made in all chains."""
    first = BANDS * ROWS + deals * CHAINS * STEP
    more = texts.join(_small(large.select("unit")), "unit", "left_semi").select("unit", _samples(n_rows, first)("text", "df").alias("x"))
    joined = large.select("band", "cell", "unit", "total").join(more.hint("merge"), "unit")
    if deals:  # band holds the chain
        return joined.select("band", F.xxhash64("cell", F.element_at("x", (F.col("band") % CHAINS + 1).cast("int"))).alias("cell"), "unit", "total")
    chained = joined.select("band", "cell", "unit", "total", F.posexplode("x").alias("chain", "y"))
    return chained.select((F.col("band") * CHAINS + F.col("chain")).cast("int").alias("band"), F.xxhash64("cell", "y").alias("cell"), "unit", "total")


def _parts(cells: DataFrame, deals: int = 0) -> DataFrame:
    """Rows (band, cell, unit, total) of buckets that more than one unit shares, with ``leader``, ``leader_total`` and ``n``.

    The leader is the unit least in an order that all buckets of a deal share, so buckets of the same units ask for the same pairs.
    """
    cells = C.keep(cells)
    lead = F.struct(F.xxhash64("unit", F.lit(deals)).alias("h"), F.col("unit").alias("unit"), F.col("total").alias("total"))
    shared = cells.groupBy("band", "cell").agg(F.min(lead).alias("l"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("band", "cell", F.col("l.unit").alias("leader"), F.col("l.total").alias("leader_total"), "n")
    return C.keep(cells.join(shared, ["band", "cell"]))


def _merge(labels: DataFrame, edges: DataFrame, alone: bool = False) -> DataFrame:
    """``labels`` (unit, cls) after the classes that ``edges`` (a, b) connect are one. ``alone``: each unit is its own class so far."""
    if alone:
        between = edges
    else:
        own = _small(labels)
        ca, cb = (own.select(F.col("unit").alias(c), F.col("cls").alias(f"c{c}")) for c in "ab")
        between = C.keep(edges.join(ca, "a").join(cb, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if between.isEmpty():
        return labels
    joined = _small(components(between)).select(F.col("unit").alias("cls"), F.col("cls").alias("new"))
    return C.keep(labels.join(joined, "cls", "left").select("unit", F.coalesce("new", "cls").alias("cls")))


def _result(signed: DataFrame, labels: DataFrame) -> DataFrame:
    own = F.concat(F.lit("row "), F.col("rid").cast("string"))  # no words: a class of its own
    rows = C.keep(signed.select("doc_id", "rid", "unit").join(_small(labels), "unit", "left").select("doc_id", "rid", F.coalesce("cls", "unit", own).alias("cls")))
    sizes = C.keep(rows.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
                                           F.min(F.struct("doc_id", "rid")).alias("least")))
    owners = sizes.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("least.rid").alias("owner"))
    own_id = F.when(F.col("owner") == F.col("least.rid"), F.col("class_id")).otherwise(-1 - F.col("least.rid").bitwiseAND((1 << 62) - 1))
    few = sizes.count() <= SMALL
    sizes = sizes.join(owners, "class_id", "left").select("cls", own_id.alias("class_id"), "class_size", "least")
    out = rows.join(F.broadcast(sizes) if few else sizes, "cls")
    return out.select("doc_id", "class_id", "class_size",
                      (F.col("rid") == F.col("least.rid")).alias("is_first"), "rid")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) for each class."""
    stay = C.keep(classes(docs).where("is_first").select(F.col("doc_id").alias("__id"), F.col("rid").alias("__stay")))
    cols = docs.columns
    rows = docs.withColumn("__rid", F.xxhash64("doc_id", F.col("text").cast("string")))
    same = rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__rid"] == stay["__stay"])
    return rows.join(stay.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__rid"]).select(*cols)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all whole texts of ``documents``."""
    return classes(C.table(spark, sf_dir, "documents")).drop("rid")
