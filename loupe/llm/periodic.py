"""Periodic runs of words, by string synchronising sets at dyadic scales.

A run is a maximal stretch of consecutive words with smallest period ``q`` that is
at least ``max(min_length, EXPONENT * q)`` words long. At scale t a position is in
the synchronising set if the least hash of the t-grams that start at it and at the
next t positions is that of the first or the last of them; t-grams of a period of at
most t/3 take no part. Membership and the context of 2t words only depend on that
context, so a run of period q in [2t, 4t) holds members q apart with equal contexts,
and each pair of members with equal contexts at such a distance proposes it. Highly
periodic regions are what the set omits; their periods are at most t/3 and come from
lower scales, the smallest ones (under ``2 * BASE``) from comparing the words with
their shifts. A proposal is extended word by word to the maximal stretch and kept if
it is long enough and no divisor of its period is a period of it.

A task takes texts in slices of about ``SLICE`` bytes; texts of a slice are one array
with a value of its own after each, and texts shorter than six times a scale leave it.
Work is n log n numpy operations whatever the texts repeat.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Null, empty and
wordless texts have no run and an empty collapsed text. Rows may repeat ids; each row
gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

MIN_LENGTH, EXPONENT = 24, 3
BASE = 8
SLICE = 2_000_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def _smallest(x: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether q is the smallest period of x[s:e], which has period q and at least two of them."""
    return not any(np.array_equal(x[s:e - q // p], x[s + q // p:e]) for p in _primes(q))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values two arrays of one length share, by growing pieces."""
    at, step = 0, 64
    while at < len(a):
        differ = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def _short_periods(x: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """Runs of periods under ``top``, by comparing x with its shifts."""
    out = []
    for q in range(1, min(top, len(x))):
        differ = np.flatnonzero(x[q:] != x[:-q])
        edges = np.concatenate([[-1], differ, [len(x) - q]])
        for k in np.flatnonzero(np.diff(edges) - 1 >= (EXPONENT - 1) * q):
            s, e = int(edges[k]) + 1, int(edges[k + 1]) + q
            if _smallest(x, s, e, q):
                out.append((s, e, q))
    return out


def _members(ids: np.ndarray, t: int) -> np.ndarray:
    """Positions of the synchronising set, given hashes of t-grams (``_TOP`` for those left out)."""
    least, size = ids, 1
    while size < t:
        least = np.minimum(least, np.roll(least, -size))
        size *= 2
    last = np.roll(ids, -t)
    least = np.minimum(least, last)
    return np.flatnonzero((least != _TOP) & ((least == ids) | (least == last)))


def _proposals(p: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of members with equal contexts at a distance in [2t, 4t).

    Members with equal contexts are over t/3 apart, so twelve steps in their order reach them all.
    """
    order = np.argsort(contexts[p], kind="stable")
    at, c = p[order], contexts[p][order]
    found = []
    for m in range(1, 13):
        same = c[m:] == c[:-m]
        if not same.any():
            break
        d = at[m:] - at[:-m]
        ok = same & (d >= 2 * t) & (d < 4 * t)
        found.append((at[:-m][ok], d[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find(x: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least EXPONENT periods in texts laid end to end in ``x``.

    A value that occurs nowhere else stands after each text; no run has one, as a run repeats each of its values.
    """
    runs = _short_periods(x, 2 * BASE)
    place, sizes = np.arange(len(x)), lengths + 1
    h, t, y = C.mix(x.astype(np.int64).view(np.uint64)), 1, x
    while t < BASE:
        h = C.mix(h * C.M1 + np.roll(h, -t))
        t *= 2
    while True:
        stay = sizes - 1 >= 2 * EXPONENT * t
        if not stay.any():
            return runs
        if not stay.all():
            mask = np.repeat(stay, sizes)
            place, h, y, sizes = place[mask], h[mask], y[mask], sizes[stay]
        ids = h.copy()
        ids[ids == _TOP] -= np.uint64(1)
        for s, e, q in runs:
            if EXPONENT * q <= t <= e - s and (a := int(np.searchsorted(place, s))) < len(place) and place[a] == s:
                ids[a:a + e - s - t + 1] = _TOP
        wide = C.mix(h * C.M1 + np.roll(h, -t))
        at, d = _proposals(_members(ids, t), wide, t)
        if len(at):
            # the equal stretch is 4t words or more, 2t of them from here on: t more must be equal after or before those
            n = len(h)
            near = (h[(at + 2 * t) % n] == h[(at + 2 * t + d) % n]) | (h[at - t] == h[(at - t + d) % n])
            runs += _extended(y, place, at[near], d[near])
        h, t = wide, 2 * t


def _extended(y: np.ndarray, place: np.ndarray, at: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int]]:
    out, done, was = [], 0, 0
    for k in np.lexsort((at, periods)):
        i, d = int(at[k]), int(periods[k])
        if d == was and i < done:
            continue  # in the stretch just settled
        right = _shared(y[i:len(y) - d], y[i + d:])
        left = _shared(y[:i][::-1], y[d:i + d][::-1])
        s, e = i - left, i + right + d
        done, was = i + right, d
        if e - s >= EXPONENT * d and _smallest(y, s, e, d):
            out.append((int(place[s]), int(place[s]) + e - s, d))
    return out


def _slices(values: pa.Array):
    """Bounds of slices of about SLICE bytes."""
    sizes = np.diff(C.string_buffers(pa.chunked_array([values]))[1])
    ends, a = np.cumsum(sizes), 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield a, b
        a = b


def _analyse(min_length: int):
    def analyse(texts: list[bytes | None]) -> tuple[list[list[dict]], list[str]]:
        said = [(t or b"").split() for t in texts]  # bytes are split at U+0020 and U+0009 to U+000D
        lengths = np.array([len(w) for w in said], np.int64)
        x = np.empty(int(lengths.sum()) + len(said), np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        for k, (w, a) in enumerate(zip(said, starts.tolist())):
            x[a:a + len(w)] = np.fromiter(map(hash, w), np.int64, len(w))
            x[a + len(w)] = -(1 << 62) - k
        own: list[list[tuple[int, int, int]]] = [[] for _ in said]
        for s, e, q in find(x, lengths):
            if e - s >= max(min_length, EXPONENT * q):
                k = int(np.searchsorted(starts, s, "right")) - 1
                own[k].append((s - int(starts[k]), e - s, q))
        runs, kept = [], []
        for w, found in zip(said, own):
            found = sorted(set(found), key=lambda r: (r[0], r[2]))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            if found:
                drop = np.zeros(len(w), bool)
                for s, n, q in found:
                    drop[s + q:s + n] = True
                w = [b for b, d in zip(w, drop.tolist()) if not d]
            kept.append(b" ".join(w).decode("utf-8"))
        return runs, kept
    return analyse


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, runs, collapsed)`` per row of ``docs``: runs (start, length, period) by start, then period, and the text without repeats.

    ``collapsed`` leaves out each word that lies in a run after its first ``period`` words; words are joined by one space.
    """
    C.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    ids = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    analyse = _analyse(min_length)

    def apply(batches):
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found, kept = analyse(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(apply, f"doc_id {ids}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, of every tenth document (by crc32 of its id) repeated from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(said: Column) -> Column:
        a = g % F.size(said)
        p = F.lit(1) + F.floor((F.size(said) - a) / (g % 8 + 3))
        at = lambda k, i: F.when(i < k["a"], i).otherwise(k["a"] + (i - k["a"]) % k["p"])
        words = _bound(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda k: F.transform(said, lambda w, i: F.element_at(said, at(k, i) + 1)))
        return F.when(F.size(said) > 0, F.array_join(words, " ")).otherwise(text)

    return F.when(h % 10 == 0, _bound(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), again)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent, and digests of the runs and the collapsed text, per row of ``runs``."""
    first = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.when(F.size("runs") > 0, F.col("runs")[0]), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))  # by start, then period: the first of equals stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = found.withColumn("best", first)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000L * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all whole texts of ``documents``, every tenth with repeats planted."""
    docs = C.table(spark, sf_dir, "documents")
    return digests(runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
