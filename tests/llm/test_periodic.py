"""Periodic runs against all stretches of all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from loupe.llm import common as C, periodic as P

SF = "/root/testdata/sf0.001"


def brute(w, least=24):
    """(start, length, period) of all runs, period by period, word by word."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(least, 3 * q) and not any(w[s:e + q - p] == w[s + p:e + q] for p in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def texts(rng):
    yield from (None, "", " \t\n", "a", "a " * 23, "a " * 24, "a b " * 500, " ".join("abcdefgh") + " " + "x y z " * 8)
    for _ in range(60):  # few letters, repeats of repeats
        part = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        w = [rng.choice("abc") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(1, 4)):
            w += part * rng.randrange(1, 12) + [rng.choice("abc") for _ in range(rng.randrange(30))]
            part = part * rng.randrange(1, 3) + [rng.choice("abcd") for _ in range(rng.randrange(9))]
        yield " ".join(w)
    for q in (15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 150):  # edges of the scales; within a period almost all words alike
        for extra in (-1, 0, 5):
            part = ["a"] * (q - 1) + ["b"] if extra else [str(i) for i in range(q)]
            yield " ".join((part * 4)[:3 * q + extra])
        yield " ".join([*(str(i) for i in range(50)), *(["x", "y"] * (q // 4) + [str(i) for i in range(q - q // 4 * 2)]) * 3, "end"])
    yield " a  b\x0bc " * 30  # no-break and em spaces are no separators, a vertical tab is


def test_same_as_all_stretches(spark):
    rows = list(enumerate(texts(random.Random(11))))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS start", "3 AS period", "4 AS collapsed")
    got = P.runs(df).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        w = re.findall("[^\x20\x09-\x0d]+", rows[r["doc_id"]][1] or "")
        want = brute(w)
        assert [tuple(x) for x in r["runs"]] == want, rows[r["doc_id"]]
        assert r["collapsed"] == collapse(w, want)


@pytest.mark.parametrize("seed", range(4))
def test_many_texts_in_one_array(seed):
    rng = random.Random(seed)
    said = [[rng.choice("abc") for _ in range(rng.randrange(12))] * rng.randrange(1, 30) for _ in range(80)]
    x, lengths = [], np.array([len(w) for w in said], np.int64)
    for k, w in enumerate(said):
        x += [ord(c) for c in w] + [-1 - k]
    starts = np.cumsum(lengths + 1) - lengths - 1
    got = sorted(set(P.find(np.array(x, np.int64), lengths)))
    want = sorted((int(a) + s, int(a) + s + n, q) for a, w in zip(starts, said) for s, n, q in brute(w, 3))
    assert got == want


def test_query_on_whole_table(spark):
    rows = {r["doc_id"]: r["text"] for r in C.table(spark, SF, "documents").collect()}
    got = P.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got) > 10
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        w = re.findall("[^\x20\x09-\x0d]+", rows[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == sha(collapse(w, runs))


def test_long_text_nulls_and_empty_table(spark):
    long = "w " * 100_000 + " ".join(str(i) for i in range(5000)) + " " + ("p " + "q " * 999) * 40
    rows = [(None, long), (None, None), (1, long)]
    for r in P.digests(P.runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        assert (r["n_runs"], r["length"], r["period"]) in ((0, None, None), (42, 100_000, 1))
    assert P.digests(P.runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
