"""The Merkle manifest against a tree built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loupe.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The last node, and for each leaf its (left, right) siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for leaf, a in enumerate(at):
            run = runs[a // 3]
            paths[leaf].append((run[:a % 3], run[a % 3 + 1:]))
            at[leaf] = a // 3
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    leaves = {}
    for r in rows:
        now = list(r)
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            now[4] = r[4].replace("\n", "")
        leaves.setdefault(r[1], []).append((r[0], H(*map(field, r)), H(*map(field, now))))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in leaves[s]])
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (i, leaf, now), path in zip(leaves[s], trees[s][1]):
            h = now
            for left, right in path + top:
                h = H(*left, h, *right)
            out.append((i, leaf, trees[s][0], root, H(*(x for l, r in path + top for x in l + r)), h, h == root))
    return sorted(out, key=str)


def run(spark, rows, levels):
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS pos", "2 AS gid", "3 AS node", "4 AS path", "5 AS grp")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.verify(df, cut, levels=levels).select(*cols).collect()), key=str)


ROWS = [(i, "hot" if i % 3 else f"s{i % 21}", "en" if i % 2 else None, i, f"line {i}\nline\n" if i % 4 else "plain") for i in range(1, 60)]


@pytest.mark.parametrize("levels", [1, 2])
def test_same_as_tree(spark, levels):
    got = run(spark, ROWS, levels)
    assert got == brute(ROWS) and {r[-1] for r in got} == {True, False}


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = ROWS[:7] + [ROWS[3]] * 4 + [(5, "hot", "fr", 2, "x\n"), (5, "hot", None, None, None), (None, None, None, None, None), (None, "hot", "en", 1, "a\nb"),
                                      (77, None, "en", 0, ""), (78, "É", "en", 3, "é\n" * 200_000)]
    assert run(spark, rows, 1) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, [], 2) == []
    (only,) = run(spark, ROWS[:1], 2)
    assert only[1] == only[2] == only[3] and only[4] == H()
