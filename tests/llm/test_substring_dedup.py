import hashlib
import random

import pyarrow as pa
import pytest

from loupe import session
from loupe.llm import substring_dedup as S


def brute(rows, size=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        if d is not None:
            for i in range(len(b) - size + 1):
                w = b[i:i + size]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - size + 1):
                if least[b[i:i + size]] < d:
                    gone[i:i + size] = [True] * size
        kept = bytes(x for x, c in zip(b, gone) if not c)
        runs = sum(c and not p for c, p in zip(gone, [False] + gone[:-1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (30, 49, 50, 51, 60, 90, 200, 65, 70)]
    rows = []
    for d in range(60):
        t = "".join(rng.choice(parts)[rng.choice([0, 0, 5]):] if rng.random() < .5 else
                    "".join(rng.choice("abxyz ") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(8)))
        rows.append((None if d == 17 else d, None if d == 11 else t))
    return rows + [(3, rows[3][1]), (70, rows[5][1]), (71, "a" * 300), (72, "a" * 120), (7, "z" * 70), (7, "z" * 70), (None, rows[5][1])]


@pytest.mark.parametrize("group_bytes", [700, 10**6])
def test_same_as_brute_force(spark, group_bytes):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS g", "'x' AS h", "2 AS row")
    got = S.remove_repeats(df, group_bytes=group_bytes, range_keys=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é" * 60), (2, "x" + "é" * 60 + "y")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(df, with_kept=True).collect()}
    assert got == {1: ("é" * 60).encode(), 2: b"xy"}
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_over_the_edge_of_a_chunk(spark):
    """Windows of a text longer than what one pass of numpy takes, and of its neighbours in the group."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, edge = noise(120), 1 << 19
    rows = [(1, noise(edge - 60) + passage + noise(900)), (2, noise(300) + passage), (3, passage[:70] + noise(edge - 100) + passage[40:] + noise(200)),
            (4, noise(100)), (5, "x" * 700_000)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r["n_removed"] > 0 for r in got) == 2


def test_one_line_in_every_text(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    line = noise(80)
    rows = [(d, noise(rng.randrange(90)) + line[rng.randrange(20):80 - rng.randrange(9)] + noise(rng.randrange(90)) + (line if d % 7 == 0 else "")) for d in range(300)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=3000, range_keys=500).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pieces_are_made_once(spark):
    """What is left to do reads the settled pieces: the plan asks for windows, refines them and removes, no more."""
    out = S.remove_repeats(spark.createDataFrame(corpus(), "doc_id long, text string"), group_bytes=700, range_keys=50)
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") <= 3


def test_passages_of_16_bytes_alone_are_not_refined():
    """Two groups of texts share 16-byte passages between noise, and one passage of 50 bytes: only its windows are left."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    common, passage = [noise(16) for _ in range(40)], noise(50)
    tabs = [pa.table({"doc_id": [g], "text": ["".join(c + noise(20) for c in rng.choices(common, k=300)) + passage + noise(60)], "g": pa.array([g], pa.int32()),
                      "h": [g]}) for g in range(2)]
    copies = tabs[0].slice(0, 0)
    asked = pa.concat_tables([S._ask(1, 48)(t, copies) for t in tabs])
    replies = S._reply(asked).append_column("doc_id", pa.nulls(2, pa.int64())).append_column("h", pa.nulls(2, pa.int64()))
    pieces = [S._super_windows(1, 48)(t, replies.filter(replies["g"].to_numpy() == g)) for g, t in enumerate(tabs)]
    assert [0 < sum(p["n"].to_pylist()) <= S.SPAN for p in pieces] == [True, True]
    for t, p in zip(tabs, pieces):
        at = t["text"][0].as_py().index(passage)
        assert any(a <= at < a + n for a, n in zip(p["at"].to_pylist(), p["n"].to_pylist()))


def test_shuffle_files_of_a_kept_table_go_at_once(spark, monkeypatch):
    """The texts are dealt twice: what the first job dealt is gone when the second begins."""
    left, keep = [], S.C.keep
    n = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    def kept(df, *args, **kw):
        before = n()
        out = keep(df, *args, **kw)
        left.append(n() - before)
        return out

    monkeypatch.setattr(S.C, "keep", kept)
    S.remove_repeats(spark.createDataFrame(corpus(), "doc_id long, text string"), group_bytes=700, range_keys=50)
    assert len(left) == 3 and max(left) <= 0
    assert spark.conf.get(session.FREE, None) is None
