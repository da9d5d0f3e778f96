import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from loupe.llm import near_dedup as N

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return tuple(w), Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weigh(texts):
    """(words, {shingle: weight}) of each text, by true document counts of all texts."""
    sets = [grams(t) for t in texts]
    df = Counter(g for _, c in sets for g in c)
    idf = {g: 1 + np.log((len(texts) + 1) / (k + 1)) / np.log(len(texts) + 2) for g, k in df.items()}
    return [(w, {g: k * idf[g] for g, k in c.items()}) for w, c in sets]


def alike(a, b):
    shared = sum(min(v, b[g]) for g, v in a.items() if g in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows, threshold=0.8):
    """Classes by comparing all pairs of texts, from their words."""
    vec = weigh([t for _, t in rows])
    cls = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if vec[i][0] and vec[j][0] and cls[i] != cls[j] and (vec[i][0] == vec[j][0] or alike(vec[i][1], vec[j][1]) >= threshold):
                a, b = cls[i], cls[j]
                cls = [b if c == a else c for c in cls]
    return sorted(sorted(i for i in range(len(rows)) if cls[i] == c) for c in set(cls))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            t = base[:]
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t).upper() if rng.random() < .2 else " ".join(t))
    texts += [line + " " + word() for _ in range(30)] + [line + " " + " ".join(word() for _ in range(30)) for _ in range(10)]
    texts += [None, "", "", "...", "one two", "one two", "One, two!", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(spark, rows):
    out = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and sum(r["is_first"] for r in out) == len({r["class_id"] for r in out})
    by = {}
    for r in out:
        by.setdefault(r["class_id"], []).append(r["doc_id"])
    assert all(min(v) == k for k, v in by.items())
    return sorted(sorted(v) for v in by.values())


def test_same_classes_as_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def links(groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    """One line in every text: buckets of mostly unlike texts, with near copies among them."""
    monkeypatch.setattr(N, "PAIRS", 30)
    deals, was = [], N._dealt
    monkeypatch.setattr(N, "_dealt", lambda *a: deals.append(a[-1]) or was(*a))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line, texts = " ".join(word() for _ in range(60)), []
    for _ in range(120):
        own = [word() for _ in range(50)]
        texts.append(line + " " + " ".join(own))
        if rng.random() < 0.4:
            own[rng.randrange(40)] = word()
            texts.append(line + " " + " ".join(own))
    rows = list(enumerate(texts))
    want, got = links(brute(rows)), links(found(spark, rows))
    assert deals and got <= want and len(got) >= 0.9 * len(want) > 30


def test_pairs_that_dealing_parts_are_compared_all_the_same(spark, monkeypatch):
    """Buckets too large for one task, and deals that keep no two texts together: no link of a bucket is lost."""
    monkeypatch.setattr(N, "STEP", 90)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line, texts = " ".join(word() for _ in range(60)), []
    for _ in range(60):
        own = [word() for _ in range(50)]
        texts.append(line + " " + " ".join(own))
        own[rng.randrange(40)] = word()
        texts.append(line + " " + " ".join(own))
    rows = list(enumerate(texts))
    was = N._parts
    one = lambda cells: cells.selectExpr("unit", "rid", "total", "0 AS band", "0L AS cell").distinct()
    monkeypatch.setattr(N, "_parts", lambda cells, deals=0: was(cells if deals else one(cells), deals))  # one bucket of all texts
    monkeypatch.setattr(N, "PAIRS", 1)
    monkeypatch.setattr(N, "WEIGHT", 3000)  # some blocks
    want = brute(rows)
    assert len(links(want)) > 50 and found(spark, rows) == want


def test_recall_on_whole_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    ids = [i for i, _ in rows]
    want = links([[ids[k] for k in g] for g in brute([(k, t) for k, (_, t) in enumerate(rows)])])
    got = links(found(spark, rows))
    assert got <= want and len(got) >= 0.9 * len(want) > 50


def test_class_ids_are_unique(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "o p q r s t"), (None, "u v w x y z"), (None, "u v w x y z"), (2, None), (2, "")]
    out = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter(r["class_id"] for r in out)
    assert sorted(sizes.values()) == [1, 1, 1, 1, 1, 2] and all(r["class_size"] == sizes[r["class_id"]] for r in out)
    assert {1, 2} < set(sizes) and sum(i < 0 for i in sizes) == 4


def test_empty_and_repeated_rows(spark):
    assert N.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS unit", "'x' AS cls")
    out = N.classes(df).collect()
    assert sorted(r["class_size"] for r in out) == [1, 3, 3, 3]
    kept = N.drop_near(df)
    assert kept.columns == df.columns and kept.count() == 2


def test_recall_of_bands_at_the_threshold():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(200):
        s = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
        a, b = s[:270], s[30:]  # Jaccard 0.8
        rows = np.repeat([0, 1], [len(a), len(b)])
        bands = N.band_hashes(np.concatenate([a, b]), rows, np.ones(len(rows), np.float32) * 1.7, 2)
        hit += (bands[0] == bands[1]).any()
    assert hit >= 195


def test_weights_follow_true_document_counts(spark):
    texts = [" ".join(f"w{i}" for i in range(200_000))] + [t for _, t in corpus(7) if t]
    want = [sum(v.values()) for _, v in weigh(texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "xxhash64(doc_id, text) AS rid")
    signed, n = N._signed(rows, group_bytes=5000, range_keys=1000)
    got = {r["doc_id"]: r["total"] for r in signed.collect()}
    assert n == len(texts) and all(abs(got[i] - w) <= 1e-5 * w for i, w in enumerate(want))


def test_one_text_with_many_is_pair_by_pair():
    rng = np.random.default_rng(3)
    vec = [(np.sort(rng.choice(60, size=n, replace=False)).astype(np.uint64), rng.integers(1, 4, n).astype(np.float32) * np.float32(1.3)) for n in rng.integers(1, 40, 25)]
    group = N._Group(vec)
    for i in (0, 7, 24):
        others = np.array([j for j in range(25) if j != i])
        assert np.allclose(group.similarities(i, others), [N.weighted_jaccard(vec[i], vec[j]) for j in others], rtol=0, atol=1e-12)


def test_stars_connect_what_chains_do():
    chain = [f"u{i:03}" for i in range(200)]
    edges = pd.DataFrame([(a, b) for a, b in zip(chain[1:], chain[:-1])] + [("x", "y")], columns=["a", "b"]).sample(frac=1, random_state=5)
    (stars,) = N._stars([edges])
    assert sorted(map(tuple, stars.to_numpy())) == [(u, "u000") for u in chain[1:]] + [("y", "x")]


def test_samples_are_drawn_once_a_text(spark):
    """The filter inferred for the exploded samples must not draw them again: that took two workers a task."""
    large = spark.createDataFrame([(0, 1, "u", 3.0)], "band int, cell long, unit string, total double")
    texts = spark.createDataFrame([("u", "a b c d e f g", bytearray(b"\1\1\1"))], "unit string, text string, df binary")
    dealt = N._dealt(large, texts, 1, 0)
    assert dealt._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    rows = dealt.collect()
    assert [r["band"] for r in rows] == list(range(N.CHAINS)) and {(r["unit"], r["total"]) for r in rows} == {("u", 3.0)}


def test_slices_of_a_group_hold_all_rows_and_give_the_same(monkeypatch):
    texts = [t for _, t in corpus(4)]
    tab = pa.table({"doc_id": pa.array(range(len(texts))), "rid": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    assert [r for t in N._slices(tab, 1000) for r in t["rid"].to_pylist()] == list(range(len(texts)))
    keys = N._held(tab)[0]
    replies = pa.table({"r": pa.array([0], pa.int32()), "totals": pa.array([N.C.numbers(np.arange(len(keys)) % 9 + 1)])})
    whole, was = N._signer(50, 1)(tab, replies), N._slices
    monkeypatch.setattr(N, "_slices", lambda t: was(t, 1000))
    assert len(list(N._slices(tab))) > 5 and N._signer(50, 1)(tab, replies).equals(whole)


def test_slices_are_small_beside_a_group():
    """Some ten arrays of 8 bytes a word stand beside a slice: at 2 MB that was more than the group itself."""
    tab = pa.table({"text": pa.array(["w" * 999] * 4000 + ["x" * 1_500_000, None, "y"])})
    sizes = [pc.sum(pc.binary_length(t["text"])).as_py() or 0 for t in N._slices(tab)]
    assert sum(sizes) == 999 * 4000 + 1_500_001 and sorted(sizes)[-2] <= 1_000_000


def _components(spark, edges):
    return {(r["unit"], r["cls"]) for r in N.components(spark.createDataFrame(edges, "a string, b string").repartition(4)).collect()}


def test_few_links_are_connected_in_one_job(spark, monkeypatch):
    """A chain over several partitions and a pair: no rounds of joins while the links are few, the same classes by rounds."""
    chain = [f"u{i:03}" for i in range(60)]
    edges = [*zip(chain[1:], chain[:-1]), ("x", "y"), ("y", "x"), ("x", "y")]
    want = {(u, "u000") for u in chain} | {("x", "x"), ("y", "x")}
    kept, was = [], N.C.keep
    monkeypatch.setattr(N.C, "keep", lambda df: kept.append(df) or was(df))
    assert _components(spark, edges) == want and len(kept) == 1
    monkeypatch.setattr(N, "EDGES", 1)
    assert _components(spark, edges) == want and len(kept) > 4


def test_same_classes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 0)
    monkeypatch.setattr(N, "EDGES", 0)
    monkeypatch.setattr(N, "PAIRS", 30)
    rows = corpus(5)
    want, got = links(brute(rows)), links(found(spark, rows))
    assert got <= want and len(got) >= 0.9 * len(want) > 30
