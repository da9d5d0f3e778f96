"""The positional index against a scan of all windows of all texts."""

import random
import re

from pyspark.sql import functions as F

from loupe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s:s + n]))):
                    ids |= found
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), len(ids), sorted(ids), [x for x in sorted(hit) if x - 1 not in hit]))
    return sorted(out, key=str)


def run(spark, docs, items, size):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS words", "3 AS item_id", "4 AS term", "5 AS k")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS n", "3 AS words")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], [s["start"] for s in r["spans"]])
                   for r in D.contamination(d, b, size).collect()), key=str)


def random_words(rng, n, of=6):
    return " ".join(rng.choice("abcdefghijkl"[:of]) for _ in range(n))


def test_same_as_scan_on_few_words(spark):
    """So few words that every term is frequent and windows overlap themselves."""
    rng = random.Random(5)
    docs = [(i, random_words(rng, rng.randrange(60), 3)) for i in range(60)]
    items = [(i, random_words(rng, rng.randrange(1, 12), 3)) for i in range(12)]
    got = run(spark, docs, items, 4)
    assert got == brute(docs, items, 4) and any(r[2] for r in got) and any(not r[2] for r in got)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 16)  # stretches that cross pieces of a text
    rng = random.Random(6)
    passage = "One two-three FOUR É five 6 seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (None, passage), (None, None), (3, passage), (3, passage), (3, "other " + passage + " " + passage), (4, "é five 6"),
            (5, random_words(rng, 3000) + " " + passage + " " + random_words(rng, 3000)), (6, "solo"), (7, "É five 6 solo"), (8, "... -- !")]
    items = [(1, passage), (1, "solo"), (2, passage + " thirteen"), (2, passage + " thirteen"), (3, "É FIVE 6"), (4, None), (5, ""), (None, "twelve one two"), (10, "never said")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)
    assert run(spark, docs, [], 10) == brute(docs, [], 10)
    assert run(spark, [], items, 10) == []


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_BYTES", -1)
    rng = random.Random(7)
    docs = [(i, random_words(rng, 80)) for i in range(30)]
    items = [(i, random_words(rng, 8)) for i in range(9)]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_word_classes_list_their_characters(spark):
    """Ranges in a class cost Java several times the time of listed characters; the words are the same."""
    text = "".join(f"a{chr(i)}B{chr(i)}9 " for i in [*range(1, 0x250), 0x2028, 0x3042, 0xFFFD, 0x1F600, 0x10FFFF])
    rows = spark.createDataFrame([(text,)], "text string")
    (got, n), = rows.select(D.words(rows["text"]), F.regexp_count("text", F.lit(D.ANY_WORD))).collect()
    assert got == split(text) and n == len(got)
    assert "-" not in D.WORD + D.ANY_WORD


def test_proximity(spark):
    rng = random.Random(8)
    docs = [(i, random_words(rng, 40, 12)) for i in range(40)] + [(99, None), (98, "a")]
    items = [(i, random_words(rng, 3, 12)) for i in range(10)] + [(20, "a"), (21, "zz a"), (22, None)]
    said = [(i, split(t)) for i, t in docs]
    count = {}
    for _, w in said:
        for x in w:
            count[x] = count.get(x, 0) + 1
    want = []
    for k, t in items:
        terms = set(split(t))
        if not terms or any(x not in count for x in terms):
            continue
        rare = min(terms, key=lambda x: (count[x], x))
        for i, w in said:
            near = [p for p, x in enumerate(w) if x == rare and terms <= set(w[max(0, p - 4):p + 5])]
            if near:
                want.append((i, str(k), len(near), near[0]))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in D.proximity(d, b, 4).select("doc_id", "item_id", "places", "first").collect())
    assert got == sorted(want) and len(got) > 5
