"""Text predicates, correction, tokens and n-grams (FIXTURES A1-A5)."""

import random

from pyspark.sql import functions as F

from loupe.functions import text
from loupe.functions.text import correct_text, is_ascii
from loupe.operators import terms

REVIEWS = [(0, "great machine"), (1, "loud machine"), (2, "great machine")]


def _reviews(spark, rows=REVIEWS):
    return spark.createDataFrame(rows, "review_id bigint, text string")


def test_is_ascii(spark):
    df = spark.createDataFrame([("hallo",), ("¿",), ("",)], "t string")
    assert [r[0] for r in df.select(is_ascii("t")).collect()] == [True, False, True]


def test_correction_cases(spark):
    cases = {
        "DOES IT WORK": "does it work",
        "DOES  IT WORK": "does it work",
        "DOES IT WORK?.": "does it work.",
        " DOES IT WORK ": "does it work",
        " DOES IT WOOORK ": "does it work",
        " DOES IT WORK??? ": "does it work?",
        " DOES.IT,WORK!THOUGH?HMM": "does. it, work! though? hmm",
        " IT WAS , GREAT": "it was, great",
        "greeat machine": "greeat machine",
        "great machine!!!": "great machine!",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = dict(df.select("t", correct_text("t")).collect())
    assert got == cases


def test_unigrams(spark):
    tok = terms.review_tokens(_reviews(spark)).orderBy("review_id", "idx").collect()
    assert [(r.review_id, r.idx, r.term) for r in tok] == [
        (0, 0, "great"), (0, 1, "machine"), (1, 0, "loud"), (1, 1, "machine"),
        (2, 0, "great"), (2, 1, "machine")]


def test_unigram_pos_rules(spark):
    tok = terms.with_pos(terms.review_tokens(_reviews(spark))).orderBy("review_id", "idx")
    assert [r.pos for r in tok.collect()] == ["ADJ", "NOUN", "ADJ", "NOUN", "ADJ", "NOUN"]


def test_bigrams(spark):
    bg = terms.review_ngrams(_reviews(spark), 2).orderBy("review_id").collect()
    assert [(r.review_id, r.idx, r.term) for r in bg] == [
        (0, 0, "great machine"), (1, 0, "loud machine"), (2, 0, "great machine")]


def test_ngrams_short_text_gives_none(spark):
    df = _reviews(spark, [(0, "one"), (1, "")])
    assert terms.review_ngrams(df, 2).count() == 0
    assert terms.review_ngrams(df, 3).count() == 0


def test_trigram_positions(spark):
    df = _reviews(spark, [(0, "a b c d")])
    got = [(r.idx, r.term) for r in terms.review_ngrams(df, 3).orderBy("idx").collect()]
    assert got == [(0, "a b c"), (1, "b c d")]


def test_ngram_filters(spark):
    df = _reviews(spark, [(0, "the big dog saw 3 cats and the big dog")])
    stops = terms.review_ngrams(df, 2, filter_stops=True).collect()
    assert all(not r.term.startswith("the ") and not r.term.endswith(" the")
               and not r.term.startswith("and ") and not r.term.endswith(" and") for r in stops)
    nums = terms.review_ngrams(df, 2, filter_nums=True).collect()
    assert all("3" not in r.term.split() for r in nums)
    freq = terms.review_ngrams(df, 2, min_freq=2).select("term").distinct().collect()
    assert sorted(r.term for r in freq) == ["big dog", "the big"]
    inc = terms.review_ngrams(df, 2, include_pos=["ADJ", "NOUN"]).select("term").collect()
    assert sorted(r.term for r in inc) == ["big dog", "big dog", "dog saw"]


def test_correction_steps_on_any_whitespace_and_marks(spark):
    """The chain as its rules say, a pattern for each: any whitespace at the ends and inside, marks in any order."""
    rng = random.Random(1)
    marks = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000aabbcZ.,?!;:\"-_9é漢'()\u200b")
    df = spark.createDataFrame([(i, "".join(rng.choices(marks, k=rng.randint(0, 25)))) for i in range(3000)] + [(-1, None)], "i long, t string")
    s = F.lower("t")
    for pattern, by in ((f"^{text.WS}+|{text.WS}+$", ""), (f"{text.WS}+", " "), ("([a-z])\\1{2,}", "$1"), (f"({text.NONWORD})\\1+", "$1"), (f"{text.NONWORD}+?\\.", "."),
                        (f"([.?!,])({text.WORD})", "$1 $2"), (f"{text.WS}([?.!,;:\"](?:{text.WS}|$))", "$1")):
        s = F.regexp_replace(s, pattern, by)
    out = df.select(F.col("t"), s.alias("want"), text.correct_text("t").alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]
    plan = df.select(text.correct_text("t").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" in plan and plan.count("regexp_replace") == 6
