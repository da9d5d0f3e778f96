"""F1-F8, J1, P1-P4, R1 on the literal fixtures (FIXTURES A1, A4, A6, A15)."""

from pyspark.sql import functions as F

from loupe.operators import report, sample, terms

ROWS = [(0, "great machine", 1.5, 0), (1, "loud machine", 2.0, 1), (2, "great machine", 1.5, 0)]


def _rv(spark):
    return spark.createDataFrame(ROWS, "review_id bigint, text string, weight double, label int")


def _tf(df):
    cols = [c for c in ("label", "term", "frequency") if c in df.columns]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_plain_and_sorted(spark):
    tok = terms.review_tokens(_rv(spark))
    tf = terms.term_frequency(tok)
    assert _tf(tf) == [("great", 2), ("loud", 1), ("machine", 3)]
    srt = [(r.term, r.frequency) for r in terms.sort_frequency(tf).collect()]
    assert srt == [("machine", 3), ("great", 2), ("loud", 1)]


def test_weighted(spark):
    tok = terms.review_tokens(_rv(spark), carry=("weight",))
    assert _tf(terms.term_frequency(tok, weight_col="weight")) == [("great", 3.0), ("loud", 2.0), ("machine", 5.0)]


def test_pos_types(spark):
    tok = terms.with_pos(terms.review_tokens(_rv(spark)))
    assert _tf(terms.term_frequency(tok, types="NOUN")) == [("machine", 3)]


def test_extra_stopwords_whole_term(spark):
    uni = terms.review_tokens(_rv(spark))
    assert _tf(terms.term_frequency(uni, additional_stopwords="loud")) == [("great", 2), ("machine", 3)]
    bi = terms.review_ngrams(_rv(spark), 2)
    assert _tf(terms.term_frequency(bi, n=2, additional_stopwords="loud")) == [
        ("great machine", 2), ("loud machine", 1)]


def test_builtin_stopwords_only_for_plain_unigrams(spark):
    df = spark.createDataFrame([(0, "the machine the")], "review_id bigint, text string")
    uni = terms.review_tokens(df)
    assert _tf(terms.term_frequency(uni)) == [("machine", 1)]
    assert _tf(terms.term_frequency(uni, use_stem=True)) == [("machine", 1), ("the", 2)]
    bi = terms.review_ngrams(df, 2)
    assert _tf(terms.term_frequency(bi, n=2)) == [("machine the", 1), ("the machine", 1)]


def test_by_label(spark):
    tok = terms.review_tokens(_rv(spark), carry=("label", "weight"))
    assert _tf(terms.term_frequency(tok, label_col="label")) == [
        (0, "great", 2), (0, "machine", 2), (1, "loud", 1), (1, "machine", 1)]
    bi = terms.review_ngrams(_rv(spark), 2, carry=("label",)).withColumn("w", F.lit(1.0))
    assert _tf(terms.term_frequency(bi, n=2, label_col="label")) == [(0, "great machine", 2), (1, "loud machine", 1)]
    assert _tf(terms.term_frequency(bi, n=2, label_col="label", weight_col="w")) == [
        (0, "great machine", 2.0), (1, "loud machine", 1.0)]


def test_weighted_sorted_terms(spark):
    df = spark.createDataFrame([(0, "hello", 1.0), (1, "what", 2.0), (2, "is", 3.0), (3, "hello", 4.0)],
                               "review_id bigint, term string, w double")
    tf = terms.term_frequency(df, n=2, weight_col="w")
    assert [(r.term, r.frequency) for r in terms.sort_frequency(tf).collect()] == [
        ("hello", 5.0), ("is", 3.0), ("what", 2.0)]


def test_recycle_drops_reviews_without_tokens(spark):
    ids = [0, 0, 0, 1, 1, 3, 3, 3, 3]
    tok = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "review_id bigint, idx int")
    lab = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 0)], "review_id bigint, label int")
    out = terms.recycle(tok, lab).orderBy("idx").collect()
    assert [r.label for r in out] == [0, 0, 0, 1, 1, 0, 0, 0, 0]


def test_top_terms_and_wordcloud(spark):
    tok = terms.review_tokens(_rv(spark), carry=("label",))
    tf = terms.term_frequency(tok, label_col="label")
    top = sorted((r.label, r.rank, r.term) for r in terms.top_terms(tf, 1).collect())
    assert top == [(0, 1, "great"), (1, 1, "loud")]  # ties broken by term
    wc = {(r.label, r.term): r.weight for r in terms.wordcloud_weights(tf, 20).collect()}
    assert wc[(0, "great")] == 1.0 and wc[(1, "machine")] == 1.0
    overall = terms.top_terms(terms.term_frequency(terms.review_tokens(_rv(spark))), 2)
    assert [(r.term, r.rank) for r in overall.orderBy("rank").collect()] == [("machine", 1), ("great", 2)]


def test_sample_reviews(spark):
    df = spark.createDataFrame([(0, "great", 0), (1, "great", 0), (2, "amazing", 1)],
                               "review_id bigint, text string, label int")
    got = {}
    for r in sample.sample_reviews(df, 2, seed=314).collect():
        got.setdefault(r.label, []).append(r.text)
    assert {k: sorted(v) for k, v in got.items()} == {0: ["great", "great"], 1: ["amazing"]}
    # layout independence: repartitioning does not change the sample
    big = spark.range(200).select(F.col("id").alias("review_id"), (F.col("id") % 3).cast("int").alias("label"))
    a = {r.review_id for r in sample.sample_reviews(big, 5, 7).collect()}
    b = {r.review_id for r in sample.sample_reviews(big.repartition(7), 5, 7).collect()}
    assert a == b and len(a) == 15


def test_crosstab_and_summary(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "a", 0.0), (0, "b", 0.0), (1, "b", 1.0)],
                               "label int, true_label string, sentiment double")
    ct = sorted((r.label, r.true_label, r.frequency, r.rank) for r in report.label_crosstab_topk(df, 1).collect())
    assert ct == [(0, "a", 2, 1), (1, "b", 1, 1)]
    cs = sorted(tuple(r) for r in report.cluster_summary(df).collect())
    assert cs == [(0, 3, 0.33), (1, 1, 1.0)]
