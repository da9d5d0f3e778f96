"""Registered text and term queries.

Data binding: ``documents`` are the reviews (``doc_id`` key, ``n_chars``
weight), ``labels.quality`` is the cluster label and ``labels.toxic`` the
sentiment, ``documents.source`` a second (true) labelling. Each query has a
Spark builder and the DuckDB SQL that must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.functions.pos import pos_tag_sql
from loupe.functions.text import is_ascii
from loupe.operators import report, sample, terms
from loupe.plans.sqltext import STOP_SQL, corrected_reviews_cte, sql_list, tokens_cte
from loupe.sources import tables

# query parameters
EXTRA_STOPWORDS = ("le", "la", "de", "et")
POS_TYPES = ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "PART")
TOP_K = 10
ONE_LABEL = 1
SAMPLE_SEED = 314
SAMPLE_K = 3
CROSSTAB_K = 15
WORDCLOUD_MAX = 20

# --------------------------------------------------------------------------
# Spark builders


def _labelled_tokens(spark, sf_dir, n=1, **kw):
    rv = tables.labelled_reviews(spark, sf_dir)
    return terms.review_ngrams(rv, n, carry=("label", "weight"), **kw)


def reviews_scan(spark, sf_dir):
    return tables.read_reviews(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def is_ascii_q(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), is_ascii("text").alias("is_ascii"))


def correct_text_q(spark, sf_dir):
    return tables.reviews(spark, sf_dir).select("review_id", "text")


def unigrams(spark, sf_dir):
    return terms.review_tokens(tables.reviews(spark, sf_dir))


def bigrams(spark, sf_dir):
    return terms.review_ngrams(tables.reviews(spark, sf_dir), 2)


def trigrams(spark, sf_dir):
    return terms.review_ngrams(tables.reviews(spark, sf_dir), 3)


def bigrams_filtered(spark, sf_dir):
    return terms.review_ngrams(tables.reviews(spark, sf_dir), 2, filter_stops=True, filter_nums=True)


def bigrams_min_freq(spark, sf_dir):
    return terms.review_ngrams(tables.reviews(spark, sf_dir), 2, min_freq=2)


def unigrams_pos(spark, sf_dir):
    """T7 lexicon join: a (term, pos) lexicon of the corpus vocabulary is
    tagged once, then left-joined to every token."""
    tok = terms.review_tokens(tables.reviews(spark, sf_dir))
    lexicon = terms.with_pos(tok.select("term").distinct())
    return terms.with_pos(tok, lexicon=lexicon)


def recycle_labels(spark, sf_dir):
    tok = terms.review_tokens(tables.reviews(spark, sf_dir))
    return terms.recycle(tok, tables.review_labels(spark, sf_dir).select("review_id", "label"))


def term_frequency(spark, sf_dir):
    return terms.term_frequency(terms.review_tokens(tables.reviews(spark, sf_dir)))


def term_frequency_bigrams(spark, sf_dir):
    return terms.term_frequency(terms.review_ngrams(tables.reviews(spark, sf_dir), 2), n=2)


def term_frequency_weighted(spark, sf_dir):
    tok = terms.review_tokens(tables.reviews(spark, sf_dir), carry=("weight",))
    return terms.term_frequency(tok, weight_col="weight")


def term_frequency_sorted(spark, sf_dir):
    return terms.sort_frequency(term_frequency(spark, sf_dir))


def term_frequency_by_label(spark, sf_dir):
    return terms.term_frequency(_labelled_tokens(spark, sf_dir), label_col="label")


def term_frequency_pos(spark, sf_dir):
    tok = terms.with_pos(terms.review_tokens(tables.reviews(spark, sf_dir)))
    return terms.term_frequency(tok, types="NOUN")


def term_frequency_extra_stopwords(spark, sf_dir):
    tok = terms.review_tokens(tables.reviews(spark, sf_dir))
    return terms.term_frequency(tok, additional_stopwords=EXTRA_STOPWORDS)


def term_frequency_by_label_weighted(spark, sf_dir):
    return terms.term_frequency(_labelled_tokens(spark, sf_dir, 2), n=2, label_col="label",
                                weight_col="weight")


def top_ngrams(spark, sf_dir):
    return terms.top_terms(term_frequency_bigrams(spark, sf_dir), TOP_K)


def top_ngrams_one_label(spark, sf_dir):
    tok = _labelled_tokens(spark, sf_dir, 2).where(F.col("label") == ONE_LABEL)
    return terms.top_terms(terms.term_frequency(tok, n=2, label_col="label"), TOP_K)


def top_ngrams_by_label(spark, sf_dir):
    """Flagship: the ten most frequent terms of each cluster."""
    tf = terms.term_frequency(_labelled_tokens(spark, sf_dir), label_col="label")
    return terms.top_terms(tf, TOP_K)


def wordcloud_weights(spark, sf_dir):
    tok = terms.with_pos(terms.review_tokens(tables.reviews(spark, sf_dir)))
    return terms.wordcloud_weights(terms.term_frequency(tok, types=POS_TYPES), WORDCLOUD_MAX)


def wordcloud_weights_by_label(spark, sf_dir):
    tok = terms.with_pos(_labelled_tokens(spark, sf_dir))
    tf = terms.term_frequency(tok, types=POS_TYPES, label_col="label", weight_col="weight")
    return terms.wordcloud_weights(tf, WORDCLOUD_MAX)


def label_crosstab_topk(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"),
                                                       F.col("source").alias("true_label"))
    return report.label_crosstab_topk(d.join(tables.review_labels(spark, sf_dir), "review_id"), CROSSTAB_K)


def cluster_summary(spark, sf_dir):
    return report.cluster_summary(tables.review_labels(spark, sf_dir))


def sample_reviews(spark, sf_dir):
    rv = tables.labelled_reviews(spark, sf_dir, corrected=False).select("review_id", "label", "text")
    return sample.sample_reviews(rv, SAMPLE_K, SAMPLE_SEED)


QUERIES = {
    "reviews_scan": reviews_scan,
    "is_ascii": is_ascii_q,
    "correct_text": correct_text_q,
    "unigrams": unigrams,
    "bigrams": bigrams,
    "trigrams": trigrams,
    "bigrams_filtered": bigrams_filtered,
    "bigrams_min_freq": bigrams_min_freq,
    "pos_lexicon_join": unigrams_pos,
    "recycle_labels": recycle_labels,
    "term_frequency": term_frequency,
    "term_frequency_bigrams": term_frequency_bigrams,
    "term_frequency_weighted": term_frequency_weighted,
    "term_frequency_sorted": term_frequency_sorted,
    "term_frequency_by_label": term_frequency_by_label,
    "term_frequency_pos": term_frequency_pos,
    "term_frequency_extra_stopwords": term_frequency_extra_stopwords,
    "term_frequency_by_label_weighted": term_frequency_by_label_weighted,
    "top_ngrams": top_ngrams,
    "top_ngrams_one_label": top_ngrams_one_label,
    "top_ngrams_by_label": top_ngrams_by_label,
    "wordcloud_weights": wordcloud_weights,
    "wordcloud_weights_by_label": wordcloud_weights_by_label,
    "label_crosstab_topk": label_crosstab_topk,
    "cluster_summary": cluster_summary,
    "sample_reviews": sample_reviews,
}

# --------------------------------------------------------------------------
# DuckDB SQL

_RV = corrected_reviews_cte()
_LAB = "lab AS (SELECT doc_id AS review_id, quality AS label, CAST(toxic AS DOUBLE) AS sentiment FROM labels)"
_W = "wt AS (SELECT doc_id AS review_id, CAST(n_chars AS DOUBLE) AS weight FROM documents)"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip()) + "\n"


def _tf(src: str, where: str = "", label: bool = False, weight: bool = False) -> str:
    lab = "label, " if label else ""
    agg = "SUM(weight)" if weight else "COUNT(*)"
    w = f"WHERE {where}" if where else ""
    return f"SELECT {lab}term, {agg} AS frequency FROM {src} {w} GROUP BY ALL"


def _topk(src: str, k: int, by_label: bool, extra: str = "") -> str:
    part = "PARTITION BY label " if by_label else ""
    return (f"SELECT * {extra} FROM (SELECT *, CAST(row_number() OVER ({part}ORDER BY frequency DESC, term ASC) AS BIGINT) AS rank "
            f"FROM ({src})) WHERE rank <= {k}")


_POS = pos_tag_sql("term")
_NOT_STOP = f"term NOT IN {STOP_SQL}"

SQL = {
    "reviews_scan": "SELECT doc_id AS review_id, text FROM documents",
    "is_ascii": "SELECT doc_id AS review_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS is_ascii FROM documents",
    "correct_text": _with(_RV) + "SELECT review_id, text FROM rv",
    "unigrams": _with(_RV, tokens_cte()) + "SELECT review_id, idx, term FROM tok",
    "bigrams": _with(_RV, tokens_cte(n=2)) + "SELECT review_id, idx, term FROM tok",
    "trigrams": _with(_RV, tokens_cte(n=3)) + "SELECT review_id, idx, term FROM tok",
    "bigrams_filtered": _with(_RV, tokens_cte(n=2)) + (
        f"SELECT review_id, idx, term FROM tok WHERE ws[1] NOT IN {STOP_SQL} AND ws[-1] NOT IN {STOP_SQL} "
        "AND len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{N}+$'))) = 0"),
    "bigrams_min_freq": _with(_RV, tokens_cte(n=2)) + (
        "SELECT review_id, idx, term FROM (SELECT *, COUNT(*) OVER (PARTITION BY review_id, lower(term)) AS c FROM tok) "
        "WHERE c >= 2"),
    "pos_lexicon_join": _with(_RV, tokens_cte()) + f"SELECT review_id, idx, term, {_POS} AS pos FROM tok",
    "recycle_labels": _with(_RV, tokens_cte(), _LAB) + "SELECT review_id, idx, term, label FROM tok JOIN lab USING (review_id)",
    "term_frequency": _with(_RV, tokens_cte()) + _tf("tok", _NOT_STOP),
    "term_frequency_bigrams": _with(_RV, tokens_cte(n=2)) + _tf("tok"),
    "term_frequency_weighted": _with(_RV, tokens_cte(), _W) + _tf("tok JOIN wt USING (review_id)", _NOT_STOP, weight=True),
    "term_frequency_sorted": _with(_RV, tokens_cte()) + _tf("tok", _NOT_STOP) + " ORDER BY frequency DESC, term ASC",
    "term_frequency_by_label": _with(_RV, tokens_cte(), _LAB) + _tf("tok JOIN lab USING (review_id)", _NOT_STOP, label=True),
    "term_frequency_pos": _with(_RV, tokens_cte()) + _tf("tok", f"{_NOT_STOP} AND ({_POS}) = 'NOUN'"),
    "term_frequency_extra_stopwords": _with(_RV, tokens_cte()) + _tf(
        "tok", f"{_NOT_STOP} AND term NOT IN {sql_list(EXTRA_STOPWORDS)}"),
    "term_frequency_by_label_weighted": _with(_RV, tokens_cte(n=2), _LAB, _W) + _tf(
        "tok JOIN lab USING (review_id) JOIN wt USING (review_id)", label=True, weight=True),
    "top_ngrams": _with(_RV, tokens_cte(n=2)) + _topk(_tf("tok"), TOP_K, False),
    "top_ngrams_one_label": _with(_RV, tokens_cte(n=2), _LAB) + _topk(
        _tf("tok JOIN lab USING (review_id)", f"label = {ONE_LABEL}", label=True), TOP_K, True),
    "top_ngrams_by_label": _with(_RV, tokens_cte(), _LAB) + _topk(
        _tf("tok JOIN lab USING (review_id)", _NOT_STOP, label=True), TOP_K, True),
    "wordcloud_weights": _with(_RV, tokens_cte()) + (
        "SELECT *, CAST(frequency AS DOUBLE) / MAX(frequency) OVER () AS weight FROM ("
        + _topk(_tf("tok", f"{_NOT_STOP} AND ({_POS}) IN {sql_list(POS_TYPES)}"), WORDCLOUD_MAX, False) + ")"),
    "wordcloud_weights_by_label": _with(_RV, tokens_cte(), _LAB, _W) + (
        "SELECT *, frequency / MAX(frequency) OVER (PARTITION BY label) AS weight FROM ("
        + _topk(_tf("tok JOIN lab USING (review_id) JOIN wt USING (review_id)",
                    f"{_NOT_STOP} AND ({_POS}) IN {sql_list(POS_TYPES)}", label=True, weight=True),
                WORDCLOUD_MAX, True) + ")"),
    "label_crosstab_topk": (
        "SELECT * FROM (SELECT label, true_label, frequency, CAST(row_number() OVER (PARTITION BY label ORDER BY frequency DESC, true_label) AS BIGINT) AS rank "
        "FROM (SELECT l.quality AS label, d.source AS true_label, COUNT(*) AS frequency FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)) "
        f"WHERE rank <= {CROSSTAB_K}"),
    "cluster_summary": "SELECT quality AS label, COUNT(*) AS n, round(AVG(CAST(toxic AS DOUBLE)), 2) AS sentiment FROM labels GROUP BY ALL",
    "sample_reviews": (
        "SELECT * FROM (SELECT d.doc_id AS review_id, l.quality AS label, d.text, "
        f"CAST(row_number() OVER (PARTITION BY l.quality ORDER BY md5(concat('{SAMPLE_SEED}-', CAST(d.doc_id AS VARCHAR))), d.doc_id) AS BIGINT) AS sample_rank "
        f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE sample_rank <= {SAMPLE_K}"),
}
