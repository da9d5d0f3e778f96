"""Tokens, n-grams and term-frequency tables.

Review-level columns (label, weight, sentiment) are carried through the
explode, so attaching them costs one join per *review* instead of one per
token. ``recycle`` is the token-level join for tables that do not carry them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions.pos import pos_tag
from loupe.functions.stopwords import ENGLISH_STOP_WORDS, as_list, stop_words_for
from loupe.functions.text import ngram_word_array, words

KEY = "review_id"


def review_tokens(reviews: DataFrame, text_col: str = "text", key: str = KEY,
                  carry=()) -> DataFrame:
    """T4: one row per word, ``(review_id, idx, term, *carry)``, idx 0-based."""
    return reviews.select(
        F.col(key).alias(KEY), *[F.col(c) for c in carry],
        F.posexplode(words(text_col)).alias("idx", "term"),
    ).select(KEY, "idx", "term", *carry)


def _all_words(slice_col: Column, pred) -> Column:
    return F.forall(slice_col, pred)


def review_ngrams(reviews: DataFrame, n: int, text_col: str = "text", key: str = KEY,
                  carry=(), filter_stops: bool = False, stop_words=ENGLISH_STOP_WORDS,
                  filter_nums: bool = False, include_pos=None, exclude_pos=None,
                  min_freq: int = 1) -> DataFrame:
    """N-grams ``(review_id, idx, term, *carry)``.

    Options follow the usual n-gram extractor: ``filter_stops`` drops n-grams
    that start or end with a stop word, ``filter_nums`` drops n-grams holding
    a number, ``include_pos`` / ``exclude_pos`` keep n-grams whose words all
    have / none has one of the given tags, ``min_freq`` keeps n-grams seen at
    least that often in their review. Tokens hold no punctuation, so the
    punctuation filter has nothing to remove.
    """
    if n == 1 and not (filter_stops or filter_nums or include_pos or exclude_pos or min_freq > 1):
        return review_tokens(reviews, text_col, key, carry)
    # the word array is materialised once per review; inlined into the
    # n-gram lambda the tokenising regex would run once per position
    wdf = reviews.select(F.col(key).alias(KEY), *[F.col(c) for c in carry],
                         words(text_col).alias("_words"))
    grams = wdf.select(
        KEY, *carry, F.posexplode(ngram_word_array(F.col("_words"), n)).alias("idx", "ws"),
    )
    conds = []
    if filter_stops:
        stops = list(stop_words)
        conds.append(~F.element_at("ws", 1).isin(stops) & ~F.element_at("ws", -1).isin(stops))
    if filter_nums:
        conds.append(_all_words(F.col("ws"), lambda w: ~w.rlike("^\\p{N}+$")))
    if include_pos:
        tags = as_list(include_pos)
        conds.append(_all_words(F.col("ws"), lambda w: pos_tag(w).isin(tags)))
    if exclude_pos:
        tags = as_list(exclude_pos)
        conds.append(_all_words(F.col("ws"), lambda w: ~pos_tag(w).isin(tags)))
    for c in conds:
        grams = grams.where(c)
    grams = grams.select(KEY, "idx", F.array_join("ws", " ").alias("term"), *carry)
    if min_freq > 1:
        # one pass: group the occurrences of each (review, lower-cased n-gram)
        # and keep groups seen often enough; a group is bounded by its
        # review's length, and the n-grams are generated only once
        occ = grams.groupBy(KEY, F.lower("term").alias("_lt")).agg(
            F.collect_list(F.struct("idx", "term", *carry)).alias("_occ"))
        grams = (occ.where(F.size("_occ") >= min_freq)
                 .select(KEY, F.inline("_occ")).select(KEY, "idx", "term", *carry))
    return grams


def with_pos(tokens: DataFrame, term_col: str = "term", lexicon: DataFrame | None = None) -> DataFrame:
    """Attach a ``pos`` column.

    Without a lexicon the rule tagger runs as a projection. With a lexicon
    ``(term, pos)`` it is a left join; unmatched tokens get a null tag.
    """
    if lexicon is None:
        return tokens.withColumn("pos", pos_tag(F.col(term_col)))
    lex = lexicon.select(F.col("term").alias("_lex_term"), F.col("pos"))
    return (tokens.join(lex, tokens[term_col] == lex["_lex_term"], "left").drop("_lex_term"))


def recycle(tokens: DataFrame, values: DataFrame, key: str = KEY) -> DataFrame:
    """Repeat a review-level value on each of the review's rows.

    Inner equi-join on the key: a review with no tokens simply vanishes.
    Catalyst/AQE pick broadcast or sort-merge from the measured sizes; a hot
    review is split by AQE's skew-join handling.
    """
    return tokens.join(values, key, "inner")


def term_frequency(tokens: DataFrame, term_col: str = "term", n: int = 1,
                   use_stem: bool = False, types=None, label_col: str | None = None,
                   weight_col: str | None = None, additional_stopwords=None,
                   stop_words: DataFrame | None = None) -> DataFrame:
    """``([label,] term, frequency)``.

    Built-in stop words apply only to plain unigrams (``n == 1`` and not
    stems); ``additional_stopwords`` apply to any term column as whole terms.
    A large stop-word table can be passed as a DataFrame (anti join).
    The aggregation is partial per task before the shuffle, so a hot term
    ships one row per task.
    """
    stops = stop_words_for(n, use_stem, additional_stopwords)
    df = tokens
    if stops:
        df = df.where(~F.col(term_col).isin(stops))
    if stop_words is not None:
        df = df.join(stop_words.select(F.col(stop_words.columns[0]).alias(term_col)), term_col, "left_anti")
    if types is not None:
        df = df.where(F.col("pos").isin(as_list(types)))
    keys = ([F.col(label_col).alias("label")] if label_col else []) + [F.col(term_col).alias("term")]
    if weight_col:
        agg = F.sum(F.col(weight_col).cast("double")).alias("frequency")
    else:
        agg = F.count(F.lit(1)).alias("frequency")
    return df.groupBy(*keys).agg(agg)


def sort_frequency(tf: DataFrame) -> DataFrame:
    """descending frequency, ties by term ascending."""
    order = ([F.col("label")] if "label" in tf.columns else []) + [F.desc("frequency"), F.asc("term")]
    return tf.orderBy(*order)


def top_terms(tf: DataFrame, k: int, by_label: bool | None = None) -> DataFrame:
    """The k most frequent terms, overall or per label, with their rank.

    Per label this is ``row_number() <= k`` with a literal k, which Spark
    plans as a partial WindowGroupLimit before the shuffle.
    """
    by_label = ("label" in tf.columns) if by_label is None else by_label
    if by_label:
        w = Window.partitionBy("label").orderBy(F.desc("frequency"), F.asc("term"))
    else:
        w = Window.orderBy(F.desc("frequency"), F.asc("term"))
        # global: TakeOrderedAndProject keeps k rows per task, then k overall
        tf = tf.orderBy(F.desc("frequency"), F.asc("term")).limit(k)
    return (tf.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def wordcloud_weights(tf: DataFrame, max_words: int = 20) -> DataFrame:
    """Top ``max_words`` terms with weight relative to the most frequent."""
    top = top_terms(tf, max_words)
    part = Window.partitionBy("label") if "label" in tf.columns else Window.partitionBy()
    return top.withColumn("weight", F.col("frequency").cast("double") / F.max("frequency").over(part))
