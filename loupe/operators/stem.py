"""Porter stems of unigrams and n-grams.

For a vocabulary, the Python stemmer runs once per *distinct* term (a pandas UDF,
Arrow batches) and the result is joined back on the term. The vocabulary is
data-derived, so AQE picks broadcast or shuffle from its measured size, and its
skew handling splits a hot term's partition. For n-grams of reviews the words are
stemmed in the review's row, from a bounded cache of the worker, before n-grams
are built: no n-gram is stemmed twice and nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from loupe.functions.porter import stem as porter_stem
from loupe.functions.text import ngram_array, words
from loupe.session import ship_package


@lru_cache(maxsize=200_000)
def _stem_word(word: str) -> str:
    return porter_stem(word)


@pandas_udf(ArrayType(StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [_stem_word(w) for w in ws])


def review_ngram_stems(reviews: DataFrame, n: int, text_col: str = "text", key: str = "review_id", carry=()) -> DataFrame:
    """n-grams with the n-grams of their words' stems: ``(review_id, idx, term, *carry, stem)``."""
    ship_package(reviews.sparkSession)
    rows = reviews.select(F.col(key).alias("review_id"), *[F.col(c) for c in carry], words(text_col).alias("_words"))
    rows = rows.withColumn("_stems", stem_words("_words"))
    both = F.arrays_zip(ngram_array(F.col("_words"), n).alias("term"), ngram_array(F.col("_stems"), n).alias("stem"))
    return rows.select("review_id", *carry, F.posexplode(both).alias("idx", "z")).select(
        "review_id", "idx", F.col("z.term").alias("term"), *carry, F.col("z.stem").alias("stem"))


def stem_phrase(term: str) -> str:
    """Stem each space-separated word and rejoin them."""
    return " ".join(porter_stem(w) for w in term.split())


@pandas_udf(StringType())
def stem_udf(terms: pd.Series) -> pd.Series:
    return terms.map(stem_phrase)


def stem_vocabulary(tokens: DataFrame, term_col: str = "term") -> DataFrame:
    """``(term, stem)`` for every distinct term."""
    ship_package(tokens.sparkSession)
    vocab = tokens.select(F.col(term_col).alias("term")).distinct()
    return vocab.select("term", stem_udf("term").alias("stem"))


def with_stems(tokens: DataFrame, term_col: str = "term", vocab: DataFrame | None = None) -> DataFrame:
    """Add a ``stem`` column to a token or n-gram table."""
    vocab = stem_vocabulary(tokens, term_col) if vocab is None else vocab
    return tokens.join(vocab.withColumnRenamed("term", term_col), term_col, "left")
