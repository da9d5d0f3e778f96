"""Language flag (1 English, 0 other, 2 undetermined) by naive Bayes.

A multinomial naive-Bayes language model over word tokens, trained and
applied as Spark aggregations and joins:

* train: ``groupBy(lang, term).count()`` (sparse), per-language token totals
  and document priors, vocabulary size V;
* score: one equi-join of the words to the model as a per-term vector over
  languages (broadcast where it is proven small), one per-review sum of
  ``log(c + 1)`` for each language by plain aggregates, so words combine
  map-side; the unseen-pair mass is the closed form
  ``- n_in_vocab * log(T_lang + V)``; the language table (a handful of rows)
  is the only constant;
* choose: highest score, ties to the alphabetically first language.

Add-one smoothing: log p(w | l) = log(c_lw + 1) - log(T_l + V).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.guards import bounded_broadcast, collect_bounded
from loupe.session import keep

MAX_LANGUAGES = 10_000


def train(tokens: DataFrame, docs: DataFrame, lang_col: str = "lang") -> tuple[DataFrame, list]:
    """Return (sparse model ``(term, lang, logc)``, language stats list).

    ``tokens`` is ``(review_id, term, lang)`` or already-aggregated
    ``(review_id, term, lang, n)`` rows; ``docs`` is ``(review_id, lang)``.
    """
    n = F.col("n") if "n" in tokens.columns else F.lit(1)
    counts = keep(tokens.groupBy(F.col(lang_col).alias("lang"), "term").agg(F.sum(n).alias("c")))
    model = counts.select("term", "lang", F.log(F.col("c") + 1.0).alias("logc"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("t"))
    v = counts.select("term").distinct().count()
    priors = docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("d"))
    stats = sorted(collect_bounded(priors.join(totals, "lang", "left"), "language table", MAX_LANGUAGES),
                   key=lambda r: r["lang"])
    n_docs = float(sum(r["d"] for r in stats))
    lang_stats = [(r["lang"], math.log(r["d"] / n_docs), math.log(float(r["t"] or 0) + v)) for r in stats]
    return model, lang_stats


def profile(model: DataFrame, lang_stats: list) -> DataFrame:
    """Dense-free view of the model: ``(lang, term, logp)`` for seen pairs."""
    den = F.create_map(*[x for lang, _, ld in lang_stats for x in (F.lit(lang), F.lit(ld))])
    return model.select("lang", "term", (F.col("logc") - F.element_at(den, F.col("lang"))).alias("logp"))


def score(tokens: DataFrame, reviews: DataFrame, model: DataFrame, lang_stats: list,
          english: str = "en") -> DataFrame:
    """``(review_id, lang_pred, is_english)`` for every review.

    ``tokens`` is ``(review_id, term)`` or aggregated ``(review_id, term, n)``
    rows; ``reviews`` lists every review id.
    The model becomes one row per term holding log(c + 1) for every language
    (exactly 0 where the pair was never seen), so scoring is one join and
    one sum per review and language; the argmax is a projection. Reviews without
    any known word get no prediction and flag 2.
    """
    if len(lang_stats) > MAX_LANGUAGES:
        raise ValueError("too many languages for the constant language table")
    langs = [lang for lang, _, _ in lang_stats]
    n = F.col("n") if "n" in tokens.columns else F.lit(1)
    per_term = model.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("lang", "logc"))).alias("m"))
    lang_arr = F.array(*[F.lit(x) for x in langs])
    vec = per_term.select("term", F.transform(lang_arr, lambda l: F.coalesce(F.element_at("m", l), F.lit(0.0)))
                          .alias("logc"))
    joined = tokens.join(bounded_broadcast(vec), "term")
    sums = joined.groupBy("review_id").agg(F.sum(n).alias("n_in"), *[F.sum(F.get("logc", F.lit(i)) * n).alias(f"_{i}") for i in range(len(langs))])
    sums = sums.select("review_id", "n_in", F.array(*[F.col(f"_{i}") for i in range(len(langs))]).alias("s"))
    consts = F.array(*[F.struct(F.lit(lp).alias("prior"), F.lit(ld).alias("logden")) for _, lp, ld in lang_stats])
    scores = F.zip_with(consts, F.col("s"), lambda c, x: c["prior"] - F.col("n_in") * c["logden"] + x)
    # highest score; equal scores go to the alphabetically first language
    best = F.array_min(F.transform(F.arrays_zip(scores.alias("sc"), lang_arr.alias("l")),
                                   lambda z: F.struct((-z["sc"]).alias("neg"), z["l"].alias("l"))))
    top = sums.select("review_id", best["l"].alias("lang_pred"))
    out = reviews.select("review_id").join(top, "review_id", "left")
    flag = F.when(F.col("lang_pred").isNull(), F.lit(2)).when(F.col("lang_pred") == english, F.lit(1)).otherwise(F.lit(0))
    return out.select("review_id", "lang_pred", flag.alias("is_english"))
