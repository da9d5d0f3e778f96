"""The one-call topic report job.

Validates the inputs with aggregate checks, fills parameters (S3), then
writes one Parquet table per artifact: the model (S6), top n-grams per
cluster (P1), word-cloud weights (P2), the cluster summary (P4), random and
central review texts (S4/S5), centre-distance densities (G9), the centre
distance matrix (G7) and silhouettes with their plot bands (G10, P6; squared
Euclidean ones for the Euclidean metric, and named so). Centres, labels and
precisions come from a fitted model (``operators.estimators``) where they are not
given. Names, metric and precisions are checked before anything is written. The review texts shared by
several artifacts are checkpointed to the session's checkpoint folder once,
which also cuts their lineage.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.operators import geometry as G
from loupe.operators import report, stem, terms
from loupe.operators.estimators import CentersModel
from loupe.session import checkpoint_dir
from loupe.sources import sinks


def validate(vectors: DataFrame, centers: list, reviews: DataFrame) -> int:
    """Aggregate checks: labels are 0..g-1, one centre per label, equal dims."""
    s = vectors.agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                    F.countDistinct("label").alias("g"), F.min(F.size("embedding")).alias("d0"),
                    F.max(F.size("embedding")).alias("d1"), F.count(F.lit(1)).alias("n")).first()
    if s["lo"] != 0 or s["hi"] != s["g"] - 1:
        raise ValueError("labels must be 0, 1, ..., g-1")
    if len(centers) != s["g"]:
        raise ValueError("one centre per label is required")
    if s["d0"] != s["d1"] or any(len(c) != s["d0"] for _, c in centers):
        raise ValueError("embeddings and centres must share one dimension")
    missing = vectors.join(reviews, "review_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} embeddings have no review")
    return int(s["g"])


SIZES = {"unigram": 1, "bigram": 2, "trigram": 3}
SILHOUETTES = {"cosine": ("silhouettes", "cosine"), "euclidean": ("silhouettes_sqeuclidean", "sqeuclidean")}


def validate_options(options: sinks.ReportOptions, labels: list[int], precisions) -> None:
    """Refuse what a later artifact could not be made from."""
    for name in [*options.ngrams.names, *options.clouds.names]:
        if name.removesuffix("_stem") not in SIZES:
            raise ValueError(f"unknown n-gram name {name!r}: one of {sorted(SIZES)}, with _stem for stems")
    if any(types is not None for types in options.clouds.types):
        tagless = [name for name in options.clouds.names if SIZES[name.removesuffix("_stem")] > 1]
        if tagless:
            raise ValueError(f"word types need unigrams, not {tagless}: n-grams have no part of speech")
    if options.metric == "mahalanobis":
        given = set(G.precision_matrices(precisions) or ())
        if not set(labels) <= given:
            raise ValueError(f"mahalanobis needs a precision matrix for each label; none for {sorted(set(labels) - given)}")
        if options.diagnostics.silhouettes:
            raise ValueError("silhouettes exist for the cosine and euclidean metrics")


def _tokens(reviews: DataFrame, name: str) -> tuple[DataFrame, str, int]:
    n, stemmed = SIZES[name.removesuffix("_stem")], name.endswith("_stem")
    tok = (stem.review_ngram_stems if stemmed else terms.review_ngrams)(reviews, n, carry=("label",))
    if n == 1:
        tok = terms.with_pos(tok)
    return tok, "stem" if stemmed else "term", n


def topic_report(path: str, reviews: DataFrame, vectors: DataFrame, centers=None, metric: str = "cosine",
                 precisions=None, seed: int = 0, ngram_params=None, wordcloud_params=None,
                 text_params=None, diagnostic_params=None, overwrite: bool = False, model=None) -> DataFrame:
    """Write every artifact of a clustering under ``path``; return ``(artifact, rows)``.

    With a fitted ``model`` (``CentersModel`` or ``MixtureClusters``) vectors and
    reviews need no label, and centres and precisions are the model's unless given.
    """
    spark = reviews.sparkSession
    checkpoint_dir(spark)
    options = sinks.ReportOptions(metric, ngram_params, wordcloud_params, text_params, diagnostic_params)
    ngrams, clouds, diagnostics = options.ngrams, options.clouds, options.diagnostics
    if model is not None:
        if "label" not in vectors.columns:
            vectors = model.transform(vectors).withColumnRenamed(model.getPredictionCol(), "label").checkpoint()
        if "label" not in reviews.columns:
            reviews = reviews.join(vectors.select("review_id", "label"), "review_id")
        centers = model.centers if centers is None else centers
        if metric == "mahalanobis" and precisions is None:
            if not hasattr(model, "precisions"):
                raise ValueError("mahalanobis needs precision matrices or a fitted mixture")
            precisions = model.precisions
    if centers is None:
        centers = G.centers(vectors, normalize=(metric == "cosine"))
    centers = G.collect_centers(centers)
    validate(vectors, centers, reviews)
    validate_options(options, [label for label, _ in centers], precisions)
    mode = "overwrite" if overwrite else "errorifexists"
    root = path.rstrip("/")
    written: list[tuple[str, DataFrame]] = []

    def put(name: str, df: DataFrame) -> None:
        df.write.mode(mode).parquet(f"{root}/{name}")
        written.append((name, spark.read.parquet(f"{root}/{name}")))

    saved = model or CentersModel(centers)._set(metric=metric if metric == "euclidean" else "cosine")
    (saved.write().overwrite() if overwrite else saved.write()).save(f"{root}/model")

    rv = reviews.select("review_id", "text", "label").checkpoint()
    for name in ngrams.names:
        tok, col, n = _tokens(rv, name)
        tf = terms.term_frequency(tok, term_col=col, n=n, use_stem=(col == "stem"), label_col="label",
                                  additional_stopwords=ngrams.additional_stopwords.get(name))
        put(f"ngram_{name}", terms.top_terms(tf, ngrams.k))
    for name in clouds.names:
        tok, col, n = _tokens(rv, name)
        for types in clouds.types:
            tf = terms.term_frequency(tok, term_col=col, n=n, use_stem=(col == "stem"), types=types,
                                      label_col="label",
                                      additional_stopwords=clouds.additional_stopwords.get(name))
            suffix = "" if types is None else "_" + "_".join(types).lower()
            put(f"wordcloud_{name}{suffix}", terms.wordcloud_weights(tf, clouds.max_words))

    put("cluster_summary", report.cluster_summary(reviews))

    tables = sinks.cluster_text(reviews, vectors, centers, asdict(options.texts), metric, precisions, seed)
    sinks.write_cluster_text(f"{root}/text", tables, overwrite)
    for name, lines in tables.items():
        put(name, lines)

    if diagnostics.center_distance_density:
        own = G.own_center_distance(vectors, centers, metric, precisions)
        put("center_distance_density", G.center_distance_density(own))
    if diagnostics.distance_between_clusters:
        put("distance_between_clusters", G.center_distance_matrix(centers, metric, precisions, spark))
    if diagnostics.silhouettes:
        name, kind = SILHOUETTES[metric]
        put(name, report.silhouette_bands(G.silhouette_samples(vectors, metric=kind)))
    rows = [(name, df.count()) for name, df in written]
    return spark.createDataFrame(rows, "artifact string, rows bigint")
