"""Registered report queries: S2 (report job), S4/S5 (text lines), S6 (model round trip).

Binding: ``embeddings`` give vectors and cluster labels, the review with the
same id (``doc_id = vec_id``) gives the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loupe.operators import geometry as G
from loupe.operators.estimators import CentersModel
from loupe.plans import report_job
from loupe.plans.vector_queries import _ASSIGN0, _E, _w
from loupe.session import checkpoint_dir
from loupe.sources import sinks, tables

TEXT_K = 3
SEED = 314
TITLE, MARK = "sampled reviews", "\n\x1e\n"


def _inputs(spark, sf_dir, corrected=False):
    """Reviews that have a vector, and the vectors that have a review."""
    v = tables.vectors(spark, sf_dir)
    rv = tables.reviews(spark, sf_dir, corrected=corrected).select("review_id", "text")
    rv = rv.join(v.select("review_id", "label"), "review_id")
    v = v.join(rv.select("review_id"), "review_id", "left_semi")
    return v, rv


def cluster_text_central(spark, sf_dir):
    v, rv = _inputs(spark, sf_dir)
    return sinks.cluster_text(rv, v, G.centers(v, normalize=True), {"central_sentences": TEXT_K})["central_sentences"]


def cluster_text_random(spark, sf_dir):
    v, rv = _inputs(spark, sf_dir)
    return sinks.cluster_text(rv, v, None, {"random": TEXT_K}, seed=SEED)["random_sentences"]


def cluster_text_lines(spark, sf_dir):
    """The files of sampled reviews, written and read again: what stands between their separators."""
    v, rv = _inputs(spark, sf_dir)
    lines = sinks.cluster_text(rv, v, None, {"random": TEXT_K}, seed=SEED)["random_sentences"]
    path = _scratch(spark, "text")
    sinks.write_text(lines, path, TITLE, sep=MARK)
    return spark.read.option("lineSep", MARK).text(path).select(F.col("label").cast("int").alias("label"), "value")


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def model_roundtrip(spark, sf_dir):
    """Labels by the unit centres of the given clusters, after saving and loading them as a model."""
    v = tables.vectors(spark, sf_dir)
    path = _scratch(spark, "model")
    CentersModel(G.centers(v, normalize=True)).write().save(path)
    return CentersModel.load(path).transform(v.drop("label")).select("review_id", "label")


def topic_report(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    rv = tables.reviews(spark, sf_dir).select("review_id", "text").join(v.select("review_id", "label"), "review_id")
    return report_job.topic_report(_scratch(spark, "topic-report"), rv, v, seed=SEED,
                                   text_params={"random": TEXT_K, "central_sentences": TEXT_K})


QUERIES = {
    "cluster_text_central": cluster_text_central,
    "cluster_text_random": cluster_text_random,
    "cluster_text_lines": cluster_text_lines,
    "model_roundtrip": model_roundtrip,
    "topic_report": topic_report,
}

_BASE = """e AS (SELECT vec_id AS review_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
       WHERE vec_id IN (SELECT doc_id FROM documents)),
rv AS (SELECT e.review_id, e.label, d.text FROM e JOIN documents d ON d.doc_id = e.review_id),
summ AS (SELECT label, 'label = ' || CAST(label AS VARCHAR) || ', n = ' || CAST(COUNT(*) AS VARCHAR) || ', sentiment = NA' AS line
         FROM rv GROUP BY label)"""

SQL = {
    "model_roundtrip": _w(_E, _ASSIGN0) + "SELECT review_id, label FROM a1",
    "cluster_text_central": "WITH " + _BASE + """,
el AS (SELECT review_id, label, generate_subscripts(x, 1) AS dim, unnest(x) AS v FROM e),
cv AS (SELECT label, list(c ORDER BY dim) AS cx FROM (SELECT label, dim, AVG(v) AS c FROM el GROUP BY ALL) GROUP BY label),
d AS (SELECT e.review_id, cv.label AS center_label, 1 - list_cosine_similarity(e.x, cv.cx) AS distance FROM e, cv),
r AS (SELECT d.*, row_number() OVER (PARTITION BY center_label ORDER BY distance, review_id) AS rank,
             COUNT(*) OVER (PARTITION BY center_label) AS dummy FROM d),
sz AS (SELECT label, COUNT(*) AS n FROM rv GROUP BY label)
SELECT label, CAST(0 AS BIGINT) AS line_no, line FROM summ
UNION ALL
SELECT r.center_label AS label, CAST(r.rank AS BIGINT) AS line_no,
       CAST(round(r.distance, 2) AS VARCHAR) || ', ' || COALESCE(rv.text, '') AS line
FROM r JOIN sz ON sz.label = r.center_label LEFT JOIN rv ON rv.review_id = r.review_id
WHERE r.rank <= """ + str(TEXT_K) + " AND r.rank <= sz.n",
    "cluster_text_random": "WITH " + _BASE + """
SELECT label, CAST(0 AS BIGINT) AS line_no, line FROM summ
UNION ALL
SELECT label, line_no, text AS line FROM (
  SELECT label, text, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(concat('""" + str(SEED) + """-', CAST(review_id AS VARCHAR))), review_id) AS BIGINT) AS line_no
  FROM rv) WHERE line_no <= """ + str(TEXT_K),
    "cluster_text_lines": "WITH " + _BASE + f"""
SELECT label, '{TITLE}' || chr(10) || ' ' || chr(10) || ' ' || chr(10) || line AS value FROM summ
UNION ALL
SELECT label, text AS value FROM (
  SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5(concat('{SEED}-', CAST(review_id AS VARCHAR))), review_id) AS k FROM rv) WHERE k <= {TEXT_K}""",
}
