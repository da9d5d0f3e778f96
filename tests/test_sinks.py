"""Parameters, text files, model round trip, report job."""

import glob
import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loupe.operators.estimators import CenterClustering, CentersModel, MixtureClustering
from loupe.plans import report_job
from loupe.sources import sinks


def test_report_options():
    o = sinks.ReportOptions(texts={"random": 3})
    assert o.texts == sinks.Texts(3, 10) and o.ngrams.k == 10 and o.clouds.max_words == 20
    assert o.diagnostics == sinks.Diagnostics(True, True, True)
    assert sinks.ReportOptions("mahalanobis").diagnostics == sinks.Diagnostics(False, False, False)
    assert sinks.ReportOptions("mahalanobis", diagnostics={"silhouettes": True}).diagnostics == sinks.Diagnostics(False, False, True)
    assert sinks.ReportOptions(ngrams=sinks.NgramTables(k=3)).ngrams.k == 3
    for bad in ({"texts": {"central": 5}}, {"metric": "manhattan"}, {"ngrams": {"max_words": 3}}):
        with pytest.raises(ValueError):
            sinks.ReportOptions(**bad)


def test_one_label_is_written_by_many_tasks_in_order(spark):
    n = 20_000
    lines = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    lines = lines.withColumn("line", F.concat("line", F.lit(" "), *(F.sha2(F.concat("line", F.lit(str(i))), 256) for i in range(4)))).repartition(7)
    out = tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp") + "/text"
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.write_text(lines, out, "title")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    for label in (0, 1):
        files = sorted(glob.glob(f"{out}/label={label}/part-*.txt"))
        text = "".join(open(f).read() for f in files)
        mine = [i for i in range(n) if (i % 3 == 0) == label]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = [f"line {i} " + "".join(sha(f"line {i}{j}") for j in range(4)) for i in mine]
        if label:  # line 0 is this label's: the title comes first
            want[0] = "title\n \n \n" + want[0]
        assert len(files) > 1 and text == "".join(w + "\n \n" for w in want)


def test_failed_writing_leaves_nothing(spark):
    top = tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp")
    rows = spark.createDataFrame([(0, 0, "head"), (0, 1, "x")], "label int, line_no bigint, line string")
    bad = rows.withColumn("line", F.when(F.col("line_no") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception):
        sinks.write_text(bad, f"{top}/a", "t")
    assert os.listdir(top) == []
    sinks.write_text(rows, f"{top}/a", "t")
    with pytest.raises(Exception):
        sinks.write_text(bad, f"{top}/a", "t", overwrite=True)
    assert os.listdir(top) == ["a"] and glob.glob(f"{top}/a/label=0/part-*.txt")  # the earlier one is whole
    with pytest.raises(FileExistsError):
        sinks.write_text(rows, f"{top}/a", "t")


def _inputs(spark):
    texts = ["this", "is", "just", "a", "test", "file"]
    rv = spark.createDataFrame([(i, t, 0 if i < 3 else 1, float(i % 2)) for i, t in enumerate(texts)],
                               "review_id bigint, text string, label int, sentiment double")
    v = spark.createDataFrame([(i, [float(i + 1), float(i + 1)], 0 if i < 3 else 1) for i in range(6)],
                              "review_id bigint, embedding array<double>, label int")
    return rv, v


def test_text_files(spark):
    rv, v = _inputs(spark)
    tables = sinks.cluster_text(rv, v, [(0, [2.0, 2.0]), (1, [5.0, 5.0])], {"central_sentences": 1},
                                metric="euclidean")
    lines = sorted((r.label, r.line_no, r.line) for r in tables["central_sentences"].collect())
    assert lines == [(0, 0, "label = 0, n = 3, sentiment = 0.33"), (0, 1, "0.0, is"),
                     (1, 0, "label = 1, n = 3, sentiment = 0.67"), (1, 1, "0.0, test")]
    out = tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp")
    sinks.write_cluster_text(out, tables)
    files = sorted(glob.glob(f"{out}/central_sentences/label=*/part-*.txt"))
    body = "".join(open(f).read() for f in files if "label=0" in f)
    assert body.startswith("sentences that are close to the cluster centers\n \n \n")
    assert "label = 0, n = 3, sentiment = 0.33\n \n0.0, is\n \n" in body
    with pytest.raises(Exception):
        sinks.write_cluster_text(out, tables)  # refuses to overwrite by default
    sinks.write_cluster_text(out, tables, overwrite=True)


def test_report_job(spark):
    rv, v = _inputs(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "report")
    arts = {r.artifact: r.rows for r in report_job.topic_report(
        out, rv, v, text_params={"random": 2, "central_sentences": 1}).collect()}
    assert set(arts) == {"ngram_bigram", "ngram_bigram_stem", "wordcloud_unigram_noun_verb_adj_adv_propn_part",
                         "wordcloud_unigram_stem_noun_verb_adj_adv_propn_part", "random_sentences",
                         "central_sentences", "center_distance_density", "distance_between_clusters",
                         "silhouettes", "cluster_summary"}
    assert arts["distance_between_clusters"] == 4 and arts["silhouettes"] == 6
    assert arts["random_sentences"] == 2 + 4
    bad = v.withColumn("label", F.col("label") + 1)
    with pytest.raises(ValueError):
        report_job.topic_report(out + "2", rv, bad)


@pytest.mark.parametrize("bad", [
    {"ngram_params": {"names": ["fourgram"]}},
    {"wordcloud_params": {"names": ["bigram"]}},
    {"metric": "mahalanobis"},
    {"metric": "mahalanobis", "precisions": {0: [[1.0, 0.0], [0.0, 1.0]]}},
])
def test_report_refuses_before_writing(spark, bad):
    rv, v = _inputs(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "report")
    with pytest.raises(ValueError):
        report_job.topic_report(out, rv, v, **bad)
    assert not os.path.exists(out)


def test_mahalanobis_report(spark):
    rv, v = _inputs(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "report")
    prec = {label: [[2.0, 0.5], [0.5, 1.0]] for label in (0, 1)}
    arts = {r.artifact: r.rows for r in report_job.topic_report(
        out, rv, v, metric="mahalanobis", precisions=prec, ngram_params={"names": ["unigram"]},
        diagnostic_params={"center_distance_density": True, "distance_between_clusters": True, "silhouettes": False}).collect()}
    assert arts["distance_between_clusters"] == 4 and arts["cluster_summary"] == 2 and "silhouettes" not in arts


@pytest.mark.parametrize("kind", ["centres", "full", "tied", "diag", "spherical"])
def test_report_from_a_fitted_model(spark, kind):
    """Labels, centres and precisions all come from the model, which is saved with the report."""
    rv, v = _inputs(spark)
    v = v.unionByName(spark.createDataFrame([(i, [float(i), 20.0 - i], 0) for i in range(6, 12)], v.schema)).drop("label")
    rv = rv.unionByName(spark.createDataFrame([(i, f"word{i} more", 0, 1.0) for i in range(6, 12)], rv.schema)).drop("label")
    model = (CenterClustering(k=2, metric="euclidean", seed=3) if kind == "centres" else MixtureClustering(k=2, covarianceType=kind, regCovar=0.1, seed=3)).fit(v)
    metric = "euclidean" if kind == "centres" else "mahalanobis"
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "report")
    arts = {r.artifact: r.rows for r in report_job.topic_report(
        out, rv, v, metric=metric, model=model, ngram_params={"names": ["unigram"]}, text_params={"random": 2, "central_sentences": 2},
        diagnostic_params={"center_distance_density": True, "distance_between_clusters": True, "silhouettes": kind == "centres"}).collect()}
    assert arts["cluster_summary"] == 2 and arts["distance_between_clusters"] == 4 and arts["central_sentences"] == 2 * 2 + 2
    loaded = type(model).load(f"{out}/model")
    assert loaded.centers == model.centers
    labels = lambda m: sorted(tuple(r) for r in m.transform(v).select("review_id", "label").collect())
    assert labels(loaded) == labels(model)


def test_mahalanobis_report_needs_precisions(spark):
    rv, v = _inputs(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="loupe-test-", dir="/tmp"), "report")
    with pytest.raises(ValueError):
        report_job.topic_report(out, rv, v, metric="mahalanobis", model=CentersModel([(0, [1.0, 1.0]), (1, [2.0, 2.0])]))
    with pytest.raises(ValueError):  # a vector without a review
        report_job.topic_report(out, rv.where("review_id > 0"), v)
    assert not os.path.exists(out)
