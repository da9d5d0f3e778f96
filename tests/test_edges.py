"""Equal distances, identical vectors, null values and zero vectors."""

import pytest

from loupe.operators import cluster, geometry as G, report
from loupe.session import get_session


def test_density_skips_labels_without_spread(spark):
    own = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, 0.1), (1, 0.9), (2, 0.3)], "label int, distance double")
    out = G.center_distance_density(own, 5).collect()
    assert {r["label"] for r in out} == {1} and len(out) == 5


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_silhouette_of_identical_vectors(spark, metric):
    df = spark.createDataFrame([(i, [1.0, 0.0], i % 2) for i in range(6)], "review_id long, embedding array<double>, label int")
    assert {r["silhouette"] for r in G.silhouette_samples(df, metric=metric).collect()} == {0.0}


def test_boxplot_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "g string, v double")
    r = report.boxplot_stats(df, "g", "v").first()
    assert (r["q1"], r["median"], r["q3"], r["outliers"]) == (1.5, 2.0, 2.5, 0)


def test_spherical_kmeans_labels_zero_vectors(spark):
    rows = [(i, [1.0, 0.1 * i]) for i in range(4)] + [(i, [0.1 * i, -1.0]) for i in range(4, 8)] + [(8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "review_id long, embedding array<double>")
    res = cluster.spherical_kmeans(df, k=2)
    labels = {r["review_id"]: r["label"] for r in res.labels.collect()}
    assert len(labels) == 9 and labels[8] == 0 and res.dropped_zero_rows == 1


def test_session_settings_are_left_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert get_session().conf.get("spark.sql.shuffle.partitions") == before
