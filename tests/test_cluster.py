"""Clustering: properties that hold whatever the start."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rillwork.operators import cluster as M


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        c = 0 if i < 120 else 1 if i < 200 else 2
        centre = [(0, 0, 0), (20, 0, 5), (0, 30, -5)][c]
        rows.append((i, c, *[v + rng.gauss(0, 1) for v in centre]))
    rows.append((999, None, None, None, None))
    return spark.createDataFrame(rows, "i int, c int, a double, b double, d double")


def test_standardise_uses_population_deviation(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert [tuple(r)[2:] for r in M.standardise(rows, ["x", "y"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_clusters_are_found_saved_and_looked_up(spark, blobs, tmp_path):
    columns = ["a", "b", "d"]
    matrix = M.feature_matrix(blobs, columns)
    assert matrix.count() == 240
    model = M.fit_clusters(matrix, columns, k=None, size=None, restarts=2)
    labelled = M.assign_clusters(blobs, columns, model)
    pairs = {(r.c, r.Cluster) for r in labelled.collect()}
    # Numbered by falling size; the row without features has no cluster.
    assert pairs == {(0, 0), (1, 1), (2, 2), (None, None)}
    path = str(tmp_path / "model")
    model.write().save(path)
    summary = spark.createDataFrame([(0, "large"), (1, "middle")], "Cluster int, kind string")
    scored = {r.i: r.kind for r in M.classify(matrix, path, summary).collect()}
    assert scored[0] == "large" and scored[150] == "middle" and scored[230] is None
    assert M.silhouette(model.transform(matrix), "scores") > 0.8


def test_more_restarts_never_cost_more(spark, blobs):
    columns = ["a", "b", "d"]
    scaled = PipelineModel(M.scaling_stages(blobs, columns)).transform(M.feature_matrix(blobs, columns))
    one = M.fit_kmeans(scaled, 4, "scaled", restarts=1).summary.trainingCost
    four = M.fit_kmeans(scaled, 4, "scaled", restarts=4).summary.trainingCost
    assert four <= one


def test_all_models_of_one_scan_are_as_good_as_single_fits(spark, blobs):
    columns = ["a", "b", "d"]
    scaled = PipelineModel(M.scaling_stages(blobs, columns)).transform(M.feature_matrix(blobs, columns)).repartition(3)
    found = M.shared_kmeans(scaled, "scaled", [2, 3, 5], restarts=4)
    rows = np.array([r["scaled"].toArray() for r in scaled.collect()])
    for k, (centres, sums) in found.items():
        distance = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
        own = distance.argmin(axis=1)
        assert sums["n"].tolist() == np.bincount(own, minlength=k).tolist()
        assert sums["cost"].sum() == pytest.approx(distance.min(axis=1).sum())
        assert sums["cost"].sum() <= 1.05 * M.fit_kmeans(scaled, k, "scaled", restarts=4).summary.trainingCost
        # No step of Lloyd's would move a centre any more.
        assert all(np.allclose(rows[own == c].mean(axis=0), centres[c], atol=1e-3) for c in range(k))
        labelled = M.centre_stage((centres, sums), "scaled").transform(scaled)
        assert M.shared_silhouettes(scaled, "scaled", {k: (centres, sums)})[k] == pytest.approx(M.silhouette(labelled, "scaled"))
    assert M.best_k(scaled, "scaled", [2, 3, 4], restarts=3)[0] == 3


def test_fewer_points_than_clusters(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "a double")
    scaled = PipelineModel(M.scaling_stages(rows, ["a"])).transform(rows)
    found = M.shared_kmeans(scaled, "scaled", [1, 4], restarts=2)
    assert [len(found[k][0]) for k in (1, 4)] == [1, 2] and found[4][1]["cost"].sum() == pytest.approx(0)
    scores = M.shared_silhouettes(scaled, "scaled", found)
    assert scores[1] == -1.0 and scores[4] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        M.shared_kmeans(scaled.limit(0), "scaled", [2])


def test_components_reach_the_share(spark, blobs):
    columns = ["a", "b", "d"]
    scaled = PipelineModel(M.scaling_stages(blobs, columns)).transform(M.feature_matrix(blobs, columns))
    model = M.fit_pca(scaled, 3)
    keep = M.components_for(model, 0.9)
    assert sum(model.explainedVariance[:keep]) > 0.9 >= sum(model.explainedVariance[:keep - 1])
    assert M.explained_percent(model, 3) == pytest.approx(100.0)


def test_labels_written_back(spark):
    rows = spark.range(4).withColumnRenamed("id", "k")
    labels = spark.createDataFrame([(1, 7)], "k long, Cluster int")
    got = {r.k: r.Cluster for r in M.attach_labels(rows, labels, "k").collect()}
    assert got == {0: None, 1: 7, 2: None, 3: None}
    assert M.attach_labels(rows, labels, "k").where(F.col("Cluster") == 7).count() == 1
