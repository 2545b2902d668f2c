"""Scaling, principal components, k-means and classification with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.operators.clean import drop_blank
from rillwork.session import broadcast_if_small

#: Rows of the sample that starts of k-means are drawn from.
START_ROWS = 4096


def feature_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one of the features, missing ones as 0."""
    present = drop_blank(df, columns)
    return present.withColumns({c: F.coalesce(V.numeric(df, c), F.lit(0.0)) for c in columns})


def standardise(df: DataFrame, columns: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population deviation over the whole table; a constant column gives 0."""
    parts = [
        F.struct(F.avg(V.ref(c)).alias("m"), F.stddev_pop(V.ref(c)).alias("s")).alias(str(i))
        for i, c in enumerate(columns)
    ]
    # One column for the sub-query, so that the plan holds it once however many columns use it.
    with_moments = df.withColumn("_moments", df.agg(F.struct(*parts)).scalar())
    out = {}
    for i, c in enumerate(columns):
        centred = V.ref(c) - F.col("_moments")[str(i)]["m"]
        spread = F.col("_moments")[str(i)]["s"]
        out[c + suffix] = F.when(spread == 0, centred).otherwise(centred / spread)
    return with_moments.withColumns(out).drop("_moments")


def scaling_stages(df: DataFrame, columns: list[str], out: str = "scaled") -> list:
    """Pipeline stages that fill, standardise and assemble, with the moments of ``df`` in them."""
    filled = F.array(*[F.coalesce(V.numeric(df, c), F.lit(0.0)) for c in columns])
    moments = df.select(array_to_vector(filled).alias("v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")
    ).first()["s"]
    # The summary gives the sample variance.
    population = max(moments["count"] - 1, 0) / max(moments["count"], 1)
    scaled = []
    for i, c in enumerate(columns):
        mean = float(moments["mean"][i])
        spread = math.sqrt(float(moments["variance"][i]) * population) or 1.0
        scaled.append(f"(coalesce(cast(`{c}` as double), 0D) - ({mean!r}D)) / {spread!r}D AS `_z{i}`")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_z{i}" for i in range(len(columns))], outputCol=out),
        SQLTransformer(statement="SELECT * EXCEPT (" + ", ".join(
            f"`_z{i}`" for i in range(len(columns))) + ") FROM __THIS__"),
    ]


def fit_pca(vectors: DataFrame, size: int, column: str = "scaled", out: str = "components") -> PCAModel:
    return PCA(k=size, inputCol=column, outputCol=out).fit(vectors)


def components_for(model: PCAModel, share: float = 0.9) -> int:
    """Smallest number of components that explain more than the given share of variance."""
    total = 0.0
    for i, part in enumerate(model.explainedVariance, start=1):
        total += float(part)
        if total > share:
            return i
    return len(model.explainedVariance)


def component_columns(df: DataFrame, n: int = 2, scores: str = "scores") -> DataFrame:
    """The first n scores as columns PC1, PC2, ..."""
    values = vector_to_array(F.col(scores))
    return df.withColumns({f"PC{i + 1}": F.get(values, F.lit(i)) for i in range(n)})


def explained_percent(model: PCAModel, n: int = 2) -> float:
    """Share of variance that the first n components explain."""
    return 100.0 * float(sum(model.explainedVariance[:n]))


def silhouette(labelled: DataFrame, features: str, cluster: str = "Cluster") -> float:
    """Mean silhouette with squared Euclidean distance, from cluster sums (not all pairs)."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(labelled)


def fit_kmeans(
    vectors: DataFrame, k: int, features: str, restarts: int = 10, seed: int = S.SEED, out: str = "Cluster"
) -> KMeansModel:
    """Best of several starts by training cost."""
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol=out).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def _plus_plus(sample: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Starting centres, each drawn by its squared distance to those before; fewer than k if there are fewer points."""
    centres = sample[random.integers(len(sample))][None, :]
    while len(centres) < k:
        far = ((sample[:, None, :] - centres[None, -1:, :]) ** 2).sum(axis=2).min(axis=1)
        near = far if len(centres) == 1 else np.minimum(near, far)
        if not near.sum() > 0:
            break
        centres = np.vstack([centres, sample[random.choice(len(sample), p=near / near.sum())]])
    return centres


def _assigned(arrays: DataFrame, models: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """Rows, sums, squares and cost of every cluster of every model, all from one scan.

    Each task adds up its rows; as many sums as there are centres pass on, whatever the number of rows.
    """
    sent = arrays.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch["x"].flatten()).reshape(batch.num_rows, -1)
            squares = (rows * rows).sum(axis=1)
            for number, centres in enumerate(sent.value):
                distance = squares[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
                own = distance.argmin(axis=1)
                cost = np.maximum(distance[np.arange(len(rows)), own], 0)
                for centre in np.unique(own):
                    mine = own == centre
                    sums = held.setdefault((number, int(centre)), [0, 0.0, 0.0, 0.0])
                    for at, more in enumerate((int(mine.sum()), rows[mine].sum(axis=0), squares[mine].sum(), cost[mine].sum())):
                        sums[at] = sums[at] + more
        if held:
            keys, values = list(held), list(zip(*held.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(values[0], pa.int64()),
                 pa.array([list(map(float, v)) for v in values[1]], pa.list_(pa.float64())), pa.array(values[2], pa.float64()), pa.array(values[3], pa.float64())],
                ["model", "centre", "n", "total", "squares", "cost"])

    parts = arrays.mapInArrow(run, "model int, centre int, n long, total array<double>, squares double, cost double")
    sums = parts.groupBy("model", "centre").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("squares").alias("squares"), F.sum("cost").alias("cost"))
    out = [{"n": np.zeros(len(c), np.int64), "total": np.zeros(c.shape), "squares": np.zeros(len(c)), "cost": np.zeros(len(c))} for c in models]
    for row in sums.collect():
        for name in out[row["model"]]:
            out[row["model"]][name][row["centre"]] = row[name].toArray() if name == "total" else row[name]
    return out


def shared_kmeans(
    vectors: DataFrame, features: str, ks: Iterable[int], restarts: int = 10, seed: int = S.SEED, iterations: int = 20, tolerance: float = 1e-4
) -> dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The best of several starts for each k: (centres, sums of their clusters). All models share each scan.

    Starts are drawn from a sample of at most ``START_ROWS`` rows; every step of every model is over all rows. A model rests once
    no centre moves by more than ``tolerance``. A cluster that loses its rows keeps its centre.
    """
    arrays = vectors.select(vector_to_array(F.col(features)).alias("x"))
    sample = np.array([r["x"] for r in arrays.orderBy(F.rand(seed)).limit(START_ROWS).collect()])
    if not len(sample):
        raise ValueError("no rows to cluster")
    names = [(k, start) for k in ks for start in range(restarts)]
    models = [_plus_plus(sample, k, np.random.default_rng([seed, k, start])) for k, start in names]
    moving = list(range(len(models)))
    for _ in range(iterations):
        sums = _assigned(arrays, [models[m] for m in moving])
        still = []
        for m, found in zip(moving, sums):
            full = found["n"] > 0
            centres = models[m].copy()
            centres[full] = found["total"][full] / found["n"][full, None]
            if (((centres - models[m]) ** 2).sum(axis=1) > tolerance**2).any():
                still.append(m)
            models[m] = centres
        moving = still
        if not moving:
            break
    best: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]] = {}
    for (k, _), centres, sums in zip(names, models, _assigned(arrays, models)):
        if k not in best or sums["cost"].sum() < best[k][1]["cost"].sum():
            best[k] = centres, sums
    return best


def shared_silhouettes(vectors: DataFrame, features: str, found: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]) -> dict[int, float]:
    """Mean silhouette with squared Euclidean distance of each model, all from one scan; -1 for a single cluster."""
    kept = {k: (centres, sums["n"], sums["total"], sums["squares"]) for k, (centres, sums) in found.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch["x"].flatten()).reshape(batch.num_rows, -1)
            squares, at = (rows * rows).sum(axis=1), np.arange(batch.num_rows)
            for k, (centres, n, total, inner) in sent.value.items():
                own = ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
                size = np.maximum(n, 1)
                apart = squares[:, None] + inner / size - 2 * rows @ (total / size[:, None]).T
                near = apart[at, own] * size[own] / np.maximum(size[own] - 1, 1)
                apart[:, n == 0] = np.inf
                apart[at, own] = np.inf
                other = apart.min(axis=1)
                value = np.where(size[own] > 1, (other - near) / np.maximum(np.maximum(near, other), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(value.sum())])], ["k", "value"])

    arrays = vectors.select(vector_to_array(F.col(features)).alias("x"))
    several = {k: sums["n"] for k, (_, sums) in found.items() if (sums["n"] > 0).sum() > 1}
    sums = {r["k"]: r["value"] for r in arrays.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()}
    return {k: float(sums[k] / several[k].sum()) if k in several else -1.0 for k in found}


def best_k(
    vectors: DataFrame, features: str, ks: Iterable[int] = range(2, 9), restarts: int = 10
) -> tuple[int, dict[int, float]]:
    """The k of highest silhouette (the first on a tie) and all scores; one scan serves all fits at once."""
    scores = shared_silhouettes(vectors, features, shared_kmeans(vectors, features, ks, restarts))
    return max(scores, key=lambda k: scores[k]), scores


class NearestCentre(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Stage that gives each row the number of its nearest centre, the first of equals."""

    centres = Param(Params._dummy(), "centres", "coordinates of each centre", typeConverter=TypeConverters.identity)
    features = Param(Params._dummy(), "features", "vector column", typeConverter=TypeConverters.toString)
    out = Param(Params._dummy(), "out", "column of the cluster number", typeConverter=TypeConverters.toString)

    def __init__(self, centres: list[list[float]] | None = None, features: str = "scores", out: str = "Cluster"):
        super().__init__()
        self._set(centres=centres or [], features=features, out=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.getOrDefault("centres")])
        row = vector_to_array(F.col(self.getOrDefault("features")))
        far = F.transform(table, lambda c: F.aggregate(
            F.zip_with(row, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))
        return df.withColumn("_far", far).withColumn(
            self.getOrDefault("out"), (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far")


def centre_stage(found: tuple[np.ndarray, dict[str, np.ndarray]], features: str, out: str = "Cluster") -> NearestCentre:
    """Stage that numbers clusters by falling size, then by centre."""
    centres, sizes = [tuple(map(float, c)) for c in found[0]], found[1]["n"]
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
    return NearestCentre([list(centres[i]) for i in order], features, out)


def fit_clusters(
    df: DataFrame,
    columns: list[str],
    k: int | None = 4,
    size: int | None = 2,
    restarts: int = 20,
    share: float = 0.9,
) -> PipelineModel:
    """Scaler, PCA, k-means and label order as one model that can be saved and applied.

    ``size=None`` keeps the components that explain more than ``share``; ``k=None`` picks k
    in 2..8 by silhouette (of ten starts each).
    """
    scaling = PipelineModel(scaling_stages(df, columns))
    vectors = scaling.transform(df).select("scaled").persist()
    try:
        pca = fit_pca(vectors, size or len(columns))
        keep = size or components_for(pca, share)
        slicer = VectorSlicer(inputCol="components", outputCol="scores", indices=list(range(keep)))
        scores = slicer.transform(pca.transform(vectors)).select("scores").persist()
        try:
            if k is None:
                k, _ = best_k(scores, "scores", restarts=min(restarts, 10))
            found = shared_kmeans(scores, "scores", [k], restarts)[k]
        finally:
            scores.unpersist()
    finally:
        vectors.unpersist()
    return PipelineModel([*scaling.stages, pca, slicer, centre_stage(found, "scores")])


def assign_clusters(df: DataFrame, columns: list[str], model: PipelineModel) -> DataFrame:
    """Every row with its cluster; rows without any feature get NULL."""
    usable = V.any_of([V.ref(c).isNotNull() for c in columns if c in df.columns])
    scored = model.transform(df)
    return scored.withColumn("Cluster", F.when(usable, F.col("Cluster")))


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Write labels back to the unfiltered table by key; others get NULL."""
    return df.join(labels, key, "left")


def lookup_cluster(df: DataFrame, summary: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """Rows with the summary of their cluster; an unknown cluster gives NULLs."""
    return df.join(broadcast_if_small(summary), cluster, "left")


def classify(df: DataFrame, model_path: str, summary: DataFrame) -> DataFrame:
    """Score new samples with a saved model and attach the cluster summary."""
    model = PipelineModel.load(model_path)
    return lookup_cluster(model.transform(df), summary)
