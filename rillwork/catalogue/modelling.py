"""Queries over scaling, components, clustering and classification."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.registry import query, rounded
from rillwork.functions import values as V
from rillwork.operators import cluster as M
from rillwork.operators import features as A
from rillwork.plans import domain as D
from rillwork.session import checkpoint, scratch_path

DIMENSIONS = 64


def _site_vectors(spark, folder):
    """Mean of each analyte per site."""
    table = D.results(spark, folder).withColumnRenamed(S.SITE, "site")
    analytes = list(D.ANALYTE_OF.values())
    return A.watershed_wide(table, analytes, "site", complete=False), analytes


@query("feature_matrix", f"""
WITH {Q.TREATMENT} SELECT site, round(coalesce(Fe, 0), 6) AS "Fe", round(coalesce(TempIn, 0), 6) AS "TempIn"
FROM treatment WHERE Fe IS NOT NULL OR TempIn IS NOT NULL""")
def feature_matrix(spark, folder):
    """Rows with any feature, gaps as zero."""
    matrix = M.feature_matrix(D.treatment(spark, folder), ["Fe", "TempIn"])
    return rounded(matrix.select(F.col(S.SITE).alias("site"), "Fe", "TempIn"))


@query("standardise", f"""
SELECT vec_id, {", ".join(
    f"round((embedding[{i}]::DOUBLE - avg(embedding[{i}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i}]::DOUBLE) OVER (), 6) AS f{i - 1}_std"
    for i in range(1, 65))}, CAST(0 AS DOUBLE) AS flat_std FROM embeddings""")
def standardise(spark, folder):
    """Population standardisation; a constant column gives zero."""
    rows, names = D.vectors(spark, folder, DIMENSIONS)
    table = rows.select("vec_id", *names, F.lit(3.0).alias("flat"))
    return rounded(M.standardise(table, [*names, "flat"]).drop(*names, "flat"))


def _components(rows, names):
    """The components of the rows, as a fitted model and its scores."""
    table = rows
    for stage in M.scaling_stages(rows, names):
        table = stage.transform(table)
    model = M.fit_pca(table, len(names))
    return model, model.transform(table)


Z = ", ".join(
    f"(embedding[{i}]::DOUBLE - avg(embedding[{i}]::DOUBLE) OVER ()) / stddev_pop(embedding[{i}]::DOUBLE) OVER ()"
    for i in range(1, DIMENSIONS + 1))


@query("pca_components", f"""
WITH z AS (SELECT vec_id, [{Z}] AS z FROM embeddings)
SELECT vec_id, {DIMENSIONS} AS n_components, round(list_sum(list_transform(z, lambda v: v * v)), 5) AS squares FROM z""")
def pca_components(spark, folder):
    """Scores on all components: a rotation, so their squares add up to those of the standardised row."""
    rows, names = D.vectors(spark, folder, DIMENSIONS)
    _, scored = _components(rows, names)
    scores = vector_to_array("components")
    squares = F.aggregate(scores, F.lit(0.0), lambda total, v: total + v * v)
    return rounded(scored.select("vec_id", F.size(scores).alias("n_components"), squares.alias("squares")), 5)


# Three copies of one standardised column a (one with its sign changed) and another column b of correlation r. The
# components are those of the matrix [[3, r * sqrt 3], [r * sqrt 3, 1]], which has a closed form.
@query("pca_kept", """
WITH z AS (SELECT vec_id,
    (embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER () AS a,
    (embedding[2]::DOUBLE - avg(embedding[2]::DOUBLE) OVER ()) / stddev_pop(embedding[2]::DOUBLE) OVER () AS b,
    corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) OVER () AS r FROM embeddings),
t AS (SELECT *, atan2(2 * sqrt(3) * r, 2) / 2 AS turn, (2 + sqrt(1 + 3 * r * r)) / 4 AS share FROM z)
SELECT vec_id, CASE WHEN share > 0.7 THEN 1 ELSE 2 END AS kept, CASE WHEN share > 0.9 THEN 1 ELSE 2 END AS kept_most,
  round(100 * share, 5) AS explained, round(pow(cos(turn) * sqrt(3) * a + sin(turn) * b, 2), 5) AS squares FROM t""")
def pca_kept(spark, folder):
    """As many components as explain more than 70 % and 90 %, and each row's squared scores on the former."""
    rows, _ = D.vectors(spark, folder, 2)
    names = ["c0", "c1", "c2", "c3"]
    table = rows.select("vec_id", F.col("f0").alias("c0"), (-F.col("f0")).alias("c1"), F.col("f0").alias("c2"), F.col("f1").alias("c3"))
    model, scored = _components(table, names)
    kept, most = (M.components_for(model, share) for share in (0.7, 0.9))
    scores = F.slice(vector_to_array("components"), 1, kept)
    squares = F.aggregate(scores, F.lit(0.0), lambda total, v: total + v * v)
    return rounded(scored.select("vec_id", F.lit(kept).alias("kept"), F.lit(most).alias("kept_most"),
                                 F.lit(M.explained_percent(model, kept)).alias("explained"), squares.alias("squares")), 5)


@query("pca_pair", """
WITH z AS (SELECT vec_id,
    (embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER () AS a,
    (embedding[2]::DOUBLE - avg(embedding[2]::DOUBLE) OVER ()) / stddev_pop(embedding[2]::DOUBLE) OVER () AS b,
    corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE) OVER () AS r FROM embeddings)
SELECT vec_id, round(abs(a + sign(r) * b) / sqrt(2), 5) AS pc1, round(abs(a - sign(r) * b) / sqrt(2), 5) AS pc2,
  round(50 * (1 + abs(r)), 5) AS explained FROM z""")
def pca_pair(spark, folder):
    """Both components of two standardised columns, which have a closed form, without their free
    sign, and the percentage that the first explains."""
    rows, names = D.vectors(spark, folder, 2)
    model, scored = _components(rows, names)
    named = M.component_columns(scored, 2, "components")
    return rounded(named.select(
        "vec_id", F.abs("PC1").alias("pc1"), F.abs("PC2").alias("pc2"),
        F.lit(M.explained_percent(model, 1)).alias("explained")), 5)


# Planted groups of unequal size: a row's group follows from the last digit of its key, and each group is moved
# far from the others, so that the right clusters are known from the tables alone. They are numbered by falling size.
def _group_of(key: str, cuts: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {key} % 10 < {cut} THEN {i}" for i, cut in enumerate(cuts)) + f" ELSE {len(cuts)} END"


FOUR, THREE = (4, 7, 9), (5, 8)


def _planted(matrix, columns, key: str, cuts: tuple[int, ...], step: float):
    group = F.expr(_group_of(key, cuts))
    return matrix.withColumns({c: V.ref(c) + group * step for c in columns})


def _planted_sites(spark, folder, cuts: tuple[int, ...]):
    wide, analytes = _site_vectors(spark, folder)
    matrix = M.feature_matrix(wide, analytes)
    keyed = matrix.withColumn("key", F.substring("site", 2, 20).cast("long"))
    # Both the model and its application read the sites; the results behind them are read once.
    return checkpoint(_planted(keyed, analytes, "key", cuts, 100_000.0)), analytes


@query("watershed_clusters", f"""
WITH {Q.RESULTS}, keys AS (SELECT DISTINCT site, site_key FROM results)
SELECT site, {_group_of("site_key", FOUR)} AS "Cluster" FROM keys""")
def watershed_clusters(spark, folder):
    """Two components and four clusters of sites, found where groups were planted."""
    sites, analytes = _planted_sites(spark, folder, FOUR)
    model = M.fit_clusters(sites, analytes, k=4, size=2)
    return M.assign_clusters(sites, analytes, model).select("site", "Cluster")


@query("silhouette", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT label, COUNT(*) AS n FROM e GROUP BY label),
d AS (SELECT x.vec_id, x.label AS own, y.label AS other, sum(pow(list_distance(x.v, y.v), 2)) AS total
  FROM e x, e y GROUP BY 1, 2, 3),
m AS (SELECT vec_id, own, other, CASE WHEN own = other THEN total / nullif(n - 1, 0) ELSE total / n END AS mean
  FROM d JOIN n ON d.other = n.label),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN mean END) AS a, min(CASE WHEN own <> other THEN mean END) AS b
  FROM m GROUP BY vec_id)
SELECT COUNT(*) AS n_rows, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM s""")
def silhouette(spark, folder):
    """How well the given labels part the vectors."""
    rows, names = D.vectors(spark, folder, DIMENSIONS)
    table = VectorAssembler(inputCols=names, outputCol="v").transform(rows)
    score = M.silhouette(table, "v", "label")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(score).alias("silhouette")))


@query("best_k", f"""
WITH e AS (SELECT vec_id, {_group_of("vec_id", FOUR)} AS g, embedding FROM embeddings),
m AS (SELECT vec_id, g, [{", ".join(f"embedding[{i}]::DOUBLE + 50 * g" for i in range(1, DIMENSIONS + 1))}] AS embedding FROM e),
z AS (SELECT vec_id, g, [{Z}] AS v FROM m),
n AS (SELECT g, COUNT(*) AS n FROM z GROUP BY g),
d AS (SELECT x.vec_id, x.g AS own, y.g AS other, sum(pow(list_distance(x.v, y.v), 2)) AS total
  FROM z x, z y GROUP BY 1, 2, 3),
w AS (SELECT vec_id, own, other, CASE WHEN own = other THEN total / nullif(n - 1, 0) ELSE total / n END AS mean
  FROM d JOIN n ON d.other = n.g),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN mean END) AS a, min(CASE WHEN own <> other THEN mean END) AS b
  FROM w GROUP BY vec_id)
SELECT COUNT(*) AS n_rows, 4 AS chosen, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM s""")
def best_k(spark, folder):
    """The k of 2..8 with the highest silhouette on all components, and that silhouette; the vectors
    are moved into four planted groups."""
    rows, names = D.vectors(spark, folder, DIMENSIONS)
    moved = checkpoint(_planted(rows, names, "vec_id", FOUR, 50.0))
    _, scored = _components(moved, names)
    scores = scored.select("components").persist()
    try:
        chosen, found = M.best_k(scores, "components")
    finally:
        scores.unpersist()
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(one.select("n_rows", F.lit(chosen).alias("chosen"), F.lit(found[chosen]).alias("silhouette")), 5)


@query("classify", f"""
WITH {Q.RESULTS}, keys AS (SELECT DISTINCT site, site_key FROM results),
g AS (SELECT site, {_group_of("site_key", THREE)} AS "Cluster" FROM keys)
SELECT site, "Cluster", COUNT(*) OVER (PARTITION BY "Cluster") AS size FROM g""")
def classify(spark, folder):
    """A saved model scores rows; the summary of the predicted cluster is attached."""
    sites, analytes = _planted_sites(spark, folder, THREE)
    path = scratch_path(spark, "model")
    model = M.fit_clusters(sites, analytes, k=3, size=2)
    model.write().save(path)
    summary = A.cluster_summary(model.transform(sites), analytes)
    scored = M.classify(sites, path, summary.select("Cluster", F.col("Count").alias("size")))
    return scored.select("site", "Cluster", "size")


@query("cluster_lookup", """
SELECT vec_id, label AS "Cluster", n FROM embeddings LEFT JOIN (
  SELECT label AS l, COUNT(*) AS n FROM embeddings WHERE label <> 0 GROUP BY label) ON label = l""")
def cluster_lookup(spark, folder):
    """Rows with the summary of their cluster; an unknown cluster has none."""
    rows = D.table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("Cluster"))
    summary = rows.where("Cluster <> 0").groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))
    return M.lookup_cluster(rows, summary).select("vec_id", "Cluster", "n")


@query("labels_back", """
SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def labels_back(spark, folder):
    """Labels of some rows written back to the whole table."""
    rows = D.table(spark, folder, "documents").select("doc_id", "source")
    return M.attach_labels(rows, D.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
