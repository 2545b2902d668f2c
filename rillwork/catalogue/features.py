"""Queries over aggregates, profiles, scores, ranks, samples."""

from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.registry import day_text, query, rounded
from rillwork.operators import clean as C
from rillwork.operators import features as A
from rillwork.operators import health as H
from rillwork.operators import profile as P
from rillwork.operators.quantiles import exact_quantiles
from rillwork.plans import domain as D

PRESENT = ["pH", "Iron", "Manganese", "Sulfate", "Alkalinity", "Specific conductance"]


def _feature_sql() -> str:
    parts = []
    for a in [*PRESENT, "Aluminum"]:
        pick = f"CASE WHEN analyte = '{a}' THEN m END"
        year = f"CASE WHEN analyte = '{a}' THEN CAST(yr AS DOUBLE) END"
        parts += [
            f"""round(avg({pick}), 6) AS "{a}_mean", round(median({pick}), 6) AS "{a}_median",
            round(stddev_pop({pick}), 6) AS "{a}_std", round(min({pick}), 6) AS "{a}_min",
            round(max({pick}), 6) AS "{a}_max", CAST(nullif(count({pick}), 0) AS INTEGER) AS "{a}_n_years",
            CASE WHEN count({pick}) > 2 THEN round(regr_slope({pick}, {year}), 6) END AS "{a}_trend" """
        ]
    iron, mn = "avg(CASE WHEN analyte = 'Iron' THEN m END)", "avg(CASE WHEN analyte = 'Manganese' THEN m END)"
    so4, ph = "avg(CASE WHEN analyte = 'Sulfate' THEN m END)", "avg(CASE WHEN analyte = 'pH' THEN m END)"
    return f"""
WITH {Q.RESULTS}, yearly AS (
  SELECT site, analyte, yr, avg(v) AS m FROM results WHERE abs(v) <= 100000 GROUP BY site, analyte, yr)
SELECT site AS "MonitoringLocationIdentifier", {", ".join(parts)},
  round({iron} / nullif({mn}, 0), 6) AS "Fe_Mn_ratio", round({iron} / nullif({so4}, 0), 6) AS "Fe_Sulfate_ratio",
  CASE WHEN {ph} < 5 THEN 1 WHEN {iron} > 10 THEN 1 ELSE 0 END AS "AMD_impacted"
FROM yearly GROUP BY site"""


@query("site_features", _feature_sql())
def site_features(spark, folder):
    """Annual means, their statistics and trends, ratios and the impact label per site."""
    return rounded(A.site_features(D.results(spark, folder)))


@query("annual_means", f"""
WITH {Q.RESULTS} SELECT site, analyte, CAST(yr AS INTEGER) AS "Year", round(avg(v), 6) AS annual_mean
FROM results GROUP BY site, analyte, yr""")
def annual_means(spark, folder):
    yearly = A.annual_means(A.usable_results(D.results(spark, folder)))
    return rounded(yearly.withColumnsRenamed({S.SITE: "site", S.ANALYTE: "analyte"}))


def _mean_if(name: str) -> str:
    return f"avg(CASE WHEN analyte = '{name}' THEN v END)"


@query("site_wide_label", f"""
WITH {Q.RESULTS}, scaled AS (
  SELECT site, lat, lon, site_type, analyte,
    CASE WHEN analyte = 'Iron' THEN v / 10 WHEN analyte = 'Sulfate' THEN v / 2
      WHEN analyte = 'Specific conductance' AND unit IN ('uS/cm', 'µS/cm') THEN v / 1000 ELSE v END AS v
  FROM results)
SELECT site AS "MonitoringLocationIdentifier", round(lat, 6) AS latitude, round(lon, 6) AS longitude, site_type,
  round({_mean_if("Specific conductance")}, 6) AS "Conductivity", round({_mean_if("Iron")}, 6) AS "Fe_mgL",
  round({_mean_if("Manganese")}, 6) AS "Mn_mgL", round({_mean_if("Sulfate")}, 6) AS "SO4_mgL",
  round({_mean_if("Alkalinity")}, 6) AS "Alk_mgL", round({_mean_if("pH")}, 6) AS "pH",
  CASE WHEN {_mean_if("pH")} < 6 THEN 1 WHEN {_mean_if("Iron")} > 1 THEN 1
    WHEN {_mean_if("Sulfate")} > 250 THEN 1 ELSE 0 END AS "AMD_present"
FROM scaled GROUP BY site, lat, lon, site_type""")
def site_wide_label(spark, folder):
    """Raw results to one labelled row per site."""
    v, a = F.col(S.VALUE), F.col(S.ANALYTE)
    scaled = F.when(a == "Iron", v / 10).when(a == "Sulfate", v / 2).otherwise(v)
    return rounded(A.site_wide(D.results(spark, folder).withColumn(S.VALUE, scaled)))


@query("analyte_profile", f"""
WITH {Q.RESULTS}
SELECT analyte AS "CharacteristicName", COUNT(v) AS n_results, round(avg(v), 6) AS mean_value,
  round(min(v), 6) AS min_value, round(max(v), 6) AS max_value,
  strftime(min(day), '%Y-%m-%d') AS first_date, strftime(max(day), '%Y-%m-%d') AS last_date
FROM results GROUP BY analyte""")
def analyte_profile(spark, folder):
    return rounded(day_text(A.analyte_profile(D.results(spark, folder)), "first_date", "last_date"))


@query("site_profile", f"""
WITH {Q.RAW}, typed AS (
  SELECT site, {Q.number("value_text")} AS v, TRY_CAST(day_text AS DATE) AS day FROM raw)
SELECT site AS "MonitoringLocationIdentifier", COUNT(v) AS n_results,
  strftime(min(day), '%Y-%m-%d') AS first_date, strftime(max(day), '%Y-%m-%d') AS last_date
FROM typed GROUP BY site""")
def site_profile(spark, folder):
    """Counts and period per site from text that is partly unreadable."""
    return day_text(A.site_profile(D.raw_results(spark, folder)), "first_date", "last_date")


DESCRIBED = ["Fe", "pH_In", "pH_Out", "Cond_In", "Cond_Out", "Temp_In", "Temp_Out"]
SOURCE = dict(zip(DESCRIBED, ["Fe", "pH_in", "pH_out", "CondIn", "CondOut", "TempIn", "TempOut"]))


def _describe_sql(name: str, c: str) -> str:
    return f"""SELECT '{name}' AS "column", COUNT({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(max({c}), 6) AS "max" FROM treatment"""


@query("describe_exact", f"WITH {Q.TREATMENT} " + " UNION ALL ".join(
    _describe_sql(n, c) for n, c in SOURCE.items()))
def describe_exact(spark, folder):
    table = C.rename(D.treatment(spark, folder), S.TREATMENT_RENAMES)
    return rounded(P.describe_exact(table, [*DESCRIBED, "absent"]))


@query("quantiles", """
SELECT p, round(value, 6) AS value FROM (
  SELECT CAST(unnest([0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0]) AS DOUBLE) AS p,
    unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0])) AS value FROM lineitem)""")
def quantiles(spark, folder):
    """Exact interpolated quantiles, ends included."""
    table = D.table(spark, folder, "lineitem")
    found = exact_quantiles(table, ["l_extendedprice"], [0.0, 0.01, 0.1, 0.5, 0.9, 0.999, 1.0])
    return rounded(found.select("p", "value"))


@query("coverage", f"""
WITH {Q.TREATMENT}
SELECT 'Fe' AS analyte, COUNT(Fe) AS non_null_numeric FROM treatment
UNION ALL SELECT 'pH_out', COUNT(pH_out) FROM treatment
UNION ALL SELECT 'Temperatur', COUNT(Temperatur) FROM treatment""")
def coverage(spark, folder):
    return P.coverage(D.treatment(spark, folder), ["Fe", "pH_out", "Temperatur"])


@query("pick_best", f"""
WITH {Q.TREATMENT} SELECT 'IronIn' AS picked, round(avg(IronIn), 6) AS mean FROM treatment""")
def pick_best(spark, folder):
    """Of several candidates the column with most values."""
    table = D.treatment(spark, folder)
    best = P.pick_best(table, ["Temperatur", "IronIn", "absent", "IronOut"])
    return rounded(table.agg(F.lit(best).alias("picked"), F.avg(best).alias("mean")))


@query("top_columns", f"""
WITH {Q.TREATMENT}
SELECT round(avg(IronIn), 6) AS "IronIn", round(avg(pH_in), 6) AS "pH_in",
  round(avg(CondIn), 6) AS "CondIn" FROM treatment""")
def top_columns(spark, folder):
    """The three best covered columns."""
    table = D.treatment(spark, folder)
    best = P.top_columns(table, ["Temperatur", "pH_in", "IronIn", "CondIn"], n=3)
    return rounded(table.agg(*[F.avg(c).alias(c) for c in best]))


CORRELATED = ["Fe", "pH_out", "TempIn", "TempOut", "IronOut"]


@query("corr_matrix", f"WITH {Q.TREATMENT} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM treatment"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]))
def corr_matrix(spark, folder):
    return rounded(P.corr_matrix(D.treatment(spark, folder), CORRELATED))


@query("corr_wide", """
WITH e AS (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings),
v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM e WHERE (vec_id + i) % 7 <> 0)
SELECT 'f' || (a.i - 1) AS a, 'f' || (b.i - 1) AS b, round(corr(a.x, b.x), 6) AS r
FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i""")
def corr_wide(spark, folder):
    """All pairs of the 64 embedding columns, each with gaps of its own."""
    rows, names = D.vectors(spark, folder, 64)
    gaps = rows.select(*[F.when((F.col("vec_id") + at + 1) % 7 != 0, F.col(n)).alias(n) for at, n in enumerate(names)])
    return rounded(P.corr_wide(gaps, names))


@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) * 12 / (hi - lo)) AS BIGINT), 11) AS bin FROM lineitem, s),
c AS (SELECT bin, COUNT(*) AS n FROM b GROUP BY bin)
SELECT r.bin, round(lo + (hi - lo) * r.bin / 12, 6) AS bin_from, round(lo + (hi - lo) * (r.bin + 1) / 12, 6) AS bin_to,
  coalesce(n, 0) AS "count"
FROM (SELECT range AS bin FROM range(12)) r CROSS JOIN s LEFT JOIN c ON r.bin = c.bin""")
def histogram(spark, folder):
    return rounded(P.histogram(D.table(spark, folder, "lineitem"), "l_extendedprice", 12))


def _box_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_low,
  round(max(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_high,
  COUNT(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM skewed, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS q3
  FROM skewed) GROUP BY q1, m, q3"""


@query("box_stats", "WITH skewed AS (SELECT l_extendedprice * l_discount AS a, l_quantity * l_quantity * l_quantity "
       "AS b FROM lineitem) " + _box_sql("a") + " UNION ALL " + _box_sql("b"))
def box_stats(spark, folder):
    """Quartiles, whiskers and outliers of two skewed quantities."""
    q = F.col("l_quantity")
    table = D.table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") * F.col("l_discount")).alias("a"), (q * q * q).alias("b"))
    return rounded(P.box_stats(table, ["a", "b"]))


@query("watershed_counts", """
SELECT coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'Unknown') AS status, o_orderpriority AS priority,
  COUNT(*) AS "count" FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""")
def watershed_counts(spark, folder):
    """Largest key combinations, missing keys named."""
    table = D.table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    return P.group_counts(table, ["status", "priority"], limit=15, fill="Unknown")


@query("group_counts", f"""
WITH {Q.RESULTS} SELECT site_type, COUNT(*) AS "count" FROM results GROUP BY site_type""")
def group_counts(spark, folder):
    table = D.results(spark, folder).withColumnRenamed("MonitoringLocationTypeName", "site_type")
    return P.group_counts(table, ["site_type"])


@query("missing_counts", f"""
WITH {Q.TREATMENT}
SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(Fe) AS no_iron, COUNT(CASE WHEN pH_out < 2 THEN 1 END) AS very_acid
FROM treatment""")
def missing_counts(spark, folder):
    table = D.treatment(spark, folder)
    return P.rule_counts(table, {"no_iron": F.col("Fe").isNull(), "very_acid": F.col("pH_out") < 2})


@query("input_report", f"""
WITH {Q.RAW}, t AS (SELECT site, value_text, {Q.number("value_text")} AS v FROM raw)
SELECT 'MonitoringLocationIdentifier' AS "column", COUNT(site) AS non_null, 0 AS unparsable FROM t
UNION ALL SELECT 'ResultMeasureValue', COUNT(value_text),
  COUNT(CASE WHEN value_text IS NOT NULL AND v IS NULL THEN 1 END) FROM t""")
def input_report(spark, folder):
    return P.input_report(D.raw_results(spark, folder), [S.SITE, S.VALUE], [S.VALUE])


@query("retained", f"""
WITH {Q.TREATMENT}, t AS (SELECT site, coalesce(Fe > 8, false) AS k FROM treatment)
SELECT COUNT(*) AS n_rows, COUNT(CASE WHEN k THEN 1 END) AS n_kept, COUNT(DISTINCT site) AS n_sites,
  COUNT(DISTINCT CASE WHEN k THEN site END) AS n_sites_kept,
  round(100.0 * COUNT(CASE WHEN k THEN 1 END) / COUNT(*), 6) AS kept_percent FROM t""")
def retained(spark, folder):
    return rounded(P.retained(D.treatment(spark, folder), F.col("Fe") > 8, S.SITE))


@query("extent", f"""
WITH {Q.SITES}
SELECT round(min(lon), 6) AS min_x, round(min(lat), 6) AS min_y, round(max(lon), 6) AS max_x,
  round(max(lat), 6) AS max_y, round((min(lon) + max(lon)) / 2, 6) AS center_x,
  round((min(lat) + max(lat)) / 2, 6) AS center_y FROM sites""")
def extent(spark, folder):
    return rounded(P.extent(D.sites(spark, folder), "lon", "lat"))


@query("sample_n", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 1234""")
def sample_n(spark, folder):
    """Exactly n reproducible rows."""
    return P.sample_n(D.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1234)


@query("size_guard", f"""
WITH {Q.MINES} SELECT id AS feature_id, layer, COUNT(*) OVER (PARTITION BY layer) AS group_rows FROM mines""")
def size_guard(spark, folder):
    """Every feature with the size of its layer."""
    return P.size_guard(D.mines(spark, folder), "layer").select("feature_id", "layer", "group_rows")


@query("minmax", """
WITH e AS (SELECT event_id, value, CASE WHEN event_type <> 'error' THEN value END AS gap FROM events),
s AS (SELECT min(value) AS lo, max(value) AS hi, min(gap) AS glo, max(gap) AS ghi,
  quantile_cont(gap, 0.5) AS gm FROM e)
SELECT event_id, round((value - lo) / (hi - lo), 6) AS value_norm, CAST(NULL AS DOUBLE) AS flat_norm,
  round((coalesce(gap, gm) - glo) / (ghi - glo), 6) AS gap_scaled, CAST(0 AS DOUBLE) AS flat_scaled, CAST(0 AS DOUBLE) AS none_scaled
FROM e, s""")
def minmax(spark, folder):
    """Scaling with and without median filling; columns without spread or values."""
    table = D.events(spark, folder).select(
        "event_id", "value", F.lit(2.0).alias("flat"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("gap"),
    )
    scaled = H.minmax(table, ["value", "flat"])
    scaled = H.minmax(scaled, ["gap", "flat", "none"], constant=0.0, impute=True, suffix="_scaled")
    return rounded(scaled.drop("value", "flat", "gap", "none"))


@query("rank_dense", """
WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 10 <> 0 THEN CAST(round(sum(o_totalprice), -4) AS BIGINT) END
  AS score FROM orders GROUP BY o_custkey)
SELECT o_custkey, score, CASE WHEN score IS NOT NULL THEN
  CAST(dense_rank() OVER (ORDER BY score DESC NULLS LAST) AS INTEGER) END AS "Rank" FROM s""")
def rank_dense(spark, folder):
    """Dense rank over the whole table with ties and missing scores."""
    total = F.round(F.sum("o_totalprice"), -4).cast("long")
    scores = D.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.when(F.col("o_custkey") % 10 != 0, total).alias("score"))
    return H.rank_dense(scores, "score")


@query("priority_top10", """
SELECT c_custkey, round(c_acctbal, 6) AS score FROM customer WHERE c_mktsegment <> 'BUILDING'
ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def priority_top10(spark, folder):
    table = D.table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("score"))
    return rounded(H.top_by(table, "score", "c_custkey"))


@query("score_range", """
SELECT round(min(value), 6) AS vmin, round(max(value), 6) AS vmax FROM events WHERE event_type <> 'click'""")
def score_range(spark, folder):
    v = F.when(F.col("event_type") != "click", F.col("value"))
    return rounded(P.score_range(D.events(spark, folder).withColumn("value", v), "value"))


@query("watershed_wide", f"""
WITH {Q.RESULTS}
SELECT site AS "HUC12", round({_mean_if("Iron")}, 6) AS "Iron", round({_mean_if("pH")}, 6) AS "pH",
  round({_mean_if("Sulfate")}, 6) AS "Sulfate" FROM results GROUP BY site
HAVING {_mean_if("Iron")} IS NOT NULL AND {_mean_if("pH")} IS NOT NULL AND {_mean_if("Sulfate")} IS NOT NULL""")
def watershed_wide(spark, folder):
    """Mean per area and analyte, complete areas only."""
    table = D.results(spark, folder).withColumnRenamed(S.SITE, "HUC12")
    return rounded(A.watershed_wide(table, ["Iron", "pH", "Sulfate"]))


@query("cluster_summary", f"""
SELECT label AS "Cluster", {", ".join(f"round_even(avg(embedding[{i + 1}]::DOUBLE), 2) AS f{i}" for i in range(64))},
  COUNT(*) AS "Count" FROM embeddings GROUP BY label""")
def cluster_summary(spark, folder):
    """Means of all dimensions per cluster."""
    rows, names = D.vectors(spark, folder, 64)
    return A.cluster_summary(rows.withColumnRenamed("label", "Cluster"), names)
