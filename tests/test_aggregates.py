"""Site features, profiles, quantiles, ranks, samples."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.operators import clean as C
from rillwork.operators import features as A
from rillwork.operators import health as H
from rillwork.operators import profile as P
from rillwork.operators import quantiles as Qn


def _results(spark, rows):
    return spark.createDataFrame(rows, f"{S.SITE} string, {S.ANALYTE} string, {S.DATE} string, {S.VALUE} string")


def test_annual_statistics_and_trend(spark):
    rows = [("s", "Iron", "2001-05-01", "1"), ("s", "Iron", "2001-06-01", "3"), ("s", "Iron", "2002-01-01", "4"),
            ("s", "Iron", "2003-01-01", "7"), ("s", "Iron", "2004-01-01", "999999"), ("s", "Iron", "bad", "5"),
            ("t", "pH", "2001-01-01", "4"), ("t", "pH", "2002-01-01", "4.5"), ("t", "Zinc", "2002-01-01", "4.5"),
            (None, "pH", "2001-01-01", "1")]
    got = {r[S.SITE]: r for r in A.site_features(_results(spark, rows)).collect()}
    assert set(got) == {"s", "t"}
    s, t = got["s"], got["t"]
    assert s["Iron_mean"] == pytest.approx(13 / 3) and s["Iron_median"] == 4
    assert s["Iron_std"] == pytest.approx(2.054805, abs=1e-6)
    assert (s["Iron_min"], s["Iron_max"], s["Iron_n_years"]) == (2, 7, 3)
    assert s["Iron_trend"] == pytest.approx(2.5) and s["AMD_impacted"] == 0
    assert t["pH_trend"] is None and t["pH_n_years"] == 2 and t["AMD_impacted"] == 1
    assert s["pH_mean"] is None and s["pH_n_years"] is None and s["Fe_Mn_ratio"] is None


def test_pivot_leaves_out_null_keys(spark):
    rows = spark.createDataFrame([("a", None, "pH", 1.0), ("a", "x", "pH", 3.0), ("a", "x", "pH", 5.0)],
                                 f"k string, t string, {S.ANALYTE} string, {S.VALUE} double")
    got = [tuple(r) for r in A.pivot_mean(rows, ["k", "t"], ["pH", "Iron"]).collect()]
    assert got == [("a", "x", 4.0, None)]


def test_describe_matches_pandas(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double")
    r = P.describe_exact(rows, ["v", "absent"]).first()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert r["mean"] == pytest.approx(7 / 3) and r["std"] == pytest.approx(1.527525, abs=1e-6)


@pytest.mark.parametrize("kind", ["distinct", "hot", "skewed", "constant"])
def test_quantiles_are_exact_beyond_the_sketch(spark, kind, monkeypatch):
    """Small accuracy, so that brackets and collapsed slots are really used."""
    monkeypatch.setattr(Qn, "ACCURACY", 200)
    rng = np.random.default_rng(1)
    n = 20_000
    values = {
        "distinct": rng.permutation(n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)),
        "skewed": np.exp(rng.normal(0, 4, n)),
        "constant": np.full(n, 2.5),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    ps = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9995, 1.0]
    got = {r.p: r.value for r in Qn.exact_quantiles(df, ["v"], ps).collect()}
    assert got == {p: pytest.approx(float(np.quantile(values, p))) for p in ps}


def test_no_bin_of_a_heavy_tail_is_large(spark):
    rng = np.random.default_rng(3)
    values = np.exp(rng.normal(0, 6, 400_000))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for p in (0.9999, 1.0):
        marks = [max(p - 4 / Qn.ACCURACY, 0.0), min(p + 4 / Qn.ACCURACY, 1.0)]
        counted = Qn.bracket_counts(Qn.long_values(df, ["v"]), Qn.column_moments(df, ["v"], marks), marks)
        inside = Qn.binned(counted).where("value is not null")
        sizes = [r["count"] for r in inside.groupBy("column", "slot", "bin").count().collect()]
        assert max(sizes) < 0.05 * sum(sizes)
    got = {r.p: r.value for r in Qn.exact_quantiles(df, ["v"], [0.9999, 1.0]).collect()}
    assert got == {p: pytest.approx(float(np.quantile(values, p))) for p in (0.9999, 1.0)}


def test_quantiles_read_the_table_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(30_000).selectExpr("id % 977 + 0.5 AS a", "cast(id AS double) AS b").write.parquet(path)
    found = Qn.quantile_table(spark.read.parquet(path), ["a", "b"], [0.5])
    assert {r["column"]: r["quantiles"] for r in found.collect()} == {"a": [14_999 // 31 + 0.5], "b": [14999.5]}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 2


def test_a_crowded_slot_is_divided(spark, monkeypatch):
    monkeypatch.setattr(P, "SLOT_ROWS", 3)
    rows = spark.range(200_000).withColumnRenamed("id", "k")
    digest = F.md5(F.concat_ws(":", F.col("k").cast("string"), F.lit("42")))
    plain = {r.k for r in rows.orderBy(digest).limit(777).collect()}
    assert {r.k for r in P.sample_n(rows, "k", 777).collect()} == plain


def test_minmax_without_spread(spark):
    rows = spark.createDataFrame([(2.0, None, 1.0), (2.0, None, None), (2.0, None, 3.0)], "a double, b double, c double")
    plain = [tuple(r) for r in H.minmax(rows, ["a", "b", "c"]).select("a_norm", "b_norm", "c_norm").collect()]
    assert plain == [(None, None, 0.0), (None, None, None), (None, None, 1.0)]
    filled = H.minmax(rows, ["a", "b", "c"], constant=0.0, impute=True)
    assert [tuple(r) for r in filled.select("a_norm", "b_norm", "c_norm").collect()] == [
        (0.0, 0.0, 0.0), (0.0, 0.0, 0.5), (0.0, 0.0, 1.0)]


def test_health_v1_single_row_values(spark):
    rows = spark.createDataFrame(
        [("h", 0.0, None, 0.0), ("h", 1.0, None, 1.0), ("h", 0.5, None, 0.25), (None, 9.0, 9.0, 9.0)],
        "huc string, Fe double, T double, d double")
    got = {r.d: r.Sickness_Index for r in H.sickness_v1(rows, ["Fe", "T"], "d", "huc").collect()}
    assert got[0.25] == pytest.approx(0.6 * 0.5 + 0.4 * 0.75) and len(got) == 3


def test_health_v2_weights_and_distance(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 0.0, 0.0), (0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)],
                                 "Iron_mean double, Cond_mean double, Temp_mean double, d double")
    first = H.sickness_v2(rows, distance="d").collect()[0]
    assert first.Sickness_Index == pytest.approx(0.6)
    gone = H.sickness_v2(rows.withColumn("d", F.lit(None).cast("double")), distance="d").collect()[0]
    assert gone.Sickness_Index == pytest.approx(0.6)
    assert H.sickness_v2(rows.drop("Cond_mean")).collect()[0].Sickness_Index == pytest.approx(0.4)


def test_dense_rank_with_ties_and_missing(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([3.0, None, 3.0, 1.0])], "i int, s double")
    assert {r.i: r.Rank for r in H.rank_dense(rows, "s").collect()} == {0: 1, 1: None, 2: 1, 3: 2}


def test_dense_rank_across_partitions(spark):
    rng = random.Random(3)
    scores = [round(rng.random(), 3) for _ in range(5000)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").repartition(7)
    want = pd.Series(scores).rank(ascending=False, method="dense").astype(int)
    assert {r.i: r.Rank for r in H.rank_dense(rows, "s").collect()} == dict(enumerate(want))


def test_pick_best_takes_first_of_equals(spark):
    rows = spark.createDataFrame([(None if i < 4 else 1.0, 1.0, 2.0) for i in range(9)], "a double, b double, c double")
    assert P.pick_best(rows, ["a", "b", "c"], 6) == "b"
    assert P.pick_best(rows, ["a"], 6) is None and P.pick_best(rows, ["z"], 1) is None


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    first = {r.k for r in P.sample_n(rows, "k", 3000).collect()}
    assert len(first) == 3000
    assert first == {r.k for r in P.sample_n(rows.repartition(11), "k", 3000).collect()}
    assert P.sample_n(rows, "k", 50_000).count() == 20_000
    assert P.sample_n(rows, "k", 0).count() == 0


def test_size_guard(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "layer string")
    sized = P.size_guard(rows.unionByName(spark.createDataFrame([(None,)], "layer string")), "layer")
    assert {(r.layer, r.group_rows) for r in sized.collect()} == {("a", 5), ("b", 2), (None, 1)}
    assert sized.count() == 8


def test_correlation_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None], "b": [2, 4, 5, None, 1], "c": [1.0, 1, 1, 1, 1]})
    rows = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.values],
                                 "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in P.corr_matrix(rows, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(pdf.a.corr(pdf.b)) and got["a", "c"] is None


def test_missing_input_column_is_an_error(spark):
    with pytest.raises(ValueError, match="absent"):
        P.input_report(spark.range(1), ["id", "absent"])


def test_histogram_of_a_constant(spark):
    rows = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [r["count"] for r in P.histogram(rows, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_wide_correlation_equals_the_narrow_one(spark):
    """Gaps, a column without spread, one that is never there, and one that shares a single row with the others."""
    draw = random.Random(6)
    rows = [(draw.choice([None, 1e6 + draw.random()]), draw.gauss(0, 1), 0.1, None, 5.0 if n == 3 else None, n * 0.5 if n % 3 else None) for n in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, `f g` double").repartition(4)
    names = df.columns
    narrow = {(r["a"], r["b"]): r["r"] for r in P.corr_matrix(df, names).collect()}
    wide = {(r["a"], r["b"]): r["r"] for r in P.corr_wide(df, names).collect()}
    assert wide.keys() == narrow.keys() and len(wide) == 15
    for pair, r in narrow.items():
        assert (wide[pair] is None) == (r is None) and (r is None or wide[pair] == pytest.approx(r, abs=1e-9)), pair
    plan = [len(P.corr_wide(spark.range(3).select(*[F.col("id").alias(f"x{i}") for i in range(n)]), [f"x{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()) for n in (20, 40)]
    assert plan[1] < 2.5 * plan[0]
    assert P.corr_wide(df.limit(0), names).where("r is not null").count() == 0


def test_text_columns_are_found_by_name(spark):
    df = spark.createDataFrame([(1, "acid mine", "x"), (2, "clean", "acid")], "id int, problem_desc string, other string")
    assert [r["id"] for r in C.filter_text_any(df, words=["acid"]).collect()] == [1]
    assert C.filter_text_any(df.drop("problem_desc"), words=["acid"]).count() == 0
