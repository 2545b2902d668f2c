"""Numbers, missing values, text."""

import math

from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.operators import clean as C


def test_num_reads_plain_numbers_only(spark):
    texts = ["<0.5", " 7.1 ", "1e3", "1d", "7.1f", "NaN", "inf", "0x10", None, "", "-.5", "+3.", "Infinity"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.select("i", V.num(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [None, 7.1, 1000.0, None, None, None, math.inf, None, None, None, -0.5, 3.0, math.inf]


def test_numeric_turns_nan_into_null(spark):
    rows = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int")
    assert [r[0] for r in rows.select(V.numeric(rows, "v")).collect()] == [None, 2.0]
    assert [r[0] for r in rows.select(V.numeric(rows, "i")).collect()] == [1.0, 2.0]


def test_sentinels_and_negatives(spark):
    rows = spark.createDataFrame([(999999.0,), (1e5,), (-3.0,), (math.inf,), (None,)], f"{S.VALUE} double")
    assert sorted(r[0] for r in C.drop_sentinels(rows).collect()) == [-3.0, 1e5]


def test_unit_text_and_conversion(spark):
    rows = spark.createDataFrame(
        [("Conductivity", 420.0, "uS/cm"), ("Conductivity", 420.0, "mS/cm"), ("Iron", 420.0, "uS/cm"),
         ("Iron", 1.0, "MG/L as X"), ("Iron", 1.0, None)],
        f"{S.ANALYTE} string, {S.VALUE} double, `{S.UNIT}` string",
    )
    got = [tuple(r) for r in C.normalise_unit_text(C.convert_unit(rows)).collect()]
    assert got == [("Conductivity", 0.42, "mS/cm"), ("Conductivity", 420.0, "mS/cm"), ("Iron", 420.0, "uS/cm"),
                   ("Iron", 1.0, "mg/L as X"), ("Iron", 1.0, None)]


def test_label_is_zero_without_evidence(spark):
    rows = spark.createDataFrame(
        [(None, None, None), (5.9, None, None), (6.0, 1.0, 250.0), (None, None, 250.1)],
        "pH double, Fe_mgL double, SO4_mgL double",
    )
    got = [r.AMD_present for r in C.label_any(rows, S.PRESENT_RULES, "AMD_present").collect()]
    assert got == [0, 1, 0, 1]


def test_ratio_by_zero_is_null(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r.r for r in C.add_ratio(rows, "a", "b", "r").collect()] == [None, None, 2.0]


def test_in_out_mean(spark):
    rows = spark.createDataFrame([(0.0, 4.0), (None, None), (2.0, 4.0)], "IronIn double, IronOut double")
    merged = C.merge_in_out(rows, "Iron", "m", zero_is_null=True)
    assert [r.m for r in merged.collect()] == [4.0, None, 3.0]
    assert [r.Iron for r in C.merge_in_out(rows, "iron", "Iron", exact=True).collect()] == [2.0, None, 3.0]
    assert C.merge_in_out(rows, "Cond").columns == rows.columns


def test_headers_first_of_equal_names_wins(spark):
    rows = spark.createDataFrame([(1, 2, 3)], ["a b", " a/b ", "c-d"])
    out = C.normalise_headers(rows)
    assert out.columns == ["a_b", "c_d"]
    assert tuple(out.first()) == (1, 3)


def test_drop_empty_columns_looks_at_all_rows(spark):
    rows = spark.createDataFrame([(1, None, None)] * 5 + [(None, "x", None)], "a int, b string, c double")
    assert C.drop_empty_columns(rows).columns == ["a", "b"]


def test_numeric_tokens_spare_text_columns(spark):
    rows = spark.createDataFrame(
        [("5", "mg/L", "ok", "1")],
        ["ResultMeasureValue", "ResultMeasure.MeasureUnitCode", "ResultCommentText", "DetectionLimit"],
    )
    assert tuple(C.coerce_numeric(rows).first()) == (5.0, "mg/L", "ok", 1.0)


def test_keyword_rows(spark):
    rows = spark.createDataFrame([("Acid seep",), ("academic",), ("mine water pool",), (None,)], "t string")
    assert [r.t for r in C.filter_text_any(rows, ["t"]).collect()] == ["Acid seep", "mine water pool"]


def test_bad_dates_are_null(spark):
    rows = spark.createDataFrame([("2015-03-04",), ("unknown",), (None,)], f"{S.DATE} string")
    got = [(str(r[0]) if r[0] else None, r[1]) for r in C.coerce_dates(rows, S.DATE, "Year").collect()]
    assert got == [("2015-03-04", 2015), (None, None), (None, None)]


def test_hotspot_fallback_order(spark):
    rows = spark.createDataFrame(
        [(1, 7.0, 1.0, 300.0, 10.0), (2, 7.0, 1.0, 1.0, 900.0), (3, None, None, None, None)],
        "i int, ph double, fe double, so4 double, cond double",
    )
    hits = lambda df: [r.i for r in df.where("hotspot").orderBy("i").collect()]
    assert hits(C.flag_hotspots(rows, "ph", "fe", "so4", "cond")) == [1]
    assert hits(C.flag_hotspots(rows, "ph", "fe", None, "cond")) == [2]
    assert hits(C.flag_hotspots(rows, "ph", "fe", "so4", ph_below=8.0)) == [1, 2]
    assert hits(C.flag_hotspots(rows, "ph", "fe")) == []


def test_dedup_counts_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (1, "a")], "i int, t string")
    assert C.dedup(rows).count() == 2


def test_column_picking():
    names = ["pH", "pH_in", "Temp outflow", "Iron_mg", "Site"]
    assert C.select_by_keyword(names, S.CHEMISTRY_TOKENS, S.IN_OUT_TOKENS) == ["pH", "Iron_mg"]
    assert C.select_by_keyword(names, ["zz"], min_columns=1) == names


def test_title_parts_and_popup(spark):
    rows = spark.createDataFrame([("temperature_water", None)], "a string, b string")
    assert rows.select(V.title_parts(F.col("a"))).first()[0] == "Temperature_Water"
    assert rows.select(V.key_value_text(["a", "b"], 12)).first()[0] == "a: temperatu"
    assert rows.select(V.key_value_text(["a", "b"])).first()[0] == "a: temperature_water<br>b: "


def test_trim_takes_any_white_space(spark):
    rows = spark.createDataFrame([("\t a b\u00a0\r\n",), ("\u2003",), (None,)], "a string")
    assert [r.a for r in C.trim_strings(rows).collect()] == ["a b", "", None]


def test_date_forms(spark):
    texts = ["2010-01-15", "01/15/2010", "1/5/2010", "2010/01/15", "20100115", "15.1.2010", "13/45/2010", None]
    rows = spark.createDataFrame([(t,) for t in texts], f"{S.DATE} string")
    days = [str(r[S.DATE]) for r in C.coerce_dates(rows).collect()]
    assert days == ["2010-01-15", "2010-01-15", "2010-01-05", "2010-01-15", "2010-01-15", "None", "None", "None"]


def test_text_columns_go_by_name():
    assert C.text_columns(["Site_Name", "lat", "problem1", "depth", "notes"]) == ["Site_Name", "problem1", "notes"]
