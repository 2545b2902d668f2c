"""Queries over cleaning operators."""

from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.registry import day_text, query, rounded
from rillwork.functions import values as V
from rillwork.operators import clean as C
from rillwork.plans import domain as D
from rillwork.sources.tables import canonicalise, union_by_name


def short(df):
    """Plain names for the check."""
    names = {S.SITE: "site", S.ANALYTE: "analyte", S.DATE: "day", S.VALUE: "value", S.UNIT: "unit"}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


NUM = Q.number("value_text")


@query("valid_results", f"""
WITH {Q.RAW}, typed AS (
  SELECT site, analyte, YEAR(TRY_CAST(day_text AS DATE)) AS "Year", {NUM} AS v FROM raw)
SELECT site, analyte, CAST("Year" AS INTEGER) AS "Year", v AS value FROM typed
WHERE "Year" IS NOT NULL AND v IS NOT NULL AND abs(v) <= 100000
  AND analyte IN ('pH', 'Iron', 'Sulfate')""")
def valid_results(spark, folder):
    """Column subset, coercion, complete rows, analyte membership, sentinel removal."""
    picked = C.keep_columns(D.raw_results(spark, folder), [S.SITE, S.ANALYTE, S.DATE, S.VALUE, "absent"])
    typed = C.coerce_dates(C.coerce_numeric(picked, [S.VALUE]), S.DATE, "Year")
    kept = C.drop_incomplete(typed, ["Year", S.VALUE, S.ANALYTE, S.SITE])
    listed = C.keep_values(kept, S.ANALYTE, ["pH", "Iron", "Sulfate"])
    return short(C.drop_sentinels(listed).drop(S.DATE))


@query("clean_results", f"""
WITH {Q.RAW}
SELECT DISTINCT trim(site) AS "Site_Id", analyte AS "Characteristic_Name", day_text AS "Start_Date",
  {NUM} AS "Result_Measure_Value", trim(unit) AS "Result_Unit_Code" FROM raw""")
def clean_results(spark, folder):
    """Headers, trimming, numbers and duplicates, as one plan."""
    raw = D.raw_results(spark, folder).toDF(
        " Site Id", "Characteristic/Name", "Start-Date ", "Result Measure-Value", "Result/Unit Code"
    )
    return C.clean_results(raw)


@query("dedup_results", f"WITH {Q.RAW} SELECT DISTINCT analyte, day_text AS day, unit FROM raw")
def dedup_results(spark, folder):
    return short(C.dedup(D.raw_results(spark, folder).select(S.ANALYTE, S.DATE, f"`{S.UNIT}`")))


@query("coerce_numeric", f"""
WITH {Q.RAW} SELECT value_text AS text, {NUM} AS value, COUNT(*) AS n FROM raw GROUP BY 1, 2""")
def coerce_numeric(spark, folder):
    raw = D.raw_results(spark, folder).withColumn("text", F.col(S.VALUE))
    typed = C.coerce_numeric(raw).withColumnRenamed(S.VALUE, "value")
    return typed.groupBy("text", "value").agg(F.count(F.lit(1)).alias("n"))


@query("json_numbers", """
SELECT event_type, COUNT(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS n_k,
  SUM(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS sum_k,
  COUNT(coalesce(json_extract_string(props, '$.absent'), 'none')) AS n_default
FROM events GROUP BY event_type""")
def json_numbers(spark, folder):
    """JSON fields with a default, read as numbers."""
    k = V.num(V.json_field(F.col("props"), "$.k"))
    other = V.json_field(F.col("props"), "$.absent", F.lit("none"))
    return D.events(spark, folder).groupBy("event_type").agg(
        F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.count(other).alias("n_default")
    )


@query("coerce_dates", f"""
WITH {Q.RAW} SELECT day_text AS text, strftime(TRY_CAST(day_text AS DATE), '%Y-%m-%d') AS day,
  CAST(YEAR(TRY_CAST(day_text AS DATE)) AS INTEGER) AS "Year", COUNT(*) AS n
FROM raw GROUP BY 1, 2, 3""")
def coerce_dates(spark, folder):
    raw = D.raw_results(spark, folder).withColumn("text", F.col(S.DATE))
    typed = day_text(C.coerce_dates(raw, S.DATE, "Year"), S.DATE).withColumnRenamed(S.DATE, "day")
    return typed.groupBy("text", "day", "Year").agg(F.count(F.lit(1)).alias("n"))


@query("recode_units", f"""
WITH {Q.RESULTS}, named AS (
  SELECT site, CASE analyte WHEN 'Specific conductance' THEN 'Conductivity' WHEN 'Iron' THEN 'Fe_mgL'
    WHEN 'Manganese' THEN 'Mn_mgL' WHEN 'Sulfate' THEN 'SO4_mgL' WHEN 'Alkalinity' THEN 'Alk_mgL'
    ELSE analyte END AS analyte, v, unit FROM results)
SELECT site, analyte,
  round(CASE WHEN analyte = 'Conductivity' AND unit IN ('uS/cm', 'µS/cm') THEN v / 1000 ELSE v END, 6) AS value,
  CASE WHEN analyte = 'Conductivity' AND unit IN ('uS/cm', 'µS/cm') THEN 'mS/cm'
    ELSE regexp_replace(unit, 'mg/l', 'mg/L', 'gi') END AS unit
FROM named""")
def recode_units(spark, folder):
    """Analyte names, unit text and conditional unit conversion."""
    named = C.recode(D.results(spark, folder), S.ANALYTE, S.SHORT_NAMES)
    converted = C.normalise_unit_text(C.convert_unit(named))
    return short(rounded(converted.select(S.SITE, S.ANALYTE, S.VALUE, f"`{S.UNIT}`")))


@query("drop_empty_columns", f"""
WITH {Q.TREATMENT} SELECT site, Fe, IronOut FROM treatment""")
def drop_empty_columns(spark, folder):
    table = D.treatment(spark, folder).select(
        F.col(S.SITE).alias("site"), "Fe", F.lit(None).cast("double").alias("blank"), "IronOut",
        F.lit(None).cast("string").alias("note"),
    )
    return C.drop_empty_columns(table)


@query("normalise_headers", """
SELECT s_suppkey AS "SUPP_KEY", trim(s_name) AS "S_NAME", s_nationkey AS "NATION_KEY_ID" FROM supplier""")
def normalise_headers(spark, folder):
    """Header clean-up to upper case with repeated names, and trimmed text."""
    raw = D.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias(" supp key"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("s_name"),
        F.col("s_nationkey").alias("nation/key-id "), F.col("s_acctbal").alias("nation key id"),
    )
    return C.trim_strings(C.normalise_headers(raw, upper=True))


@query("rename_and_drop", f"""
WITH {Q.TREATMENT} SELECT site, Fe, Temperatur AS "Temp", CAST(1.5 AS DOUBLE) AS "Bituminous_dist_m" FROM treatment""")
def rename_and_drop(spark, folder):
    """Rename by map, drop by pattern with exceptions."""
    table = D.treatment(spark, folder).withColumn("Bituminous_dist_m", F.lit(1.5))
    table = table.withColumn("point_x", F.lit(0)).withColumn("site", F.col(S.SITE))
    named = C.rename(table.drop("site_key", S.VALUE), {"Temperatur": "Temp", "absent": "x"})
    return C.drop_matching(named)


@query("any_chemistry", f"""
WITH {Q.TREATMENT}
SELECT site, round(Fe, 6) AS "Fe", round(TempIn, 6) AS "TempIn", round(TempOut, 6) AS "TempOut" FROM treatment
WHERE Fe IS NOT NULL OR TempIn IS NOT NULL OR TempOut IS NOT NULL""")
def any_chemistry(spark, folder):
    """Rows with at least one value."""
    columns = ["Fe", "TempIn", "TempOut"]
    kept = C.drop_blank(D.treatment(spark, folder), columns)
    return rounded(kept.select(F.col(S.SITE).alias("site"), *columns))


@query("complete_rows", f"""
WITH {Q.TREATMENT} SELECT site, round(pH_out, 6) AS "pH_out", round(Temperatur, 6) AS "Temperatur"
FROM treatment WHERE pH_out IS NOT NULL AND Temperatur IS NOT NULL""")
def complete_rows(spark, folder):
    table = D.treatment(spark, folder).select(F.col(S.SITE).alias("site"), "pH_out", "Temperatur")
    return rounded(C.drop_incomplete(table))


@query("in_out_merge", f"""
WITH {Q.TREATMENT}
SELECT site, round({Q.row_mean("nullif(IronIn, 0)", "nullif(IronOut, 0)")}, 6) AS "Iron_mean",
  round({Q.row_mean("nullif(CondIn, 0)", "nullif(CondOut, 0)")}, 6) AS "Cond_mean",
  round({Q.row_mean("TempIn", "TempOut")}, 6) AS "Temp" FROM treatment""")
def in_out_merge(spark, folder):
    """Inlet and outlet merged, with zero as missing and without."""
    table = D.treatment(spark, folder)
    merged = C.merge_in_out(table, "Iron", "Iron_mean", zero_is_null=True)
    merged = C.merge_in_out(merged, "Cond", "Cond_mean", zero_is_null=True)
    merged = C.merge_in_out(merged, "Temp", exact=True)
    return rounded(merged.select(F.col(S.SITE).alias("site"), "Iron_mean", "Cond_mean", "Temp"))


@query("deltas", f"""
WITH {Q.TREATMENT}
SELECT site, round(pH_out - pH_in, 6) AS "delta_pH", round(CondOut - CondIn, 6) AS "delta_Cond",
  round(TempOut - TempIn, 6) AS "delta_Temp" FROM treatment
WHERE coalesce(Fe, pH_in, pH_out, CondIn, CondOut, TempIn, TempOut, Temperatur) IS NOT NULL""")
def deltas(spark, folder):
    """Treatment chemistry: rows with any value, standard names, outlet minus inlet."""
    table = C.drop_blank(D.treatment(spark, folder), S.TREATMENT_COLUMNS)
    named = C.add_deltas(C.rename(table, S.TREATMENT_RENAMES))
    out = {"ΔpH": "delta_pH", "ΔCond": "delta_Cond", "ΔTemp": "delta_Temp"}
    renamed = named.withColumnsRenamed(out).withColumnRenamed(S.SITE, "site")
    return rounded(renamed.select("site", *out.values()))


@query("label_and_ratio", f"""
WITH {Q.TREATMENT}
SELECT site, CASE WHEN pH_in < 3.0 THEN 1 WHEN Fe > 9.0 THEN 1 WHEN TempOut >= 18.0 THEN 1 ELSE 0 END AS label,
  round(CondIn / nullif(CondOut, 0), 6) AS cond_ratio, CAST(NULL AS DOUBLE) AS no_ratio FROM treatment""")
def label_and_ratio(spark, folder):
    """Any-of threshold label and guarded ratios."""
    rules = [("pH_in", "<", 3.0), ("Fe", ">", 9.0), ("TempOut", ">=", 18.0)]
    table = C.label_any(D.treatment(spark, folder), rules, "label")
    table = C.add_ratio(table, "CondIn", "CondOut", "cond_ratio")
    table = C.add_ratio(table, "CondIn", "absent", "no_ratio")
    return rounded(table.select(F.col(S.SITE).alias("site"), "label", "cond_ratio", "no_ratio"))


@query("select_by_keyword", f"""
WITH {Q.TREATMENT} SELECT round(sum(Fe), 4) AS "Fe", round(sum(Temperatur), 4) AS "Temperatur" FROM treatment""")
def select_by_keyword(spark, folder):
    """Numeric columns picked by name tokens, inlet and outlet names excluded."""
    table = D.treatment(spark, folder)
    names = C.select_by_keyword(table, ["fe", "temp", "cond"], ["in", "out"], numeric=True)
    return table.agg(*[F.round(F.sum(n), 4).alias(n) for n in names])


WORDS = ["token", "thatin", "reha", "from the", "that is"]


@query("keyword_rows", """
SELECT doc_id, n_chars FROM documents
WHERE regexp_matches(concat_ws(' ', source, lang, text), '(?i)\\b(token|thatin|reha|from the|that is)\\b')""")
def keyword_rows(spark, folder):
    """Rows whose text columns hold a listed word."""
    hits = C.filter_text_any(D.table(spark, folder, "documents"), ["source", "lang", "text"], WORDS)
    return hits.select("doc_id", "n_chars")


@query("keyword_columns", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(concat_ws(' ', p_name, p_type), '(?i)\\b(promo|blue|13|rod)\\b')""")
def keyword_columns(spark, folder):
    """Rows with a listed word in the columns whose names say that they hold text: name and type, not brand."""
    hits = C.filter_text_any(D.table(spark, folder, "part"), words=["promo", "blue", "13", "rod"])
    return hits.select("p_partkey", "p_name")


@query("keyword_pages", """
SELECT page_id, url FROM pages WHERE regexp_matches(concat_ws(' ', url, html), '(?i)\\b(nav|footer|http)\\b')""")
def keyword_pages(spark, folder):
    hits = C.filter_text_any(D.table(spark, folder, "pages"), ["url", "html"], ["nav", "footer", "http"])
    return hits.select("page_id", "url")


@query("hotspots", f"""
WITH {Q.TREATMENT}
SELECT site, round(pH_in, 6) AS ph, round(Fe, 6) AS fe FROM treatment WHERE pH_in < 4.0 OR Fe > 10.0""")
def hotspots(spark, folder):
    """Rows that break the pH or iron threshold."""
    flagged = C.flag_hotspots(D.treatment(spark, folder), "pH_in", "Fe", so4="CondOut")
    hit = flagged.where("hotspot").select(
        F.col(S.SITE).alias("site"), F.col("pH_in").alias("ph"), F.col("Fe").alias("fe"))
    return rounded(hit)


@query("hotspots_proxy", f"""
WITH {Q.TREATMENT}, marks AS (
  SELECT *, coalesce(pH_in < 0.1, false) OR coalesce(Fe > 1000.0, false) AS main,
    coalesce(CondOut > 250.0, false) AS proxy FROM treatment)
SELECT site, round(CondOut, 6) AS so4 FROM marks
WHERE CASE WHEN (SELECT bool_or(main) FROM marks) THEN main ELSE proxy END""")
def hotspots_proxy(spark, folder):
    """No row breaks the main thresholds, so sulfate decides."""
    flagged = C.flag_hotspots(
        D.treatment(spark, folder), "pH_in", "Fe", "CondOut", "CondIn", ph_below=0.1, fe_above=1000.0
    )
    return rounded(flagged.where("hotspot").select(F.col(S.SITE).alias("site"), F.col("CondOut").alias("so4")))


@query("fill_missing", f"""
WITH {Q.TREATMENT}
SELECT site, round(coalesce(Fe, (SELECT quantile_cont(Fe, 0.5) FROM treatment)), 6) AS "Fe",
  round(coalesce(TempIn, 0.0), 6) AS "TempIn",
  coalesce(CASE WHEN TempOut > 10 THEN 'warm' END, 'Unknown') AS kind FROM treatment""")
def fill_missing(spark, folder):
    """Missing values as median, constant and text."""
    table = D.treatment(spark, folder).withColumn("kind", F.when(F.col("TempOut") > 10, "warm"))
    filled = C.fill_missing(C.fill_median(table, ["Fe"]), {"TempIn": 0.0, "kind": "Unknown"})
    return rounded(filled.select(F.col(S.SITE).alias("site"), "Fe", "TempIn", "kind"))


@query("stringify", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_orderstatus FROM orders""")
def stringify(spark, folder):
    """Columns as text; nested columns are dropped first."""
    table = D.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus",
        F.array("o_custkey").alias("nested"),
    )
    return C.stringify(C.drop_complex(table), ["o_orderkey", "day"])


@query("finite_only", """
SELECT event_type, COUNT(value) AS n, COUNT(CASE WHEN value <= 20 THEN 1 END) AS n_finite FROM events
GROUP BY event_type""")
def finite_only(spark, folder):
    """Infinite and NaN values made missing."""
    v = F.col("value")
    made = F.when(v > 30, F.lit(float("inf"))).when(v > 20, F.lit(float("nan"))).otherwise(v)
    table = D.events(spark, folder).withColumn("made", made)
    cleaned = C.finite_only(table, ["made"])
    return cleaned.groupBy("event_type").agg(F.count("value").alias("n"), F.count("made").alias("n_finite"))


@query("canonical_columns", f"""
WITH {Q.SITES}
SELECT site AS id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM sites
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(NULL AS DOUBLE), round(s_acctbal / 100, 6) FROM supplier""")
def canonical_columns(spark, folder):
    """Exports with different column names brought to one schema and united."""
    a = D.sites(spark, folder).select(
        S.SITE, F.col("lat").alias("DEC_LAT"), F.col("lon").alias("Longitude"))
    b = D.table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ActivityIdentifier"),
        (F.col("s_acctbal") / 100).alias("Lon"),
    )
    names = {"id": S.ID_NAMES, "lat": S.LAT_NAMES, "lon": S.LON_NAMES}
    united = union_by_name([canonicalise(a, names, ["lat", "lon"]), canonicalise(b, names)])
    return rounded(united)
