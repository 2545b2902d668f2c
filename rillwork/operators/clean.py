"""Cleaning: columns, types, units, sentinels, labels and duplicates.

Each function takes and returns a DataFrame and adds only projections and filters to the plan,
apart from the few whose result schema depends on the data (one small aggregate each).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.operators.quantiles import quantile_table


# --- columns -------------------------------------------------------------------------------

def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[V.ref(n) for n in names if n in df.columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def normalise_headers(df: DataFrame, upper: bool = False) -> DataFrame:
    """Trim headers, turn space, slash and dash into ``_``; keep the first of equal names."""
    names = [re.sub(r"[ /\-]", "_", c.strip()) for c in df.columns]
    if upper:
        names = [n.upper() for n in names]
    first = {name: i for i, name in reversed(list(enumerate(names)))}
    unique = df.toDF(*[f"{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"`{i}`").alias(n) for n, i in sorted(first.items(), key=lambda p: p[1])])


def drop_matching(df: DataFrame, pattern: str = S.DROP_PATTERN, keep: list[str] = S.DROP_KEEP) -> DataFrame:
    """Drop columns whose name matches the pattern, unless listed in ``keep``."""
    gone = [c for c in df.columns if re.search(pattern, c) and c not in keep]
    return df.drop(*gone)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value, judged over the whole table in one aggregate."""
    seen = df.agg(*[F.max(V.ref(c).isNotNull()).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[V.ref(c) for i, c in enumerate(df.columns) if seen[str(i)]])


def drop_complex(df: DataFrame) -> DataFrame:
    """Drop array, map, struct and binary columns."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return df.select(*[V.ref(f.name) for f in df.schema.fields if not isinstance(f.dataType, nested)])


def select_by_keyword(
    columns: DataFrame | list[str],
    include: list[str],
    exclude: list[str] = (),
    numeric: bool = False,
    min_columns: int = 0,
) -> list[str]:
    """Column names holding any of the tokens (any case) and none of the excluded ones.

    With ``numeric`` only numeric columns count; with fewer than ``min_columns`` hits every
    (numeric) column is returned.
    """
    if isinstance(columns, DataFrame):
        fields = columns.schema.fields
        pool = [f.name for f in fields if not numeric or isinstance(f.dataType, T.NumericType)]
    else:
        pool = list(columns)
    hits = [
        c for c in pool
        if any(t in c.lower() for t in include) and not any(t in c.lower() for t in exclude)
    ]
    return hits if len(hits) >= min_columns else pool


# --- rows ----------------------------------------------------------------------------------

def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of the columns (all columns by default)."""
    return df.where(V.all_of([V.ref(c).isNotNull() for c in subset or df.columns]))


def drop_blank(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows in which all of the columns are NULL."""
    return df.where(V.any_of([V.ref(c).isNotNull() for c in subset if c in df.columns]))


def keep_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(V.ref(column).isin(allowed))


def filter_text_any(df: DataFrame, columns: list[str] | None = None, words: list[str] = S.LAYER_WORDS) -> DataFrame:
    """Rows whose text columns hold one of the words, on word boundaries, any case.

    Without given columns those are read whose name tells that they hold text (``text_columns``); if there are none, no row is kept.
    """
    columns = text_columns(df.columns) if columns is None else columns
    text = F.concat_ws(" ", *[V.ref(c).cast("string") for c in columns])
    return df.where(text.rlike(r"(?i)\b(" + "|".join(words) + r")\b"))


def text_columns(columns: list[str], tokens: list[str] = S.LAYER_TEXT_TOKENS) -> list[str]:
    """The columns whose name holds one of the tokens, any case: those that ``filter_text_any`` reads by itself."""
    return [c for c in columns if any(t.lower() in c.lower() for t in tokens)]


def drop_sentinels(df: DataFrame, column: str = S.VALUE, limit: float = S.SENTINEL_LIMIT) -> DataFrame:
    """Drop placeholder values beyond the limit; legitimate negatives stay."""
    return df.where(F.abs(V.ref(column)) <= limit)


def dedup(df: DataFrame) -> DataFrame:
    """Equal rows once, over the whole table; copies collapse before the shuffle."""
    return df.dropDuplicates()


# --- values --------------------------------------------------------------------------------

def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace listed values; others stay as they are."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(column, F.coalesce(table[V.ref(column)], V.ref(column)))


def normalise_unit_text(df: DataFrame, column: str = S.UNIT) -> DataFrame:
    """``mg/l`` in any case, anywhere in the text, becomes ``mg/L``."""
    return df.withColumn(column, F.regexp_replace(V.ref(column), "(?i)mg/l", "mg/L"))


def convert_unit(
    df: DataFrame,
    analyte: str = "Conductivity",
    from_units: list[str] = S.CONDUCTIVITY_UNITS,
    to_unit: str = "mS/cm",
    divisor: float = 1000.0,
    analyte_col: str = S.ANALYTE,
    value_col: str = S.VALUE,
    unit_col: str = S.UNIT,
) -> DataFrame:
    """Divide values of one analyte given in some units; the unit text changes with them."""
    hit = V.flag((V.ref(analyte_col) == analyte) & V.ref(unit_col).isin(from_units))
    value = V.numeric(df, value_col)
    return df.withColumns({
        value_col: F.when(hit, value / divisor).otherwise(value),
        unit_col: F.when(hit, F.lit(to_unit)).otherwise(V.ref(unit_col)),
    })


# Fixed value: white space of any kind at the ends of a text.
ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# Date forms that are tried after the ISO form, in this order.
DATE_FORMS = ["M/d/yyyy", "yyyy/M/d", "yyyyMMdd"]


def trim_strings(df: DataFrame) -> DataFrame:
    """White space of any kind taken off both ends of every text."""
    return df.select(*[
        F.regexp_replace(V.ref(f.name), ENDS, "").alias(f.name) if isinstance(f.dataType, T.StringType) else V.ref(f.name)
        for f in df.schema.fields
    ])


def coerce_numeric(
    df: DataFrame, columns: list[str] | None = None, tokens: list[str] = S.NUMERIC_TOKENS
) -> DataFrame:
    """Text to double, bad numbers to NULL: named columns, or those whose name holds a token.

    Names that end in Code, Text, Name or Identifier hold text and are left alone.
    """
    if columns is None:
        columns = [
            c for c in df.columns
            if any(t in c for t in tokens) and not c.endswith(S.TEXT_SUFFIXES)
        ]
    return df.withColumns({c: V.numeric(df, c) for c in columns})


def coerce_dates(df: DataFrame, column: str = S.DATE, year: str | None = None) -> DataFrame:
    """Text to date, bad dates to NULL; optionally with the year beside it.

    The ISO form comes first, then month/day/year, year/month/day and eight digits.
    """
    text = F.trim(V.ref(column).cast("string"))
    forms = [F.try_to_timestamp(text, F.lit(form)).cast("date") for form in DATE_FORMS]
    df = df.withColumn(column, F.coalesce(V.ref(column).try_cast("date"), *forms))
    return df.withColumn(year, F.year(V.ref(column))) if year else df


def finite_only(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite and NaN values become NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: V.finite(V.ref(c)) for c in columns or floats})


def stringify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text for export; NULL stays NULL."""
    return df.withColumns({c: V.ref(c).cast("string") for c in columns})


def fill_missing(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(V.ref(c), F.lit(v)) for c, v in constants.items()})


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs become the exact median of their column."""
    filled = {c: F.coalesce(V.ref(c), F.try_element_at("_medians", F.lit(c))["median"]) for c in columns}
    return df.withColumn("_medians", median_map(df, columns)).withColumns(filled).drop("_medians")


def median_map(df: DataFrame, columns: list[str]) -> Column:
    """Scalar sub-query: map from column name to its median and range (one entry per column)."""
    found = quantile_table(df, columns, [0.5]).withColumn("median", F.get("quantiles", F.lit(0)))
    entries = F.collect_list(F.struct("column", F.struct("median", "lo", "hi")))
    return found.agg(F.map_from_entries(entries)).scalar()


def merge_in_out(
    df: DataFrame, base: str, out: str | None = None, zero_is_null: bool = False, exact: bool = False
) -> DataFrame:
    """Mean of the inlet and outlet columns of an analyte, ignoring NULLs.

    By default every column that holds ``base`` and ends in in/out (any case) counts; with
    ``exact`` only ``<base>In`` and ``<base>Out``. Without such columns nothing changes.
    """
    if exact:
        pattern = re.compile(re.escape(base) + "(in|out)", re.I)
        columns = [c for c in df.columns if pattern.fullmatch(c)]
    else:
        columns = [
            c for c in df.columns if base.lower() in c.lower() and c.lower().endswith(("in", "out"))
        ]
    if not columns:
        return df
    values = [V.numeric(df, c) for c in columns]
    if zero_is_null:
        values = [F.nullif(v, F.lit(0.0)) for v in values]
    return df.withColumn(out or base, V.row_mean(values))


def add_deltas(df: DataFrame, pairs: list[tuple[str, str, str]] = S.DELTAS) -> DataFrame:
    """Outlet minus inlet for every pair whose two columns exist."""
    return df.withColumns({
        out: V.ref(b) - V.ref(a) for a, b, out in pairs if a in df.columns and b in df.columns
    })


def label_any(df: DataFrame, rules: list[tuple[str, str, float]], out: str) -> DataFrame:
    """1 if any threshold rule holds, else 0; missing evidence does not count."""
    tests = [V.compare(V.ref(c), sign, bound) for c, sign, bound in rules if c in df.columns]
    return df.withColumn(out, V.any_of(tests).cast("int"))


def add_ratio(df: DataFrame, numerator: str, denominator: str, out: str) -> DataFrame:
    """Ratio of two columns; NULL for a zero denominator or an absent column."""
    if numerator not in df.columns or denominator not in df.columns:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, V.ratio(V.ref(numerator), V.ref(denominator)))


def flag_hotspots(
    df: DataFrame,
    ph: str | None = None,
    fe: str | None = None,
    so4: str | None = None,
    cond: str | None = None,
    ph_below: float = S.HOTSPOT_PH,
    fe_above: float = S.HOTSPOT_IRON,
    so4_above: float = S.HOTSPOT_SULFATE,
    cond_above: float = S.HOTSPOT_CONDUCTIVITY,
    out: str = "hotspot",
) -> DataFrame:
    """Flag acidic or iron-rich rows; only if the whole table has none, use a proxy.

    The proxy is sulfate if that column is given, otherwise conductivity.
    """
    tests = []
    if ph:
        tests.append(V.numeric(df, ph) < ph_below)
    if fe:
        tests.append(V.numeric(df, fe) > fe_above)
    primary = V.any_of(tests)
    if so4:
        proxy = V.numeric(df, so4) > so4_above
    elif cond:
        proxy = V.numeric(df, cond) > cond_above
    else:
        return df.withColumn(out, primary)
    found = df.agg(F.coalesce(F.max(primary), F.lit(False))).scalar()
    return df.withColumn(out, F.when(found, primary).otherwise(V.flag(proxy)))


def clean_results(df: DataFrame) -> DataFrame:
    """Headers, text, numbers and duplicates of a raw result table in one plan."""
    return dedup(coerce_numeric(trim_strings(normalise_headers(df))))
