"""Column expressions for numbers, missing values and text.

Missing is NULL everywhere: NaN is turned into NULL on the way in, comparisons with NULL
count as false, and a division by zero gives NULL.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the text forms read as a number (decimal literal, optional exponent, infinity).
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"

INFINITY = float("inf")


def ref(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(value: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def numeric(df: DataFrame, name: str) -> Column:
    """``num`` chosen by the column's type, so numbers are not printed and parsed again."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return not_nan(ref(name).cast("double"))
    if isinstance(kind, T.NumericType):
        return ref(name).cast("double")
    return num(ref(name))


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) != INFINITY), value)


def flag(condition: Column) -> Column:
    """A condition on a missing value is false, not NULL."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, [flag(c) for c in conditions], F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def row_mean(values: list[Column]) -> Column:
    """Mean across columns of one row, ignoring NULLs; NULL if all are NULL."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(total, present)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def compare(value: Column, sign: str, bound: float) -> Column:
    tests = {"<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound}
    return tests[sign]


def title_parts(text: Column, separator: str = "_") -> Column:
    """``temperature_water`` to ``Temperature_Water``."""
    return F.array_join(F.transform(F.split(text, separator), F.initcap), separator)


def json_field(text: Column, path: str, default: Column | None = None) -> Column:
    found = F.get_json_object(text, path)
    return found if default is None else F.coalesce(found, default)


def key_value_text(columns: list[str], limit: int | None = None) -> Column:
    """``name: value`` pairs of a row as one text, cut only where a ``limit`` is given."""
    pairs = [F.concat(F.lit(f"{c}: "), F.coalesce(ref(c).cast("string"), F.lit(""))) for c in columns]
    text = F.concat_ws("<br>", *pairs)
    return text if limit is None else F.substring(text, 1, limit)
