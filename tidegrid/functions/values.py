"""Typed columns and the coercions that filters, expressions and rules share.

A `Typed` is a Column with the kind of its cells: null, bool, int, float, str or time. Three families of rules meet here and
are kept apart: filters (blank cells never match), wire expressions (null counts as 0) and rules in the text language
(null counts as NaN).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NAN, INFINITY = float("nan"), float("inf")


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(data_type: T.DataType) -> str:
    """The kind of a Spark type's cells."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "float"
    if isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    if isinstance(data_type, T.NullType):
        return "null"
    return "str"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def cell(name: str, kind: str) -> Typed:
    return Typed(F.col(f"`{name}`"), kind)


def literal(value: object) -> Typed:
    """A JSON scalar."""
    if value is None:
        return Typed(F.lit(None).cast("string"), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long") if -(1 << 63) <= value < 1 << 63 else F.lit(float(value)), "int" if -(1 << 63) <= value < 1 << 63 else "float")
    if isinstance(value, float):
        return Typed(F.lit(value), "float")
    if isinstance(value, str):
        return Typed(F.lit(value), "str")
    raise ValueError(f"not a scalar: {value!r}")


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, others with the fewest digits, very large and small ones with an exponent."""
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    whole = (x == F.floor(x).cast("double")) & (size < 1e15)
    scientific = F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), r"\.0e", "e"), r"e([0-9])", "e+$1")
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == INFINITY, "Infinity")
        .when(x == -INFINITY, "-Infinity")
        .when(whole, F.when(whole, x).cast("long").cast("string"))
        .when((size >= 1e-6) & (size < 1e19), F.when((size >= 1e-6) & (size < 1e19), plain))
        .otherwise(scientific)
    )


def text(t: Typed) -> Column:
    """The cell as text; null stays null."""
    if t.kind == "float":
        return number_text(t.column.cast("double"))
    if t.kind == "time":
        return F.date_format(t.column.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.column.cast("string")


def trimmed(c: Column) -> Column:
    """Without white space at either end, by Unicode."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parsed(c: Column, empty: float | None, bad: float | None) -> Column:
    """Text as a double: `empty` for blank text, `bad` for text that is no number."""
    t = trimmed(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(t == "", F.lit(empty).cast("double")).when(t.rlike(NUMBER), t.try_cast("double")).otherwise(F.lit(bad).cast("double"))


def epoch_ms(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1000.0


def number(t: Typed, null: float | None, bad: float | None = NAN, empty: float | None = 0.0) -> Column:
    """The cell as a double, `null` for null."""
    if t.kind == "null":
        return F.lit(null).cast("double")
    if t.kind == "str":
        value = parsed(t.column, empty, bad)
    elif t.kind == "time":
        value = epoch_ms(t.column)
    else:
        value = t.column.cast("double")
    return value if null is None else F.coalesce(value, F.lit(null))


# filters


def blank(t: Typed) -> Column:
    return t.column.isNull() | (t.column == "") if t.kind == "str" else t.column.isNull()


def fold(t: Typed) -> Column:
    """Lower-cased text; null for a blank cell."""
    return F.lower(F.nullif(text(t), F.lit("")))


def numeric_cell(t: Typed) -> Column:
    """What a grid aggregate takes from a cell: its number, or null where it is blank or no number."""
    if t.kind == "str":
        return parsed(t.column, None, None)
    value = number(t, None)
    return F.when(~F.isnan(value), value) if t.kind == "float" else value


def filter_number(t: Typed) -> Column:
    """A cell as a number in a comparison: NaN where it is none."""
    return number(t, NAN, NAN, NAN)


# comparisons that treat NaN as unequal to all


def below(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def at_most(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a <= b)


def same_number(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def divide(a: Column, b: Column) -> Column:
    """By the rules of floating point; Spark's own raises at 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | F.isnan(b) | (a == 0), NAN).when(a > 0, INFINITY).otherwise(-INFINITY)


def half_up(x: Column, digits: Column | None = None) -> Column:
    """floor(x * 10**d + 0.5) / 10**d, NaN and infinities left alone."""
    power = F.pow(F.lit(10.0), digits) if digits is not None else F.lit(1.0)
    odd = F.isnan(x) | (F.abs(x) == INFINITY)
    return F.when(odd, x).otherwise(whole(x * power + 0.5, F.floor) / power)


def whole(x: Column, rounding) -> Column:  # noqa: ANN001
    """floor or ceil as a double; numbers too large to have a fraction stay."""
    small = F.abs(x) < 9e15
    return F.when(small, rounding(F.when(small, x)).cast("double")).otherwise(x)


def extreme(values: list[Column], least: bool) -> Column:
    """The least or greatest; NaN if any is NaN, 0 of none."""
    if not values:
        return F.lit(0.0)
    odd = values[0].isNull() & F.lit(False)
    for v in values:
        odd = odd | F.isnan(v)
    best = values[0] if len(values) == 1 else (F.least if least else F.greatest)(*values)
    return F.when(odd, NAN).otherwise(best)
