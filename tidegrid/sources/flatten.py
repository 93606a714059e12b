"""Nested records as flat rows: structs by joined names, arrays by a strategy, types by declaration."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import values as V

SEPARATORS = ("_", "/", "-", ":")


@dataclass(frozen=True)
class ArrayRule:
    """pin (arity columns), aggregate (count, sum, min or max, of a path in the items), json, or explode (a child table)."""

    strategy: str = "json"
    arity: int = 0
    fn: str = "count"
    path: str | None = None


@dataclass(frozen=True)
class Flatten:
    separator: str = "_"
    depth: int = 8
    arrays: Mapping[str, ArrayRule] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.separator not in SEPARATORS:
            raise ValueError(f"separator {self.separator!r}: one of {' '.join(SEPARATORS)}")


def flatten(df: DataFrame, rules: Flatten | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """All leaves as columns of one row. A missing struct gives nulls; arrays to explode are left to `children`."""
    rules = rules or Flatten()
    out = [F.col(f"`{c}`") for c in keep]
    for f in df.schema.fields:
        if f.name not in keep:
            out += [c.alias(name) for name, c in leaves(F.col(f"`{f.name}`"), f.dataType, f.name, f.name, rules, 1)]
    return df.select(*out)


def leaves(c: Column, kind: T.DataType, name: str, path: str, rules: Flatten, depth: int) -> Iterator[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        if depth > rules.depth:
            yield name, F.to_json(c)
            return
        for f in kind.fields:
            yield from leaves(c.getField(f.name), f.dataType, f"{name}{rules.separator}{f.name}", f"{path}.{f.name}", rules, depth + 1)
    elif isinstance(kind, T.ArrayType):
        yield from array_leaves(c, kind, name, path, rules, depth)
    elif isinstance(kind, T.MapType):
        yield name, F.to_json(c)
    else:
        yield name, c


def array_leaves(c: Column, kind: T.ArrayType, name: str, path: str, rules: Flatten, depth: int) -> Iterator[tuple[str, Column]]:
    rule = rules.arrays.get(path, ArrayRule())
    if rule.strategy == "pin":
        for i in range(rule.arity):
            yield from leaves(F.get(c, F.lit(i)), kind.elementType, f"{name}{rules.separator}{i}", f"{path}[]", rules, depth + 1)
    elif rule.strategy == "aggregate":
        yield name, array_aggregate(c, kind, rule)
    elif rule.strategy == "json":
        yield name, F.to_json(c)
    elif rule.strategy != "explode":
        raise ValueError(f"array strategy {rule.strategy!r} at {path}")


def array_aggregate(c: Column, kind: T.ArrayType, rule: ArrayRule) -> Column:
    """Of the numbers among an array's items, or at a path in them; null if there are none (a count: 0)."""
    item, element = kind.elementType, (lambda x: x)
    for part in rule.path.split(".") if rule.path else []:
        outer = element
        element = (lambda name, outer: lambda x: outer(x).getField(name))(part, outer)
        item = item[part].dataType if isinstance(item, T.StructType) else item
    if rule.fn == "count":
        return F.when(c.isNotNull(), F.size(c)).cast("long")
    as_number = (lambda x: V.parsed(x, None, None)) if isinstance(item, T.StringType) else (lambda x: x.cast("double"))
    numbers = F.filter(F.transform(c, lambda x: as_number(element(x))), lambda x: x.isNotNull() & ~F.isnan(x))
    some = F.size(numbers) > 0
    if rule.fn == "sum":
        return F.when(some, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x))
    return F.array_min(numbers) if rule.fn == "min" else F.array_max(numbers)


def children(df: DataFrame, key: Column, path: str, rules: Flatten | None = None) -> DataFrame:
    """An array's items as a child table: __parentKey, __index, __key (parent and index), and the items' leaves."""
    rules = rules or Flatten()
    parts = path.split(".")
    c = F.col(f"`{parts[0]}`")
    for p in parts[1:]:
        c = c.getField(p)
    items = df.select(key.alias("__parentKey"), F.posexplode(c).alias("__index", "__item"))
    kind = items.schema["__item"].dataType
    made = dict(leaves(F.col("__item"), kind, "", path, rules, 1)) if isinstance(kind, T.StructType) else {"value": F.col("__item")}
    named = [v.alias(k.lstrip(rules.separator)) for k, v in made.items()]
    return items.select("__parentKey", "__index", F.concat_ws("\u0001", F.col("__parentKey"), F.col("__index").cast("string")).alias("__key"), *named)


# declared types


def declared(c: Column, source: T.DataType, kind: str) -> Column:
    """A cell in its declared type; what cannot be read as that type is null."""
    t = V.Typed(c, V.kind_of(source))
    if kind in ("integer", "int", "long"):
        x = V.number(t, None, None, None)
        return F.when(F.abs(x) < 9.2e18, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("long")
    if kind in ("float", "double", "number", "f64"):
        return V.number(t, None, None, None)
    if kind in ("boolean", "bool"):
        word = F.lower(V.text(t))
        return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
    if kind in ("string", "str", "dateString"):
        return V.text(t)
    if kind in ("date", "datetime", "timestamp"):
        return V.text(t)
    raise ValueError(f"type {kind!r}")


DATES = ("date", "dateString", "timestamp", "datetime")


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The declared columns in their types (absent ones as null); of a date column also its instant, as `<name>__ts`."""
    from tidegrid.functions.wire import instant

    source = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c, kind in types.items():
        cell = declared(F.col(f"`{c}`"), source[c], kind) if c in source else F.lit(None).cast("string")
        out.append(cell.alias(c))
        if kind in DATES:
            out.append(instant(V.Typed(cell.cast("string"), "str")).alias(f"{c}__ts"))
    extra = [F.col(f"`{c}`") for c in df.columns if c.startswith("__") and c not in types]
    return df.select(*extra, *out)


# coercions into companion columns

#: Eighths of a 32nd that a price's last sign stands for.
TICK_SIGNS = {"+": 4, "¼": 2, "½": 4, "¾": 6, "1": 1, "4": 4, "8": 8}
TICKS = r"^\s*(-?[0-9]+)-([0-9]{1,2})([+¼½¾148]?)\s*$"


def ticks(c: Column) -> Column:
    """A price in 32nds, such as 99-16+, as a decimal number."""
    handle = F.regexp_extract(c, TICKS, 1).try_cast("double")
    sign = F.regexp_extract(c, TICKS, 3)
    eighths = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TICK_SIGNS.items() for x in p]), sign), F.lit(0))
    part = (F.regexp_extract(c, TICKS, 2).try_cast("double") + eighths / 8.0) / 32.0
    return F.when(c.rlike(TICKS), F.when(F.trim(c).startswith("-"), handle - part).otherwise(handle + part))


def epoch_text(c: Column) -> Column:
    """Epoch seconds (below 1e11) or milliseconds as ISO text."""
    at = F.when(F.abs(c) < 1e11, F.timestamp_millis((c * 1000).cast("long"))).otherwise(F.timestamp_millis(c.cast("long")))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def coerce(df: DataFrame, column: str, how: str, companion: str, scale: float = 1.0) -> DataFrame:
    """A companion column made from another one, which stays as it is."""
    t = V.Typed(F.col(f"`{column}`"), V.kind_of(df.schema[column].dataType))
    made = {
        "ticks-to-decimal": lambda: ticks(V.text(t)),
        "string-to-number": lambda: V.number(t, None, None, None),
        "epoch-to-datetime": lambda: epoch_text(V.number(t, None, None, None)),
        "scaled-integer": lambda: V.number(t, None, None, None) / F.lit(float(scale)),
    }
    if how not in made:
        raise ValueError(f"coercion {how!r}")
    return df.withColumn(companion, made[how]())


def body_rows(df: DataFrame, column: str, schema: str, shape: str = "record-array") -> DataFrame:
    """Records of JSON bodies: one a body, or one an element of its array; a body that does not parse gives none."""
    item = T.StructType.fromDDL(schema)
    if shape == "record":
        return df.select(F.from_json(F.col(column), item).alias("r")).where("r IS NOT NULL").select("r.*")
    return df.select(F.explode(F.from_json(F.col(column), T.ArrayType(item))).alias("r")).select("r.*")


def present_fields(column: str) -> Column:
    """Names of the fields that a JSON object holds, null ones too: what tells an absent field from a null one."""
    return F.json_object_keys(F.col(column))


def template(text: str, params: Mapping[str, object]) -> str:
    """`{name}` replaced by the parameter's value; a missing one is an error."""
    import re

    def value(m) -> str:  # noqa: ANN001
        if m[1] not in params:
            raise KeyError(f"no parameter {m[1]!r} for {text!r}")
        return str(params[m[1]])

    return re.sub(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", value, text)
