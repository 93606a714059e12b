"""Schema inference, off line: statistics of every leaf in one pass, and a reviewable decision from them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import values as V

ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
#: Pairs of tokens that a two-valued text column may stand for a boolean by.
BOOLEAN_WORDS = ({"true", "false"}, {"y", "n"}, {"yes", "no"}, {"t", "f"}, {"0", "1"})
FEW, MANY, UNBOUNDED = 20, 10_000, 0.9


@dataclass(frozen=True)
class Decision:
    column: str
    type: str
    nullable: bool
    filter: str
    review: tuple[str, ...]
    stats: Mapping


def statistics(df: DataFrame) -> dict[str, dict]:
    """Per column: rows, values, blanks, distinct (approximate), least, greatest, longest, ISO-like, number-like."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    kinds = V.kinds(df)
    for i, (c, kind) in enumerate(kinds.items()):
        x = F.col(f"`{c}`")
        words = V.text(V.Typed(x, kind))
        some = x.isNotNull() & (words != "")
        aggs += [
            F.count_if(some).alias(f"{i}_values"), F.approx_count_distinct(F.when(some, words)).alias(f"{i}_distinct"), F.min(F.when(some, words)).alias(f"{i}_least"), F.max(F.when(some, words)).alias(f"{i}_greatest"),
            F.max(F.length(words)).alias(f"{i}_longest"), F.count_if(some & words.rlike(ISO)).alias(f"{i}_iso"), F.count_if(some & words.rlike(V.NUMBER)).alias(f"{i}_numbers"),
            F.count_if(some & words.contains(".")).alias(f"{i}_decimals"), F.min(F.when(some, F.lower(words))).alias(f"{i}_low"),
            F.max(F.when(some, F.lower(words))).alias(f"{i}_high"),
        ]
    row = df.agg(*aggs).head().asDict()
    return {c: {"kind": kind, "rows": row["rows"]} | {k.split("_", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}_")} for i, (c, kind) in enumerate(kinds.items())}


def decide(column: str, s: Mapping) -> Decision:
    """Text stays text even if it looks like numbers; dates need 99 of 100 values; few values ask for a review."""
    review = []
    n = s["values"]
    kind = s["kind"]
    if kind == "int":
        made = "integer"
    elif kind in ("float", "bool"):
        made = {"float": "float", "bool": "boolean"}[kind]
    elif kind == "time":
        made = "datetime"
    elif n and s["iso"] >= 0.99 * n:
        made = "datetime" if s["longest"] > 10 else "date"
    elif n and s["distinct"] <= 2 and {s["low"], s["high"]} in [*BOOLEAN_WORDS] and s["low"] != s["high"]:
        made = "boolean"
    else:
        made = "string"
        if n and s["numbers"] == n:
            review.append("text that looks like numbers")
    if n < FEW:
        review.append(f"only {n} values")
    wide = s["distinct"] > MANY or (n and s["distinct"] / n >= UNBOUNDED)
    choose = "number" if made in ("integer", "float") else "date" if made.startswith("date") else "search-select" if wide else "set"
    return Decision(column, made, n < s["rows"], choose, tuple(review), s)


def infer(df: DataFrame) -> dict[str, Decision]:
    """Decisions for the columns of a flat sample."""
    return {c: decide(c, s) for c, s in statistics(df).items()}


def progress(df: DataFrame, each: int) -> DataFrame:
    """Per leaf how many values were seen, and whether that is enough."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "leaf", "seen").withColumn("enough", F.col("seen") >= each)


def unknown_paths(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Top-level fields of JSON payloads that the reviewed schema does not have, with their counts."""
    keys = df.select(F.explode(F.json_object_keys(F.col(column))).alias("path"))
    return keys.where(~F.col("path").isin(known) if known else F.lit(True)).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
