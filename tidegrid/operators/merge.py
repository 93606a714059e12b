"""Merging keyed messages into rows: a later value wins field by field, a delete removes the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, SEQ, OP, PRESENT = "__key", "__seq", "__op", "__present"
SEPARATOR = "\u0001"
#: What messages call their operations.
DEFAULT_OPS = {"I": "insert", "N": "insert", "insert": "insert", "U": "update", "update": "update", "D": "delete", "delete": "delete"}


def row_key(columns: Sequence[str]) -> Column:
    """Key parts as text, joined; null if a part is missing, and such a row has no address."""
    parts = [F.col(f"`{c}`").cast("string") for c in columns]
    some = F.lit(True)
    for p in parts:
        some = some & p.isNotNull()
    return F.when(some, F.concat_ws(SEPARATOR, *parts))


def operation(column: str | None, ops: dict[str, str] | None = None, strict: bool = True) -> Column:
    """insert, update or delete; an absent token is an update, an unknown one is null (to be set aside) or an update."""
    if column is None:
        return F.lit("update")
    c = F.col(f"`{column}`").cast("string")
    table = F.create_map(*[F.lit(x) for pair in (ops or DEFAULT_OPS).items() for x in pair])
    known = F.try_element_at(table, c)
    return F.when(c.isNull(), "update").otherwise(known if strict else F.coalesce(known, F.lit("update")))


def fold_messages(messages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a key from many: __key, __seq (of its first message since the last delete), __last, __op, __present and fields.

    messages: __key, __seq, __op, __present (names of the fields that are there; null: all) and the columns. A field that is
    there and null overwrites; one that is not there leaves the older value. Messages before a key's last delete count for
    nothing. All of it is one aggregation with partial sums.
    """
    named = [c for c in columns if c not in (KEY, SEQ, OP, PRESENT)]
    deleted = F.max(F.when(F.col(OP) == "delete", F.col(SEQ)))
    gone = messages.groupBy(KEY).agg(deleted.alias("__deleted"), F.max(SEQ).alias("__last"))
    live = messages.join(gone.select(KEY, F.col("__deleted")), KEY).where((F.col(OP) != "delete") & (F.col("__deleted").isNull() | (F.col(SEQ) > F.col("__deleted"))))
    there = lambda c: F.col(PRESENT).isNull() | F.array_contains(PRESENT, c)
    values = [F.max_by(F.when(there(c), F.struct(F.col(f"`{c}`").alias("v"))), F.when(there(c), F.col(SEQ))).alias(c) for c in named]
    merged = live.groupBy(KEY).agg(F.min(SEQ).alias(SEQ), *values)
    out = gone.join(merged, KEY, "left")
    present = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in named])) if named else F.array().cast("array<string>")
    op = F.when(F.col(SEQ).isNull(), "delete").when(F.col("__deleted").isNotNull(), "replace").otherwise("update")
    return out.select(KEY, F.coalesce(SEQ, "__last").alias(SEQ), "__last", op.alias(OP), present.alias(PRESENT), *[F.col(f"`{c}`.v").alias(c) for c in named])


def apply_patch(state: DataFrame, patch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The state after a patch (of fold_messages): updated, inserted and kept rows; deleted ones are gone."""
    named = [c for c in columns if c not in (KEY, SEQ)]
    fields = F.struct(*[F.col(f"`{c}`") for c in named]).alias("__n")
    new = patch.select(F.col(KEY).alias("__k"), F.col(SEQ).alias("__s"), F.col(OP).alias("__o"), F.col(PRESENT).alias("__p"), fields)
    both = state.join(new, state[KEY] == new["__k"], "full_outer").where("__o IS NULL OR __o <> 'delete'")
    untouched = F.col("__o").isNull()
    fresh = ~untouched & (F.col(KEY).isNull() | (F.col("__o") == "replace"))

    def value(c: str) -> Column:
        old, given = F.col(f"`{c}`"), F.col(f"__n.`{c}`")
        return F.when(untouched, old).when(fresh | F.array_contains("__p", c), given).otherwise(old).alias(c)

    return both.select(F.coalesce(KEY, "__k").alias(KEY), F.when(fresh, F.col("__s")).otherwise(F.col(SEQ)).alias(SEQ), *map(value, named))


def latest(messages: DataFrame) -> DataFrame:
    """The last whole message of each key, deletes left out: for feeds that always send whole rows."""
    rest = [c for c in messages.columns if c != KEY]
    last = messages.groupBy(KEY).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(SEQ)).alias("m"))
    return last.select(KEY, *[F.col(f"m.`{c}`").alias(c) for c in rest]).where(F.coalesce(F.col(OP), F.lit("update")) != "delete")


def soft_delete(df: DataFrame, flag: str) -> DataFrame:
    """Deletes become updates that raise a flag, inserts lower it, updates leave it as it is."""
    named = [c for c in df.columns if not c.startswith("__")]
    there = F.coalesce(F.col(PRESENT), F.array(*[F.lit(c) for c in named]).cast("array<string>"))
    touched = F.array_union(F.when(F.col(OP) == "delete", F.array().cast("array<string>")).otherwise(there), F.array(F.lit(flag)))
    return df.withColumns(
        {
            flag: F.when(F.col(OP) == "delete", True).when(F.col(OP) == "insert", False),
            PRESENT: F.when(F.col(OP).isin("delete", "insert"), touched).otherwise(there),
            OP: F.when(F.col(OP) == "delete", "update").otherwise(F.col(OP)),
        }
    )


def overlay(incoming: DataFrame, edits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows as a user sees them: an edit holds while upstream resends what it had before, and gives way to anything newer.

    edits: __key, column, value and baseline (both as text), one row for each field edited.
    """
    held = edits.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("value", "baseline")))).alias("__edits"))
    df = incoming.join(held, KEY, "left")
    for c in columns:
        e = F.try_element_at("__edits", F.lit(c))
        stale = e.isNotNull() & F.col(f"`{c}`").cast("string").eqNullSafe(e["baseline"])
        df = df.withColumn(c, F.when(stale, e["value"].cast(dict(incoming.dtypes)[c])).otherwise(F.col(f"`{c}`")))
    return df.drop("__edits")


def edit_outcomes(incoming: DataFrame, edits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What became of edits: confirmed (upstream has the edited value), pending (it has the old one), diverged, or gone."""
    cells = incoming.select(KEY, F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))).alias("column", "now"), F.lit(True).alias("seen"))
    both = edits.join(cells, [KEY, "column"], "left")
    outcome = F.when(F.col("seen").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("value")), "confirmed").when(F.col("now").eqNullSafe(F.col("baseline")), "pending").otherwise("diverged")
    return both.select(KEY, "column", outcome.alias("outcome"))


def commands(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Write commands told apart: rejected (no key or field), duplicate (their idempotency key was seen before), applied."""
    first = F.row_number().over(Window.partitionBy("idempotency").orderBy(SEQ))
    marked = incoming.withColumn("__n", first).join(ledger.select(F.col("idempotency"), F.lit(True).alias("known")), "idempotency", "left")
    status = F.when(F.col(KEY).isNull() | F.col("column").isNull(), "rejected").when(F.col("known") | (F.col("__n") > 1), "duplicate").otherwise("applied")
    return marked.select("idempotency", KEY, "column", "value", SEQ, status.alias("status"))
