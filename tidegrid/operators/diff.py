"""What changed between two versions of a table, of its groups, or of a view's members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, columns: Sequence[str], name: str) -> Column:
    return F.struct(*[df[f"`{c}`"].alias(c) for c in columns]).alias(name)


def snapshot_diff(previous: DataFrame, incoming: DataFrame, key: str = "__key", soft_delete: str | None = None) -> DataFrame:
    """key, change (insert, update, remove, same) and the incoming row (of a removal: null), as struct `row`.

    One full join on the key; rows compare null-safe over the columns that both have. A row whose soft-delete flag is up
    counts as removed.
    """
    columns = [c for c in incoming.columns if c in previous.columns and c != key]
    alive = lambda df: df.where(F.coalesce(~F.col(soft_delete).cast("boolean"), F.lit(True))) if soft_delete else df
    a, b = alive(previous), alive(incoming)
    old, new = a.select(a[key].alias("k_old"), _row(a, columns, "old")), b.select(b[key].alias("k_new"), _row(b, columns, "new"))
    both = old.join(new, F.col("k_old") == F.col("k_new"), "full_outer")
    change = F.when(F.col("k_new").isNull(), "remove").when(F.col("k_old").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return both.select(F.coalesce("k_new", "k_old").alias(key), change.alias("change"), F.when(F.col("k_new").isNotNull(), F.col("new")).alias("row"))


def group_diff(previous: DataFrame, current: DataFrame, groups: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Group rows (of View.levels) that are new or changed, and those that are gone: change, __level, group columns, values.

    Numbers within `tolerance` are the same.
    """
    at = [*groups, "__level"]
    values = [c for c in current.columns if c not in at]
    old, new = (df.select(*[F.col(f"`{c}`").alias(f"{c}__{side}") for c in df.columns]) for df, side in ((previous, "old"), (current, "new")))
    on = [F.col(f"`{c}__old`").eqNullSafe(F.col(f"`{c}__new`")) for c in at]
    both = old.join(new, on, "full_outer")

    def same(c: str) -> Column:
        a, b = F.col(f"`{c}__old`"), F.col(f"`{c}__new`")
        if tolerance and dict(current.dtypes)[c] in ("double", "float"):
            return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
        return a.eqNullSafe(b)

    unchanged = F.lit(True)
    for c in values:
        unchanged = unchanged & same(c)
    gone, fresh = F.col("__level__new").isNull(), F.col("__level__old").isNull()
    change = F.when(gone, "remove").when(fresh, "insert").when(~unchanged, "update")
    shown = [F.when(gone, F.col(f"`{c}__old`")).otherwise(F.col(f"`{c}__new`")).alias(c) for c in at]
    return both.select(change.alias("change"), *shown, *[F.col(f"`{c}__new`").alias(c) for c in values]).where("change IS NOT NULL")


def membership(previous: DataFrame, current: DataFrame, key: str = "__key") -> DataFrame:
    """Keys that entered or left a view: (event, key)."""
    entered = current.select(key).join(previous.select(key), key, "left_anti").select(F.lit("entered").alias("event"), key)
    left = previous.select(key).join(current.select(key), key, "left_anti").select(F.lit("left").alias("event"), key)
    return entered.unionByName(left)


def alert_transitions(previous: DataFrame, current: DataFrame, predicate: Column, key: str = "__key") -> DataFrame:
    """Rows of the whole table for which a predicate has become true (fired), and keys for which it no longer holds (cleared).

    With an empty `previous`, all rows that match now fire.
    """
    now, before = current.where(predicate), previous.where(predicate)
    fired = now.join(before.select(key), key, "left_anti").select(F.lit("fired").alias("event"), key)
    cleared = before.select(key).join(now.select(key), key, "left_anti").select(F.lit("cleared").alias("event"), key)
    return fired.unionByName(cleared)


def conflate(deltas: DataFrame, key: str = "__key", order: str = "__seq") -> DataFrame:
    """Of several deltas of a key the last one, by partial sums."""
    rest = [c for c in deltas.columns if c != key]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("__last")
    return deltas.groupBy(key).agg(last).select(key, *[F.col(f"__last.`{c}`").alias(c) for c in rest])
