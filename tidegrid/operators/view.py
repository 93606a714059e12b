"""Views over a keyed table: filter, computed columns, sort, windows of rows, group trees, pivots, totals.

A table is any DataFrame; `__seq` (insertion order) breaks ties where it is there. Everything is one lazy plan, so Spark
pushes filters and columns into the scan and picks the joins; nothing is collected but the few values a pivot needs as
column names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import aggregates, predicates, wire
from tidegrid.functions import values as V
from tidegrid.plans.viewspec import Aggregate, SortKey, SpecError, ViewSpec

#: A pivot makes a column for each of its values; more than this many are refused.
MOST_PIVOT_VALUES = 2_000


def name(column: str) -> Column:
    return F.col(f"`{column}`")


class View:
    """A validated specification over a table."""

    def __init__(self, table: DataFrame, spec: ViewSpec | dict, seq: str = "__seq", collation: str = "code") -> None:
        self.table = table
        parsed = spec if isinstance(spec, ViewSpec) else ViewSpec.parse(spec)
        self.spec = parsed.validated(V.kinds(table))
        self.seq = seq if seq in table.columns else None
        self.collation = collation
        self.row_computed = [c for c in self.spec.computed if not self._over_aggregates(c.name)]
        self.node_computed = [c for c in self.spec.computed if self._over_aggregates(c.name)]

    def _over_aggregates(self, column: str) -> bool:
        """Whether a computed column follows from aggregates, itself or through others."""
        by_name = {c.name: c for c in self.spec.computed}
        c = by_name.get(column)
        return c is not None and (bool(wire.aggregates(c.expression)) or any(x != column and self._over_aggregates(x) for x in wire.columns(c.expression)))

    # rows

    def with_row_computed(self) -> DataFrame:
        """Computed columns that need only their row, in the order declared."""
        df = self.table
        for c in self.row_computed:
            df = df.withColumn(c.name, wire.compile_expression(c.expression, V.kinds(df)).column)
        return df

    def filtered(self) -> DataFrame:
        """Rows that pass, with computed columns; aggregates in those are over the rows that pass the rest of the filter."""
        df = self.with_row_computed()
        if not self.node_computed:
            return df.where(predicates.condition(self.spec.filter, V.kinds(df)))
        late = {c.name for c in self.node_computed}
        early = [n for n in self.spec.filter if not self._reads(n, late)]
        df = df.where(predicates.condition(early, V.kinds(df)))
        needed = list(dict.fromkeys(a for c in self.node_computed for a in wire.aggregates(c.expression)))
        kinds = V.kinds(df)
        if needed:
            # one row, by its making, so it can go to all tasks
            totals = df.agg(*[aggregates.expression(fn, V.cell(c, kinds[c])).alias(f"__agg_{i}") for i, (fn, c) in enumerate(needed)])
            df = df.crossJoin(F.broadcast(totals))
        at = {a: f"__agg_{i}" for i, a in enumerate(needed)}
        for c in self.node_computed:
            df = df.withColumn(c.name, wire.compile_expression(c.expression, V.kinds(df), lambda fn, col: name(at[fn, col])).column)
        df = df.drop(*at.values())
        rest = [n for n in self.spec.filter if self._reads(n, late)]
        return df.where(predicates.condition(rest, V.kinds(df)))

    def _reads(self, node: dict, columns: set[str]) -> bool:
        from tidegrid.functions import dsl

        if "expr" in node:
            return bool(columns & set(dsl.fields(dsl.parse(node["expr"]))))
        return node.get("column") in columns or any(self._reads(c, columns) for c in node.get("conditions") or [])

    def sort_columns(self, kinds: dict[str, str], keys: Sequence[SortKey] | None = None) -> list[Column]:
        """Blank cells last going up and first going down; the grid's own collation has them the other way round."""
        out = []
        for k in self.spec.sort if keys is None else keys:
            c, kind = name(k.column), kinds[k.column]
            if self.collation == "grid":
                if kind == "str":
                    c = F.lower(F.nullif(c, F.lit("")))
                out.append(c.desc_nulls_last() if k.descending else c.asc_nulls_first())
            else:
                out.append(c.desc_nulls_first() if k.descending else c.asc_nulls_last())
        return out + ([name(self.seq).asc()] if self.seq else [])

    def ordered(self) -> DataFrame:
        df = self.filtered()
        order = self.sort_columns(V.kinds(df))
        return df.orderBy(*order) if order else df

    def rows(self, start: int = 0, end: int | None = None) -> DataFrame:
        """Rows [start, end) of the sorted view."""
        start = max(start, 0)
        df = self.ordered()
        if self.spec.columns:
            keep = [c for c in ("__key", *self.spec.columns) if c in df.columns]
            df = df.select(*map(name, dict.fromkeys(keep)))
        df = df.offset(start) if start else df
        return df if end is None else df.limit(max(end - start, 0))

    def count(self) -> DataFrame:
        return self.filtered().agg(F.count(F.lit(1)).alias("rows"))

    def rank(self, key: str, value: object) -> DataFrame:
        """The place, from 0, of the rows with this key in the sorted view; no row if it is not in the view.

        Counts the rows before it, instead of numbering all rows in one task.
        """
        df = self.filtered()
        kinds = V.kinds(df)
        keys = [*self.spec.sort, *([SortKey(self.seq)] if self.seq else [])]
        target = df.where(name(key) == F.lit(value)).select(*[name(k.column).alias(f"__t{i}") for i, k in enumerate(keys)]).limit(1)
        joined = df.crossJoin(F.broadcast(target))
        before, tie = F.lit(False), F.lit(True)
        for i, k in enumerate(keys):
            c, t = name(k.column), F.col(f"__t{i}")
            c, t = (c, t) if kinds[k.column] != "float" else (F.nanvl(c, F.lit(V.INFINITY)), F.nanvl(t, F.lit(V.INFINITY)))
            up = F.when(c.isNull() | t.isNull(), t.isNull() & c.isNotNull()).otherwise(c < t)
            down = F.when(c.isNull() | t.isNull(), c.isNull() & t.isNotNull()).otherwise(c > t)
            before = before | (tie & (down if k.descending else up))
            tie = tie & c.eqNullSafe(t)
        return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(before).alias("rank")).where("n > 0").select("rank")

    # aggregates

    def _aggregate(self, df: DataFrame, a: Aggregate) -> Column:
        kinds = V.kinds(df)
        if a.fn == "count":
            return F.count(F.lit(1)).alias(a.name)
        order = name(self.seq) if self.seq else None
        weight = V.cell(a.weight, kinds[a.weight]) if a.weight else None
        return aggregates.grid(a.fn, V.cell(a.column, kinds[a.column]), weight, order).alias(a.name)

    def totals(self) -> DataFrame:
        """The aggregates over all rows that pass: one row."""
        df = self.filtered()
        return df.agg(*[self._aggregate(df, a) for a in self.spec.aggregates])

    def _node_values(self, df: DataFrame) -> tuple[list[Column], list[str]]:
        """Aggregates that node-scoped computed columns need, under names of their own."""
        kinds = V.kinds(df)
        needed = list(dict.fromkeys(a for c in self.node_computed for a in wire.aggregates(c.expression)))
        return [aggregates.expression(fn, V.cell(c, kinds[c])).alias(f"__agg_{fn}_{c}") for fn, c in needed], [f"__agg_{fn}_{c}" for fn, c in needed]

    def _with_node_computed(self, grouped: DataFrame, made: list[str]) -> DataFrame:
        for c in self.node_computed:
            if set(wire.columns(c.expression)) <= set(grouped.columns):
                value = wire.compile_expression(c.expression, V.kinds(grouped), lambda fn, col: name(f"__agg_{fn}_{col}")).column
                grouped = grouped.withColumn(c.name, value)
        return grouped.drop(*made)

    def groups(self) -> DataFrame:
        """One row a group of the (first) group column, with __count and the aggregates, by value."""
        return self.levels(1).drop("__level").orderBy(*self.path_order(self.spec.groups[:1]))

    def levels(self, depth: int | None = None) -> DataFrame:
        """All group rows down to a depth: every prefix of the group columns, told apart by __level (from 0)."""
        groups = list(self.spec.groups[:depth])
        if not groups:
            raise SpecError(["no group columns"])
        scope = self.spec.filter if not self.node_computed else [n for n in self.spec.filter if not self._reads(n, {c.name for c in self.node_computed})]
        df = self.with_row_computed()
        df = df.where(predicates.condition(scope, V.kinds(df)))
        extra, made = self._node_values(df)
        own = [a for a in self.spec.aggregates if a.column in df.columns or a.fn == "count"]
        prefixes = [groups[: i + 1] for i in range(len(groups))]
        plain = [self._aggregate(df, a) for a in own]
        level = sum((1 - F.grouping(name(g)).cast("int") for g in groups[1:]), F.lit(0)).alias("__level")
        out = df.groupingSets([[name(g) for g in p] for p in prefixes], *map(name, groups)).agg(F.count(F.lit(1)).alias("__count"), level, *plain, *extra)
        out = self._with_node_computed(out, made)
        return out.select(*[c for c in out.columns if c not in ("__count", "__level")], "__count", "__level")

    def mixed(self, column: str, fn: str = "sum") -> DataFrame:
        """Aggregate, group by group, of a computed column that reads both its row and its group's aggregates."""
        df = self.with_row_computed()
        df = df.where(predicates.condition(self.spec.filter, V.kinds(df)))
        kinds = V.kinds(df)
        c = next(c for c in self.spec.computed if c.name == column)
        groups = list(self.spec.groups)
        needed = {a: f"__agg_{i}" for i, a in enumerate(wire.aggregates(c.expression))}
        nodes = df.groupBy(*[name(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(*[aggregates.expression(f, V.cell(x, kinds[x])).alias(made) for (f, x), made in needed.items()])
        joined = df.join(nodes, all_of([name(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]))
        joined = joined.withColumn(column, wire.compile_expression(c.expression, kinds, lambda f, x: F.col(needed[f, x])).column)
        return joined.groupBy(*map(name, groups)).agg(aggregates.grid(fn, V.cell(column, "float")).alias(column))

    def path_order(self, groups: Sequence[str]) -> list[Column]:
        """Groups go up by value, unless the sort names their column to go down."""
        down = {k.column for k in self.spec.sort if k.descending}
        return [name(g).desc_nulls_first() if g in down else name(g).asc_nulls_last() for g in groups]

    def tree(self, expanded: Sequence[Sequence[object]] = (), leaves: bool = True) -> DataFrame:
        """The visible rows in order: top groups, what is under expanded paths, and rows under expanded deepest groups.

        Columns: __group (is a group row), __level, __expanded, __count, then group columns and aggregates (null in rows),
        and the table's columns (null in group rows).
        """
        groups = list(self.spec.groups)
        spark = self.table.sparkSession
        levels = self.levels()
        types = {f.name: f.dataType for f in levels.schema.fields}
        open_paths = self._paths(spark, expanded, groups, types)
        parents = [name(g) for g in groups]
        path = F.struct(*[F.when(F.col("__level") >= i, p).alias(f"g{i}") for i, p in enumerate(parents)], F.col("__level").alias("level"))
        above = F.struct(*[F.when(F.col("__level") > i, p).alias(f"g{i}") for i, p in enumerate(parents)], (F.col("__level") - 1).alias("level"))
        marked = levels.withColumn("__path", path).withColumn("__above", above)
        # a child is seen if each path above it is open; open_paths has those whose own ancestors are open too
        seen = marked.join(F.broadcast(open_paths), F.col("__above").eqNullSafe(F.col("open")), "left").where("__level = 0 OR open IS NOT NULL").drop("open")
        seen = seen.join(F.broadcast(open_paths), F.col("__path").eqNullSafe(F.col("open")), "left").withColumn("__expanded", F.col("open").isNotNull()).drop("open", "__path", "__above")
        group_rows = seen.withColumn("__group", F.lit(True))
        if leaves:
            rows = self.filtered()
            deepest = F.struct(*[p.alias(f"g{i}") for i, p in enumerate(parents)], F.lit(len(groups) - 1).alias("level"))
            under = rows.join(F.broadcast(open_paths), deepest.eqNullSafe(F.col("open")), "left_semi")
            shared = [a.name for a in self.spec.aggregates if a.name in under.columns]
            under = _as_types(under, group_rows, shared).withColumns({"__group": F.lit(False), "__level": F.lit(len(groups)), "__expanded": F.lit(False)})
            group_rows = group_rows.unionByName(under, allowMissingColumns=True)
        order: list[Column] = []
        for i, c in enumerate(self.path_order(groups)):
            order += [c, (F.col("__level") > i).asc()]
        present = {k: v for k, v in V.kinds(group_rows).items()}
        keys = [k for k in self.spec.sort if k.column in present and k.column not in groups]
        return group_rows.orderBy(*order, *(self.sort_columns(present, keys) if leaves and (not self.seq or self.seq in group_rows.columns) else []))

    def _paths(self, spark, expanded: Sequence[Sequence[object]], groups: list[str], types: dict) -> DataFrame:  # noqa: ANN001
        """Expanded paths as structs (g0, g1, ..., level); those below a closed path are left out."""
        wanted = {tuple(p) for p in expanded}
        kept = [p for p in wanted if all(p[: i + 1] in wanted for i in range(len(p)))]
        inner = T.StructType([*[T.StructField(f"g{i}", types[g]) for i, g in enumerate(groups)], T.StructField("level", T.IntegerType())])
        schema = T.StructType([T.StructField("open", inner)])
        return spark.createDataFrame([((*p, *[None] * (len(groups) - len(p)), len(p) - 1),) for p in kept], schema)

    # pivot

    def pivot_values(self) -> list[str]:
        """The pivot's keys, sorted; refused if there are very many."""
        df = self.filtered()
        got = [r[0] for r in df.select(self.split_key(df).alias("k")).distinct().limit(MOST_PIVOT_VALUES + 1).collect()]
        if len(got) > MOST_PIVOT_VALUES:
            raise SpecError([f"the pivot has more than {MOST_PIVOT_VALUES} values"])
        return sorted(got)

    def split_key(self, df: DataFrame) -> Column:
        """The split columns' values joined by |; null as the word, and a | inside a value as a broken bar."""
        kinds = V.kinds(df)
        return F.concat_ws("|", *[F.replace(F.coalesce(V.text(V.cell(c, kinds[c])), F.lit("null")), F.lit("|"), F.lit("¦")) for c in self.spec.splits])

    def pivot(self, values: Sequence[str] | None = None) -> DataFrame:
        """Groups (or, without group columns, one row of all) by the split columns' values: columns `value|aggregate`."""
        values = list(values) if values is not None else self.pivot_values()
        df = self.filtered()
        df = df.withColumn("__split", self.split_key(df))
        out = []
        for v in values:
            at = F.col("__split") == v
            for a in self.spec.aggregates:
                inner = self._aggregate_where(df, a, at)
                out.append(inner.alias(f"{v}|{a.name}"))
        by = [name(g) for g in self.spec.groups]
        total = F.count(F.lit(1)).alias("__count")
        if not by:
            return df.agg(total, *out)
        return df.groupBy(*by).agg(total, *out).orderBy(*self.path_order(self.spec.groups))

    def _aggregate_where(self, df: DataFrame, a: Aggregate, at: Column) -> Column:
        kinds = V.kinds(df)
        some = F.count_if(at) > 0
        if a.fn == "count":
            return F.when(some, F.count_if(at))
        t = V.Typed(F.when(at, name(a.column)), kinds[a.column])
        weight = V.Typed(F.when(at, name(a.weight)), kinds[a.weight]) if a.weight else None
        order = F.when(at, name(self.seq)) if self.seq else None
        return F.when(some, aggregates.grid(a.fn, t, weight, order))

    # columns' values

    def distinct(self, column: str, limit: int = 10_000, order: str = "seen") -> DataFrame:
        """A column's values among the rows that pass, in the order first seen (or by value), at most `limit` of them."""
        df = self.filtered()
        c = name(column)
        if order == "value" or not self.seq:
            return df.select(c.alias("value")).distinct().orderBy(F.col("value").asc_nulls_first()).limit(limit)
        return df.groupBy(c.alias("value")).agg(F.min(name(self.seq)).alias("first")).orderBy("first", "value").limit(limit).select("value")

    def starting_with(self, column: str, prefix: str, limit: int = 100) -> DataFrame:
        """Typeahead: distinct values whose text begins with the prefix, without regard to case."""
        df = self.filtered()
        kind = V.kinds(df)[column]
        found = df.where(predicates.leaf(V.cell(column, kind), "startsWith", prefix))
        return found.select(name(column).alias("value")).distinct().orderBy("value").limit(limit)

    # leaving Spark

    def as_csv(self, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows as CSV lines (without a header): quoted where need be, blank for null."""
        return self._lines(columns, ",")

    def as_tsv(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self._lines(columns, "\t")

    def _lines(self, columns: Sequence[str] | None, separator: str) -> DataFrame:
        df = self.ordered()
        kinds = V.kinds(df)
        chosen = list(columns or [c for c in df.columns if not c.startswith("__")])

        def shown(c: str) -> Column:
            t = F.coalesce(V.text(V.cell(c, kinds[c])), F.lit(""))
            quoted = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
            return F.when(t.rlike('[",\r\n]'), quoted).otherwise(t) if separator == "," else t

        return df.select(F.concat_ws(separator, *map(shown, chosen)).alias("line"))


def _as_types(df: DataFrame, like: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leaf cells in the types that group rows have under the same names."""
    types = {f.name: f.dataType for f in like.schema.fields}
    return df.withColumns({c: name(c).cast(types[c]) for c in columns})


def selection(df: DataFrame, key: str, select_all: bool, toggled: Sequence[object]) -> DataFrame:
    """Rows of a selection kept as a rule: all but the toggled, or only these."""
    hit = name(key).isin(list(toggled)) if toggled else F.lit(False)
    return df.where(~hit if select_all else hit)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
