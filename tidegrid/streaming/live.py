"""A keyed table kept by micro-batches.

Rows are spread over buckets by the hash of their key. A batch is folded to one patch a key, and only the buckets it touches
are written anew; a version is a small manifest that names each bucket's files, so a version is published whole or not at
all, readers keep theirs, and a batch that runs twice (after a lost driver or executor) gives the same version again. An empty
batch makes no version.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators import merge
from tidegrid.operators.merge import KEY, OP, PRESENT, SEQ


@dataclass
class Version:
    rev: int
    buckets: dict[str, int] = field(default_factory=dict)
    batch: int = -1
    floor: int = 0


class LiveTable:
    """`columns` is the DDL of the fields; root is a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str, columns: str, buckets: int = 16, keep: int = 64) -> None:
        self.spark, self.root, self.n, self.keep = spark, root.rstrip("/"), buckets, keep
        self.fields = T.StructType.fromDDL(columns)
        meta = [T.StructField(KEY, T.StringType()), T.StructField(SEQ, T.LongType()), T.StructField("__rev", T.LongType())]
        self.schema = T.StructType([*meta, *self.fields.fields])
        self.removed_schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("__rev", T.LongType())])

    # files

    def _path(self, *parts: object):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write_text(self, text: str, *parts: object) -> None:
        """Through a temporary name, so that a reader never sees half of it."""
        half, fs = self._path(*parts[:-1], f"_{parts[-1]}.tmp")
        out = fs.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        whole, _ = self._path(*parts)
        fs.delete(whole, False)
        fs.rename(half, whole)

    def _read_text(self, *parts: object) -> str:
        p, fs = self._path(*parts)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        p, fs = self._path("manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName()[0].isdigit())

    def version(self, rev: int | None = None) -> Version:
        known = self.versions()
        if rev is None:
            rev = known[-1] if known else 0
        return Version(**json.loads(self._read_text("manifest", f"{rev}.json"))) if rev in known else Version(0)

    @property
    def rev(self) -> int:
        return self.version().rev

    # reading

    def read(self, rev: int | None = None) -> DataFrame:
        """The table as of a version (the latest, if none is named)."""
        v = self.version(rev)
        paths = [f"{self.root}/state/bucket={b}/rev={r}" for b, r in v.buckets.items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def changed_since(self, rev: int) -> tuple[DataFrame, DataFrame, bool]:
        """(rows written after a version, keys removed since and not back, whether the reader must start anew)."""
        v = self.version()
        if rev < v.floor:
            return self.read(), self.spark.createDataFrame([], self.removed_schema), True
        now = self.read()
        later = [r for r in self.versions() if r > rev]
        logs = [f"{self.root}/removed/rev={r}" for r in later if self._exists("removed", f"rev={r}")]
        gone = self.spark.read.schema(self.removed_schema).parquet(*logs) if logs else self.spark.createDataFrame([], self.removed_schema)
        gone = gone.groupBy(KEY).agg(F.max("__rev").alias("__rev")).join(now.select(KEY), KEY, "left_anti")
        return now.where(F.col("__rev") > rev), gone, False

    def _exists(self, *parts: object) -> bool:
        p, fs = self._path(*parts)
        return fs.exists(p)

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(KEY), F.lit(self.n)).cast("int")

    def apply(self, messages: DataFrame, batch: int | None = None) -> int:
        """Merge a batch (__key, __seq, __op, __present, fields); rows without a key are left out. The new version's number."""
        before = self.version()
        if batch is not None and batch <= before.batch:
            return before.rev
        named = self.fields.fieldNames()
        patch = merge.fold_messages(messages.where(F.col(KEY).isNotNull()), named).withColumn("bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in patch.select("bucket").distinct().collect())
            if not touched:
                return before.rev
            rev = before.rev + 1
            old = self._buckets(before, touched)
            merged = merge.apply_patch(old.select(KEY, SEQ, *named), patch, named)
            # a row is of this version if the batch had its key; others keep theirs
            stamped = merged.join(patch.select(KEY, F.lit(rev).cast("long").alias("__new")), KEY, "left").join(old.select(KEY, F.col("__rev").alias("__old")), KEY, "left")
            state = stamped.select(KEY, SEQ, F.coalesce("__new", "__old").alias("__rev"), *named)
            self._store(state, before, touched, rev)
            gone = patch.where(F.col(OP) == "delete").join(old.select(KEY), KEY, "left_semi").select(KEY, F.lit(rev).cast("long").alias("__rev"))
            gone.write.mode("overwrite").parquet(f"{self.root}/removed/rev={rev}")
            self._publish(Version(rev, before.buckets | {str(b): rev for b in touched}, before.batch if batch is None else batch, before.floor))
            return rev
        finally:
            patch.unpersist()

    def _buckets(self, v: Version, which: Sequence[int]) -> DataFrame:
        paths = [f"{self.root}/state/bucket={b}/rev={v.buckets[str(b)]}" for b in which if str(b) in v.buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _store(self, state: DataFrame, before: Version, touched: Sequence[int], rev: int) -> None:
        """All touched buckets in one job, then each moved to its place."""
        stage = f"{self.root}/stage/rev={rev}"
        state.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
        for b in touched:
            src, fs = self._path("stage", f"rev={rev}", f"bucket={b}")
            dst, _ = self._path("state", f"bucket={b}", f"rev={rev}")
            fs.delete(dst, True)
            if fs.exists(src):
                fs.mkdirs(dst.getParent())
                fs.rename(src, dst)
            else:  # no row is left in it
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(dst.toString())
        src, fs = self._path("stage", f"rev={rev}")
        fs.delete(src, True)

    def _publish(self, v: Version) -> None:
        known = self.versions()
        old = known[: max(0, len(known) + 1 - self.keep)]
        v.floor = max(v.floor, old[-1] if old else 0)
        self._write_text(json.dumps(v.__dict__), "manifest", f"{v.rev}.json")
        for r in old:
            for parts in (("manifest", f"{r}.json"), ("removed", f"rev={r}")):
                p, fs = self._path(*parts)
                fs.delete(p, True)
        if old:
            self._drop_unnamed()

    def _drop_unnamed(self) -> None:
        """Files of buckets that no kept version names."""
        named = {(b, r) for rev in self.versions() for b, r in self.version(rev).buckets.items()}
        for b in range(self.n):
            p, fs = self._path("state", f"bucket={b}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if (str(b), int(s.getPath().getName().split("=")[1])) not in named:
                    fs.delete(s.getPath(), True)

    def replace(self, snapshot: DataFrame, expected: int | None = None) -> int:
        """The whole table anew, as one version: keys that stay are never among the removed.

        A snapshot of another size than declared is refused, and the table stays as it was.
        """
        if expected is not None and (n := snapshot.count()) != expected:
            raise ValueError(f"a snapshot of {n} rows, {expected} declared")
        before, rev = self.version(), self.rev + 1
        old = self.read()
        named = self.fields.fieldNames()
        state = snapshot.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.max_by(F.struct(SEQ, *named), SEQ).alias("r"))
        state = state.select(KEY, F.col(f"r.{SEQ}").alias(SEQ), F.lit(rev).cast("long").alias("__rev"), *[F.col(f"r.`{c}`").alias(c) for c in named])
        gone = old.select(KEY).join(state.select(KEY), KEY, "left_anti").select(KEY, F.lit(rev).cast("long").alias("__rev"))
        self._store(state, before, range(self.n), rev)
        gone.write.mode("overwrite").parquet(f"{self.root}/removed/rev={rev}")
        self._publish(Version(rev, {str(b): rev for b in range(self.n)}, before.batch, before.floor))
        return rev

    def truncate(self) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema).select(KEY, SEQ, *self.fields.fieldNames()))

    def follow(self, stream: DataFrame, checkpoint: str, after=None, trigger: Mapping | None = None):  # noqa: ANN001, ANN201
        """A streaming query that merges each micro-batch; `after(rev)` is called when a batch made a version."""

        def batch(df: DataFrame, number: int) -> None:
            before = self.rev
            rev = self.apply(df, number)
            if after is not None and rev != before:
                after(rev)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def as_messages(df: DataFrame, key: Sequence[str], seq: Column, op: str | None = None, ops: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages for a LiveTable, rows set aside: without a key, or of an unknown operation)."""
    marked = df.withColumns({KEY: merge.row_key(key), SEQ: seq.cast("long"), OP: merge.operation(op, ops)})
    if PRESENT not in df.columns:
        marked = marked.withColumn(PRESENT, F.lit(None).cast("array<string>"))
    marked = marked.drop(op) if op else marked
    good = F.col(KEY).isNotNull() & F.col(OP).isNotNull()
    return marked.where(good), marked.where(~good)
