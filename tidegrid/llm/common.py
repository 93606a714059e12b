"""What the operators of this subpackage share: tables, folds, scratch tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegrid.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of a dataset folder; other columns, whatever their names, are left out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[F.col(f"`{c}`") for c in columns])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: Rows in a batch of texts that goes to Python: some megabytes, where the session's own 10,000 may be hundreds.
BATCH_ROWS = 1_000


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows; a worker gives its freed memory back when a task ends.

    The number of rows in a batch is a setting of the session, and is lowered there if it is larger.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Seconds between two times that saving scratch tables gives the driver's memory back.
RELIEVE_S = 10
_relieved = float("-inf")


def relieve(spark: SparkSession, every: float = 0) -> None:
    """Collect the driver's garbage and return what its Python and its JVM keep of freed memory to the system, once in `every` seconds.

    A job of hundreds of plans leaves garbage for which the JVM takes more heap instead of collecting it, and native memory (of
    compiled code, of a table's bytes on their way) that its C library keeps in an arena for each of some threads.
    """
    global _relieved
    if time.monotonic() - _relieved < every:
        return
    gc.collect()
    give_back()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    of = jvm.Class.forName
    kinds, values = new(jvm.Class, 4), new(jvm.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(name)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # a JVM without that command
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    _relieved = time.monotonic()


class Scratch:
    """Intermediate tables in the shared folder: written once, so that lineage ends there, and dropped when no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.options(**options).parquet(path)
        relieve(self.spark, RELIEVE_S)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)  # type: ignore[attr-defined]
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sampled(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows (all, if fewer), chosen by the key's hash: the same rows on each run, and without a sort."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int(most / n * (1 << 40)))
