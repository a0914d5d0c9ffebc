"""Shared helpers of the corpus operators: staging tables in the shared folder, memory of workers, and binding of values in expressions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset (tests) a local one is made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-stage-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is staged, bytes of rows that go to a worker at once: the executor and its worker both hold them.
SENT = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    While it is written its shuffle files are kept; nothing reads them afterwards, so they are deleted when the table is whole.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = dict([(CLEANUP, "true"), SENT])
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no pending plan reads any more."""
    spark, path = df.sparkSession, df._stage_path
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that a worker process keeps between tasks, by the operator that fills them.
KEPT: dict[str, dict] = {}


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def begin(operator: str) -> None:
    """A task of ``operator`` begins in this worker: tables of others are let go."""
    for name, kept in KEPT.items():
        if name != operator:
            kept.clear()


def give_back() -> None:
    """Memory that a task has freed goes back to the system; else a worker that is reused, or idle, holds as much as its largest task took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a function for mapInArrow whose worker holds nothing but its own operator's tables, and those only, when it is done."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def let(value, body):
    """Evaluate ``value`` once per row and bind it: lambda variables are never inlined, so no re-evaluation per element."""
    return F.element_at(F.transform(F.array(value), body), 1)
