"""Structured Streaming: points to closed five-minute rollups, and each batch up the ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.granularity import LADDER, MIN_5, Granularity
from ..operators.rollups import KEYS, compute


def windowed(points: DataFrame, lateness: str = "5 minutes", g: Granularity = MIN_5) -> DataFrame:
    """Tumbling windows over double points, final once the watermark has passed them. ``ts`` must be a timestamp."""
    w = F.window("ts", f"{g.ms // 60_000} minutes")
    out = points.withWatermark("ts", lateness).groupBy("tenant_id", "metric", w.alias("w")).agg(F.count("*").alias("count"), F.avg("v_double").alias("avg_double"), F.var_pop("v_double").alias("variance"), F.min("v_double").alias("min"), F.max("v_double").alias("max"), F.sum("v_double").alias("sum"))
    return out.select("tenant_id", "metric", F.unix_millis("w.start").alias("bucket_ms"), "count", F.lit(None).cast("long").alias("avg_long"), "avg_double", "variance", "min", "max", "sum")


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Run ``each`` for every batch of closed windows. A batch that is run again has the same number."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def roll_up_batch(root: str, raw_kind: str = "BF_BASIC") -> Callable[[DataFrame, int], None]:
    """A sink: writes a batch's rollups, then rolls up again every coarser bucket that they touch, level by level."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/5m/batch={number}")
        for g in LADDER[2:]:
            parent = F.col("bucket_ms") - F.pmod("bucket_ms", F.lit(g.ms))
            touched = batch.select("tenant_id", "metric", parent.alias("p")).distinct()
            children = read_level(spark, root, g.finer).withColumn("p", parent).join(touched, ["tenant_id", "metric", "p"], "left_semi").drop("p")
            compute(raw_kind, children, g, False).write.mode("overwrite").parquet(f"{root}/{g.short}/batch={number}")

    return each


def read_level(spark: SparkSession, root: str, g: Granularity) -> DataFrame:
    """The latest rollup of each bucket of a level."""
    newest = W.partitionBy(*KEYS).orderBy(F.desc("batch"))
    return spark.read.parquet(f"{root}/{g.short}").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")


class Emitter:
    """Listeners by event name; ``once`` listeners go after their first call. Fit for ``foreachBatch``."""

    def __init__(self):
        self.listeners: dict[str, list[tuple[Callable, bool]]] = {}

    def on(self, event: str, f: Callable) -> None:
        self.listeners.setdefault(event, []).append((f, False))

    def once(self, event: str, f: Callable) -> None:
        self.listeners.setdefault(event, []).append((f, True))

    def off(self, event: str, f: Callable | None = None) -> None:
        self.listeners[event] = [x for x in self.listeners.get(event, []) if f is not None and x[0] is not f]

    def emit(self, event: str, *args) -> int:
        some = list(self.listeners.get(event, []))
        self.listeners[event] = [x for x in some if not x[1]]
        for f, _ in some:
            f(*args)
        return len(some)
