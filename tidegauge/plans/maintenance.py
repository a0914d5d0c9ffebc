"""Maintenance: rolling up again what is late or asked for, expiry, copies and their check, export files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.granularity import LADDER, Granularity, snap
from ..operators.ingest import TtlDays, unexpired
from ..operators.rollups import KEYS, SERIES, compute, ladder

#: Folders that annotations are spread over by a hash of their tenant.
ROUTES = 64
#: Fixed value: late points that a backfill puts up with.
MOST_LATE = 10


def reroll_late(stored: DataFrame, points: DataFrame, late: DataFrame, g: Granularity, kind: str = "BF_BASIC") -> DataFrame:
    """Stored buckets, with those that late points touch computed again from all points."""
    touched = late.select(*SERIES, snap(F.col("ts_ms"), g).alias("bucket_ms")).distinct()
    hit = points.withColumn("bucket_ms", snap(F.col("ts_ms"), g)).join(touched, KEYS, "left_semi").drop("bucket_ms")
    new = compute(kind, hit, g, True)
    return stored.join(touched, KEYS, "left_anti").unionByName(new)


def reroll_series(points: DataFrame, start: int, stop: int, kind: str = "BF_BASIC") -> dict[str, DataFrame]:
    """All levels of a range, whole buckets of the coarsest level wide."""
    top = LADDER[-1].ms
    return ladder(points.where((F.col("ts_ms") >= start - start % top) & (F.col("ts_ms") < stop - stop % top + top)), kind)


def reroll_shards(points: DataFrame, shards: list[int], start: int, stop: int) -> dict[str, DataFrame]:
    from ..functions.scalars import locator, shard

    return reroll_series(points.where(shard(locator(F.col("tenant_id"), F.col("metric"))).isin(shards)), start, stop)


def vacuum(levels: dict[str, DataFrame], now_ms: int, days: TtlDays | None = None, kind: str = "BF_BASIC", forced: int | None = None) -> dict[str, DataFrame]:
    return {k: unexpired(df, now_ms, k, days, "ts_ms" if k == "full" else "bucket_ms", kind, forced) for k, df in levels.items()}


def _route(tenant: Column) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(ROUTES))


def write_events(events: DataFrame, root: str) -> None:
    """Appends annotations, each to its tenant's route; a route's rows are spread over tasks by day, so that a large tenant is not one task's."""
    day = F.to_date(F.timestamp_millis("when"))
    routed = events.withColumn("route", _route(F.col("tenant_id")))
    routed.repartition("route", day).sortWithinPartitions("route", "tenant_id", "when").write.mode("append").partitionBy("route").parquet(root)


def read_events(spark: SparkSession, root: str, tenant: str) -> DataFrame:
    """A tenant's annotations: its route is the only one read."""
    return spark.read.parquet(root).where((F.col("route") == _route(F.lit(tenant))) & (F.col("tenant_id") == tenant)).drop("route")


def write_level(df: DataFrame, root: str, g: Granularity) -> None:
    """Overwrites the days that ``df`` holds, and no others; ``df`` must hold those days whole."""
    day = F.to_date(F.timestamp_millis("bucket_ms"))
    df.withColumn("day", day).repartition("day").sortWithinPartitions(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/{g.short}")


def read_stored(spark: SparkSession, root: str, g: Granularity, start: int, stop: int) -> DataFrame:
    """A range of a level: days are pruned, the rest is pushed to the scan."""
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    df = spark.read.parquet(f"{root}/{g.short}")
    return df.where(F.col("day").between(day(start - start % g.ms), day(stop)) & F.col("bucket_ms").between(start - start % g.ms, stop)).drop("day")


def copy_differences(source: DataFrame, copy: DataFrame, share: float | None = None, seed: int = 1) -> DataFrame:
    """Rows that one side has and the other not, of all series or of a share of them chosen by a hash of the series."""
    if share is not None:
        pick = F.pmod(F.xxhash64(*SERIES, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
        source, copy = source.where(pick), copy.where(pick)
    lost = source.exceptAll(copy).withColumn("side", F.lit("source"))
    return lost.unionByName(copy.exceptAll(source).withColumn("side", F.lit("copy")))


def export_json(events: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Newline JSON, gzipped, a bounded number of lines in each file."""
    events.select(F.col("json").alias("value")).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def backfill(points: DataFrame, g: Granularity, newest_ms: int, open_buckets: int = 3, done_ms: int | None = None, most_late: int = MOST_LATE) -> tuple[DataFrame, DataFrame]:
    """(rollups of buckets that are closed, points of those still open): the newest buckets stay open for late points.

    Points before ``done_ms`` belong to buckets that an earlier call closed. A few such are left out; more than ``most_late`` are an error.
    """
    if done_ms is not None:
        if points.where(F.col("ts_ms") < done_ms).limit(most_late + 1).count() > most_late:
            raise ValueError(f"more than {most_late} points are older than the buckets closed before")
        points = points.where(F.col("ts_ms") >= done_ms)
    closed = newest_ms - newest_ms % g.ms - (open_buckets - 1) * g.ms
    return compute("BF_BASIC", points.where(F.col("ts_ms") < closed), g, True), points.where(F.col("ts_ms") >= closed)
