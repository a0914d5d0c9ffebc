"""Sources: stored metric tables, JSON payloads, export files, and views of the driver's tables as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import locator, resolve_number, shard

RAW = "tenantId string, metricName string, metricValue string, collectionTime bigint, ttlInSeconds bigint, unit string"
NAMED = "array<struct<name:string,value:string>>"
BUNDLE = (
    f"tenantId string, timestamp bigint, flushInterval bigint, gauges {NAMED}, counters array<struct<name:string,value:string,rate:double>>, "
    "timers array<struct<name:string,count:bigint,rate:double,min:double,max:double,sum:double,avg:double,median:double,std:double,"
    "percentiles:map<string,struct<avg:double,max:double,sum:double>>,histogram:map<string,double>>>, sets array<struct<name:string,values:array<string>>>"
)
EVENT = "tenantId string, when bigint, what string, data string, tags string"
CHECK = "id string, timestamp bigint, accountId string, tenantId string, entityId string, checkId string, target string, checkType string, monitoringZoneId string, collectorId string, metrics map<string,map<string,string>>"


def read_points(spark: SparkSession, path: str, start: int, stop: int, locators: list[tuple[str, str]] | None = None) -> DataFrame:
    """Points within [start, stop] of some series; both filters reach the scan."""
    df = spark.read.parquet(path).where(F.col("ts_ms").between(start, stop))
    if locators is not None:
        df = df.where(F.col("tenant_id").isin(sorted({t for t, _ in locators})) & F.col("metric").isin(sorted({m for _, m in locators})))
        df = df.where(F.struct("tenant_id", "metric").isin([F.struct(F.lit(t), F.lit(m)) for t, m in locators])) if len(locators) > 1 else df
    return df


def dump_points(spark: SparkSession, path: str, tenant: str, metric: str, now_ms: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """One series in order of time: the last seven days if nothing else is asked for."""
    stop = now_ms if stop is None else stop
    start = stop - 7 * 86_400_000 if start is None else start
    return read_points(spark, path, start, stop, [(tenant, metric)]).orderBy("ts_ms")


def parse_raw(lines: DataFrame, tenant: str | None = None, column: str = "value") -> DataFrame:
    """JSON arrays (or single objects) of raw metrics, one payload a line. A given tenant overrides the items'."""
    one = F.from_json(column, T.ArrayType(T.StructType.fromDDL(RAW)))
    out = lines.select(F.explode_outer(one).alias("m")).select("m.*")
    return out.withColumn("tenantId", F.lit(tenant)) if tenant is not None else out


def raw_points(parsed: DataFrame) -> DataFrame:
    whole, real = resolve_number(F.col("metricValue"))
    return parsed.select(F.col("tenantId").alias("tenant_id"), F.col("metricName").alias("metric"), F.col("collectionTime").alias("ts_ms"), whole.alias("v_long"), real.alias("v_double"), F.col("ttlInSeconds").alias("ttl_s"), "unit")


def parse_bundles(lines: DataFrame, column: str = "value") -> DataFrame:
    """Aggregated bundles, one or an array of them a line."""
    return lines.select(F.explode_outer(F.from_json(column, T.ArrayType(T.StructType.fromDDL(BUNDLE)))).alias("b")).select("b.*")


def name_parts(name: Column) -> Column:
    """A bundle's names use // as well as dots for levels."""
    return F.array_join(F.split(name, r"//|\."), ".")


def bundle_gauges(b: DataFrame) -> DataFrame:
    whole, real = resolve_number(F.col("x.value"))
    rows = b.select(F.col("tenantId").alias("tenant_id"), F.col("timestamp").alias("ts_ms"), F.explode("gauges").alias("x"))
    return rows.select("tenant_id", name_parts(F.col("x.name")).alias("metric"), "ts_ms", whole.alias("v_long"), real.alias("v_double"))


def bundle_counters(b: DataFrame) -> DataFrame:
    """sample_count: the rate times the flush interval in seconds, or 1 without an interval."""
    rows = b.select(F.col("tenantId").alias("tenant_id"), F.col("timestamp").alias("bucket_ms"), F.coalesce("flushInterval", F.lit(0)).alias("flush"), F.explode("counters").alias("x"))
    samples = F.when(F.col("flush") <= 0, F.lit(1)).otherwise(F.floor(F.col("x.rate") * F.col("flush") / 1000)).cast("long")
    return rows.select("tenant_id", name_parts(F.col("x.name")).alias("metric"), "bucket_ms", F.col("x.value").cast("double").alias("count"), F.col("x.rate").alias("rate"), samples.alias("sample_count"))


def bundle_timers(b: DataFrame) -> DataFrame:
    """Variance is the squared deviation; of a percentile only the mean is kept; medians and histograms are not stored."""
    rows = b.select(F.col("tenantId").alias("tenant_id"), F.col("timestamp").alias("bucket_ms"), F.explode("timers").alias("x"))
    spread = F.coalesce(F.col("x.std") * F.col("x.std"), F.lit(0.0))
    return rows.select(
        "tenant_id", name_parts(F.col("x.name")).alias("metric"), "bucket_ms", F.col("x.sum").alias("sum"), F.col("x.count").alias("count"), F.col("x.rate").alias("rate"), F.lit(1).cast("long").alias("sample_count"),
        F.lit(None).cast("long").alias("avg_long"), F.col("x.avg").alias("avg_double"), spread.alias("variance"), F.col("x.min").alias("min"), F.col("x.max").alias("max"), F.transform_values("x.percentiles", lambda k, v: v["avg"]).alias("percentiles"),
    )


def bundle_sets(b: DataFrame) -> DataFrame:
    rows = b.select(F.col("tenantId").alias("tenant_id"), F.col("timestamp").alias("ts_ms"), F.explode("sets").alias("x"))
    return rows.select("tenant_id", name_parts(F.col("x.name")).alias("metric"), "ts_ms", F.explode("x.values").alias("value"))


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Export files: newline JSON, gzipped or not, of check records; one row for each numeric metric."""
    return check_points(spark.read.schema(CHECK).json(path))


def check_points(checks: DataFrame) -> DataFrame:
    """metrics: name -> {typed value}; the type sign comes first ('L', 'l', 'I', 'i': whole; 'n': double); text is skipped."""
    ok = checks.where("timestamp > 0 AND tenantId is not null AND entityId is not null AND checkId is not null")
    rows = ok.select("tenantId", "entityId", "checkId", "timestamp", F.explode("metrics").alias("group", "values")).select("*", F.explode("values").alias("kind", "text")).drop("values")
    metric = F.concat_ws(".", "entityId", "checkId", "group")
    return rows.where(F.col("kind").isin("L", "l", "I", "i", "n")).select(
        F.col("tenantId").alias("tenant_id"), metric.alias("metric"), F.col("timestamp").alias("ts_ms"),
        F.when(F.col("kind") != "n", F.col("text").try_cast("bigint")).alias("v_long"), F.when(F.col("kind") == "n", F.col("text").try_cast("double")).alias("v_double"),
    )


def synthetic_points(spark: SparkSession, n: int, step_ms: int = 30_000, start_ms: int = 0, tenant: str = "demo", metric: str = "demo.points") -> DataFrame:
    return spark.range(1, n + 1).select(F.lit(tenant).alias("tenant_id"), F.lit(metric).alias("metric"), (F.lit(start_ms) + (F.col("id") - 1) * step_ms).alias("ts_ms"), F.col("id").alias("v_long"), F.lit(None).cast("double").alias("v_double"))


def locators_of(points: DataFrame) -> DataFrame:
    """(shard, locator): register of series."""
    return points.select("tenant_id", "metric").distinct().select("tenant_id", "metric", shard(locator(F.col("tenant_id"), F.col("metric"))).alias("shard"))


def new_locators(points: DataFrame, known: DataFrame) -> DataFrame:
    return locators_of(points).join(known.select("tenant_id", "metric"), ["tenant_id", "metric"], "left_anti")


# --- the driver's tables as metrics ---------------------------------------------------------------------------------

def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


#: Where a row stands in a stored table.
PLACE = ["stored_file", "stored_row"]


def _place() -> list[Column]:
    return [F.col(f"_metadata.{k}").alias(v) for k, v in zip(("file_path", "row_index"), PLACE, strict=True)]


def event_points(spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None, placed: bool = False) -> DataFrame:
    """All events, or those of a range of milliseconds (both ends included), for which the scan prunes row groups by ``ts``; with their PLACE if asked for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda ms: F.timestamp_millis(F.lit(ms)).cast(e.schema["ts"].dataType)
    if from_ms is not None:
        e = e.where(F.col("ts") >= at(from_ms))
    if to_ms is not None:
        e = e.where(F.col("ts") < at(to_ms + 1))
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), F.concat(F.lit("app."), "event_type").alias("metric"), _ms("ts").alias("ts_ms"), F.lit(None).cast("long").alias("v_long"), F.col("value").alias("v_double"), *(_place() if placed else []))


def shipment_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series with many writes at one time. A part of the name that is null makes the name null; quantities are rounded to the nearest whole number, halves to the even one."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("tenant_id"), F.concat(F.lit("qty."), "l_returnflag", F.lit("."), "l_linestatus").alias("metric"), _ms("l_shipdate").alias("ts_ms"),
        F.rint("l_quantity").cast("long").alias("v_long"), F.lit(None).cast("double").alias("v_double"), "l_orderkey", "l_linenumber", *_place(),
    )


def shipment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each time; of writes with equal keys the first in the table, which is what the SQL takes on small tables (on large ones it takes any)."""
    from ..operators.rollups import latest_write

    keys = ["l_orderkey", "l_linenumber"]
    return latest_write(shipment_writes(spark, sf_dir), [*[F.desc(k) for k in keys], *[F.asc(k) for k in PLACE]]).drop(*keys, *PLACE)


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series with several points in a day: cents of an order's price, spread over the day by its key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("o"), F.col("o_custkey") % 2).alias("tenant_id"), F.concat(F.lit("price."), "o_orderstatus").alias("metric"), (_ms("o_orderdate") + F.pmod(F.col("o_orderkey") * 7919, F.lit(86_400)) * 1000).alias("ts_ms"), F.col("o_totalprice").cast("long").alias("v_long"), F.lit(None).cast("double").alias("v_double"), "o_orderkey")


def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier"))
    name = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"))
    full = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return full.select(F.lit("acme").alias("tenant_id"), F.concat_ws(".", name("r_name"), name("n_name"), name("s_name")).alias("metric"), F.when(F.col("s_suppkey") % 3 == 0, "ms").alias("unit"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), _ms("ts").alias("when"), F.concat(F.lit("event "), "event_id").alias("what"), F.col("props").alias("data"), F.col("event_type").alias("tags"))


