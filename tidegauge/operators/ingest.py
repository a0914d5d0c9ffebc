"""Validation and admission of incoming metrics. Every operator takes the time it works at; none asks the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.granularity import LADDER
from ..sources.tables import EVENT

DAY = 86_400_000
# Limits of what is taken in.
PAST_MS, FUTURE_MS = 3 * DAY, 600_000
DELAY_MS = 300_000
MAX_TTL_S = 2**31 - 1
PER_MINUTE, PER_TENANT_MINUTE = 50_000, 500
TYPES = ("BF_BASIC", "COUNTER", "GAUGE", "SET", "TIMER")

#: Days by level, or by level and type.
TtlDays = dict[str | tuple[str, str], int]


def problem(now_ms: int) -> Column:
    """What is wrong with a parsed raw metric, null if nothing: struct of source and message."""
    said = lambda source, message: F.struct(F.lit(source).alias("source"), F.lit(message).alias("message"))
    return (
        F.when(F.coalesce(F.trim("metricName"), F.lit("")) == "", said("metricName", "may not be empty"))
        .when(F.col("metricValue").try_cast("double").isNull(), said("metricValue", "invalid value"))
        .when(F.col("ttlInSeconds").isNull() | ~F.col("ttlInSeconds").between(1, MAX_TTL_S), said("ttlInSeconds", f"must be between 1 and {MAX_TTL_S}"))
        .when(F.col("collectionTime").isNull() | (F.col("collectionTime") < now_ms - PAST_MS), said("collectionTime", "too far in the past"))
        .when(F.col("collectionTime") > now_ms + FUTURE_MS, said("collectionTime", "too far in the future"))
    )


def validate(parsed: DataFrame, now_ms: int, forced_ttl_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); items without a value are neither. Rejected rows say why."""
    if forced_ttl_s is not None:
        parsed = parsed.withColumn("ttlInSeconds", F.lit(forced_ttl_s).cast("long"))
    judged = parsed.where("metricValue is not null").withColumn("_p", problem(now_ms))
    rejected = judged.where("_p is not null").select(F.col("tenantId").alias("tenant_id"), F.col("collectionTime").alias("ts_ms"), F.col("metricName").alias("metric"), "_p.source", "_p.message")
    return judged.where("_p is null").drop("_p"), rejected


def status(valid: int, rejected: int) -> int:
    """200 if all is well, 207 if some, 400 if nothing is."""
    return 200 if not rejected else 207 if valid else 400


def bundle_problem(now_ms: int) -> Column:
    empty = lambda c: F.coalesce(F.size(c), F.lit(-1)) <= 0
    return (
        F.when(F.coalesce("tenantId", F.lit("")) == "", "tenantId may not be empty")
        .when(F.col("timestamp").isNull() | ~F.col("timestamp").between(now_ms - PAST_MS, now_ms + FUTURE_MS), "timestamp out of bounds")
        .when(F.coalesce("flushInterval", F.lit(0)) < 0, "flushInterval must not be negative")
        .when(empty("gauges") & empty("counters") & empty("timers") & empty("sets"), "at least one of gauges, counters, timers, sets is needed")
    )


def delay_class(now_ms: int, short_ms: int = DELAY_MS, long_ms: int = 3_600_000) -> Column:
    delay = F.lit(now_ms) - F.col("ts_ms")
    return F.when(delay <= short_ms, "on-time").when(delay <= long_ms, "short-delay").otherwise("long-delay")


def is_delayed(now_ms: int, ts: str = "ts_ms") -> Column:
    return F.lit(now_ms) - F.col(ts) > DELAY_MS


def split_bundles(bundles: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): each bundle of a payload is judged by itself. Rejected rows say why."""
    judged = bundles.withColumn("_p", bundle_problem(now_ms))
    rejected = judged.where("_p is not null").select(F.col("tenantId").alias("tenant_id"), F.col("timestamp").alias("ts_ms"), F.col("_p").alias("message"))
    return judged.where("_p is null").drop("_p"), rejected


def ttl_of(gran: str, kind: str = "BF_BASIC", days: TtlDays | None = None, forced: int | None = None) -> int:
    """Days that a level of a type is kept: raw points those forced; else those configured for (level, type), else for the level, else the table's.

    Counters have no configured days of their own type.
    """
    if gran == "full" and forced is not None:
        return forced
    typed = (days or {}).get((gran, kind)) if kind != "COUNTER" else None
    return typed or (days or {}).get(gran) or next(g.ttl_days for g in LADDER if g.short == gran)


def unexpired(df: DataFrame, now_ms: int, gran: str, days: TtlDays | None = None, ts: str = "bucket_ms", kind: str = "BF_BASIC", forced: int | None = None) -> DataFrame:
    """Rows not older than their days. Where rows have a ``rollup_type`` each goes by its own (null: by ``kind``); a bound that all share reaches the scan."""
    cut = lambda k: now_ms - ttl_of(gran, k, days, forced) * DAY
    if "rollup_type" not in df.columns:
        return df.where(F.col(ts) >= cut(kind))
    cuts = F.create_map(*[F.lit(x) for k in TYPES for x in (k, cut(k))])
    mine = F.coalesce(F.try_element_at(cuts, F.coalesce("rollup_type", F.lit(kind))), F.lit(cut(kind)))
    return df.where((F.col(ts) >= min(cut(k) for k in {*TYPES, kind})) & (F.col(ts) >= mine))


def unit_changes(writes: DataFrame) -> DataFrame:
    """Writes whose unit differs from the series' unit before: tenant_id, metric, ts_ms, old_unit, new_unit."""
    w = W.partitionBy("tenant_id", "metric").orderBy("ts_ms", "unit")
    return writes.where("unit is not null").withColumn("old_unit", F.lag("unit").over(w)).where("old_unit <> unit").select("tenant_id", "metric", "ts_ms", "old_unit", F.col("unit").alias("new_unit"))


def upsert_metadata(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """Unit and type by series: the latest given ones; null never replaces a value."""
    new = writes.groupBy("tenant_id", "metric").agg(F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("ts_ms"))).alias("_u"), F.max_by("rollup_type", F.when(F.col("rollup_type").isNotNull(), F.col("ts_ms"))).alias("_t"))
    both = stored.join(new, ["tenant_id", "metric"], "full")
    return both.select("tenant_id", "metric", F.coalesce("_u", "unit").alias("unit"), F.coalesce("_t", "rollup_type").alias("rollup_type"))


def throttle(new: DataFrame, known: DataFrame, per_minute: int = PER_MINUTE, per_tenant: int = PER_TENANT_MINUTE) -> DataFrame:
    """Series not known yet that may be admitted: so many a minute for each tenant, and so many in all.

    Arrivals beyond a tenant's share go first, so that what is ranked over all tenants of a minute is bounded by them.
    """
    unseen = new.groupBy("tenant_id", "metric").agg(F.min("ts_ms").alias("ts_ms")).join(known.select("tenant_id", "metric"), ["tenant_id", "metric"], "left_anti")
    minute = unseen.withColumn("minute", F.floor(F.col("ts_ms") / 60_000))
    mine = W.partitionBy("tenant_id", "minute").orderBy("ts_ms", "metric")
    every = W.partitionBy("minute").orderBy("ts_ms", "tenant_id", "metric")
    some = minute.withColumn("_a", F.row_number().over(mine)).where(F.col("_a") <= per_tenant)
    return some.withColumn("_b", F.row_number().over(every)).where(F.col("_b") <= per_minute).drop("_a", "_b")


def valid_events(events: DataFrame) -> DataFrame:
    """Annotations with a time and something to say."""
    return events.where("when > 0 AND coalesce(what, '') <> ''")


def split_events(requests: DataFrame, column: str = "value", tenant: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of requests that hold one annotation each as JSON. The request's tenant is the annotation's.

    A body that is no single JSON object is rejected: none, several, an array, or text that cannot be parsed.
    """
    body = F.trim(F.col(column))
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(T.StructType.fromDDL(EVENT)), {"mode": "PERMISSIVE"})
    judged = requests.select(F.col(tenant).alias("tenant_id"), F.startswith(body, F.lit("{")).alias("_object"), one.alias("_e"))
    e = F.get("_e", 0)
    why = (
        F.when(~F.coalesce("_object", F.lit(False)) | F.col("_e").isNull() | (F.size("_e") == 0) | e.isNull(), "Invalid Data")
        .when(F.size("_e") > 1, "Only one event is allowed per request")
        .when(F.coalesce(e["what"], F.lit("")) == "", "what may not be empty")
        .when(F.coalesce(e["when"], F.lit(0)) <= 0, "when must be greater than or equal to 1")
    )
    judged = judged.withColumn("_p", why)
    valid = judged.where("_p is null").select("tenant_id", e["when"].alias("when"), e["what"].alias("what"), e["data"].alias("data"), e["tags"].alias("tags"))
    return valid, judged.where("_p is not null").select("tenant_id", F.col("_p").alias("message"))


def route(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(basic, pre-aggregated) writes by their rollup_type; without one a write is basic."""
    basic = F.coalesce("rollup_type", F.lit("BF_BASIC")) == "BF_BASIC"
    return writes.where(basic), writes.where(~basic)


def tracked(requests: DataFrame, tenants: list[str], metrics: list[str]) -> DataFrame:
    """Requests of tracked tenants that mention a tracked metric, or any if none is tracked."""
    hit = F.lit(not metrics)
    for m in metrics:
        hit = hit | F.contains("message", F.lit(m))
    return requests.where(F.col("tenant_id").isin(tenants) & hit)
