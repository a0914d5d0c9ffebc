"""Reading: ranges of points by resolution or number of points, repair of what is not rolled up yet, and what is shown of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.granularity import FULL, Granularity, by_resolution, select, snap_ms
from ..operators.rollups import KEYS, SERIES, average, compute
from ..operators.search import with_units

MAX_METRICS = 100

#: What is shown by type if nothing is asked for.
DEFAULTS = {"BF_BASIC": ["average", "numPoints", "sum"], "COUNTER": ["numPoints", "sum"], "GAUGE": ["numPoints", "latest"], "SET": ["numPoints"], "TIMER": ["rate", "numPoints", "average"], "RAW": ["average", "numPoints"]}


def _columns(kind: str) -> dict[str, Column]:
    c = F.col
    if kind == "RAW":
        v = F.coalesce(c("v_double"), c("v_long").cast("double"))
        return {"average": v, "variance": F.lit(0.0), "min": v, "max": v, "numPoints": F.lit(1).cast("long"), "latest": v, "rate": v, "sum": v, "percentiles": v}
    base = {"average": average(), "variance": c("variance"), "min": c("min"), "max": c("max"), "numPoints": c("count")}
    latest = F.coalesce(c("latest.v_double"), c("latest.v_long").cast("double")) if kind == "GAUGE" else None
    return {
        "BF_BASIC": base | {"sum": c("sum")} if kind == "BF_BASIC" else {},
        "GAUGE": {"numPoints": c("count"), "latest": latest},
        "COUNTER": {"numPoints": c("sample_count"), "rate": c("rate"), "sum": c("count")},
        "TIMER": base | {"rate": c("rate"), "sum": c("sum"), "percentiles": c("percentiles")},
        "SET": {"numPoints": c("count")},
    }[kind]


def show(df: DataFrame, kind: str, stats: list[str] | str | None = None, time: str = "bucket_ms") -> DataFrame:
    """The statistics asked for (a list, or commas); what a type has not is left out, as are unknown names. A bucket of no points has nulls."""
    asked = [s.strip() for s in stats.split(",")] if isinstance(stats, str) else list(stats or DEFAULTS[kind])
    have = _columns(kind)
    n = have["numPoints"]
    shown = {s: have[s] if s == "numPoints" else F.when(n != 0, have[s]) for s in dict.fromkeys(asked) if s in have}
    return df.select(*SERIES, F.col(time).alias("timestamp"), *[v.alias(k) for k, v in shown.items()])


def read_range(rollups: DataFrame, g: Granularity, start: int, stop: int) -> DataFrame:
    time = "ts_ms" if g is FULL else "bucket_ms"
    return rollups.where(F.col(time).between(snap_ms(start, g), stop))


def repair(stored: DataFrame, points: DataFrame, g: Granularity, start: int, stop: int, kind: str = "BF_BASIC", now_ms: int | None = None) -> DataFrame:
    """Stored buckets of [snap(start), stop] with those computed from raw points that lie outside what is stored.

    With nothing stored all buckets are computed. Otherwise buckets up to the first stored one are (it is replaced), if that lies after
    the start, and those behind the last stored one, if it ends before the stop. Holes within stay as they are.
    """
    first = snap_ms(start, g)
    kept = read_range(stored, g, start, stop)
    last = stop if now_ms is None else min(stop, now_ms)
    raw = points.where((F.col("ts_ms") >= first) & (F.col("ts_ms") < snap_ms(last, g) + g.ms))
    computed = compute(kind, raw if now_ms is None else raw.where(F.col("ts_ms") <= now_ms), g, True)
    edges = kept.groupBy(*SERIES).agg(F.min("bucket_ms").alias("lo"), F.max("bucket_ms").alias("hi"))
    lo, hi, b = F.col("lo"), F.col("hi"), F.col("bucket_ms")
    wanted = lo.isNull() | ((lo > start) & (b <= lo)) | ((hi + g.ms < stop) & (b >= hi + g.ms))
    new = computed.join(edges, SERIES, "left").where(wanted).drop("lo", "hi")
    return kept.join(new.select(*KEYS), KEYS, "left_anti").unionByName(new)


def query(stored: dict[str, DataFrame], points: DataFrame, metadata: DataFrame, tenant: str, metrics: list[str], start: int, stop: int, points_wanted: int | None = None, resolution: str | None = None, stats: list[str] | str | None = None, algorithm: str = "GEOMETRIC", now_ms: int | None = None, kind: str = "BF_BASIC") -> DataFrame:
    """Points of up to 100 metrics of a tenant, by resolution or by a number of points, repaired, with units, in order of time."""
    if len(metrics) > MAX_METRICS:
        raise ValueError(f"at most {MAX_METRICS} metrics a request")
    g = select(start, stop, points_wanted, algorithm, now_ms) if points_wanted is not None else by_resolution(resolution)
    mine = lambda df: df.where((F.col("tenant_id") == tenant) & F.col("metric").isin(metrics))
    if g is FULL:
        out = show(mine(points).where(F.col("ts_ms").between(start, stop)), "RAW", stats, "ts_ms")
    else:
        out = show(repair(mine(stored[g.short]), mine(points), g, start, stop, kind, now_ms), kind, stats)
    return with_units(out, metadata).orderBy(*SERIES, "timestamp")


def by_type(basic: DataFrame, preaggregated: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows from the basic or the pre-aggregated table as the series' registered type says; an unknown series is basic."""
    kinds = metadata.select(*SERIES, "rollup_type")
    pre = preaggregated.join(kinds, SERIES, "left").where("coalesce(rollup_type, 'BF_BASIC') <> 'BF_BASIC'")
    return basic.join(kinds, SERIES, "left").where("coalesce(rollup_type, 'BF_BASIC') = 'BF_BASIC'").unionByName(pre, allowMissingColumns=True)


def series_json(shown: DataFrame) -> DataFrame:
    """One JSON document for each series: values in order of time, unit and metadata."""
    stats = [c for c in shown.columns if c not in (*SERIES, "timestamp", "unit")]
    values = F.array_sort(F.collect_list(F.struct("timestamp", *stats)))
    out = shown.groupBy(*SERIES, "unit").agg(values.alias("values"))
    meta = F.struct(F.size("values").alias("count"), F.lit(None).cast("string").alias("limit"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("string").alias("next_href"))
    return out.select(*SERIES, F.to_json(F.struct("values", meta.alias("metadata"), "unit")).alias("json"))


def batch_json(shown: DataFrame) -> DataFrame:
    """One document for all series of a request (at most 100)."""
    stats = [c for c in shown.columns if c not in (*SERIES, "timestamp", "unit")]
    each = shown.groupBy(*SERIES, "unit").agg(F.array_sort(F.collect_list(F.struct("timestamp", *stats))).alias("data"))
    metric = F.struct("metric", "unit", F.lit("number").alias("type"), "data")
    return each.groupBy("tenant_id").agg(F.array_sort(F.collect_list(metric)).alias("metrics")).select("tenant_id", F.to_json(F.struct("metrics")).alias("json"))


def _number(whole: Column, real: Column) -> Column:
    """A long as a whole number, else a double: JSON keeps the difference."""
    return F.coalesce(whole.cast("variant"), real.cast("variant"))


def rollup_body(kind: str, columns: list[str]) -> Column:
    """What a listener is told of a rollup, by type. Statistics of no points are null."""
    c = F.col
    some = lambda x: F.when(c("count") != 0, x)
    long_of = lambda k: c(f"{k}_long") if f"{k}_long" in columns else F.lit(None).cast("long")
    if kind == "SET":
        return F.struct("count")
    if kind == "COUNTER":
        return F.struct("count", c("sample_count").alias("sampleCount"), "rate")
    base = [c("count"), *[some(_number(long_of(k), c(k))).alias(k) for k in ("max", "min")], some(_number(c("avg_long"), c("avg_double"))).alias("mean"), some(c("variance")).alias("var")]
    if kind == "TIMER":
        return F.struct("sum", "rate", c("sample_count").alias("sampleCount"), *base)
    if kind == "GAUGE":
        return F.struct(_number(c("latest.v_long"), c("latest.v_double")).alias("latestVal"), *base)
    return F.struct(*base, some(c("sum")).alias("sum"))


def rollup_event_json(rollups: DataFrame, g: Granularity, metadata: DataFrame, kind: str = "BF_BASIC") -> DataFrame:
    """One JSON line for each rollup of a type, for listeners and export files."""
    rows = with_units(rollups, metadata)
    line = F.struct(F.col("tenant_id").alias("tenantId"), F.col("metric").alias("metricName"), F.lit(g.short).alias("gran"), rollup_body(kind, rollups.columns).alias("rollup"), F.col("bucket_ms").alias("timestamp"), F.struct(F.lit(kind).alias("type"), "unit").alias("metadata"))
    return rows.select(*KEYS, F.to_json(line, {"ignoreNullFields": "false"}).alias("json"))


def search_json(found: DataFrame) -> DataFrame:
    return found.select("metric", F.to_json(F.struct("metric", "unit")).alias("json"))


def names_json(names: DataFrame) -> DataFrame:
    return names.select("name", F.to_json(F.create_map("name", "is_complete")).alias("json"))
