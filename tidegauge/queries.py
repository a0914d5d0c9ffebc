"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import granularity as G
from .functions import scalars
from .functions.scalars import SHARDS, locator, metric_of, string_hash, tenant_of
from .operators import ingest, rollups, search
from .plans import maintenance, reading
from .sources import tables
from .streaming import flow, slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000
TIE = 1e-9
#: The events table spans January 2024.
T0 = 1_704_067_200_000
NOW = T0 + 20 * DAY


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c: Column | str, name: str | None = None) -> Column:
    """To four digits; ties are moved out of the way, since the two engines' sums differ in their last bits."""
    out = F.round((F.col(c) if isinstance(c, str) else c) + TIE, 4)
    return out.alias(name or c) if name or isinstance(c, str) else out


EV = "ev AS (SELECT 't' || (user_id % 8) AS tenant_id, 'app.' || event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, value AS v FROM events)"
LI_ALL = "li_all AS (SELECT 's' || (l_suppkey % 4) AS tenant_id, 'qty.' || l_returnflag || '.' || l_linestatus AS metric, epoch_us(l_shipdate) // 1000 AS ts_ms, CAST(l_quantity AS BIGINT) AS v, l_orderkey, l_linenumber FROM lineitem)"
LI = LI_ALL + ", li AS (SELECT * FROM li_all QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, ts_ms ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)"
PRICE = "price AS (SELECT 'o' || (o_custkey % 2) AS tenant_id, 'price.' || o_orderstatus AS metric, epoch_us(o_orderdate) // 1000 + ((o_orderkey * 7919) % 86400) * 1000 AS ts_ms, CAST(round_even(o_totalprice - 0.5, 0) AS BIGINT) AS v, o_orderkey FROM orders)"
PRICE = PRICE.replace("CAST(round_even(o_totalprice - 0.5, 0) AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)")
B = lambda ms, ts="ts_ms": f"({ts} - {ts} % {ms})"
STATS = "count(*) AS count, round(avg(v) + 1e-9, 4) AS average, round(var_pop(v) + 1e-9, 4) AS variance, round(min(v) + 1e-9, 4) AS min, round(max(v) + 1e-9, 4) AS max, round(sum(v) + 1e-9, 4) AS sum"
KEYED = "tenant_id, metric"
#: The carried-remainder mean as a fold over a list of longs.
FOLD = "list_reduce({0}, lambda s, x: {{'n': s.n + 1, 'a': s.a + ((x.a + s.r - s.a) // (s.n + 1)), 'r': (x.a + s.r - s.a) % (s.n + 1)}}, {{'n': 0::BIGINT, 'a': 0::BIGINT, 'r': 0::BIGINT}}).a"
ITEM = "{{'n': 0::BIGINT, 'a': {0}::BIGINT, 'r': 0::BIGINT}}"


def _kind() -> Column:
    return F.when(F.col("v_long").isNotNull(), "long").otherwise("double").alias("kind")


def shown(df: DataFrame) -> DataFrame:
    return df.select(*rollups.KEYS, "count", r(rollups.average(), "average"), r("variance"), r("min"), r("max"), r("sum"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_points(spark, d)


# --- scans, dedup, buckets --------------------------------------------------------------------------------------------

@query(f"WITH {EV} SELECT {KEYED}, ts_ms, round(v + 1e-9, 4) AS value FROM ev WHERE tenant_id = 't1' AND ts_ms BETWEEN {T0 + 2 * DAY} AND {T0 + 9 * DAY}")
def raw_range_scan(spark, d):
    p = tables.event_points(spark, d, T0 + 2 * DAY, T0 + 9 * DAY).where("tenant_id = 't1'")
    return p.select("tenant_id", "metric", "ts_ms", r("v_double", "value"))


_BIG = "big AS (SELECT 'b' || (o_custkey % 2) AS tenant_id, 'key.' || o_orderstatus AS metric, epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderkey + 1152921504606846976 AS v FROM orders)"


@query(f"WITH {_BIG} SELECT {KEYED}, {B(DAY)} AS bucket_ms, count(*) AS count, min(v) AS min_long, max(v) AS max_long FROM big GROUP BY ALL")
def long_extremes(spark, d):
    """Longs beyond 2^53 keep their digits, from raw points to the day."""
    out = rollups.basic_from_basic(rollups.basic_from_raw(_big_points(spark, d), G.MIN_240), G.MIN_1440)
    return out.select(*rollups.KEYS, "count", "min_long", "max_long")


def _big_points(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.concat(F.lit("b"), F.col("o_custkey") % 2).alias("tenant_id"), F.concat(F.lit("key."), "o_orderstatus").alias("metric"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), (F.col("o_orderkey") + F.lit(1 << 60)).alias("v_long"), F.lit(None).cast("double").alias("v_double"))


@query(f"WITH {LI} SELECT {KEYED}, ts_ms, v AS value FROM li")
def raw_dedup_lww(spark, d):
    return tables.shipment_points(spark, d).select("tenant_id", "metric", "ts_ms", F.col("v_long").alias("value"))


@query(f"WITH {EV} SELECT ts_ms, " + ", ".join(f"{B(g.ms)} AS b_{g.short}" for g in G.ROLLED) + " FROM ev")
def snap_buckets(spark, d):
    return ev(spark, d).select("ts_ms", *[G.snap(F.col("ts_ms"), g).alias(f"b_{g.short}") for g in G.ROLLED])


@query(f"WITH {EV} SELECT ts_ms, " + ", ".join(f"CAST({g.slots} * ((ts_ms % {G.CYCLE_MS}) // {G.SLOT_MS}) // {G.BASE_SLOTS} AS INT) AS s_{g.short}" for g in G.ROLLED) + " FROM ev")
def slot_numbers(spark, d):
    return ev(spark, d).select("ts_ms", *[G.slot(F.col("ts_ms"), g).alias(f"s_{g.short}") for g in G.ROLLED])


@query(f"WITH {EV}, s AS (SELECT DISTINCT {KEYED} FROM ev) SELECT {KEYED}, CAST(('0x' || substring(md5(tenant_id || '.' || metric), 31, 2)) AS INT) % {SHARDS} AS shard FROM s")
def shard_of_locator(spark, d):
    return tables.locators_of(ev(spark, d))


@query(f"WITH {EV}, a AS (SELECT DISTINCT {KEYED} FROM ev), k AS (SELECT DISTINCT {KEYED} FROM ev WHERE ts_ms < {T0 + DAY // 4}) SELECT {KEYED} FROM a ANTI JOIN k USING (tenant_id, metric)")
def locator_registration(spark, d):
    p = ev(spark, d)
    return tables.new_locators(p, tables.locators_of(p.where(F.col("ts_ms") < T0 + DAY // 4))).select("tenant_id", "metric")


# --- rollups ----------------------------------------------------------------------------------------------------------

def _level(g: G.Granularity):
    def f(spark, d):
        return shown(rollups.ladder(ev(spark, d), known_double=True, top=g)[g.short])

    f.__name__ = f"rollup_{g.short}_basic" if g is G.MIN_5 else f"rollup_{g.short}_from_{g.finer.short}"
    query(f"WITH {EV} SELECT {KEYED}, {B(g.ms)} AS bucket_ms, {STATS} FROM ev GROUP BY ALL")(f)


for _g in G.ROLLED:
    _level(_g)


@query(f"WITH {EV} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{g.short}' AS gran, count(*) AS points, count(DISTINCT (tenant_id, metric, {B(g.ms)})) AS buckets, round(sum(v), 2) AS total FROM ev" for g in G.ROLLED) + ")")
def ladder_counts_invariant(spark, d):
    out = None
    for k, df in rollups.ladder(ev(spark, d), known_double=True).items():
        row = df.agg(F.sum("count").alias("points"), F.count("*").alias("buckets"), F.round(F.sum("sum"), 2).alias("total")).select(F.lit(k).alias("gran"), "points", "buckets", "total")
        out = row if out is None else out.union(row)
    return out


INT_RAW = f"(SELECT {KEYED}, {B(14_400_000)} AS bucket_ms, count(*) AS count, {FOLD.format('list(' + ITEM.format('v') + ' ORDER BY ts_ms, v)')} AS avg_long, min(v) AS min, max(v) AS max, sum(v) AS sum, var_pop(v) AS variance FROM p GROUP BY ALL)"


@query(f"WITH {PRICE}, p AS (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, ts_ms ORDER BY o_orderkey DESC) = 1) SELECT {KEYED}, bucket_ms, count, avg_long, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max, CAST(sum AS DOUBLE) AS sum FROM {INT_RAW}")
def int_mean_rollup(spark, d):
    out = rollups.basic_from_raw(_prices(spark, d), G.MIN_240)
    return out.select(*rollups.KEYS, "count", "avg_long", "min", "max", "sum")


def _prices(spark, d):
    return rollups.latest_write(tables.order_points(spark, d), [F.desc("o_orderkey")]).drop("o_orderkey")


_CHILD = "flatten(list(list_transform(range(count), lambda i: " + ITEM.format("avg_long") + ") ORDER BY bucket_ms))"


@query(f"WITH {PRICE}, p AS (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, ts_ms ORDER BY o_orderkey DESC) = 1), c AS {INT_RAW} SELECT {KEYED}, {B(DAY, 'bucket_ms')} AS day_ms, CAST(sum(count) AS BIGINT) AS count, {FOLD.format(_CHILD)} AS avg_long FROM c GROUP BY tenant_id, metric, day_ms")
def int_mean_merge(spark, d):
    children = rollups.basic_from_raw(_prices(spark, d), G.MIN_240)
    return rollups.basic_from_basic(children, G.MIN_1440).select("tenant_id", "metric", F.col("bucket_ms").alias("day_ms"), "count", "avg_long")


@query(
    f"WITH {PRICE}, p AS (SELECT * FROM price QUALIFY row_number() OVER (PARTITION BY tenant_id, metric, ts_ms ORDER BY o_orderkey DESC) = 1), c AS {INT_RAW}, "
    f"g AS (SELECT *, {B(DAY, 'bucket_ms')} AS day_ms FROM c), m AS (SELECT {KEYED}, day_ms, sum(count) AS n, sum(count * avg_long) / sum(count) AS grand FROM g GROUP BY ALL) "
    "SELECT g.tenant_id, g.metric, g.day_ms, round(sum(g.count * (g.variance + (g.avg_long - m.grand) * (g.avg_long - m.grand))) / any_value(m.n), 1) AS variance FROM g JOIN m USING (tenant_id, metric, day_ms) GROUP BY ALL"
)
def var_merge(spark, d):
    children = rollups.basic_from_raw(_prices(spark, d), G.MIN_240)
    return rollups.basic_from_basic(children, G.MIN_1440).select("tenant_id", "metric", F.col("bucket_ms").alias("day_ms"), F.round("variance", 1).alias("variance"))


_RATE = "CASE WHEN max(ts_ms) = min(ts_ms) THEN CASE WHEN sum(v) > 0 THEN 'inf' WHEN sum(v) < 0 THEN '-inf' ELSE 'nan' END ELSE CAST(CAST(round(sum(v) * 1000000 / (max(ts_ms) - min(ts_ms)), 0) AS BIGINT) AS VARCHAR) END"


@query(f"WITH {LI} SELECT {KEYED}, {B(DAY * 14)} AS fortnight_ms, CAST(sum(v) AS DOUBLE) AS count, {_RATE} AS rate_e6, count(*) AS sample_count FROM li GROUP BY ALL")
def counter_from_raw(spark, d):
    p = tables.shipment_points(spark, d)
    g = G.Granularity("fortnight", "14d", DAY * 14, 1, 1)
    out = rollups.counter_from_raw(p, g)
    rate = F.when(F.col("rate") == float("inf"), "inf").when(F.col("rate") == float("-inf"), "-inf").when(F.isnan("rate"), "nan").otherwise(F.round(F.when(F.abs("rate") < 1e300, F.col("rate")) * 1_000_000, 0).cast("long").cast("string"))
    return out.select("tenant_id", "metric", F.col("bucket_ms").alias("fortnight_ms"), "count", rate.alias("rate_e6"), "sample_count")


CN = f"{EV}, cn AS (SELECT {KEYED}, {B(300_000)} AS b5, count(*) * 1.0 AS c, count(*) / 300.0 AS rate, count(*) AS n FROM ev GROUP BY ALL)"


def _counters(spark, d):
    p = rollups.bucketed(ev(spark, d), G.MIN_5).groupBy(*rollups.KEYS).agg(F.count("*").alias("n"))
    return p.select(*rollups.KEYS, F.col("n").cast("double").alias("count"), (F.col("n") / 300.0).alias("rate"), F.col("n").alias("sample_count"))


@query(f"WITH {CN} SELECT {KEYED}, {B(3_600_000, 'b5')} AS bucket_ms, CAST(sum(c) AS DOUBLE) AS count, round(CAST(sum(c) AS DOUBLE) / sum(CASE WHEN rate = 0 THEN 0 ELSE CAST(c AS DOUBLE) / rate END), 6) AS rate, CAST(sum(n) AS BIGINT) AS sample_count FROM cn GROUP BY ALL")
def counter_merge(spark, d):
    out = rollups.counter_from_counter(_counters(spark, d), G.MIN_60)
    return out.select(*rollups.KEYS, "count", F.round("rate", 6).alias("rate"), "sample_count")


def _gauges(spark, d, g):
    """Of events at one time the SQL takes the value of the first in the table."""
    return rollups.gauge_from_raw(tables.event_points(spark, d, placed=True), g, tables.PLACE)


@query(f"WITH {EV} SELECT {KEYED}, {B(3_600_000)} AS bucket_ms, count(*) AS count, round(avg(v) + 1e-9, 4) AS average, max(ts_ms) AS latest_ms, round(max_by(v, ts_ms) + 1e-9, 4) AS latest FROM ev GROUP BY ALL")
def gauge_latest(spark, d):
    out = _gauges(spark, d, G.MIN_60)
    return out.select(*rollups.KEYS, "count", r(rollups.average(), "average"), F.col("latest.ts_ms").alias("latest_ms"), r("latest.v_double", "latest"))


@query(f"WITH {EV} SELECT {KEYED}, {B(DAY)} AS bucket_ms, count(*) AS count, round(avg(v) + 1e-9, 4) AS average, round(var_pop(v) + 1e-9, 4) AS variance, round(max_by(v, ts_ms) + 1e-9, 4) AS latest FROM ev GROUP BY ALL")
def gauge_merge(spark, d):
    out = rollups.gauge_from_gauge(rollups.gauge_from_gauge(_gauges(spark, d, G.MIN_60), G.MIN_240), G.MIN_1440)
    return out.select(*rollups.KEYS, "count", r(rollups.average(), "average"), r("variance"), r("latest.v_double", "latest"))


USERS = "SELECT 't' || (user_id % 8) AS tenant_id, 'users.' || event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS VARCHAR) AS value FROM events"
HASH = "list_reduce(list_transform(string_split(value, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT)"


def _members(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), F.concat(F.lit("users."), "event_type").alias("metric"), tables._ms("ts").alias("ts_ms"), F.col("user_id").cast("string").alias("value"))


@query(f"WITH u AS ({USERS}) SELECT {KEYED}, {B(3_600_000)} AS bucket_ms, count(DISTINCT value) AS count FROM u GROUP BY ALL")
def set_cardinality(spark, d):
    return rollups.set_from_values(_members(spark, d), G.MIN_60).select(*rollups.KEYS, "count")


@query(f"WITH u AS ({USERS}), h AS (SELECT *, {HASH} AS x FROM u) SELECT {KEYED}, {B(DAY)} AS bucket_ms, count(DISTINCT x) AS count, CAST(sum(DISTINCT CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) AS BIGINT) AS hash_sum FROM h GROUP BY ALL")
def set_merge(spark, d):
    fine = rollups.set_from_values(_members(spark, d), G.MIN_60)
    out = rollups.set_from_set(rollups.set_from_set(fine, G.MIN_240), G.MIN_1440)
    return out.select(*rollups.KEYS, "count", F.aggregate("hashes", F.lit(0).cast("long"), lambda a, h: a + h).alias("hash_sum"))


@query(f"WITH u AS (SELECT DISTINCT value FROM ({USERS})), h AS (SELECT value, {HASH} AS x FROM u) SELECT value, CAST(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END AS INT) AS hash FROM h")
def member_hash(spark, d):
    return _members(spark, d).select("value").distinct().select("value", string_hash(F.col("value")).alias("hash"))


TM = f"{EV}, tm AS (SELECT {KEYED}, {B(3_600_000)} AS h, sum(v) AS s, count(*) AS n, count(*) / 3600.0 AS rate, avg(v) AS a, var_pop(v) AS va, min(v) AS mi, max(v) AS ma, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99 FROM ev GROUP BY ALL)"


def _timers(spark, d):
    p = rollups.bucketed(ev(spark, d), G.MIN_60)
    out = p.groupBy(*rollups.KEYS).agg(
        F.sum("v_double").alias("sum"), F.count("*").alias("count"), F.lit(1).cast("long").alias("sample_count"), F.lit(None).cast("long").alias("avg_long"), F.avg("v_double").alias("avg_double"), F.var_pop("v_double").alias("variance"), F.min("v_double").alias("min"), F.max("v_double").alias("max"),
        F.create_map(F.lit("50"), F.percentile("v_double", F.lit(0.5)), F.lit("99"), F.percentile("v_double", F.lit(0.99))).alias("percentiles"),
    )
    return out.withColumn("rate", F.col("count") / 3600.0)


@query(f"WITH {TM} SELECT {KEYED}, {B(14_400_000, 'h')} AS bucket_ms, round(sum(s) + 1e-9, 4) AS sum, CAST(sum(n) AS BIGINT) AS count, round(CAST(sum(n) AS DOUBLE) / sum(n / CAST(rate AS DOUBLE)), 6) AS rate, count(*) AS sample_count, round(sum(n * a) / sum(n) + 1e-9, 4) AS average, round(min(mi) + 1e-9, 4) AS min, round(max(ma) + 1e-9, 4) AS max FROM tm GROUP BY ALL")
def timer_merge(spark, d):
    out = rollups.timer_from_timer(_timers(spark, d), G.MIN_240)
    return out.select(*rollups.KEYS, r("sum"), "count", F.round("rate", 6).alias("rate"), "sample_count", r(rollups.average(), "average"), r("min"), r("max"))


@query(f"WITH {TM} SELECT {KEYED}, {B(14_400_000, 'h')} AS bucket_ms, round(avg(p50) + 1e-9, 4) AS pct_50, round(avg(p99) + 1e-9, 4) AS pct_99 FROM tm GROUP BY ALL")
def timer_percentiles(spark, d):
    out = rollups.timer_from_timer(_timers(spark, d), G.MIN_240)
    return out.select(*rollups.KEYS, *[r(F.col("percentiles")[k], f"pct_{k}") for k in ("50", "99")])


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(DAY)} AS b, min(v) AS mi, max(v) AS ma, avg(v) AS av FROM ev GROUP BY ALL) SELECT {KEYED}, NOT bool_or(mi <> 0 AND ma <> 0 AND av <> 0) AS all_zero FROM b GROUP BY ALL")
def all_zero_check(spark, d):
    return rollups.all_zero(rollups.double_basic_from_raw(ev(spark, d), G.MIN_1440))


# --- reading ----------------------------------------------------------------------------------------------------------

@query(f"WITH {EV} SELECT {KEYED}, {B(3_600_000)} AS timestamp, round(avg(v) + 1e-9, 4) AS average, round(max(v) + 1e-9, 4) AS max, count(*) AS numPoints FROM ev WHERE tenant_id = 't2' GROUP BY ALL")
def stat_select_basic(spark, d):
    roll = rollups.ladder(ev(spark, d).where("tenant_id = 't2'"), known_double=True, top=G.MIN_60)["60m"]
    out = reading.show(roll, "BF_BASIC", "average,max,numPoints,latest,nosuch")
    return out.select("tenant_id", "metric", "timestamp", r("average"), r("max"), "numPoints")


@query(f"WITH {CN} SELECT {KEYED}, {B(3_600_000, 'b5')} AS timestamp, CAST(sum(n) AS BIGINT) AS numPoints, CAST(sum(c) AS DOUBLE) AS sum FROM cn GROUP BY ALL")
def stat_select_counter(spark, d):
    return reading.show(rollups.counter_from_counter(_counters(spark, d), G.MIN_60), "COUNTER")


ASKED = [(h, p) for h in (1, 3, 8, 12, 24, 72, 168, 720) for p in (1, 10, 50, 100, 300, 800, 2000)]


def _choices(spark, choose) -> DataFrame:
    rows = [(h, p, choose(T0, T0 + h * 3_600_000, p).short) for h, p in ASKED]
    return spark.createDataFrame(rows, "hours int, points int, gran string")


# SQL walks the ladder: the first level from which the next is no better.
_GRANS = "(VALUES (0, 'full', 30000), (1, '5m', 300000), (2, '20m', 1200000), (3, '60m', 3600000), (4, '240m', 14400000), (5, '1440m', 86400000)) g(i, gran, ms)"
_ASK = "(VALUES " + ", ".join(f"({h}, {p})" for h, p in ASKED) + ") a(hours, points)"


def _walk(cost: str) -> str:
    return f"c AS (SELECT hours, points, i, gran, ms, (hours * 3600000::BIGINT) / ms::DOUBLE AS given, {cost} AS cost FROM {_ASK}, {_GRANS}), n AS (SELECT *, lead(cost) OVER (PARTITION BY hours, points ORDER BY i) AS nxt FROM c), w AS (SELECT hours, points, arg_min(gran, i) AS gran, min(i) AS i FROM n WHERE nxt IS NULL OR nxt >= cost GROUP BY ALL)"


_GIVEN = "((hours * 3600000::BIGINT) / ms::DOUBLE)"
_GEO = f"greatest(points / {_GIVEN}, {_GIVEN} / points)"


@query(f"WITH {_walk(_GEO)} SELECT CAST(hours AS INT) AS hours, CAST(points AS INT) AS points, gran FROM w")
def gran_select_geometric(spark, d):
    return _choices(spark, lambda a, b, p: G.select_geometric(a, b, p, a))


@query(f"WITH {_walk(f'trunc(abs(points - {_GIVEN}))')} SELECT CAST(hours AS INT) AS hours, CAST(points AS INT) AS points, gran FROM w")
def gran_select_linear(spark, d):
    return _choices(spark, G.select_linear)


@query(f"WITH {_walk(f'trunc(abs(points - {_GIVEN}))')} SELECT CAST(w.hours AS INT) AS hours, CAST(w.points AS INT) AS points, g2.gran FROM w JOIN c USING (hours, points, i) JOIN {_GRANS.replace(' g(', ' g2(')} ON g2.i = least(5, w.i + CASE WHEN c.given > w.points THEN 1 ELSE 0 END)")
def gran_select_lte(spark, d):
    return _choices(spark, G.select_less_than_equal)


RS, RE = T0 + 5 * DAY + 100_000, T0 + 8 * DAY + 200_000
_H = 3_600_000


def _repair(name: str, kept_sql: str) -> None:
    """Stored: 60-minute rollups of which only some are kept, and spoilt (count + 1000) to be told apart."""
    first = RS - RS % _H
    comp = f"comp AS (SELECT {KEYED}, {B(_H)} AS bucket_ms, count(*) AS count, round(avg(v) + 1e-9, 4) AS average FROM ev WHERE ts_ms >= {first} AND ts_ms < {RE - RE % _H + _H} GROUP BY ALL)"
    sql = (
        f"WITH {EV}, {comp}, every AS (SELECT {KEYED}, {B(_H)} AS bucket_ms, count(*) + 1000 AS count, round(avg(v) + 1e-9, 4) AS average FROM ev GROUP BY ALL), "
        f"st AS (SELECT * FROM every WHERE bucket_ms BETWEEN {first} AND {RE} AND ({kept_sql})), e AS (SELECT {KEYED}, min(bucket_ms) AS lo, max(bucket_ms) AS hi FROM st GROUP BY ALL), "
        f"nw AS (SELECT comp.* FROM comp LEFT JOIN e USING (tenant_id, metric) WHERE lo IS NULL OR (lo > {RS} AND bucket_ms <= lo) OR (hi + {_H} < {RE} AND bucket_ms >= hi + {_H})) "
        "SELECT * FROM nw UNION ALL SELECT st.* FROM st ANTI JOIN nw USING (tenant_id, metric, bucket_ms)"
    )

    def f(spark, d):
        p = ev(spark, d)
        stored = rollups.double_basic_from_raw(p, G.MIN_60).withColumn("count", F.col("count") + 1000).where(kept_sql)
        return reading.repair(stored, p, G.MIN_60, RS, RE).select(*rollups.KEYS, "count", r(rollups.average(), "average"))

    f.__name__ = name
    query(sql)(f)


_repair("repair_left", f"bucket_ms >= {T0 + 6 * DAY}")
_repair("repair_right", f"bucket_ms < {T0 + 7 * DAY}")
_repair("repair_all", "false")
_repair("repair_interior_hole_kept", f"bucket_ms < {T0 + 6 * DAY} OR bucket_ms >= {T0 + 7 * DAY}")


@query(f"WITH {EV} SELECT {KEYED}, {B(1_200_000)} AS timestamp, round(avg(v) + 1e-9, 4) AS average, count(*) AS numPoints, CASE WHEN metric = 'app.click' THEN 'clicks' ELSE 'unknown' END AS unit FROM ev WHERE tenant_id = 't3' AND metric IN ('app.click', 'app.view') AND ts_ms >= {T0 + 2 * DAY} AND ts_ms < {T0 + 4 * DAY + 1_200_000} GROUP BY ALL")
def batch_query(spark, d):
    p = ev(spark, d)
    stored = rollups.ladder(p, known_double=True)
    meta = spark.createDataFrame([("t3", "app.click", "clicks")], "tenant_id string, metric string, unit string")
    out = reading.query(stored, p, meta, "t3", ["app.click", "app.view"], T0 + 2 * DAY, T0 + 4 * DAY, resolution="MIN20", stats="average,numPoints")
    return out.select("tenant_id", "metric", "timestamp", r("average"), "numPoints", "unit")


@query(f"WITH {EV} SELECT {KEYED}, {B(_H)} AS timestamp, round(avg(v) + 1e-9, 4) AS average, count(*) AS numPoints, round(sum(v) + 1e-9, 4) AS sum FROM ev WHERE tenant_id = 't5' AND metric = 'app.click' AND ts_ms >= {T0 + 3 * DAY} AND ts_ms < {T0 + 10 * DAY + _H} GROUP BY ALL")
def query_by_points(spark, d):
    p = ev(spark, d)
    meta = spark.createDataFrame([], "tenant_id string, metric string, unit string")
    out = reading.query(rollups.ladder(p, known_double=True), p, meta, "t5", ["app.click"], T0 + 3 * DAY, T0 + 10 * DAY, points_wanted=160)
    return out.select("tenant_id", "metric", "timestamp", r("average"), "numPoints", r("sum"))


META = "meta AS (SELECT DISTINCT tenant_id, metric, CASE WHEN metric = 'app.click' THEN 'clicks' END AS unit, CASE WHEN metric = 'app.view' THEN 'GAUGE' ELSE 'BF_BASIC' END AS rollup_type FROM ev WHERE tenant_id <> 't7')"


def _meta(spark, d):
    p = ev(spark, d).where("tenant_id <> 't7'").select("tenant_id", "metric").distinct()
    return p.withColumn("unit", F.when(F.col("metric") == "app.click", "clicks")).withColumn("rollup_type", F.when(F.col("metric") == "app.view", "GAUGE").otherwise("BF_BASIC"))


@query(f"WITH {EV}, {META} SELECT ev.tenant_id, ev.metric, {B(DAY)} AS bucket_ms, count(*) AS count, coalesce(any_value(meta.unit), 'unknown') AS unit FROM ev LEFT JOIN meta USING (tenant_id, metric) GROUP BY 1, 2, 3")
def units_left_join(spark, d):
    out = rollups.double_basic_from_raw(ev(spark, d), G.MIN_1440)
    return search.with_units(out, _meta(spark, d)).select(*rollups.KEYS, "count", "unit")


@query(f"WITH {EV}, {META} SELECT {KEYED}, {B(DAY)} AS bucket_ms, count(*) AS count, CASE WHEN coalesce(any_value(rollup_type), 'BF_BASIC') = 'GAUGE' THEN 'gauge' ELSE 'basic' END AS source FROM ev LEFT JOIN meta USING (tenant_id, metric) GROUP BY 1, 2, 3")
def type_routing(spark, d):
    p = ev(spark, d)
    basic = rollups.double_basic_from_raw(p, G.MIN_1440).withColumn("source", F.lit("basic"))
    gauge = rollups.gauge_from_raw(p, G.MIN_1440).withColumn("source", F.lit("gauge"))
    return reading.by_type(basic, gauge, _meta(spark, d)).select(*rollups.KEYS, "count", "source")


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(DAY)} AS bucket_ms, count(*) AS n FROM ev GROUP BY ALL) SELECT {KEYED}, bucket_ms, tenant_id AS j_tenant, metric AS j_metric, '1440m' AS j_gran, n AS j_count, bucket_ms AS j_timestamp, 'unknown' AS j_unit FROM b")
def rollup_event_json(spark, d):
    out = rollups.double_basic_from_raw(ev(spark, d), G.MIN_1440)
    j = reading.rollup_event_json(out, G.MIN_1440, spark.createDataFrame([], "tenant_id string, metric string, unit string"))
    at = lambda p: F.get_json_object("json", f"$.{p}")
    return j.select(*rollups.KEYS, at("tenantId").alias("j_tenant"), at("metricName").alias("j_metric"), at("gran").alias("j_gran"), at("rollup.count").cast("long").alias("j_count"), at("timestamp").cast("long").alias("j_timestamp"), at("metadata.unit").alias("j_unit"))


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(DAY)} AS t, count(*) AS n FROM ev WHERE tenant_id = 't0' GROUP BY ALL) SELECT {KEYED}, CAST(count(*) AS BIGINT) AS values_count, min(t) AS first_ts, arg_min(n, t) AS first_points, 'unknown' AS unit FROM b GROUP BY 1, 2")
def series_json(spark, d):
    out = reading.show(rollups.double_basic_from_raw(ev(spark, d).where("tenant_id = 't0'"), G.MIN_1440), "BF_BASIC", "numPoints")
    j = reading.series_json(search.with_units(out, spark.createDataFrame([], "tenant_id string, metric string, unit string")))
    at = lambda p: F.get_json_object("json", f"$.{p}")
    return j.select("tenant_id", "metric", at("metadata.count").cast("long").alias("values_count"), at("values[0].timestamp").cast("long").alias("first_ts"), at("values[0].numPoints").cast("long").alias("first_points"), at("unit").alias("unit"))


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(DAY)} AS t FROM ev WHERE tenant_id = 't0' GROUP BY ALL) SELECT tenant_id, metric, 'number' AS type, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1, 2")
def batch_json(spark, d):
    out = reading.show(rollups.double_basic_from_raw(ev(spark, d).where("tenant_id = 't0'"), G.MIN_1440), "BF_BASIC", "numPoints")
    j = reading.batch_json(search.with_units(out, spark.createDataFrame([], "tenant_id string, metric string, unit string")))
    back = F.from_json("json", "metrics array<struct<metric:string,unit:string,type:string,data:array<struct<timestamp:bigint,numPoints:bigint>>>>")
    return j.select("tenant_id", F.explode(back["metrics"]).alias("m")).select("tenant_id", "m.metric", "m.type", F.size("m.data").cast("long").alias("n"))


# --- discovery --------------------------------------------------------------------------------------------------------

_NAME = lambda c: f"lower(regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g'))"
NAMES = f"names AS (SELECT 'acme' AS tenant_id, {_NAME('r_name')} || '.' || {_NAME('n_name')} || '.' || {_NAME('s_name')} AS metric, CASE WHEN s_suppkey % 3 = 0 THEN 'ms' END AS unit FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {NAMES} SELECT tenant_id, metric, max(unit) AS unit FROM names WHERE regexp_full_match(metric, '(asia|europe)\\..*\\.supplier.*[02468]') OR metric = 'nosuch' GROUP BY ALL")
def metric_search_glob(spark, d):
    return search.search(search.index_metrics(tables.metric_names(spark, d)), "acme", ["{asia,europe}.*.supplier*[02468]", "nosuch"], limit=None)


def _level_names(q: str, level: int, rx: str) -> str:
    pre = f"WITH {NAMES}, p AS (SELECT DISTINCT metric FROM names), x AS (SELECT array_to_string(string_split(metric, '.')[1:{level}], '.') AS a, len(string_split(metric, '.')) AS n FROM p WHERE len(string_split(metric, '.')) >= {level}), g AS (SELECT a AS name, count(*) AS docs, count(*) FILTER (WHERE n > {level}) AS below FROM x WHERE regexp_full_match(a, '{rx}') GROUP BY ALL) "
    return pre + "SELECT name, false AS is_complete FROM g WHERE below > 0" + (" UNION ALL SELECT name, true FROM g WHERE docs > below" if level > 1 else "")


@query(_level_names("*", 1, "[^.]+"))
def metric_names_level_1(spark, d):
    return search.names_at_level(search.index_metrics(tables.metric_names(spark, d)), "acme", "*")


@query(_level_names("a*.*", 2, "a[^.]*\\.[^.]+"))
def metric_names_level_2(spark, d):
    return search.names_at_level(search.index_metrics(tables.metric_names(spark, d)), "acme", "a*.*")


@query(_level_names("*.*.*", 3, "[^.]+\\.[^.]+\\.[^.]+"))
def metric_names_level_3(spark, d):
    return search.names_at_level(search.index_metrics(tables.metric_names(spark, d)), "acme", "*.*.*")


_TOK = f"{NAMES}, q AS (SELECT DISTINCT metric, string_split(metric, '.') AS t FROM names), tok AS (SELECT DISTINCT t[i] AS token, array_to_string(t[1:i - 1], '.') AS parent, i = len(t) AS is_leaf, 'acme:' || array_to_string(t[1:i], '.') || CASE WHEN i = len(t) THEN ':$' ELSE '' END AS id, array_to_string(t[1:i], '.') AS path FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM q))"


@query(f"WITH {_TOK} SELECT token, parent, is_leaf, id FROM tok")
def path_tokens(spark, d):
    return search.path_tokens(search.index_metrics(tables.metric_names(spark, d))).select("token", "parent", "is_leaf", "id")


@query(f"WITH {_TOK} SELECT DISTINCT path AS name, is_leaf AS is_complete FROM tok WHERE regexp_full_match(parent, 'a[^.]*\\.[^.]+') AND regexp_full_match(token, 'supplier[^.]*1')")
def token_search(spark, d):
    return search.search_tokens(search.path_tokens(search.index_metrics(tables.metric_names(spark, d))), "acme", "a*.*.supplier*1")


@query(f"WITH a AS (SELECT 't' || (user_id % 8) AS tenant_id, epoch_us(ts) // 1000 AS \"when\", 'event ' || event_id AS what, props AS data, event_type AS tags FROM events) SELECT * FROM a WHERE tenant_id = 't4' AND tags = 'click' AND \"when\" BETWEEN {T0 + DAY} AND {T0 + 15 * DAY}")
def event_search(spark, d):
    return search.search_events(tables.annotations(spark, d), "t4", "click", T0 + DAY, T0 + 15 * DAY, limit=None)


@query(f"WITH {NAMES} SELECT DISTINCT metric, coalesce(unit, '') AS unit FROM names WHERE regexp_full_match(metric, 'africa\\..*')")
def search_json(spark, d):
    j = reading.search_json(search.search(search.index_metrics(tables.metric_names(spark, d)), "acme", ["africa.*"], None))
    return j.select(F.get_json_object("json", "$.metric").alias("metric"), F.coalesce(F.get_json_object("json", "$.unit"), F.lit("")).alias("unit"))


@query(f"WITH {NAMES}, p AS (SELECT DISTINCT string_split(metric, '.')[1] AS name FROM names) SELECT name, '{{\"' || name || '\":false}}' AS json FROM p")
def names_json(spark, d):
    return reading.names_json(search.names_at_level(search.index_metrics(tables.metric_names(spark, d)), "acme", "*"))


# --- ingest -----------------------------------------------------------------------------------------------------------

def _payload(spark, d):
    """Events as JSON payloads, some of them spoilt by rule."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts_ms", tables._ms("ts"))
    item = F.struct(
        F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenantId"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("app."), "event_type")).alias("metricName"),
        F.when(F.col("event_id") % 13 == 0, "x").when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.round("value", 3).cast("string")).alias("metricValue"),
        F.col("ts_ms").alias("collectionTime"),
        F.when(F.col("event_id") % 17 == 0, 0).otherwise(172_800).alias("ttlInSeconds"),
        F.when(F.col("event_id") % 2 == 0, "ms").alias("unit"),
    )
    return e.select(F.to_json(F.array(item)).alias("value"), "event_id")


BAD = f"CASE WHEN event_id % 11 = 0 THEN 'metricName' WHEN event_id % 13 = 0 THEN 'metricValue' WHEN event_id % 17 = 0 THEN 'ttlInSeconds' WHEN epoch_us(ts) // 1000 < {NOW - ingest.PAST_MS} OR epoch_us(ts) // 1000 > {NOW + ingest.FUTURE_MS} THEN 'collectionTime' END"


@query(f"WITH x AS (SELECT 't' || (user_id % 8) AS tenant_id, coalesce({BAD}, 'valid') AS verdict FROM events) SELECT tenant_id, verdict, count(*) AS n FROM x GROUP BY ALL")
def validate_split(spark, d):
    good, bad = ingest.validate(tables.parse_raw(_payload(spark, d)), NOW)
    both = good.select(F.col("tenantId").alias("tenant_id"), F.lit("valid").alias("verdict")).union(bad.select("tenant_id", "source"))
    return both.groupBy("tenant_id", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT 't' || (user_id % 8) AS tenant_id, 'app.' || event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 3 = 0 THEN 'long' ELSE 'double' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id ELSE round(value, 3) END AS value FROM events WHERE ({BAD}) IS NULL")
def json_ingest(spark, d):
    good, _ = ingest.validate(tables.parse_raw(_payload(spark, d)), NOW)
    return tables.raw_points(good).select("tenant_id", "metric", "ts_ms", _kind(), rollups.num().alias("value"))


def _bundles(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    n = F.col("c_custkey")
    stat = F.col("c_acctbal")
    bundle = F.struct(
        F.concat(F.lit("c"), n % 4).alias("tenantId"), (F.lit(T0) + n * 15_000).alias("timestamp"), F.when(n % 5 == 0, 0).otherwise(15_000).alias("flushInterval"),
        F.array(F.struct(F.lit("gauge//a").alias("name"), n.cast("string").alias("value"))).alias("gauges"),
        F.array(F.struct(F.lit("counter.b").alias("name"), n.cast("string").alias("value"), ((n % 50) / 2.0).alias("rate"))).alias("counters"),
        F.array(F.struct(F.lit("timer.c").alias("name"), F.lit(10).cast("long").alias("count"), F.lit(2.0).alias("rate"), stat.alias("min"), (stat + 9).alias("max"), (stat * 10).alias("sum"), (stat + 4).alias("avg"), F.when(n % 3 != 0, 1.5).alias("std"), F.create_map(F.lit("75"), F.struct((stat + 7).alias("avg"))).alias("percentiles"))).alias("timers"),
        F.array(F.struct(F.lit("set.d").alias("name"), F.array((n % 7).cast("string"), (n % 3).cast("string")).alias("values"))).alias("sets"),
    )
    return tables.parse_bundles(c.select(F.to_json(F.array(bundle)).alias("value")))


_C = f"SELECT 'c' || (c_custkey % 4) AS tenant_id, {T0} + c_custkey * 15000 AS ts"


@query(f"{_C}, 'gauge.a' AS metric, c_custkey AS value FROM customer")
def bundle_gauges(spark, d):
    return tables.bundle_gauges(_bundles(spark, d)).select("tenant_id", F.col("ts_ms").alias("ts"), "metric", F.col("v_long").alias("value"))


@query(f"{_C}, 'counter.b' AS metric, CAST(c_custkey AS DOUBLE) AS count, (c_custkey % 50) / 2.0::DOUBLE AS rate, CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE floor((c_custkey % 50) / 2.0 * 15) END AS BIGINT) AS sample_count FROM customer")
def bundle_counters(spark, d):
    return tables.bundle_counters(_bundles(spark, d)).withColumnRenamed("bucket_ms", "ts")


@query(f"{_C}, 'timer.c' AS metric, CASE WHEN c_custkey % 3 <> 0 THEN 2.25::DOUBLE ELSE 0.0::DOUBLE END AS variance, round(c_acctbal + 4 + 1e-9, 4) AS average, round(c_acctbal + 7 + 1e-9, 4) AS pct_75, CAST(10 AS BIGINT) AS count FROM customer")
def bundle_timers(spark, d):
    out = tables.bundle_timers(_bundles(spark, d))
    return out.select("tenant_id", F.col("bucket_ms").alias("ts"), "metric", "variance", r("avg_double", "average"), r(F.col("percentiles")["75"], "pct_75"), "count")


@query(f"WITH v AS ({_C}, c_custkey % 7 AS a, c_custkey % 3 AS b FROM customer), u AS (SELECT tenant_id, {B(DAY, 'ts')} AS bucket_ms, a AS m FROM v UNION SELECT tenant_id, {B(DAY, 'ts')}, b FROM v) SELECT tenant_id, 'set.d' AS metric, bucket_ms, count(DISTINCT m) AS count FROM u GROUP BY ALL")
def bundle_sets(spark, d):
    return rollups.set_from_values(tables.bundle_sets(_bundles(spark, d)), G.MIN_1440).select(*rollups.KEYS, "count")


@query(f"WITH {EV} SELECT tenant_id, CASE WHEN {NOW} - ts_ms <= 300000 THEN 'on-time' WHEN {NOW} - ts_ms <= 3600000 THEN 'short-delay' ELSE 'long-delay' END AS delay, count(*) AS n FROM ev GROUP BY ALL")
def delay_class(spark, d):
    return ev(spark, d).select("tenant_id", ingest.delay_class(NOW).alias("delay")).groupBy("tenant_id", "delay").agg(F.count("*").alias("n"))


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(300_000)} AS bucket_ms, count(*) AS count FROM ev GROUP BY ALL) SELECT * FROM b WHERE bucket_ms >= {NOW - 10 * DAY}")
def ttl_expiry(spark, d):
    return maintenance.vacuum({"5m": rollups.double_basic_from_raw(ev(spark, d), G.MIN_5)}, NOW)["5m"].select(*rollups.KEYS, "count")


_UNIT = "CASE WHEN event_id % 97 = 0 THEN 'pieces' ELSE 'clicks' END"


@query(f"WITH w AS (SELECT 't' || (user_id % 8) AS tenant_id, 'app.' || event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, {_UNIT} AS unit FROM events), l AS (SELECT *, lag(unit) OVER (PARTITION BY tenant_id, metric ORDER BY ts_ms, unit) AS old_unit FROM w) SELECT {KEYED}, ts_ms, old_unit, unit AS new_unit FROM l WHERE old_unit <> unit")
def unit_change(spark, d):
    return ingest.unit_changes(_unit_writes(spark, d))


def _unit_writes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), F.concat(F.lit("app."), "event_type").alias("metric"), tables._ms("ts").alias("ts_ms"), F.when(F.col("event_id") % 97 == 0, "pieces").otherwise("clicks").alias("unit"))


@query(f"WITH {EV}, {META}, w AS (SELECT 't' || (user_id % 8) AS tenant_id, 'app.' || event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, {_UNIT} AS unit FROM events WHERE event_type <> 'view'), n AS (SELECT {KEYED}, max_by(unit, ts_ms) AS u FROM w GROUP BY ALL) SELECT tenant_id, metric, coalesce(n.u, meta.unit) AS unit, rollup_type FROM meta FULL JOIN n USING (tenant_id, metric)")
def metadata_upsert(spark, d):
    writes = _unit_writes(spark, d).where("metric <> 'app.view'").withColumn("rollup_type", F.lit(None).cast("string"))
    return ingest.upsert_metadata(_meta(spark, d), writes)


@query("WITH c AS (SELECT 'n' || c_nationkey AS tenant_id, c_name AS metric, (c_custkey % 3) * 60000 AS ts_ms FROM customer WHERE c_custkey % 10 <> 0), a AS (SELECT *, ts_ms // 60000 AS minute, row_number() OVER (PARTITION BY tenant_id, ts_ms // 60000 ORDER BY ts_ms, metric) AS x FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY ts_ms, tenant_id, metric) AS y FROM a WHERE x <= 8) SELECT tenant_id, metric, ts_ms, minute FROM b WHERE y <= 120")
def discovery_throttle(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("n"), "c_nationkey").alias("tenant_id"), F.col("c_name").alias("metric"), (F.col("c_custkey") % 3 * 60_000).alias("ts_ms"), "c_custkey")
    return ingest.throttle(c.drop("c_custkey"), c.where("c_custkey % 10 = 0"), per_minute=120, per_tenant=8)


_GAUGE_CUT = "CASE WHEN rollup_type = 'GAUGE' THEN 3 WHEN rollup_type = 'COUNTER' THEN 7 ELSE 10 END"


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(300_000)} AS bucket_ms, count(*) AS count, CASE metric WHEN 'app.click' THEN 'GAUGE' WHEN 'app.view' THEN 'COUNTER' WHEN 'app.purchase' THEN 'TIMER' END AS rollup_type FROM ev GROUP BY ALL) SELECT {KEYED}, bucket_ms, count, rollup_type FROM b WHERE bucket_ms >= {NOW} - {DAY} * {_GAUGE_CUT}")
def ttl_by_type(spark, d):
    """Days by level and type: gauges 3; counters have none of their own and take the level's 7, which all other types override with 10."""
    kind = F.when(F.col("metric") == "app.click", "GAUGE").when(F.col("metric") == "app.view", "COUNTER").when(F.col("metric") == "app.purchase", "TIMER")
    rows = rollups.double_basic_from_raw(ev(spark, d), G.MIN_5).select(*rollups.KEYS, "count").withColumn("rollup_type", kind)
    days = {"5m": 7, ("5m", "GAUGE"): 3, ("5m", "COUNTER"): 1, ("5m", "BF_BASIC"): 10, ("5m", "TIMER"): 10}
    return maintenance.vacuum({"5m": rows}, NOW, days)["5m"]


@query(f"WITH {EV} SELECT {KEYED}, ts_ms, round(v + 1e-9, 4) AS value FROM ev WHERE ts_ms >= {NOW - 5 * DAY}")
def ttl_forced_raw(spark, d):
    return maintenance.vacuum({"full": ev(spark, d)}, NOW, forced=5)["full"].select("tenant_id", "metric", "ts_ms", r("v_double", "value"))


_BODY = "CASE WHEN event_id % 11 = 0 THEN 'Only one event is allowed per request' WHEN event_id % 7 = 0 THEN 'Invalid Data' WHEN event_id % 5 = 0 THEN 'what may not be empty' WHEN event_id % 3 = 0 THEN 'when must be greater than or equal to 1' ELSE 'valid' END"


def _event_requests(spark, d):
    """One annotation a request as JSON, some spoilt by rule: two in one body, cut off, nothing said, no time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id")
    one = F.to_json(F.struct(F.when((n % 3 != 0) | (n % 5 == 0), tables._ms("ts")).otherwise(0).alias("when"), F.when(n % 5 != 0, F.concat(F.lit("event "), n)).otherwise("").alias("what"), F.col("event_type").alias("tags"), F.lit("x").alias("data")))
    body = F.when(n % 11 == 0, F.concat(one, F.lit(","), one)).when(n % 7 == 0, F.substring(one, F.lit(1), F.length(one) - 3)).otherwise(one)
    return e.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), body.alias("value"))


@query(f"SELECT 't' || (user_id % 8) AS tenant_id, {_BODY} AS verdict, count(*) AS n FROM events GROUP BY ALL")
def event_ingest_split(spark, d):
    valid, rejected = ingest.split_events(_event_requests(spark, d))
    every = valid.select("tenant_id", F.lit("valid").alias("verdict")).union(rejected)
    return every.groupBy("tenant_id", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT 't' || (user_id % 8) AS tenant_id, epoch_us(ts) // 1000 AS \"when\", 'event ' || event_id AS what, 'x' AS data, event_type AS tags FROM events WHERE {_BODY} = 'valid'")
def event_ingest(spark, d):
    return ingest.split_events(_event_requests(spark, d))[0]


_BUNDLE_CASE = "CASE WHEN c_custkey % 7 = 0 THEN 'tenantId may not be empty' WHEN c_custkey % 5 = 0 THEN 'timestamp out of bounds' WHEN c_custkey % 3 = 0 THEN 'flushInterval must not be negative' WHEN c_custkey % 2 = 0 THEN 'at least one of gauges, counters, timers, sets is needed' ELSE 'valid' END"


@query(f"SELECT {_BUNDLE_CASE} AS verdict, count(*) AS n FROM customer GROUP BY ALL")
def multi_bundle_split(spark, d):
    """Payloads of four bundles, of which each is judged by itself."""
    n = F.col("c_custkey")
    none = F.lit(None).cast(tables.NAMED)
    gauges = F.array(F.struct(F.lit("a").alias("name"), n.cast("string").alias("value")))
    bundle = F.struct(F.when(n % 7 == 0, "").otherwise("c").alias("tenantId"), F.when(n % 5 == 0, F.lit(T0 - 9 * DAY)).otherwise(F.lit(T0)).alias("timestamp"), F.when(n % 3 == 0, -1).otherwise(15_000).alias("flushInterval"), F.when(n % 2 == 0, none).otherwise(gauges).alias("gauges"))
    lines = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.floor(n / 4)).agg(F.to_json(F.collect_list(bundle)).alias("value"))
    valid, rejected = ingest.split_bundles(tables.parse_bundles(lines), T0)
    return valid.select(F.lit("valid").alias("verdict")).union(rejected.select("message")).groupBy("verdict").agg(F.count("*").alias("n"))


# --- what listeners are told, and what is shown, by type ----------------------------------------------------------------

_NO_META = "tenant_id string, metric string, unit string"


def _told(rows: DataFrame, g: G.Granularity, kind: str, **paths: tuple[str, str]) -> DataFrame:
    j = reading.rollup_event_json(rows, g, rows.sparkSession.createDataFrame([], _NO_META), kind)
    at = lambda p: F.get_json_object("json", f"$.{p}")
    some = [(at(f"rollup.{p}") if t == "string" else at(f"rollup.{p}").cast(t)).alias(k) for k, (p, t) in paths.items()]
    return j.select(*rollups.KEYS, at("metadata.type").alias("j_type"), *[r(c, k) if t == "double" else c for c, (k, (_, t)) in zip(some, paths.items(), strict=True)])


@query(f"WITH {CN}, c AS (SELECT {KEYED}, {B(3_600_000, 'b5')} AS bucket_ms, CAST(sum(c) AS DOUBLE) AS j_count, CAST(sum(n) AS BIGINT) AS j_samples FROM cn GROUP BY ALL) SELECT {KEYED}, bucket_ms, 'COUNTER' AS j_type, round(j_count + 1e-9, 4) AS j_count, j_samples FROM c")
def event_json_counter(spark, d):
    return _told(rollups.counter_from_counter(_counters(spark, d), G.MIN_60), G.MIN_60, "COUNTER", j_count=("count", "double"), j_samples=("sampleCount", "long"))


@query(f"WITH {EV} SELECT {KEYED}, {B(DAY)} AS bucket_ms, 'GAUGE' AS j_type, count(*) AS j_count, round(max_by(v, ts_ms) + 1e-9, 4) AS j_latest, round(avg(v) + 1e-9, 4) AS j_mean, round(max(v) + 1e-9, 4) AS j_max FROM ev GROUP BY ALL")
def event_json_gauge(spark, d):
    return _told(_gauges(spark, d, G.MIN_1440), G.MIN_1440, "GAUGE", j_count=("count", "long"), j_latest=("latestVal", "double"), j_mean=("mean", "double"), j_max=("max", "double"))


@query(f"WITH {TM} SELECT {KEYED}, {B(14_400_000, 'h')} AS bucket_ms, 'TIMER' AS j_type, CAST(sum(n) AS BIGINT) AS j_count, count(*) AS j_samples, round(sum(s) + 1e-9, 4) AS j_sum, round(min(mi) + 1e-9, 4) AS j_min FROM tm GROUP BY ALL")
def event_json_timer(spark, d):
    return _told(rollups.timer_from_timer(_timers(spark, d), G.MIN_240), G.MIN_240, "TIMER", j_count=("count", "long"), j_samples=("sampleCount", "long"), j_sum=("sum", "double"), j_min=("min", "double"))


@query(f"WITH u AS ({USERS}) SELECT {KEYED}, {B(3_600_000)} AS bucket_ms, 'SET' AS j_type, count(DISTINCT value) AS j_count FROM u GROUP BY ALL")
def event_json_set(spark, d):
    return _told(rollups.set_from_values(_members(spark, d), G.MIN_60), G.MIN_60, "SET", j_count=("count", "long"))


@query(f"WITH {_BIG} SELECT {KEYED}, {B(DAY)} AS bucket_ms, 'BF_BASIC' AS j_type, CAST(min(v) AS VARCHAR) AS j_min, CAST(max(v) AS VARCHAR) AS j_max FROM big GROUP BY ALL")
def event_json_longs(spark, d):
    """Longs are told as whole numbers with all their digits."""
    return _told(rollups.basic_from_raw(_big_points(spark, d), G.MIN_1440), G.MIN_1440, "BF_BASIC", j_min=("min", "string"), j_max=("max", "string"))


@query(f"WITH {EV} SELECT {KEYED}, {B(3_600_000)} AS timestamp, count(*) AS numPoints, round(max_by(v, ts_ms) + 1e-9, 4) AS latest FROM ev GROUP BY ALL")
def stat_select_gauge(spark, d):
    out = reading.show(_gauges(spark, d, G.MIN_60), "GAUGE", "numPoints,latest,nosuch")
    return out.select("tenant_id", "metric", "timestamp", "numPoints", r("latest"))


@query(f"WITH {TM} SELECT {KEYED}, {B(14_400_000, 'h')} AS timestamp, round(CAST(sum(n) AS DOUBLE) / sum(n / CAST(rate AS DOUBLE)), 6) AS rate, CAST(sum(n) AS BIGINT) AS numPoints, round(sum(n * a) / sum(n) + 1e-9, 4) AS average, round(avg(p99) + 1e-9, 4) AS pct_99 FROM tm GROUP BY ALL")
def stat_select_timer(spark, d):
    out = reading.show(rollups.timer_from_timer(_timers(spark, d), G.MIN_240), "TIMER", "rate,numPoints,average,percentiles")
    return out.select("tenant_id", "metric", "timestamp", F.round("rate", 6).alias("rate"), "numPoints", r("average"), r(F.col("percentiles")["99"], "pct_99"))


@query(f"WITH u AS ({USERS}) SELECT {KEYED}, {B(3_600_000)} AS timestamp, count(DISTINCT value) AS numPoints FROM u GROUP BY ALL")
def stat_select_set(spark, d):
    return reading.show(rollups.set_from_values(_members(spark, d), G.MIN_60), "SET")


@query(f"WITH {EV} SELECT {KEYED}, ts_ms AS timestamp, round(v + 1e-9, 4) AS average, 1::BIGINT AS numPoints FROM ev WHERE tenant_id = 't6'")
def stat_select_full(spark, d):
    out = reading.show(ev(spark, d).where("tenant_id = 't6'"), "RAW", None, "ts_ms")
    return out.select("tenant_id", "metric", "timestamp", r("average"), "numPoints")


_MIXED = "mx AS (SELECT o_orderstatus AS status, o_custkey % 50 AS grp, CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN CAST(trunc(o_totalprice) AS BIGINT) END AS w, CASE WHEN NOT (o_custkey % 2 = 0 OR o_orderkey % 3 <> 0) THEN o_totalprice END AS x FROM orders)"


@query(
    f"WITH {_MIXED}, g AS (SELECT status, grp, count(x) > 0 AS is_double, CAST(sum(w) AS BIGINT) AS sw, sum(coalesce(x, w)) AS sx, count(*) AS n, max(w) AS mw, max(coalesce(x, w)) AS mx FROM mx GROUP BY ALL) "
    "SELECT status, grp, is_double, CASE WHEN is_double THEN 0 ELSE sw END AS sum_long, CASE WHEN is_double THEN round(sx + 1e-9, 2) END AS sum_double, CASE WHEN is_double THEN 0 ELSE sw // n END AS avg_long, CASE WHEN is_double THEN round(sx / n + 1e-9, 2) END AS avg_double, CASE WHEN is_double THEN 0 ELSE mw END AS max_long, CASE WHEN is_double THEN round(mx + 1e-9, 2) END AS max_double FROM g"
)
def mixed_numbers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    whole = (F.col("o_custkey") % 2 == 0) | (F.col("o_orderkey") % 3 != 0)
    p = o.select(F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).alias("grp"), F.when(whole, F.col("o_totalprice").cast("long")).alias("v_long"), F.when(~whole, F.col("o_totalprice")).alias("v_double"))
    of = scalars.mixed_numbers()
    out = p.groupBy("status", "grp").agg((F.count("v_double") > 0).alias("is_double"), *[of[k].alias(k) for k in ("sum", "avg", "max")])
    return out.select("status", "grp", "is_double", *[c for k in ("sum", "avg", "max") for c in (F.coalesce(F.col(f"{k}.v_long"), F.lit(0)).alias(f"{k}_long"), F.round(F.col(f"{k}.v_double") + TIE, 2).alias(f"{k}_double"))])


# --- slots, late points, maintenance ----------------------------------------------------------------------------------

_SHARD = f"CAST(('0x' || substring(md5(tenant_id || '.' || metric), 31, 2)) AS INT) % {SHARDS}"
_SLOTS = "sl AS (" + " UNION ALL ".join(f"SELECT '{g.short}' AS gran, CAST({g.slots} * ((ts_ms % {G.CYCLE_MS}) // {G.SLOT_MS}) // {G.BASE_SLOTS} AS INT) AS slot, {_SHARD} AS shard, ts_ms FROM ev" for g in G.ROLLED) + "), st AS (SELECT gran, slot, shard, max(ts_ms) AS ts_ms FROM sl GROUP BY ALL)"


@query(f"WITH {EV}, {_SLOTS} SELECT gran, slot, shard, 'A' AS state, ts_ms, true AS dirty FROM st")
def dirty_slots(spark, d):
    return slots.mark_dirty(ev(spark, d)).select("gran", "slot", "shard", "state", "ts_ms", "dirty")


@query(f"WITH {EV}, {_SLOTS} SELECT gran, slot, shard, false AS reroll FROM st WHERE {NOW} - ts_ms > 300000")
def eligible_slots(spark, d):
    return slots.eligible(slots.mark_dirty(ev(spark, d)), NOW).select("gran", "slot", "shard", "reroll")


_ST2 = f"st2 AS (SELECT *, CASE slot % 3 WHEN 0 THEN 0 WHEN 1 THEN {NOW - DAY} ELSE {NOW - 5 * DAY} END AS lr, ts_ms + (shard % 4) * 200000 + CASE WHEN slot % 5 = 0 THEN 400000000 ELSE 0 END AS li FROM st)"
_AGAIN = f"(lr > 0 AND {NOW} - lr < {3 * DAY})"


@query(f"WITH {EV}, {_SLOTS}, {_ST2} SELECT gran, slot, shard, {_AGAIN} AS reroll FROM st2 WHERE {NOW} - ts_ms > 300000 AND (NOT {_AGAIN} OR ({NOW} - ts_ms > 300000 AND (li - ts_ms <= 300000 OR {NOW} - li > 7200000)))")
def eligible_rerolls(spark, d):
    """Slots rolled up before, lately or long ago, some with late points that may not all have come yet."""
    n = F.col("slot")
    last = F.when(n % 3 == 0, F.lit(0)).when(n % 3 == 1, F.lit(NOW - DAY)).otherwise(F.lit(NOW - 5 * DAY)).cast("long")
    came = F.col("ts_ms") + (F.col("shard") % 4) * 200_000 + F.when(n % 5 == 0, 400_000_000).otherwise(0)
    state = slots.mark_dirty(ev(spark, d)).withColumn("last_rollup_ms", last).withColumn("last_ingest_ms", came)
    return slots.eligible(state, NOW).select("gran", "slot", "shard", "reroll")


_DONE = "(gran = '5m' AND slot % 2 = 0 OR gran = '20m' AND slot % 3 = 0)"


@query(f"WITH {EV}, {_SLOTS} SELECT gran, slot, shard, CASE WHEN {_DONE} AND shard % 3 <> 0 THEN 'X' ELSE 'A' END AS state, CASE WHEN {_DONE} THEN {NOW} ELSE 0 END AS last_rollup_ms FROM st")
def slot_completion(spark, d):
    """Some slots are rolled up while others of them (a third of the shards) become active again."""
    state = slots.mark_dirty(ev(spark, d))
    done = state.where(_DONE)
    running = slots.give_back(slots.start(state, done), done.where("shard % 3 = 0"))
    return slots.complete(running, done, NOW).select("gran", "slot", "shard", "state", "last_rollup_ms")


@query(f"WITH {EV} SELECT DISTINCT '20m' AS gran, CAST(1008 * ((ts_ms % {G.CYCLE_MS}) // {G.SLOT_MS}) // {G.BASE_SLOTS} AS INT) AS slot, {KEYED}, {_SHARD} AS shard FROM ev WHERE {NOW} - ts_ms > 300000")
def delayed_locators(spark, d):
    return slots.delayed_locators(ev(spark, d), NOW)


@query(f"WITH {EV}, {_SLOTS}, dl AS (SELECT DISTINCT CAST(1008 * ((ts_ms % {G.CYCLE_MS}) // {G.SLOT_MS}) // {G.BASE_SLOTS} AS INT) AS s20, {KEYED}, {_SHARD} AS shard FROM ev WHERE {NOW} - ts_ms > 300000), w AS (SELECT DISTINCT slot, shard FROM st WHERE gran = '60m') SELECT DISTINCT '60m' AS gran, w.slot, w.shard, {KEYED} FROM w JOIN dl ON dl.shard = w.shard AND dl.s20 // 3 = w.slot")
def reroll_locators(spark, d):
    p = ev(spark, d)
    due = slots.mark_dirty(p).where("gran = '60m'")
    return slots.reroll_locators(slots.delayed_locators(p, NOW), due)


@query(f"WITH {EV} SELECT {KEYED}, {B(_H)} AS bucket_ms, {STATS} FROM ev GROUP BY ALL")
def delayed_reroll(spark, d):
    p = ev(spark, d).withColumn("late", F.pmod(F.xxhash64("ts_ms"), F.lit(20)) == 0)
    early = rollups.double_basic_from_raw(p.where("not late"), G.MIN_60)
    return shown(maintenance.reroll_late(early, p.drop("late"), p.where("late"), G.MIN_60))


@query(f"WITH {EV} SELECT {KEYED}, {B(_H)} AS bucket_ms, count(*) AS count, round(avg(v) + 1e-9, 4) AS average FROM ev WHERE {_SHARD} < 40 AND ts_ms >= {T0 + 3 * DAY} AND ts_ms < {T0 + 6 * DAY} GROUP BY ALL")
def manual_reroll_shards(spark, d):
    out = maintenance.reroll_shards(ev(spark, d), list(range(40)), T0 + 3 * DAY, T0 + 6 * DAY - 1)["60m"]
    return out.select(*rollups.KEYS, "count", r(rollups.average(), "average"))


@query(f"WITH {EV} SELECT {KEYED}, ts_ms, round(v + 1e-9, 4) AS value, 'source' AS side FROM ev WHERE ts_ms % 50 = 0 AND ts_ms % 100 <> 0 UNION ALL SELECT {KEYED}, ts_ms, round(v + 1e-9, 4) + 1, 'copy' FROM ev WHERE ts_ms % 50 = 0 AND ts_ms % 100 <> 0")
def copy_verify(spark, d):
    src = ev(spark, d).select("tenant_id", "metric", "ts_ms", r("v_double", "value"))
    copy = src.withColumn("value", F.when((F.col("ts_ms") % 50 == 0) & (F.col("ts_ms") % 100 != 0), F.col("value") + 1).otherwise(F.col("value")))
    return maintenance.copy_differences(src, copy)


@query("SELECT 'a' || (o_custkey % 3) AS tenant_id, 'en' || (o_custkey % 5) || '.ch' || (o_orderkey % 2) || '.price' AS metric, epoch_us(o_orderdate) // 1000 AS ts_ms, 'double' AS kind, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'a' || (o_custkey % 3), 'en' || (o_custkey % 5) || '.ch' || (o_orderkey % 2) || '.key', epoch_us(o_orderdate) // 1000, 'long', CAST(o_orderkey AS DOUBLE) FROM orders WHERE o_orderkey % 7 <> 0")
def backfill_checks(spark, d):
    """Export records parsed back to points; every seventh lacks its entity and is skipped, text metrics are too."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    rec = F.struct(
        tables._ms("o_orderdate").alias("timestamp"), F.concat(F.lit("a"), F.col("o_custkey") % 3).alias("tenantId"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("en"), F.col("o_custkey") % 5)).alias("entityId"), F.concat(F.lit("ch"), F.col("o_orderkey") % 2).alias("checkId"),
        F.create_map(F.lit("price"), F.create_map(F.lit("n"), F.round("o_totalprice", 2).cast("string")), F.lit("key"), F.create_map(F.lit("L"), F.col("o_orderkey").cast("string")), F.lit("status"), F.create_map(F.lit("s"), F.col("o_orderstatus"))).alias("metrics"),
    )
    points = tables.check_points(o.select(F.from_json(F.to_json(rec), T.StructType.fromDDL(tables.CHECK)).alias("c")).select("c.*"))
    return points.select("tenant_id", "metric", "ts_ms", _kind(), rollups.num().alias("value"))


@query(f"WITH {EV}, s AS (SELECT DISTINCT {KEYED} FROM ev WHERE {_SHARD} IN (3, 17, 40, 63, 90, 101)) SELECT * FROM s")
def shard_filter(spark, d):
    return tables.locators_of(ev(spark, d)).where(F.col("shard").isin([3, 17, 40, 63, 90, 101])).select("tenant_id", "metric")


@query(f"WITH {EV} SELECT tenant_id || '.' || metric AS locator, tenant_id, metric FROM (SELECT DISTINCT {KEYED} FROM ev)")
def locator_split(spark, d):
    keys = ev(spark, d).select(locator(F.col("tenant_id"), F.col("metric")).alias("locator")).distinct()
    return keys.select("locator", tenant_of(F.col("locator")).alias("tenant_id"), metric_of(F.col("locator")).alias("metric"))


_CLOSED = "(SELECT max(ts_ms) FROM ev) - 600000"


@query(f"WITH {EV}, b AS (SELECT {KEYED}, {B(300_000)} AS bucket_ms, count(*) AS count, round(avg(v) + 1e-9, 4) AS average, round(sum(v) + 1e-9, 4) AS sum FROM ev GROUP BY ALL) SELECT * FROM b WHERE bucket_ms <= {_CLOSED}")
def stream_5m(spark, d):
    """The points as a stream, read to its end: windows that the watermark has passed."""
    import tempfile
    import uuid

    e = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/event[s].parquet")  # a pattern: a stream takes a folder or a pattern, not one file
    points = stream.select(F.concat(F.lit("t"), F.col("user_id") % 8).alias("tenant_id"), F.concat(F.lit("app."), "event_type").alias("metric"), F.timestamp_millis(tables._ms("ts")).alias("ts"), F.col("value").alias("v_double"))
    name = f"closed_{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='stream-')}"
    closed = f"{shared}/{name}/rows"
    run = flow.windowed(points).writeStream.outputMode("append").format("parquet").option("path", closed).option("checkpointLocation", f"{shared}/{name}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(closed).select(*rollups.KEYS, "count", r("avg_double", "average"), r("sum"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder up to a day, one tenant, with units."""
    p = ev(spark, sf_dir).where("tenant_id = 't1'")
    out, meta = None, _meta(spark, sf_dir)
    for k, df in rollups.ladder(p, known_double=True).items():
        level = shown(df).withColumn("gran", F.lit(k))
        out = level if out is None else out.unionByName(level)
    return search.with_units(out, meta)

