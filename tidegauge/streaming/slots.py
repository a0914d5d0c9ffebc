"""Slot bookkeeping: what is dirty, what may be rolled up, what must be rolled up again. State is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.granularity import MIN_20, MIN_60, ROLLED, slot, snap
from ..functions.scalars import locator, shard

# Ages in milliseconds.
ROLLUP_DELAY, SHORT_DELAY, LONG_DELAY, REROLL_SPAN = 300_000, 300_000, 7_200_000, 3 * 86_400_000
STATE = "gran string, slot int, shard int, state string, ts_ms bigint, last_rollup_ms bigint, last_ingest_ms bigint, dirty boolean"
SLOT = ["gran", "slot", "shard"]


def slots_of(points: DataFrame) -> DataFrame:
    """A row for each point and granularity: gran, slot, shard and the times."""
    grans = F.array(*[F.struct(F.lit(g.short).alias("gran"), slot(F.col("ts_ms"), g).alias("slot")) for g in ROLLED])
    keyed = points.withColumn("shard", shard(locator(F.col("tenant_id"), F.col("metric"))))
    return keyed.select("shard", "ts_ms", *[c for c in ("ingest_ms",) if c in points.columns], F.explode(grans).alias("g")).select("g.gran", "g.slot", "shard", "ts_ms", *[c for c in ("ingest_ms",) if c in points.columns])


def mark_dirty(points: DataFrame) -> DataFrame:
    """Slots that a batch touches, active and dirty, with the latest time in each."""
    rows = slots_of(points)
    ingest = F.max("ingest_ms") if "ingest_ms" in rows.columns else F.max("ts_ms")
    return rows.groupBy("gran", "slot", "shard").agg(F.lit("A").alias("state"), F.max("ts_ms").alias("ts_ms"), F.lit(0).cast("long").alias("last_rollup_ms"), ingest.alias("last_ingest_ms"), F.lit(True).alias("dirty"))


def merge_state(held: DataFrame, new: DataFrame) -> DataFrame:
    """The state after a batch: touched slots become active and dirty and keep when they were last rolled up."""
    h = held.select("gran", "slot", "shard", *[F.col(c).alias(f"h_{c}") for c in ("state", "ts_ms", "last_rollup_ms", "last_ingest_ms", "dirty")])
    both = h.join(new, ["gran", "slot", "shard"], "full")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"h_{c}")).alias(c)
    return both.select("gran", "slot", "shard", pick("state"), F.greatest("ts_ms", "h_ts_ms").alias("ts_ms"), F.greatest("last_rollup_ms", "h_last_rollup_ms").alias("last_rollup_ms"), F.greatest("last_ingest_ms", "h_last_ingest_ms").alias("last_ingest_ms"), pick("dirty"))


def needs_reroll(now_ms: int) -> Column:
    return (F.col("last_rollup_ms") > 0) & (F.lit(now_ms) - F.col("last_rollup_ms") < REROLL_SPAN)


def eligible(state: DataFrame, now_ms: int, min_age: int = ROLLUP_DELAY, short: int = SHORT_DELAY, long: int = LONG_DELAY) -> DataFrame:
    """Slots that may be rolled up now: old enough, and, if rolled up before, no longer waiting for late points.

    Finest granularity first, so that children go before their parents."""
    age = F.lit(now_ms) - F.col("ts_ms")
    late = F.col("last_ingest_ms") - F.col("ts_ms") > short
    settled = ~needs_reroll(now_ms) | ((age > short) & (~late | (F.lit(now_ms) - F.col("last_ingest_ms") > long)))
    level = F.create_map(*[x for i, g in enumerate(ROLLED) for x in (F.lit(g.short), F.lit(i))])
    return state.where((F.col("state") == "A") & (age > min_age) & settled).withColumn("reroll", needs_reroll(now_ms)).withColumn("level", level[F.col("gran")]).orderBy("level", "slot", "shard")


def _moved(state: DataFrame, some: DataFrame, to: str, where: str) -> DataFrame:
    hit = state.join(some.select(*SLOT).distinct().withColumn("_x", F.lit(True)), SLOT, "left")
    return hit.withColumn("state", F.when(F.col("_x") & (F.col("state") == where), to).otherwise(F.col("state"))).drop("_x")


def start(state: DataFrame, taken: DataFrame) -> DataFrame:
    """Slots taken up are running; their times stay, so that a rolled slot of the same time goes before them."""
    return _moved(state, taken, "R", "A")


def give_back(state: DataFrame, failed: DataFrame) -> DataFrame:
    """Slots whose rollup failed wait again."""
    return _moved(state, failed, "A", "R")


def startable(ready: DataFrame, state: DataFrame) -> DataFrame:
    """Of the slots that may be rolled up, those of which no finer part waits too or is running, nor they themselves."""
    busy = state.where("state = 'R'").select(*SLOT).union(ready.select(*SLOT)).distinct()
    held = _coarser(busy).union(state.where("state = 'R'").select(*SLOT)).distinct()
    return ready.join(held, SLOT, "left_anti")


def _coarser(d: DataFrame) -> DataFrame:
    """The slots of all coarser granularities that hold a slot of ``d``."""
    grans = F.array(*[F.struct(F.lit(g.short).alias("gran"), F.lit(g.slots).alias("n")) for g in ROLLED])
    per = F.create_map(*[F.lit(x) for g in ROLLED for x in (g.short, g.slots)])
    wide = d.select(per[F.col("gran")].alias("_n"), F.col("slot").alias("_s"), "shard", F.explode(grans).alias("c")).where("c.n < _n")
    return wide.select("c.gran", F.floor(F.col("_s") * F.col("c.n") / F.col("_n")).cast("int").alias("slot"), "shard").distinct()


def complete(state: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """Running slots that are done are rolled, and dirty until pushed; one that became active meanwhile stays so. Slots of coarser granularities that hold
    a slot done become active and dirty."""
    d = done.select(*SLOT).distinct()
    dirty = _coarser(d).withColumn("_d", F.lit(True)).join(d, SLOT, "left_anti")
    both = state.join(d.withColumn("_x", F.lit(True)), SLOT, "left").join(dirty, SLOT, "left")
    rolled = F.col("_x") & (F.col("state") == "R")
    return both.select(
        *SLOT, F.when(rolled, "X").when(F.col("_d"), "A").otherwise(F.col("state")).alias("state"), "ts_ms", F.when(F.col("_x"), F.lit(now_ms).cast("long")).otherwise(F.col("last_rollup_ms")).alias("last_rollup_ms"),
        "last_ingest_ms", F.when(rolled | F.col("_d"), True).otherwise(F.col("dirty")).alias("dirty"),
    )


def push(state: DataFrame, root: str, now_ms: int) -> DataFrame:
    """Appends dirty slots to the store, a folder for each shard; returns the state with none dirty.

    ``state`` is read twice, so it should be a table or checkpointed. Running slots are stored as active: another node may take them over.
    """
    stored = F.when(F.col("state") == "R", "A").otherwise(F.col("state")).alias("state")
    rows = state.where("dirty").select("gran", "slot", "shard", stored, "ts_ms", "last_rollup_ms", "last_ingest_ms", F.lit(now_ms).cast("long").alias("write_ms"))
    rows.repartition("shard").write.mode("append").partitionBy("shard").parquet(root)
    return state.withColumn("dirty", F.lit(False))


def pull(spark: SparkSession, root: str, shards: list[int]) -> DataFrame:
    """The store's last row of each slot of some shards; only their folders are read. Of rows written at one time the rolled one goes first."""
    rows = spark.read.schema(STATE.replace(", dirty boolean", ", write_ms bigint")).parquet(root).where(F.col("shard").isin(shards))
    rest = ["state", "ts_ms", "last_rollup_ms", "last_ingest_ms"]
    last = F.max_by(F.struct(*rest), F.struct("write_ms", "state", "ts_ms", "last_rollup_ms"))
    return rows.groupBy(*SLOT).agg(last.alias("s")).select(*SLOT, "s.*", F.lit(False).alias("dirty"))


def reconcile(memory: DataFrame, incoming: DataFrame) -> DataFrame:
    """One node's state after it reads another's rows.

    A slot that is not in memory is taken over. An incoming active slot of another time replaces it, unless memory is active and newer or dirty, and then
    stays dirty. An incoming rolled slot of the same time makes it rolled; of another time it only moves the last rollup forward.
    """
    keys = ["gran", "slot", "shard"]
    rest = ["state", "ts_ms", "last_rollup_ms", "last_ingest_ms", "dirty"]
    both = memory.select(*keys, F.struct(*rest).alias("m")).join(incoming.select(*keys, F.struct(*rest).alias("i")), keys, "full")
    m, i = F.col("m"), F.col("i")
    stamp = lambda **c: F.struct(*[c.get(k, F.col(f"m.{k}")).alias(k) for k in rest])
    newest = F.greatest(m["last_rollup_ms"], i["last_rollup_ms"])
    keeps = (m["state"] == "A") & ((m["ts_ms"] > i["ts_ms"]) | m["dirty"])
    out = (
        F.when(m.isNull(), i)
        .when(i.isNull(), m)
        .when((i["state"] == "A") & (m["ts_ms"] != i["ts_ms"]) & keeps, stamp(dirty=F.lit(True), last_rollup_ms=newest))
        .when((i["state"] == "A") & (m["ts_ms"] != i["ts_ms"]), F.struct(*[(newest if k == "last_rollup_ms" else i[k]).alias(k) for k in rest]))
        .when((i["state"] == "X") & (m["ts_ms"] == i["ts_ms"]), stamp(state=F.lit("X"), last_rollup_ms=newest, dirty=F.lit(False)))
        .otherwise(stamp(last_rollup_ms=newest))
    )
    return both.select(*keys, out.alias("s")).select(*keys, "s.*")


def slot_key(gran: Column, slot_no: Column, state: Column) -> Column:
    return F.concat_ws(",", gran, slot_no.cast("string"), state)


def parse_slot_key(text: Column) -> Column:
    parts = F.split(text, ",")
    return F.struct(parts[0].alias("gran"), parts[1].cast("int").alias("slot"), parts[2].alias("state"))


def delayed_locators(points: DataFrame, now_ms: int) -> DataFrame:
    """Series with late points, by their 20-minute slot."""
    late = points.where(F.lit(now_ms) - F.col("ts_ms") > ROLLUP_DELAY)
    return late.select(F.lit(MIN_20.short).alias("gran"), slot(F.col("ts_ms"), MIN_20).alias("slot"), "tenant_id", "metric", shard(locator(F.col("tenant_id"), F.col("metric"))).alias("shard")).distinct()


def delayed_in(delayed: DataFrame, gran: str, slot_no: int, shard_no: int) -> DataFrame:
    """Series noted as late under one slot of a shard."""
    return delayed.where((F.col("gran") == gran) & (F.col("slot") == slot_no) & (F.col("shard") == shard_no)).select("tenant_id", "metric")


def touched_buckets(late: DataFrame, g=MIN_60) -> DataFrame:
    """(series, bucket) that late points touch: only these are rolled up again."""
    return late.select("tenant_id", "metric", snap(F.col("ts_ms"), g).alias("bucket_ms")).distinct()


def reroll_locators(delayed: DataFrame, slots_to_roll: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Series to roll up again. For slots of up to an hour: those noted as late under any 20-minute slot that the slot holds, or that holds it;
    for coarser slots: every series (tenant_id, metric, shard) of ``known`` in the slot's shard, none if it is not given."""
    number = {g.short: g.slots for g in ROLLED}
    per = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("gran")]
    fine = F.col("gran").isin("5m", "20m", "60m")
    first = F.floor(F.col("slot") * MIN_20.slots / per).cast("int")
    last = F.greatest(first, F.floor((F.col("slot") + 1) * MIN_20.slots / per).cast("int") - 1)
    wide = slots_to_roll.where(fine).select(F.col("gran").alias("roll_gran"), F.col("slot").alias("roll_slot"), "shard", F.explode(F.sequence(first, last)).alias("slot"))
    late = wide.join(delayed.where(F.col("gran") == MIN_20.short).drop("gran"), ["slot", "shard"]).select(F.col("roll_gran").alias("gran"), F.col("roll_slot").alias("slot"), "shard", "tenant_id", "metric").distinct()
    if known is None:
        return late
    coarse = slots_to_roll.where(~fine).select("gran", "slot", "shard").distinct()
    return late.unionByName(coarse.join(known.select("tenant_id", "metric", "shard").distinct(), "shard"))
