import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import granularity as G
from tidegauge.operators import ingest, search
from tidegauge.operators import rollups as R
from tidegauge.plans import maintenance, reading
from tidegauge.sources import tables
from tidegauge.streaming import flow, slots

H = 3_600_000
RAW = "tenant_id string, metric string, ts_ms bigint, v_long bigint, v_double double"
META = "tenant_id string, metric string, unit string"


def minutes(spark, n, start=0):
    return spark.createDataFrame([("t", "m", start + i * 60_000, None, float(i % 100)) for i in range(n)], RAW)


def test_repair_keeps_interior_holes(spark):
    p = minutes(spark, 600)
    stored = R.double_basic_from_raw(p, G.MIN_60).where(f"bucket_ms in ({2 * H}, {5 * H})").withColumn("count", F.lit(1).cast("long"))
    got = {r.bucket_ms // H: r["count"] for r in reading.repair(stored, p, G.MIN_60, 1, 9 * H + 5).collect()}
    assert got == {0: 60, 1: 60, 2: 60, 5: 1, 6: 60, 7: 60, 8: 60, 9: 60}


def test_query_shapes(spark):
    p = minutes(spark, 600)
    levels, meta = R.ladder(p, known_double=True), spark.createDataFrame([("t", "m", "ms")], META)
    out = reading.query(levels, p, meta, "t", ["m"], 0, 600_000, resolution="FULL", stats="variance,numPoints,max")
    row = out.first()
    assert (row.variance, row.numPoints, row.max, row.unit) == (0.0, 1, 0.0, "ms") and out.count() == 11
    shown = reading.query(levels, p, meta, "t", ["m"], 0, 10 * H, points_wanted=10)
    assert shown.columns == ["tenant_id", "metric", "timestamp", "average", "numPoints", "sum", "unit"]
    doc = json.loads(reading.series_json(shown).first().json)
    assert doc["unit"] == "ms" and doc["metadata"]["count"] == len(doc["values"]) == 10
    with pytest.raises(ValueError):
        reading.query(levels, p, meta, "t", ["x"] * 101, 0, 1)


def test_empty_rollup_shows_nulls(spark):
    df = R.double_basic_from_raw(minutes(spark, 1)).withColumn("count", F.lit(0).cast("long"))
    row = reading.show(df, "BF_BASIC").first()
    assert row.numPoints == 0 and row.average is None and row.sum is None


def test_search_levels(spark):
    names = ["foo.bar.baz", "foo.bar", "foo.bar.baz.qux.x.y", "one.two"]
    index = spark.createDataFrame([("t", n, None) for n in names], META)
    level = lambda q: {(r.name, r.is_complete) for r in search.names_at_level(index, "t", q).collect()}
    assert level("*") == {("foo", False), ("one", False)}
    assert level("foo.*") == {("foo.bar", False), ("foo.bar", True)}
    assert level("foo.bar.*") == {("foo.bar.baz", False), ("foo.bar.baz", True)}
    assert level("one.*") == {("one.two", True)}
    found = search.search_tokens(search.path_tokens(index), "t", "foo.bar.*")
    assert {(r.name, r.is_complete) for r in found.collect()} == {("foo.bar.baz", False), ("foo.bar.baz", True)}
    assert {r.metric for r in search.search(index, "t", ["foo.{bar,nope}", "one.*"]).collect()} == {"foo.bar", "one.two"}
    assert search.search(index, "other", ["*"]).count() == 0


def test_events(spark):
    e = spark.createDataFrame([("t", 5, "deploy", "d", "x"), ("t", 9, "boot", None, "y"), ("u", 5, "deploy", "d", "x"), ("t", 0, "", "", "")], "tenant_id string, when bigint, what string, data string, tags string")
    assert ingest.valid_events(e).count() == 3
    assert [r.what for r in search.search_events(e, "t", None, 1, 9).collect()] == ["deploy", "boot"]
    assert search.search_events(e, "t", "x").count() == 1


def test_validation(spark):
    now = 10**12
    items = [
        {"metricName": "a", "metricValue": 1, "collectionTime": now, "ttlInSeconds": 5, "unit": "s"},
        {"metricName": "", "metricValue": 1, "collectionTime": now, "ttlInSeconds": 5},
        {"metricName": "b", "metricValue": None, "collectionTime": now, "ttlInSeconds": 5},
        {"metricName": "c", "metricValue": "word", "collectionTime": now, "ttlInSeconds": 5},
        {"metricName": "d", "metricValue": 1.5, "collectionTime": now - 4 * 86_400_000, "ttlInSeconds": 5},
        {"metricName": "e", "metricValue": 1.5, "collectionTime": now, "ttlInSeconds": 0},
    ]
    lines = spark.createDataFrame([(json.dumps(items),)], "value string")
    good, bad = ingest.validate(tables.parse_raw(lines, "t"), now)
    row = tables.raw_points(good).first()
    assert (row.tenant_id, row.metric, row.v_long, row.v_double) == ("t", "a", 1, None)
    assert {r.source for r in bad.collect()} == {"metricName", "metricValue", "collectionTime", "ttlInSeconds"}
    assert ingest.validate(tables.parse_raw(lines, "t"), now, forced_ttl_s=60)[0].count() == 2
    assert [ingest.status(*x) for x in ((1, 0), (1, 1), (0, 1))] == [200, 207, 400]


def test_bundles(spark):
    b = {"tenantId": "t", "timestamp": 1000, "flushInterval": 15000, "gauges": [{"name": "a//b", "value": 2}], "counters": [{"name": "c", "value": 317, "rate": 21.133333333333333}], "timers": [{"name": "x", "count": 15, "rate": 1, "min": 43, "max": 497, "sum": 3865, "avg": 257.66, "std": 149.02, "percentiles": {"75": {"avg": 1.5}}}], "sets": [{"name": "s", "values": ["cow", "dog"]}]}
    df = tables.parse_bundles(spark.createDataFrame([(json.dumps([b]),)], "value string"))
    assert tables.bundle_gauges(df).first().metric == "a.b"
    assert tables.bundle_counters(df).first().sample_count == 317
    t = tables.bundle_timers(df).first()
    assert t.variance == pytest.approx(149.02**2) and t.percentiles == {"75": 1.5} and t["count"] == 15
    assert R.set_from_values(tables.bundle_sets(df)).first()["count"] == 2
    bad = df.select(ingest.bundle_problem(1000).alias("p"), ingest.bundle_problem(10**12).alias("q")).first()
    assert bad.p is None and bad.q == "timestamp out of bounds"


def test_slot_states(spark):
    p = spark.createDataFrame([("t", "m", 1_000_000, 1, None)], RAW)
    state = slots.mark_dirty(p)
    assert state.count() == 5
    assert slots.eligible(state, 1_000_000 + 299_000).count() == 0
    ready = slots.eligible(state, 1_000_000 + 400_000)
    assert [r.gran for r in ready.collect()] == ["5m", "20m", "60m", "240m", "1440m"]
    fine = ready.where("gran = '5m'")
    assert [r.gran for r in slots.startable(ready, state).collect()] == ["5m"]
    running = slots.start(state, fine)
    assert slots.eligible(running, 1_400_000).count() == 4 and slots.startable(ready.where("gran <> '5m'"), running).count() == 0
    assert {r.state for r in slots.give_back(running, fine).collect()} == {"A"}
    done = slots.complete(running, fine, 2_000_000)
    after = {r.gran: (r.state, r.dirty, r.last_rollup_ms) for r in done.collect()}
    assert after["5m"] == ("X", True, 2_000_000) and after["20m"] == ("A", True, 0)
    late = slots.complete(slots.merge_state(running, state), fine, 2_000_000)
    assert {r.gran: r.state for r in late.collect()}["5m"] == "A"  # became active while it ran
    again = slots.merge_state(done, state)
    assert {r.gran: (r.state, r.last_rollup_ms) for r in again.collect()}["5m"] == ("A", 2_000_000)
    row = spark.createDataFrame([("5m,12,X",)], "s string").select(slots.parse_slot_key(F.col("s")).alias("k")).select("k.*").first()
    assert tuple(row) == ("5m", 12, "X")


def test_reconcile(spark):
    mk = lambda rows: spark.createDataFrame([("5m", i, 0, *r) for i, r in rows], slots.STATE)
    memory = mk([(1, ("A", 10, 0, 10, False)), (2, ("A", 30, 0, 10, False)), (3, ("A", 10, 0, 10, False)), (4, ("A", 10, 0, 10, False))])
    seen = mk([(0, ("A", 5, 0, 5, False)), (1, ("A", 20, 0, 20, False)), (2, ("A", 20, 7, 20, False)), (3, ("X", 10, 9, 10, False)), (4, ("X", 11, 9, 10, False))])
    got = {r.slot: (r.state, r.ts_ms, r.last_rollup_ms, r.dirty) for r in slots.reconcile(memory, seen).collect()}
    assert got == {0: ("A", 5, 0, False), 1: ("A", 20, 0, False), 2: ("A", 30, 7, True), 3: ("X", 10, 9, False), 4: ("A", 10, 9, False)}


def test_late_points_are_rolled_up_again(spark):
    p = minutes(spark, 300)
    early = R.double_basic_from_raw(p.where("ts_ms % 7 <> 0"), G.MIN_60)
    out = maintenance.reroll_late(early, p, p.where("ts_ms % 7 = 0"), G.MIN_60)
    assert {r["count"] for r in out.collect()} == {60}
    assert slots.delayed_locators(p, 10**10).select("gran").distinct().first()[0] == "20m"


def test_stored_levels_and_copy(spark, tmp_path):
    df = R.double_basic_from_raw(minutes(spark, 3000), G.MIN_60)
    maintenance.write_level(df, str(tmp_path), G.MIN_60)
    got = maintenance.read_stored(spark, str(tmp_path), G.MIN_60, 3 * H, 30 * H)
    assert got.count() == 28
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(bucket_ms" in plan
    assert maintenance.copy_differences(df, df, share=0.5).count() == 0
    closed, held = maintenance.backfill(minutes(spark, 60), G.MIN_5, 59 * 60_000)
    assert closed.count() == 9 and held.count() == 15


def test_export_checks(spark, tmp_path):
    rec = {"id": "1", "timestamp": 5, "tenantId": "t", "entityId": "e", "checkId": "c", "metrics": {"m": {"L": "7"}, "x": {"s": "text"}, "d": {"n": "1.5"}}}
    (tmp_path / "a.json").write_text(json.dumps(rec) + "\n" + json.dumps(rec | {"entityId": None}) + "\n")
    got = {(r.metric, r.v_long, r.v_double) for r in tables.read_checks(spark, str(tmp_path)).collect()}
    assert got == {("e.c.m", 7, None), ("e.c.d", None, 1.5)}


def test_stream_rolls_up(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    points = minutes(spark, 400).withColumn("ts", F.timestamp_millis("ts_ms"))
    points.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(points.schema).parquet(str(src))
    q = flow.start(flow.windowed(stream), str(tmp_path / "cp"), flow.roll_up_batch(str(out)))
    q.awaitTermination(120)
    done = flow.read_level(spark, str(out), G.MIN_5)
    assert done.count() >= 70 and done.agg(F.max("count")).first()[0] == 5
    hour = flow.read_level(spark, str(out), G.MIN_60).where("bucket_ms = 0").first()
    assert hour["count"] == 60 and hour.avg_double == pytest.approx(sum(range(60)) / 60)


def test_emitter():
    e, seen = flow.Emitter(), []
    e.on("rollup", seen.append)
    e.once("rollup", lambda x: seen.append(-x))
    e.emit("rollup", 1)
    e.emit("rollup", 2)
    e.off("rollup")
    assert seen == [1, -1, 2] and e.emit("rollup", 3) == 0


def test_throttle_and_units(spark):
    new = spark.createDataFrame([(f"t{i % 2}", f"m{i}", 1000 + i) for i in range(20)], "tenant_id string, metric string, ts_ms bigint")
    known = new.limit(0)
    assert ingest.throttle(new, known, per_minute=5, per_tenant=3).count() == 5
    w = spark.createDataFrame([("t", "m", 1, "s"), ("t", "m", 2, None), ("t", "m", 3, "ms")], "tenant_id string, metric string, ts_ms bigint, unit string")
    assert [tuple(r) for r in ingest.unit_changes(w).collect()] == [("t", "m", 3, "s", "ms")]


def test_config_and_modules(spark):
    from tidegauge import config

    assert config.EngineConfig().ttl_days["60m"] == 155 and config.EngineConfig(shards=4).shards == 4
    index = spark.createDataFrame([("t", "a.b", None)], META)
    for name in ("by_aggregation", "by_tokens"):
        assert [tuple(r) for r in config.module("names", name)(index, "t", "a.*").collect()] == [("a.b", True)]
    with pytest.raises(ValueError):
        config.register("nosuch", "x", None)


def test_state_store(spark, tmp_path):
    root = str(tmp_path / "state")
    points = spark.createDataFrame([("t", f"m{i}", 1_000_000, 1, None) for i in range(5)], RAW)
    state = slots.mark_dirty(points)
    fine = state.where("gran = '5m'")
    clean = slots.push(state, root, 10)
    assert clean.where("dirty").count() == 0
    slots.push(slots.complete(slots.start(state, fine), fine, 2_000_000).where("gran = '5m'"), root, 10)  # at the same time: the rolled one counts
    shards = [r.shard for r in state.select("shard").distinct().collect()]
    got = slots.pull(spark, root, shards)
    assert got.count() == state.count() and {r.state for r in got.where("gran = '5m'").collect()} == {"X"}
    assert got.where("gran <> '5m' AND state = 'X'").count() == 0
    some = slots.pull(spark, root, shards[:1])
    assert {r.shard for r in some.collect()} == set(shards[:1])
    assert "shard" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert slots.reconcile(state, got).where("gran = '5m' AND state = 'X'").count() == fine.count()


def test_events_by_route(spark, tmp_path):
    bodies = ['{"when": 5, "what": "a", "tags": "x"}', '{"when": 5, "what": "a"}{"when": 6, "what": "b"}', '[{"when": 5, "what": "a"}]', "", None, "{}", '{"when": 0, "what": "a"}', "no json", '{"when": 5, "what": "a"},{"when": 6, "what": "b"}']
    lines = spark.createDataFrame([(f"t{i}", b) for i, b in enumerate(bodies)], "tenant_id string, value string")
    valid, rejected = ingest.split_events(lines)
    assert [tuple(r) for r in valid.collect()] == [("t0", 5, "a", None, "x")]
    why = {r.tenant_id: r.message for r in rejected.collect()}
    assert set(why) == {f"t{i}" for i in range(1, 9)} and why["t5"] == "what may not be empty" and why["t8"].startswith("Only one") and why["t2"] == why["t3"] == why["t4"] == why["t7"] == "Invalid Data"
    root = str(tmp_path / "events")
    for i in range(2):
        maintenance.write_events(valid.withColumn("when", F.lit(i).cast("long")), root)
    mine = maintenance.read_events(spark, root, "t0")
    assert sorted(r.when for r in mine.collect()) == [0, 1] and maintenance.read_events(spark, root, "t1").count() == 0
    assert "route" in mine._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_ttl_and_routes(spark):
    days = {"5m": 7, ("5m", "GAUGE"): 3, ("5m", "COUNTER"): 1}
    assert [ingest.ttl_of("5m", k, days) for k in ("BF_BASIC", "GAUGE", "COUNTER")] == [7, 3, 7]
    assert ingest.ttl_of("full", "SET", None, 5) == 5 and ingest.ttl_of("60m") == 155
    w = spark.createDataFrame([("t", "a", None), ("t", "b", "GAUGE"), ("t", "c", "BF_BASIC")], "tenant_id string, metric string, rollup_type string")
    basic, pre = ingest.route(w)
    assert sorted(r.metric for r in basic.collect()) == ["a", "c"] and [r.metric for r in pre.collect()] == ["b"]


def test_rollup_json_of_no_points(spark):
    rows = spark.createDataFrame([("t", "m", 0, 0, None, None, 0.0, 0.0, 0.0, 0.0), ("t", "n", 0, 2, 3, None, 0.0, 3.0, 3.0, 6.0)], "tenant_id string, metric string, bucket_ms bigint, count bigint, avg_long bigint, avg_double double, variance double, min double, max double, sum double")
    meta = spark.createDataFrame([], META)
    out = {r.metric: json.loads(r.json)["rollup"] for r in reading.rollup_event_json(rows, G.MIN_5, meta).collect()}
    assert out["m"] == {"count": 0, "max": None, "min": None, "mean": None, "var": None, "sum": None}
    assert out["n"]["mean"] == 3 and isinstance(out["n"]["mean"], int) and isinstance(out["n"]["sum"], float)


def test_point_dump(spark, tmp_path):
    day = 86_400_000
    a = tables.synthetic_points(spark, 20, day, 0, "t", "a")
    assert a.count() == 20 and a.agg(F.max("v_long")).first()[0] == 20
    a.unionByName(tables.synthetic_points(spark, 20, day, 0, "t", "b")).write.parquet(str(tmp_path / "p"))
    got = tables.dump_points(spark, str(tmp_path / "p"), "t", "a", 19 * day)
    assert [r.ts_ms // day for r in got.collect()] == list(range(12, 20)) and {r.metric for r in got.collect()} == {"a"}
    assert tables.dump_points(spark, str(tmp_path / "p"), "t", "b", 19 * day, day, 2 * day).count() == 2
    two = tables.read_points(spark, str(tmp_path / "p"), 0, day, [("t", "a"), ("t", "b"), ("u", "a")])
    assert two.count() == 4


def test_backfill_stops_at_late_points(spark):
    p = minutes(spark, 60)
    rolled, left = maintenance.backfill(p, G.MIN_5, 59 * 60_000, done_ms=10 * 60_000)
    assert sorted(r.bucket_ms // 60_000 for r in rolled.collect()) == list(range(10, 45, 5)) and left.count() == 15
    with pytest.raises(ValueError):
        maintenance.backfill(p, G.MIN_5, 59 * 60_000, done_ms=11 * 60_000)


def test_tracked_and_has_data(spark):
    q = spark.createDataFrame([("t", "a.b 1"), ("t", "c 2"), ("u", "a.b 3")], "tenant_id string, message string")
    assert ingest.tracked(q, ["t"], ["a.b"]).count() == 1 and ingest.tracked(q, ["t"], []).count() == 2
    rows = spark.createDataFrame([(0, 0, []), (2, 1, [5])], "count bigint, sample_count bigint, hashes array<int>")
    assert [rows.where(R.has_data(k)).count() for k in ("BF_BASIC", "COUNTER", "SET")] == [1, 1, 1]
