from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import dates, globs
from tidegauge.functions import granularity as G
from tidegauge.functions.scalars import infinite_div, parse_shards, safe_div, string_hash

HOUR = 3_600_000


@pytest.mark.parametrize("hours, points, short", [(1, 300, "full"), (8, 300, "5m"), (12, 300, "5m"), (24, 300, "5m"), (168, 300, "20m")])
def test_geometric_choice(hours, points, short):
    assert G.select_geometric(0, hours * HOUR, points, 0).short == short


@pytest.mark.parametrize("points, short", [(5000, "full"), (1055, "full"), (1054, "5m"), (167, "5m"), (166, "20m"), (49, "20m"), (48, "60m"), (14, "60m"), (13, "240m"), (3, "240m"), (2, "1440m"), (1, "1440m")])
def test_geometric_boundaries(points, short):
    assert G.select_geometric(0, 100_000_000, points, 0).short == short


def test_geometric_skips_expired_levels():
    now = 100 * 86_400_000
    assert G.select_geometric(0, HOUR, 120, now).short == "60m"


def test_dispatch():
    assert G.select(0, HOUR, 10, "LINEAR").short == "5m"
    assert G.select(0, HOUR, 10, "LESSTHANEQUAL").short == "20m"
    assert G.select(0, HOUR, 10, "whatever").short == "5m"
    with pytest.raises(ValueError):
        G.select(5, 5, 1)


def test_ranges_of_a_day():
    day = 86_400_000
    assert [len(G.ranges_for_interval(g, 0, day - 1)) for g in G.LADDER] == [1, 288, 72, 24, 6, 1]
    assert len(G.finer_ranges(0, day - 1, G.MIN_1440)) == 6
    rolls = G.ranges_to_roll(HOUR, HOUR + 1, G.MIN_5, 10**12)
    assert rolls[0][0] == HOUR and len(rolls) == 4
    assert G.ranges_to_roll(0, 1, G.MIN_5, 100) == [(0, 100)]


def test_slots_wrap_and_come_back():
    for g in G.ROLLED:
        for ts in (0, 1, G.CYCLE_MS - 1, G.CYCLE_MS, 1_704_067_200_123, 1_399_999_999_999):
            n = G.slot_ms(ts, g)
            assert 0 <= n < g.slots
            start, end = G.derive_range(n, ts, g)
            assert start <= ts <= end and end - start + 1 == g.ms
    start, _ = G.derive_range(G.MIN_5.slots - 1, G.CYCLE_MS + 5, G.MIN_5)
    assert start == G.CYCLE_MS - G.SLOT_MS


def test_names():
    assert G.by_name("5m") is G.MIN_5 and G.by_name("metrics_60m") is G.MIN_60
    with pytest.raises(ValueError):
        G.by_name("5M")
    assert G.by_resolution(None) is G.FULL and G.by_resolution("min240") is G.MIN_240
    with pytest.raises(ValueError):
        G.MIN_1440.coarser


@pytest.mark.parametrize("glob, regex", [("foo.bar.*", r"foo\.bar\..*"), ("f*.bar.*", r"f.*\.bar\..*"), ("foo.{*}", r"foo\.(.*)"), ("[!abc]oo.*]", r"[^abc]oo\..*]"), ("a?{b,c}", "a.(b|c)")])
def test_globs(glob, regex):
    assert globs.to_regex(glob) == regex


def test_glob_errors_and_levels():
    for bad in ("foo.{bar", "foo[", "foo\\"):
        with pytest.raises(globs.GlobError):
            globs.to_regex(bad)
    assert globs.path_regex("*.b*") == r"[^.]+\.b[^.]*"
    assert globs.has_wildcard("a*") and not globs.has_wildcard("a.b") and not globs.has_wildcard(r"a\*")


NOW = datetime(2024, 1, 10, 15, 30, tzinfo=timezone.utc)  # a Wednesday


@pytest.mark.parametrize(
    "text, want",
    [
        ("now", (10, 15, 30)), ("noon", (10, 12, 0)), ("midnight", (10, 0, 0)), ("teatime", (10, 16, 0)), ("noon yesterday", (9, 12, 0)), ("10:30", (10, 10, 30)), ("10:30pm", (10, 22, 30)),
        ("10am tomorrow", (11, 10, 0)), ("monday", (8, 0, 0)), ("january 5", (5, 0, 0)), ("20240103", (3, 0, 0)), ("01/02/24", (2, 0, 0)), ("-1h", (10, 14, 30)), ("noon +2d", (12, 12, 0)), ("12:15 20240107", (7, 12, 15)), ("now-30min", (10, 15, 0)),
        ("today", (10, 0, 0)), ("tomorrow", (11, 0, 0)), ("yesterday", (9, 0, 0)), ("Jan 5, 2024", (5, 0, 0)), ("10:5520240105", (5, 10, 55)), ("10:55_2024_01_05", (5, 10, 55)), ("10:00tuesday", (9, 10, 0)), ("noon Fri", (5, 12, 0)),
        ("midnight Jan 30", (30, 0, 0)), ("15:45 01/30/24", (30, 15, 45)), ("teatime 01/30/2024", (30, 16, 0)), ("2024-01-05", (5, 0, 0)), ("12:30pm", (10, 12, 30)), ("now-10s", (10, 15, 29)),
    ],
)
def test_dates(text, want):
    got = dates.parse(text, NOW)
    assert (got.day, got.hour, got.minute) == want and got.month == 1


def test_other_dates():
    assert dates.parse("1704067200") == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert dates.parse("-1mon", NOW).month == 12 and dates.parse("-1y", NOW).year == 2023
    assert dates.parse("Jul 30, 2013", NOW) == datetime(2013, 7, 30, tzinfo=timezone.utc)
    assert dates.parse("now", NOW.replace(second=17)) == NOW
    with pytest.raises(ValueError):
        dates.parse("no such day", NOW)


def test_scalars(spark):
    df = spark.createDataFrame([("cow",), ("",), ("zzzzzzzz",)], "s string")
    assert [r[0] for r in df.select(string_hash(F.col("s"))).collect()][:2] == [98699, 0]
    java = 0
    for c in "zzzzzzzz":
        java = (java * 31 + ord(c)) & 0xFFFFFFFF
    java -= (java >= 1 << 31) << 32
    assert df.where("s like 'z%'").select(string_hash(F.col("s"))).first()[0] == java
    n = spark.createDataFrame([(3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in n.select(safe_div(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 2]
    got = [r[0] for r in n.select(infinite_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 2
    assert parse_shards("NONE") == [] and len(parse_shards("ALL")) == 128 and parse_shards("1,2") == [1, 2]
    with pytest.raises(ValueError):
        parse_shards("128")
