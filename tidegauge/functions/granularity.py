"""The lattice of granularities: buckets, slots, ranges, and choosing one by a number of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000
BASE_SLOTS = 4032
SLOT_MS = 5 * MINUTE
CYCLE_MS = BASE_SLOTS * SLOT_MS


@dataclass(frozen=True)
class Granularity:
    name: str
    short: str
    ms: int
    slots: int
    ttl_days: int

    @property
    def level(self) -> int:
        return LADDER.index(self)

    @property
    def finer(self) -> Granularity:
        if self.level == 0:
            raise ValueError(f"nothing is finer than {self.name}")
        return LADDER[self.level - 1]

    @property
    def coarser(self) -> Granularity:
        if self.level == len(LADDER) - 1:
            raise ValueError(f"nothing is coarser than {self.name}")
        return LADDER[self.level + 1]


# The ladder (name, short name, bucket, slots of a 14-day cycle, days kept).
FULL = Granularity("metrics_full", "full", SLOT_MS, 4032, 5)
MIN_5 = Granularity("metrics_5m", "5m", 5 * MINUTE, 4032, 10)
MIN_20 = Granularity("metrics_20m", "20m", 20 * MINUTE, 1008, 20)
MIN_60 = Granularity("metrics_60m", "60m", 60 * MINUTE, 336, 155)
MIN_240 = Granularity("metrics_240m", "240m", 240 * MINUTE, 84, 300)
MIN_1440 = Granularity("metrics_1440m", "1440m", 1440 * MINUTE, 14, 1825)
LADDER = [FULL, MIN_5, MIN_20, MIN_60, MIN_240, MIN_1440]
ROLLED = LADDER[1:]
RESOLUTIONS = {"FULL": FULL, "MIN5": MIN_5, "MIN20": MIN_20, "MIN60": MIN_60, "MIN240": MIN_240, "MIN1440": MIN_1440}


def by_name(name: str) -> Granularity:
    """By name or short name; case matters."""
    for g in LADDER:
        if name in (g.name, g.short):
            return g
    raise ValueError(f"no granularity {name!r}")


def by_resolution(name: str | None) -> Granularity:
    """The request's resolution; none means full."""
    if name is None:
        return FULL
    if name.upper() not in RESOLUTIONS:
        raise ValueError(f"no resolution {name!r}")
    return RESOLUTIONS[name.upper()]


def snap(ts: Column, g: Granularity) -> Column:
    """Start of the bucket; full keeps the time."""
    return ts if g is FULL else ts - F.pmod(ts, F.lit(g.ms))


def snap_ms(ts: int, g: Granularity) -> int:
    return ts if g is FULL else ts - ts % g.ms


def slot(ts: Column, g: Granularity) -> Column:
    base = F.floor(F.pmod(ts, F.lit(CYCLE_MS)) / SLOT_MS)
    return F.floor(F.lit(g.slots) * base / BASE_SLOTS).cast("int")


def slot_ms(ts: int, g: Granularity) -> int:
    return g.slots * ((ts % CYCLE_MS) // SLOT_MS) // BASE_SLOTS


def derive_range(slot_no: int, reference: int, g: Granularity) -> tuple[int, int]:
    """The latest range of a slot at or before the reference time: [start, end], the end within the bucket."""
    reference = snap_ms(reference, g) if g is not FULL else reference - reference % g.ms
    now = slot_ms(reference, g)
    back = now - slot_no if slot_no <= now else now - slot_no + g.slots
    start = reference - back * g.ms
    return start, start + g.ms - 1


def ranges_to_roll(start: int, stop: int, g: Granularity, now: int) -> list[tuple[int, int]]:
    """Buckets of g that cover [start, stop] up to whole buckets of the next coarser granularity, the last one cut at now."""
    c = g.coarser.ms if g.level < len(LADDER) - 1 else g.ms
    first, end = start - start % c, (stop + c) - (stop + c) % c
    return [(s, min(s + g.ms - 1, now)) for s in range(first, end, g.ms) if s < now]


def ranges_for_interval(g: Granularity, start: int, stop: int) -> list[tuple[int, int]]:
    if g is FULL:
        return [(start, stop)]
    return [(s, s + g.ms - 1) for s in range(snap_ms(start, g), snap_ms(stop, g) + 1, g.ms)]


def finer_ranges(start: int, stop: int, g: Granularity) -> list[tuple[int, int]]:
    """The ranges of the next finer granularity inside a range of g."""
    step = g.finer.ms
    return [(s, s + step - 1) for s in range(start, stop + 1, step)]


def _provided(span: int) -> list[tuple[Granularity, float]]:
    """Points that each granularity gives over a span; raw points are taken to come every 30 seconds."""
    return [(g, span / (30_000 if g is FULL else g.ms)) for g in LADDER]


def _alive(start: int, now: int, ttl_days: dict[str, int] | None) -> list[Granularity]:
    days = ttl_days or {}
    return [g for g in LADDER if start > now - days.get(g.short, g.ttl_days) * 86_400_000]


def select_geometric(start: int, stop: int, points: int, now: int, ttl_days: dict[str, int] | None = None) -> Granularity:
    """Least ratio between points asked for and given, among granularities whose data are still kept."""
    alive, best, least = _alive(start, now, ttl_days), None, None
    for g, given in _provided(stop - start):
        if g not in alive:
            continue
        ratio = max(points / given, given / points)
        if least is not None and ratio >= least:
            break
        best, least = g, ratio
    return best or MIN_1440


def select_linear(start: int, stop: int, points: int) -> Granularity:
    """Least difference between points asked for and given; stops where it stops falling."""
    best, least = FULL, None
    for g, given in _provided(stop - start):
        diff = int(abs(points - given))
        if least is not None and diff >= least:
            break
        best, least = g, diff
    return best


def select_less_than_equal(start: int, stop: int, points: int) -> Granularity:
    """Linear, and one step coarser if that gives too many points."""
    g = select_linear(start, stop, points)
    given = dict(_provided(stop - start))[g]
    return g.coarser if given > points and g is not MIN_1440 else g


def select(start: int, stop: int, points: int, algorithm: str = "GEOMETRIC", now: int | None = None, ttl_days: dict[str, int] | None = None) -> Granularity:
    if start >= stop:
        raise ValueError("the interval's start must lie before its end")
    if algorithm.startswith("LINEAR"):
        return select_linear(start, stop, points)
    if algorithm.startswith("LESSTHANEQUAL"):
        return select_less_than_equal(start, stop, points)
    return select_geometric(start, stop, points, start if now is None else now, ttl_days)
