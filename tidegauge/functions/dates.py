"""Times as people write them: ``now``, ``noon yesterday``, ``10:30am 20240105``, ``-3h``, seconds since 1970."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Words and units that a time may hold.
MOMENTS = {"midnight": (0, 0), "noon": (12, 0), "teatime": (16, 0)}
DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
UNITS = {"s": "seconds", "min": "minutes", "h": "hours", "d": "days", "mon": "months", "y": "years"}

_OFFSET = re.compile(r"([+-])\s*(\d+)\s*(seconds?|secs?|s|minutes?|min|hours?|h|days?|d|weeks?|w|months?|mon|years?|y)$")
_CLOCK = re.compile(r"(\d{1,2})(?::(\d{2}))?(am|pm)?")


def _shift(t: datetime, sign: int, n: int, unit: str) -> datetime:
    if unit.startswith("mon"):
        months = t.year * 12 + t.month - 1 + sign * n
        year, month = divmod(months, 12)
        last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
        return t.replace(year=year, month=month + 1, day=min(t.day, last))
    if unit.startswith("y"):
        return _shift(t, sign, 12 * n, "mon")
    seconds = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[unit[0]]
    return t + sign * n * timedelta(seconds=seconds)


def _day(text: str, now: datetime) -> datetime:
    """Midnight of the day that ``text`` (without separators) names."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if not text:
        return day
    if text in DAYS:
        return day + timedelta(days=DAYS[text])
    for i, name in enumerate(WEEKDAYS):
        if len(text) >= 3 and name.startswith(text):
            return day - timedelta(days=(day.weekday() - i) % 7)
    m = re.match(r"([a-z]{3,})(\d{1,2})(\d{4})?$", text)
    if m:
        for i, name in enumerate(MONTHS):
            if name.startswith(m[1]):
                return day.replace(year=int(m[3] or day.year), month=i + 1, day=int(m[2]))
    for form in ("%m/%d/%y", "%m/%d/%Y", "%Y%m%d"):
        try:
            return datetime.strptime(text, form).replace(tzinfo=now.tzinfo)
        except ValueError:
            continue
    raise ValueError(f"no date: {text!r}")


def parse(text: str, now: datetime | None = None) -> datetime:
    """The moment that ``text`` names, seen from ``now`` (UTC unless it has a zone), to the minute.

    Blanks, commas and underscores mean nothing. ``now``, or an offset alone, starts from the present minute; anything else without a time of
    day from midnight. 12:30pm is half past noon, 12:30am half past midnight. What is no time at all is an error.
    """
    now = (now or datetime.now(timezone.utc)).replace(second=0, microsecond=0)
    said = re.sub(r"[ ,_]", "", text.strip().lower())
    if re.fullmatch(r"\d+", said) and not (len(said) == 8 and 1900 < int(said[:4]) and int(said[4:6]) <= 12 and int(said[6:]) <= 31):
        return datetime.fromtimestamp(int(said), timezone.utc)
    said = re.sub(r"^(\d{4})-(\d{2})-(\d{2})(?!\d)", r"\1\2\3", said)
    offset = _OFFSET.search(said)
    if offset:
        said = said[: offset.start()]
    base = now
    if said and said != "now":
        clock, rest = None, said.replace("now", "")
        m = _CLOCK.match(rest)
        if m and (m[2] or m[3]):
            hour = int(m[1]) % 12 + (12 if m[3] == "pm" else 0) if m[3] else int(m[1])
            clock, rest = (hour, int(m[2] or 0)), rest[m.end() :]
        for word, at in MOMENTS.items():
            if word in rest:
                clock, rest = at, rest.replace(word, "")
        hour, minute = clock or (0, 0)
        base = _day(rest, now).replace(hour=hour, minute=minute)
    return _shift(base, 1 if offset[1] == "+" else -1, int(offset[2]), offset[3]) if offset else base


def parse_ms(text: str, now: datetime | None = None) -> int:
    return int(parse(text, now).timestamp() * 1000)
