"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 128


def locator(tenant: Column, metric: Column) -> Column:
    return F.concat_ws(".", tenant, metric)


def tenant_of(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def metric_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^[^.]*\.(.*)$", 1)


def shard(key: Column) -> Column:
    """Last byte of the key's md5, modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.md5(key), 31, 2), 16, 10).cast("int"), F.lit(SHARDS))


def parse_shards(text: str) -> list[int]:
    """"ALL", "NONE" or a comma list."""
    if text.upper() == "ALL":
        return list(range(SHARDS))
    if text.upper() == "NONE":
        return []
    out = [int(x) for x in text.split(",")]
    if any(not 0 <= x < SHARDS for x in out):
        raise ValueError(f"shards lie between 0 and {SHARDS - 1}")
    return out


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def infinite_div(a: Column, b: Column) -> Column:
    """Division of doubles in which a zero divisor gives an infinity or no number instead of an error."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def string_hash(s: Column) -> Column:
    """The 32-bit polynomial hash (base 31) of a string of BMP characters, signed."""
    signs = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(signs, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    h = F.when(F.length(s) == 0, F.lit(0).cast("long")).otherwise(h)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def resolve_number(text: Column) -> tuple[Column, Column]:
    """(long, double) of a number's text: integral text is long, any other double."""
    integral = text.rlike(r"^-?\d+$")
    return F.when(integral, text.try_cast("bigint")), F.when(~integral, text.try_cast("double"))


def tokens(metric: Column) -> Column:
    return F.split(metric, r"\.")


def mixed_numbers(whole: str = "v_long", real: str = "v_double") -> dict[str, Column]:
    """Aggregates over numbers that are longs or doubles: sum, avg, min and max as structs of v_long and v_double, of which one is set.

    A group is long unless it holds a double; the average of longs drops its fraction. A sum of longs that overflows is null.
    """
    x = F.coalesce(F.col(real), F.col(whole).cast("double"))
    doubles = F.count(real) > 0
    total = F.try_sum(whole)
    both = lambda a, b: F.struct(F.when(~doubles, a).alias("v_long"), F.when(doubles, b).alias("v_double"))
    return {"sum": both(total, F.sum(x)), "avg": both(F.call_function("div", total, F.count(whole)), F.avg(x)), "min": both(F.min(whole), F.min(x)), "max": both(F.max(whole), F.max(x))}
