"""Neighbours in the order of a key, without sorting everything in one task. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_of(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by bisection over a literal array."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not bounds:
        return F.lit(0)
    edges = F.lit(bounds)
    taken = lambda at, step: (at + step <= len(bounds)) & (F.coalesce(F.get(edges, at + step - 1), F.lit(bounds[-1])) <= value)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(taken(at, step), at + step).otherwise(at))


def key_bounds(df: DataFrame, key: str, each: int = 1000, least: int = 64, most: int = 1 << 16) -> list[int]:
    """Ascending bounds that cut the keys into parts of about ``each`` rows; a sketch of the key column alone."""
    n = df.count()
    parts = min(most, max(least, n // each))
    if n < 2:
        return []
    return sorted({int(x) for x in df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)})


def with_next(rows: DataFrame, key: str, tie: str, next_name: str, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add ``next_name``: a struct of ``carried`` of the next row by (key, tie); the first row's for the last.

    ``prepare`` adds columns to every row before the rows are dealt, once for each row.

    The keys are cut at bounds into parts. Each part also gets, as a guest, the first row of the part after it, so that a
    window within parts finds every next row. Only one row for each part is ordered in one task.
    """
    bounds = key_bounds(rows.select(key), key)
    dealt = rows.withColumn("_part", bucket_of(F.col(key), bounds))
    firsts = dealt.groupBy("_part").agg(F.min(F.struct(key, tie)).alias("_first"))
    whole = W.orderBy("_part")
    ends = firsts.select("_part", F.coalesce(F.lead("_first").over(whole), F.first("_first").over(whole)).alias("_first"))
    # a row for each part and at most ``most`` of them: small enough to broadcast at any size of the input
    guests = rows.join(F.broadcast(ends.select(F.col("_part"), F.col(f"_first.{key}").alias(key), F.col(f"_first.{tie}").alias(tie))), [key, tie])
    guests = guests.select(*rows.columns, "_part").dropDuplicates(["_part"])
    both = prepare(dealt.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True))))
    near = W.partitionBy("_part").orderBy("_guest", key, tie)
    return both.withColumn(next_name, F.lead(F.struct(*carried)).over(near)).where(~F.col("_guest")).drop("_guest", "_part")
