"""Discovery: metric search, names by level, path tokens, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import has_wildcard, level_regex, matches, path_regex

LIMIT = 10_000


def index_metrics(writes: DataFrame) -> DataFrame:
    """One row for each series, with a unit if there is one."""
    return writes.groupBy("tenant_id", "metric").agg(F.max("unit").alias("unit"))


def search(index: DataFrame, tenant: str, queries: list[str], limit: int | None = LIMIT) -> DataFrame:
    """Series of a tenant whose whole name matches any of the globs."""
    hit = F.lit(False)
    for q in queries:
        hit = hit | matches(F.col("metric"), q)
    out = index.where((F.col("tenant_id") == tenant) & hit).dropDuplicates(["metric"]).select("tenant_id", "metric", "unit")
    return out.limit(limit) if limit else out


def prefixes(index: DataFrame) -> DataFrame:
    """Every prefix of every name: tenant_id, prefix, level (from 1), depth of the name."""
    parts = F.split("metric", r"\.")
    rows = index.select("tenant_id", "metric", parts.alias("_p")).select("tenant_id", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("level"))
    return rows.select("tenant_id", F.array_join(F.slice("_p", F.lit(1), F.col("level")), ".").alias("prefix"), "level", F.size("_p").alias("depth"))


def names_at_level(index: DataFrame, tenant: str, query: str) -> DataFrame:
    """Names one level deep: (name, is_complete). A name with further levels is incomplete; it also occurs as complete if
    more series carry the prefix than its children account for. A query of one token gives incomplete names only."""
    level = query.count(".") + 1
    parts = F.split("metric", r"\.")
    deep = index.where(F.col("tenant_id") == tenant).select(F.array_join(F.slice(parts, 1, level), ".").alias("name"), F.size(parts).alias("depth")).where(F.col("depth") >= level)
    counts = deep.where(F.col("name").rlike(f"^{path_regex(query)}$")).groupBy("name").agg(F.count("*").alias("docs"), F.count_if(F.col("depth") > level).alias("below"))
    told = [F.when(F.col("below") > 0, F.lit(False))]
    if level > 1:
        told.append(F.when(F.col("docs") > F.col("below"), F.lit(True)))
    return counts.select("name", F.explode(F.filter(F.array(*told), lambda t: t.isNotNull())).alias("is_complete"))


def path_tokens(index: DataFrame) -> DataFrame:
    """A row for each level of each name: token, parent, is_leaf, id."""
    rows = prefixes(index)
    leaf = F.col("level") == F.col("depth")
    token = F.element_at(F.split("prefix", r"\."), -1)
    parent = F.when(F.col("level") == 1, "").otherwise(F.regexp_replace("prefix", r"\.[^.]*$", ""))
    key = F.concat("tenant_id", F.lit(":"), "prefix", F.when(leaf, ":$").otherwise(""))
    return rows.select("tenant_id", token.alias("token"), parent.alias("parent"), leaf.alias("is_leaf"), key.alias("id"), F.col("prefix").alias("path")).dropDuplicates(["id"])


def search_tokens(tokens: DataFrame, tenant: str, query: str) -> DataFrame:
    """Names from the token index: (name, is_complete)."""
    *above, last = query.split(".")
    parent = ".".join(above)
    wild = lambda c, q, rx: c.rlike(f"^{rx}$") if has_wildcard(q) else c == q
    hit = (F.col("tenant_id") == tenant) & wild(F.col("parent"), parent, path_regex(parent) if parent else "")
    if last != "*":
        hit = hit & wild(F.col("token"), last, level_regex(last))
    return tokens.where(hit).select(F.col("path").alias("name"), F.col("is_leaf").alias("is_complete")).distinct()


def search_events(events: DataFrame, tenant: str, tags: str | None = None, start: int | None = None, until: int | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Annotations by tag and time, both optional; times in milliseconds."""
    hit: Column = F.col("tenant_id") == tenant
    if tags is not None:
        hit = hit & (F.col("tags") == tags)
    if start is not None:
        hit = hit & (F.col("when") >= start)
    if until is not None:
        hit = hit & (F.col("when") <= until)
    out = events.where(hit).select("tenant_id", "when", "what", "data", "tags")
    return out.orderBy("when", "what").limit(limit) if limit else out


def with_units(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on the series; "unknown" where no unit is known."""
    return df.join(metadata.select("tenant_id", "metric", F.col("unit").alias("_u")), ["tenant_id", "metric"], "left").withColumn("unit", F.coalesce("_u", F.lit("unknown"))).drop("_u")


def _register() -> None:
    from ..config import register

    register("names", "by_aggregation", names_at_level)
    register("names", "by_tokens", lambda index, tenant, query: search_tokens(path_tokens(index), tenant, query))
    register("events", "default", search_events)
    register("discovery", "default", search)


_register()
