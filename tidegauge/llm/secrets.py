"""Secret scan with multipart credential linking, with DataFrame functions only (operator 5).

Base spans are plain pattern matches: ``assign`` (a named secret and its value), ``access`` (an access identifier) and
``hex`` (a long run of hexadecimal digits). Weak candidates mean nothing alone: ``weak_key`` (40 characters of a base-64
alphabet), ``weak_id`` (a named account) and ``endpoint`` (an address with a scheme). An interval join within each
document links them: a weak key is reported only if an identifier lies within the scope, a weak identifier only if a
secret does, an endpoint only if both do. The join orders a document's spans by place and looks for the nearest part of
each role on either side, so that it never makes pairs.

Spans count code points, ends are exclusive. Defined results: null and empty texts have no spans; repeated rows each
keep their own result; spans of different kinds may overlap; matches of a kind never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, stage

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WEAK = {
    "weak_key": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    "weak_id": r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "endpoint": r"(?i:\b(?:https?|ftp|ssh|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp))://[^\s\"'<>]+",
}
USER_INFO = r"^([^:]+://)([^/?#]*)@"
NAMED = r"""^([A-Za-z_]+["']?\x20*[:=]\x20*["']?)(.*)$"""
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "weak_key": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"


def _find(text: Column, kind: str, pattern: str) -> Column:
    """Spans of the matches of a pattern: lengths of what lies between the matches, and of the matches, added up.

    The quantifiers of BASE ask for whole runs, so their matches are the long ones among the matches of the plain
    patterns; a named secret is matched whole at any length and dropped afterwards if its value is short.
    """
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("g"))
    valid = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6) if kind == "assign" else lambda m: F.lit(True)

    def walk(p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + F.length(x["m"])
            span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(valid(x["m"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        def chunk(acc: Column, some: Column) -> Column:
            """Spans of a chunk are put together first: appending one by one to all would cost the square of their number."""
            return let(F.aggregate(some, state(acc["at"]), step), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

        state = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        pairs = F.zip_with(p["m"], F.slice(p["g"], F.lit(1), F.size(p["m"])), lambda m, g: F.struct(m.alias("m"), g.cast("long").alias("g")))
        chunks = let(pairs, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 200).cast("int")), lambda i: F.slice(x, i * 200 + 1, F.lit(200))))
        return F.aggregate(chunks, state(F.lit(0).cast("long")), chunk, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, base and weak candidate spans of each row; texts are not kept."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = lambda kinds: F.sort_array(F.concat(*[_find(F.col("text"), k, p) for k, p in kinds.items()]))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), spans(BASE).alias("base"), spans(WEAK).alias("candidates"))


def link_parts(found: DataFrame, scope: int = 300) -> DataFrame:
    """The weak candidates whose complementary parts lie within ``scope`` code points: doc_id, text_hash, linked."""
    roles = {r: [i for i, k in enumerate(KINDS) if ROLE[k] == r] for r in ("id", "secret", "endpoint")}
    one = found.where(F.size("candidates") > 0).where(F.size("base") + F.size("candidates") > 1)
    rows = one.select("doc_id", "text_hash", F.explode(F.concat("base", "candidates")).alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    doc = W.partitionBy("doc_id", "text_hash").orderBy("start", "ord", "end")
    for role, ords in roles.items():
        if role != "endpoint":
            mine = F.col("ord").isin(ords)
            before = F.max(F.when(mine, F.col("end"))).over(doc.rowsBetween(W.unboundedPreceding, -1))
            after = F.min(F.when(mine, F.col("start"))).over(doc.rowsBetween(1, W.unboundedFollowing))
            near = (F.coalesce(F.col("start") - before, F.lit(1 << 60)) <= scope) | (F.coalesce(after - F.col("end"), F.lit(1 << 60)) <= scope)
            rows = rows.withColumn(f"near_{role}", near)
    k, i, e = (KINDS.index(x) for x in ("weak_key", "weak_id", "endpoint"))
    meets = ((F.col("ord") == k) & F.col("near_id")) | ((F.col("ord") == i) & F.col("near_secret")) | ((F.col("ord") == e) & F.col("near_id") & F.col("near_secret"))
    return rows.where(meets).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end"))).alias("linked"))


def scan(docs: DataFrame, scope: int = 300, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_hash, base and linked spans, each as (start, ord, end) by start and kind."""
    found = stage(find_spans(docs, key, text), "spans")
    linked = link_parts(found, scope).withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    joined = found.join(linked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def as_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda o: F.get(F.lit(KINDS), o)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = 300) -> DataFrame:
    """The documents with every secret, base or linked, replaced by ``mask``; n_chars follows.

    Of a linked endpoint what stands before the @ of its host is masked and the address stays; of a linked account its value. All columns stay as they are otherwise. Overlapping spans become one mask.
    """
    found = scan(docs, scope).select(F.col("doc_id").alias("__llm_d"), F.col("text_hash").alias("__llm_t"), F.concat("base", "linked").alias("__llm_s"))
    hit = found.where(F.size("__llm_s") > 0).dropDuplicates(["__llm_d", "__llm_t"])
    joined = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__llm_d")) & (F.xxhash64(F.col("text")) == F.col("__llm_t")), "left")

    def masked(s: Column) -> Column:
        """The part of a span that is secret."""

        def part(pattern: str) -> Column:
            whole = F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            start = s["start"] + F.length(F.regexp_extract(whole, pattern, 1))
            return F.struct(start.alias("start"), s["ord"].alias("ord"), (start + F.length(F.regexp_extract(whole, pattern, 2))).alias("end"))

        return F.when(s["ord"] == KINDS.index("endpoint"), part(USER_INFO)).when(s["ord"] == KINDS.index("weak_id"), part(NAMED)).otherwise(s)

    def step(acc: Column, s: Column) -> Column:
        added = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], added).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.sort_array(F.filter(F.transform("__llm_s", masked), lambda s: s["start"] < s["end"])), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.col("__llm_s").isNull(), F.col("text")).otherwise(whole)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__llm_s").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
