"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, licenses, secrets
from .byte_bpe import ByteBPE
from .common import let, table
from .fingerprints import compare_with_edits
from .ngrams import jaccard_components
from .packing import pack_documents
from .quality import classify
from .token_index import read_store, write_store
from .vectors import near_vectors

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["ord"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    every = F.sort_array(F.concat("base", "linked"))
    return found.select("doc_id", *counts, F.sha2(secrets.as_string(F.col("base")), 256).alias("base_sha256"), secrets.as_string(every).alias("spans"))


def op6_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_store(write_store(docs, JSON_TOKENIZER), docs.select("doc_id"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["family"]))), ",")
    lines = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["line"].cast("string"), f["family"])), ",")
    return found.select("doc_id", F.size("findings").cast("long").alias("n_paragraphs"), families.alias("families"), lines.alias("paragraphs"), F.array_max(F.transform("findings", lambda f: f["probability"])).alias("probability"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bpe = ByteBPE(spark, RANKS, public_tokenizers.PATTERN).learn(docs)

    def digest(bound):
        def of(ids):
            decimal = F.array_join(ids.cast("array<string>"), " ")
            return F.struct(F.size(ids).cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2(bound.decode(ids), 256).alias("decoded_sha256"))

        return let(bound.encode(F.col("text")), of)

    return bpe.apply(docs.select("doc_id", "text"), ["doc_id"], "d", digest).select("doc_id", "d.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), JSON_TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSURE = "reach AS (SELECT node, node AS c FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.c)"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c) UNION ALL SELECT b, a FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
nodes AS (SELECT doc_id AS node FROM s), {_CLOSURE}
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(reach.c) AS component_id FROM s JOIN reach ON reach.node = s.doc_id GROUP BY s.doc_id, len(g)
"""

OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.98),
nodes AS (SELECT vec_id AS node FROM v), {_CLOSURE},
c AS (SELECT node, min(c) AS component_id FROM reach GROUP BY node), d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.node = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The other operators rest on hashes, fitted models or byte formats, which SQL cannot express; tests hold them against brute force."""
    return {"op2_ngram_jaccard_join": OP2_SQL, "op4_embedding_near_dedup": OP4_SQL}
