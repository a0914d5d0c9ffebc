"""Best-fit packing of token sequences by large-item matching (operator 10).

Only the lengths matter for where a piece goes, and there are at most ``capacity`` of them. The plan is therefore made
on the histogram of lengths (one number for each length, counted over all pieces): pieces over one third of the capacity
are matched greedily, at most two to a sequence, each with the longest partner that fits; the shorter ones then go, longest first, to
the tightest gap left. The plan's rows say "pieces of this length with ranks a to b go, in order, to the sequences from s on, at
offset o"; every piece finds its row by its length and its rank among the pieces of that length. Ranks are counted in
hashed buckets, so that a length which a third of all pieces have is no single task's work.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed each on their own.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, stage
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, with what is over in front."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", cache: int = 900_000) -> DataFrame:
    """Encode every text, add the end id and cut what is longer than ``capacity``; a worker keeps ``cache`` words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, cache)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for doc, raw in zip(part.column(0).to_pylist(), enc(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(raw, enc.dtype), enc.dtype.type(end_id)).astype("<u4").tobytes()
                    rows += [(doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(encode, "tokens"), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, offset), and the number of sequences."""
    left, used, rows, sequences = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    open_gaps: list[int] = []

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + count, first, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, count))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        length = large[-1]
        if not left[length]:
            large.pop()
            continue
        fit = bisect.bisect_right(large, capacity - length)
        while fit and not left[large[fit - 1]]:
            large.pop(fit - 1)
            fit -= 1
        other = large[fit - 1] if fit else None
        count = left[length] if other is None else left[length] // 2 if other == length else min(left[length], left[other])
        if other == length and not count:  # a last one of its length looks for a shorter partner
            fit -= 1
            while fit and not left[large[fit - 1]]:
                large.pop(fit - 1)
                fit -= 1
            other, count = (large[fit - 1], 1) if fit else (None, 1)
        put(length, count, sequences, 0)
        if other is not None:
            put(other, count, sequences, length)
        leave(capacity - length - (other or 0), sequences, count)
        sequences += count
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, there = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
                count = min(there, left[length])
                leave(gap, first + count, there - count)
                put(length, count, first, capacity - gap)
                leave(gap - length, first, count)
                continue
            each = capacity // length
            whole = max(1, left[length] // each)
            each = min(each, left[length])
            for j in range(each):
                put(length, whole, sequences, j * length)
            leave(capacity - each * length, sequences, whole)
            sequences += whole
    return rows, sequences


def pack(pieces: DataFrame, capacity: int = 1024, buckets: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a table of pieces, which is read more than once and should be a stored one."""
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = buckets or max(16, -(-n // 100_000))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    segments = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, first_sequence long, offset long")
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("in_bucket", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("in_bucket"))
    # The plan has a bounded number of rows at every size of the input: it depends on the lengths that occur.
    placed = ranked.join(F.broadcast(segments), "length").where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, cache: int = 900_000) -> DataFrame:
    """All documents as pieces with their sequence and offset. The encoded pieces' figures are staged once."""
    return pack(stage(piece_table(docs, tokenizer_path, capacity, end_id, cache=cache), "pieces"), capacity)
