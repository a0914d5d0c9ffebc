"""Token-id shards with a minimal perfect hash index (operator 6).

A store is a shared folder of shards. The range of keys is cut into at most ``most_parts`` parts of about equal bytes; a part's documents are
written in ascending order of the key, and a new shard begins after ``shard_bytes``. A shard is two files:

* ``<part>-<n>.ids``: nothing but ids, 16 or 32 bits each, little-endian, one document after another;
* ``<part>-<n>.idx``: a JSON header, then the arrays it lists: ``starts`` (first id of each record, and the end),
  ``words`` and ``ranks`` of the levels of a minimal perfect hash function, and by slot of that function a 32-bit
  ``prints`` (fingerprint of the key) and ``first``/``count`` (the records of that key). Keys themselves are not stored.

The hash function is a cascade of bit arrays: at each level a key that shares its bit with no other key settles there;
the others go on to the next level. The slot is the number of bits set before the key's bit, so that n keys fill the
slots 0 to n-1. A lookup reads the header and a constant number of words by their places in the file, and a key that was never stored fails its
fingerprint, but for one in four billion.

Defined results: a null text is empty; a document of no ids still has its end id; documents that share a key are all
stored, one after another (over several shards if they are long), and a lookup returns them all; a null key is stored under the smallest long.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, partitions, stage
from .order import bucket_of
from .tokens import encoder

NULL_KEY = -(1 << 63)
GAMMA = 1.7
MAX_LEVELS = 64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.bases = np.cumsum([0, *[-(-s // 64) for s in sizes]])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.int64)
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, int(len(left) * GAMMA))
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = alone
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, np.cumsum(counts) - counts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit (such a key was not stored)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            word = self.words[self.bases[level] + (at >> 6)]
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            below = np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.ranks[self.bases[level] + (at[hit] >> 6)] + below
            left = left[~hit]
        return out


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _put(fs, path: str, data: list[bytes]) -> None:
    """Write beside, then rename: a task that is run again or twice leaves the same whole file."""
    import uuid

    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        for x in data:
            out.write(x)
    fs.move(part, path)


def write_shard(root: str, name: str, keys: list[int], payloads: list[bytes], dtype: np.dtype) -> int:
    """Both files of a shard, from records in ascending order of their keys; the number of ids."""
    fs, base = _filesystem(root)
    starts = np.cumsum([0, *[len(p) // dtype.itemsize for p in payloads]]).astype("<i8")
    distinct, first, count = np.unique(np.array(keys, np.int64), return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slots = mph.slots(distinct)
    arrays = {"starts": starts, "words": mph.words.astype("<u8"), "ranks": mph.ranks.astype("<i8")}
    for kind, values, dt in (("prints", prints_of(distinct), "<u4"), ("first", first, "<i8"), ("count", count, "<i8")):
        arrays[kind] = np.empty(len(values), dt)
        arrays[kind][slots] = values
    head = json.dumps({"ids": dtype.str, "sizes": mph.sizes, "arrays": {k: [v.dtype.str, len(v)] for k, v in arrays.items()}}).encode()
    _put(fs, f"{base}/{name}.ids", payloads)
    _put(fs, f"{base}/{name}.idx", [len(head).to_bytes(8, "little"), head, *[v.tobytes() for v in arrays.values()]])
    return int(starts[-1])


class _Held:
    """An array in a file, of which entries are read where they stand, or all at once by ``load``."""

    def __init__(self, file, kind: str, length: int, at: int):
        self.file, self.dtype, self.length, self.at, self.whole = file, np.dtype(kind), length, at, None

    def load(self) -> None:
        self.whole = np.frombuffer(self.file.read_at(self.length * self.dtype.itemsize, self.at), self.dtype)

    def __getitem__(self, places) -> np.ndarray:
        if self.whole is not None:
            return self.whole[places]
        size = self.dtype.itemsize
        return np.array([np.frombuffer(self.file.read_at(size, self.at + int(i) * size), self.dtype)[0] for i in np.atleast_1d(places)], self.dtype)


class ShardReader:
    """Keyed reads of one shard: single keys by ranged reads of the index, many (``bulk``) with the index in memory."""

    def __init__(self, root: str, name: str, bulk: bool = False):
        fs, base = _filesystem(root)
        self.index, self.payload = fs.open_input_file(f"{base}/{name}.idx"), fs.open_input_file(f"{base}/{name}.ids")
        n = int.from_bytes(self.index.read_at(8, 0), "little")
        head, at = json.loads(self.index.read_at(n, 8)), 8 + n
        self.dtype, self.arrays = np.dtype(head["ids"]), {}
        for kind, (dt, length) in head["arrays"].items():
            self.arrays[kind] = _Held(self.index, dt, length, at)
            at += length * np.dtype(dt).itemsize
            if bulk:
                self.arrays[kind].load()
        self.mph = PerfectHash(head["sizes"], self.arrays["words"], self.arrays["ranks"])

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.index.close()
        self.payload.close()

    def find(self, keys: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(place among ``keys``, first id, ids) of every document stored under one of the keys."""
        slots = self.mph.slots(keys)
        there = np.flatnonzero(slots >= 0)
        there = there[self.arrays["prints"][slots[there]] == prints_of(keys[there])]
        out = []
        for i, first, count in zip(there.tolist(), self.arrays["first"][slots[there]].tolist(), self.arrays["count"][slots[there]].tolist()):
            cuts = self.arrays["starts"][np.arange(first, first + count + 1)].tolist()
            for a, b in zip(cuts, cuts[1:]):
                out.append((i, a, np.frombuffer(self.payload.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)))
        return out

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document stored under ``key``, in constant time; none if there is none."""
        return [ids for _, _, ids in self.find(np.array([NULL_KEY if key is None else key], np.int64))]


def _bounds(rows: DataFrame, shard_bytes: int, most_parts: int) -> list[int]:
    """Ascending bounds of parts of about equal bytes: sums of bytes between quantiles of the keys, which are eight times as many as parts."""
    held, low, high = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.min("key"), F.max("key")).first()
    parts = min(most_parts, max(64, -(-(held or 0) // shard_bytes)))
    if low is None or low == high:
        return []
    fine = sorted({int(x) for x in rows.stat.approxQuantile("key", [i / (8 * parts) for i in range(1, 8 * parts)], 0.05 / parts)})
    sums = rows.groupBy(bucket_of(F.col("key"), fine).alias("at")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("n")).collect()
    of, out, now = {r["at"]: r["n"] for r in sums}, [], 0
    for i, bound in enumerate(fine):
        now += of.get(i, 0)
        if now >= held / parts:
            out.append(bound)
            now = 0
    return out


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_bytes: int = 16 << 20, most_parts: int = 2048, root: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write a store; one row for each shard: part, shard, root, n_docs, n_tokens, first_key, last_key.

    Bounds of parts come from the keys and lengths alone, so texts are encoded and shuffled once. A task holds one shard's ids at a time.
    """
    spark = docs.sparkSession
    root = root or new_path(spark, "token-store")
    fs, base = _filesystem(root)
    fs.create_dir(base)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.col(text).cast("string").alias("text"))
    bounds = np.array(_bounds(rows, shard_bytes, most_parts), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = part.column("key")
                parts = np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="right")
                payload = [x + end for x in enc(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), keys, pa.array(payload, pa.binary())], ["part", "key", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer_path).dtype
        now, shard, held, keys, payloads = None, 0, 0, [], []

        def close():
            total = write_shard(root, f"{now:06d}-{shard:06d}", keys, payloads, dtype)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, shard, root, len(keys), total, keys[0], keys[-1])], ["part", "shard", "root", "n_docs", "n_tokens", "first_key", "last_key"])

        for batch in batches:
            for part, k, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if keys and (part != now or held >= shard_bytes):
                    yield close()
                    shard, held, keys, payloads = shard + 1, 0, [], []
                if part != now:
                    now, shard = part, 0
                keys.append(k)
                payloads.append(payload)
                held += len(payload)
        if keys:
            yield close()

    dealt = rows.mapInArrow(encode, "part int, key long, payload binary").repartition(max(partitions(spark), len(bounds) + 1), "part").sortWithinPartitions("part", "key", "payload")
    return stage(dealt.mapInArrow(write, "part long, shard long, root string, n_docs long, n_tokens long, first_key long, last_key long"), "token-manifest")


def read_store(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored documents of some keys, each found through its shard's index: doc_id, start (ids before it in the whole store), n_tokens, ids_crc32.

    A key is sent to its part, which at most ``most_parts`` bounds tell; there the index of each shard whose keys span it is asked. A key that repeats counts once.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min("first_key").alias("low"))
    before = totals.select("part", "low", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    shards = manifest.withColumn("inside", inside).join(before.select("part", "before"), "part").select("part", "shard", "root", "first_key", "last_key", (F.col("before") + F.col("inside")).alias("before"))
    lows = sorted((r["low"], r["part"]) for r in before.select("low", "part").collect())
    asked = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    place = bucket_of(F.col("key"), [low for low, _ in lows[1:]])
    part = F.get(F.array(*[F.lit(p) for _, p in lows]), place).cast("long") if lows else F.lit(0).cast("long")

    def read(key: tuple, wanted: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ks = np.sort(wanted.column("key").to_numpy())
        for row in sorted(held.to_pylist(), key=lambda r: r["shard"]):
            mine = ks[np.searchsorted(ks, row["first_key"]) : np.searchsorted(ks, row["last_key"], side="right")]
            with ShardReader(row["root"], f"{row['part']:06d}-{row['shard']:06d}", bulk=True) as reader:
                for i, at, ids in reader.find(mine):
                    k = int(mine[i])
                    out.append((None if k == NULL_KEY else k, row["before"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        return pa.Table.from_batches([_rows(out)])

    dealt = asked.withColumn("part", part)
    return dealt.groupBy("part").cogroup(shards.groupBy("part")).applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(spark: SparkSession, manifest: DataFrame, key: int | None) -> list[list[int]]:
    """Ids of the documents stored under one key: the manifest rows by their key range, then the index."""
    k = NULL_KEY if key is None else key
    out = []
    for r in manifest.where((F.col("first_key") <= k) & (F.col("last_key") >= k)).select("root", "part", "shard").orderBy("part", "shard").collect():
        with ShardReader(r["root"], f"{r['part']:06d}-{r['shard']:06d}") as reader:
            out += [ids.tolist() for ids in reader.get(k)]
    return out
