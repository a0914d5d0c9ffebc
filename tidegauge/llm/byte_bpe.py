"""Byte-level BPE encoding and decoding with Spark's higher-order functions (operator 8).

A text is cut into words by the published pattern. A word is folded over its merges in order of rank: the state is a string with one sign for each
part (a byte's own Latin-1 character, or a sign of the token's id), and the step of a token unites its two parts, from the left, wherever they stand.
The tokens whose bytes the word holds are all that can come up; they are found by the first bytes at each place, and sorted by rank.

This is the method's result (again and again the leftmost pair of lowest rank) if every token is made, from its bytes, by merges of lower rank only, the last of
which unites two parts: then any two neighbours with a union are that token's two parts (else its own bytes would merge otherwise), both of lower rank,
so a merge makes new pairs of higher rank only, and ranks come up in ascending order. ``read_merges`` checks this for each token. A vocabulary that is
not so is folded by searching: the state is the list of parts and, for each part, the rank of its union with the next; each step unites the leftmost
pair of lowest rank, until no union has one.

Tables are literals of the plan (scalar subqueries, which the engine replaces by their values before the query runs). Those by key are arrays of small maps, in
which a hash of the key picks the map, so that a look-up does not walk through the vocabulary. The literals are bound to a lambda variable once for each row,
so the plan holds one copy of them.

A word that is a token itself needs no fold, and words that are frequent need only one: a second literal holds the ids of all tokens and of up to
``cache_words`` distinct words, folded once, that are frequent in about ``cache_docs`` documents chosen by a hash. This cache only saves work:
every word that it lacks is folded where it stands, so results do not depend on it.

Decoding joins the byte strings of the ids (kept as Latin-1 strings, in which each character is a byte). Defined results: null and empty
texts have no ids; repeated rows are encoded each. A step passes over the whole word, and a long word has as many steps as different tokens in its bytes;
when the fold searches, a word costs the square of its length.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, partitions, stage


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def read_merges(path: str) -> dict[bytes, tuple[bytes, bytes]] | None:
    """The two parts of every token of two bytes or more; None unless merges of lower rank leave just two parts of each."""
    ranks, out = read_ranks(path), {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            if any(len(x) > 1 and ranks[x] >= rank for x in parts):
                return None
            out[token] = tuple(parts)
    return out


def _hash(key: Column, size: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(size - 1))


def _table(entries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with an array of maps, and its length, from rows (k, v): entry k is in the map that its hash picks."""
    size = 1 << max(4, (n - 1).bit_length())
    some = entries.groupBy(_hash(F.col("k"), size).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    empty = F.create_map().cast(some.schema["m"].dataType)
    every = entries.sparkSession.range(0, size, 1, 1).join(some, "id", "left").select("id", F.coalesce("m", empty).alias("m"))
    return every.repartition(1).sortWithinPartitions("id").agg(F.collect_list("m").alias("t")), size


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def _get(table: Column, size: int, key: Column) -> Column:
    return F.try_element_at(F.get(table, _hash(key, size).cast("int")), key)


NO_RANK = 0x7FFFFFFF
LOW = 0xFFFFFFFF
HIGH = NO_RANK << 32
#: Signs of tokens of two bytes or more: the id above this code point. There are SIGNS of them.
SIGN = 0x10000
SIGNS = 0x100000
#: A place knows its tokens by so many bytes, and longer ones by their lengths.
HEAD = 4
#: Longer words are looked through in pieces of so many bytes, since reaching a place in a string takes as long as it is far.
PIECE = 256


class Bound:
    """Expressions over the tables of one row's scope."""

    def __init__(self, bpe: ByteBPE, tables: Column):
        self.bpe, self.tables = bpe, tables

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.bpe.pattern), F.lit(0))

    def union(self, a: Column, b: Column) -> Column:
        """Rank, that is the id, of two parts' union; null if it is no token or a part is missing."""
        return _get(self.tables["pairs"], self.bpe.pair_size, _pair(a, b))

    def known(self, word: Column) -> Column:
        return _get(self.tables["known"], self.bpe.known_size, word)

    def _held(self, piece: Column, places: Column) -> Column:
        """Ids of the tokens of two bytes or more that begin at the first ``places`` bytes of ``piece``; some are null."""
        at = lambda i, n: F.substring(piece, i, n)
        head = lambda i, n: _get(self.tables["heads"], self.bpe.head_size, at(i, F.lit(n)))
        heads = lambda i: F.coalesce(*[head(i, n) for n in range(HEAD, 1, -1)], F.array().cast("array<int>"))
        longer = lambda i, n: _get(self.tables["long"], self.bpe.long_size, at(i, n))
        return F.flatten(F.transform(F.sequence(F.lit(1), places), lambda i: F.transform(heads(i), lambda x: F.when(x >= 0, x).otherwise(longer(i, -x)))))

    def fold(self, word: Column) -> Column:
        """Ids of one word."""
        return self.fold_ranked(word) if self.bpe.ranked else self.fold_searching(word)

    def fold_ranked(self, word: Column) -> Column:
        def merged(signs: Column) -> Column:
            n = F.length(signs)
            piece = lambda i: let(F.substring(signs, i, F.lit(PIECE + self.bpe.longest)), lambda p: self._held(p, F.least(F.length(p), F.lit(PIECE))))
            pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n, F.lit(PIECE)), piece)))
            held = F.when(n <= PIECE, self._held(signs, F.greatest(n - 1, F.lit(1)))).otherwise(pieces)
            steps = F.sort_array(F.filter(held, lambda x: x.isNotNull()))
            return F.aggregate(steps, signs, lambda acc, x: F.replace(acc, F.get(self.tables["parts"], x), F.get(self.tables["signs"], x)))

        ids = lambda c: let(F.ascii(c), lambda a: F.when(a < 256, F.get(self.tables["bytes"], a)).otherwise(a - SIGN))
        return F.transform(F.split(let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), merged), ""), ids)

    def _part(self, x: Column) -> Column:
        return (x.bitwiseAND(F.lit(LOW)) - 1).cast("int")

    def _pack(self, rank: Column, part: Column) -> Column:
        return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)).cast("long"), 32).bitwiseOR((part + 1).cast("long"))

    def fold_searching(self, word: Column) -> Column:
        """For any ranks. The state is one array of longs: a part, and above it the rank of its union with the next.

        An element that stands for nothing comes first, so that every part has one before it.
        """
        signs = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        parts = F.concat(F.array(F.lit(-1)), F.transform(signs, lambda c: F.get(self.tables["bytes"], F.ascii(c))))
        start = let(parts, lambda p: F.transform(p, lambda x, i: self._pack(self.union(x, F.get(p, i + 1)), x)))

        def merge(acc: Column, one: Column, at: Column) -> Column:
            """The parts at places at and at + 1 (from 0) become ``one``; the ranks on both sides follow."""
            before = self._part(F.get(acc, at - 1))
            new = F.array(self._pack(self.union(before, one), before), self._pack(self.union(one, self._part(F.get(acc, at + 2))), one))
            return F.concat(F.slice(acc, F.lit(1), at - 1), new, F.slice(acc, at + 3, F.size(acc)))

        def step(acc: Column, _: Column) -> Column:
            # rank and place in one number: array_position leaves its loop by an exception, which costs more than all else here
            lowest = F.array_min(F.transform(acc, lambda x, i: x.bitwiseAND(F.lit(HIGH)).bitwiseOR(i.cast("long"))))
            return let(lowest, lambda low: F.when(low >= NO_RANK << 32, acc).otherwise(merge(acc, F.shiftright(low, 32).cast("int"), low.bitwiseAND(F.lit(LOW)).cast("int"))))

        times = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
        return let(start, lambda s: F.aggregate(times, s, step, lambda acc: F.transform(F.slice(acc, F.lit(2), F.size(acc)), self._part)))

    def encode(self, text: Column) -> Column:
        """Ids of a text: array<int>."""
        return F.flatten(F.transform(self.words(text), lambda w: F.coalesce(self.known(w), self.fold(w))))

    def decode(self, ids: Column) -> Column:
        """Bytes of ids; an id outside the vocabulary makes the result null."""
        signs = F.transform(ids, lambda i: F.get(self.tables["pieces"], i))
        inside = F.coalesce((F.array_min(ids) >= 0) & (F.array_max(ids) < self.bpe.size), F.size(ids) == 0)
        return F.when(inside, F.encode(F.array_join(signs, ""), "ISO-8859-1"))


class ByteBPE:
    """The tables of one vocabulary of ranks."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks, merges = read_ranks(path), read_merges(path)
        self.pattern, self.size = "(?U)" + pattern, len(ranks)
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be 0, 1, 2 ... and hold every byte")
        rows = spark.createDataFrame(pa.table({"k": [k.decode("latin-1") for k in ranks], "v": pa.array(ranks.values(), pa.int32())}), "k string, v int")
        self.vocabulary = stage(rows, "ranks")
        self.ranked = merges is not None and len(ranks) <= SIGNS
        self.tables = self._by_rank(spark, ranks, merges) if self.ranked else self._by_pair()
        self.byte_table = spark.createDataFrame([([ranks[bytes([b])] for b in range(256)],)], "t array<int>").coalesce(1)
        self.piece_table = self.vocabulary.repartition(1).sortWithinPartitions("v").agg(F.collect_list("k").alias("t"))
        whole = F.expr("try_validate_utf8(cast(encode(k, 'ISO-8859-1') as string))")
        self.tokens = self.vocabulary.select(whole.alias("k"), F.array("v").alias("v")).where("k is not null")
        self.known_table, self.known_size = _table(self.tokens, len(ranks))

    def _by_rank(self, spark: SparkSession, ranks: dict[bytes, int], merges: dict[bytes, tuple[bytes, bytes]]) -> dict[str, DataFrame]:
        """By id, the sign of a token and those of its parts; by the first bytes at a place, the ids of tokens there and, below zero, lengths of longer ones."""
        sign = lambda token: token.decode("latin-1") if len(token) == 1 else chr(SIGN + ranks[token])
        signs, parts = [None] * self.size, [None] * self.size
        heads: dict[bytes, set[int]] = defaultdict(set)
        for token, rank in ranks.items():
            signs[rank] = sign(token)
            if token in merges:
                parts[rank] = "".join(map(sign, merges[token]))
                for n in range(2, min(len(token), HEAD) + 1):
                    heads[token[:n]] |= {ranks[token[:k]] for k in range(2, n + 1) if token[:k] in ranks}
                if len(token) > HEAD:
                    heads[token[:HEAD]].add(-len(token))
        rows = pa.table({"k": [k.decode("latin-1") for k in heads], "v": pa.array([sorted(v) for v in heads.values()], pa.list_(pa.int32()))})
        long = self.vocabulary.where(F.length("k") > HEAD)
        self.longest = max(map(len, ranks))
        head_table, self.head_size = _table(spark.createDataFrame(rows, "k string, v array<int>"), len(heads))
        long_table, self.long_size = _table(long, sum(len(t) > HEAD for t in ranks))
        by_id = lambda x: spark.createDataFrame(pa.table({"t": pa.array([x], pa.list_(pa.string()))}), "t array<string>").coalesce(1)
        return {"heads": head_table, "long": long_table, "parts": by_id(parts), "signs": by_id(signs)}

    def _by_pair(self) -> dict[str, DataFrame]:
        """Every way to cut a token into two tokens: the vocabulary joined with its prefixes and suffixes."""
        cuts = self.vocabulary.select("v", "k", F.explode(F.sequence(F.lit(1), F.greatest(F.length("k") - 1, F.lit(1)))).alias("n")).where("n < length(k)")
        cuts = cuts.select("v", F.substring("k", F.lit(1), F.col("n")).alias("a"), F.substring("k", F.col("n") + 1, F.length("k")).alias("b"))
        left, right = (self.vocabulary.select(F.col("k").alias(c), F.col("v").alias(f"i{c}")) for c in "ab")
        pairs = stage(cuts.join(left, "a").join(right, "b").select(_pair(F.col("ia"), F.col("ib")).alias("k"), "v"), "pairs")
        pair_table, self.pair_size = _table(pairs, pairs.count())
        return {"pairs": pair_table}

    def apply(self, df: DataFrame, kept: list[str], name: str, body: Callable[[Bound], Column]) -> DataFrame:
        """``df`` with the columns ``kept`` and ``name``: an expression in which ``body`` sees the tables.

        The optimizer puts the subqueries' values into the expression; no row ever carries a table.
        """
        tables = self.tables | {"bytes": self.byte_table, "known": self.known_table, "pieces": self.piece_table}
        wide = df.select("*", *[t.scalar().alias(f"_{k}") for k, t in tables.items()])
        return wide.select(*kept, let(F.struct(*[F.col(f"_{k}").alias(k) for k in tables]), lambda t: body(Bound(self, t))).alias(name))

    def learn(self, docs: DataFrame, text: str = "text", cache_words: int = 200_000, cache_docs: int = 40_000) -> ByteBPE:
        """Put the ids of frequent words into the literal. Bounded by both arguments; other words are folded in place."""
        n = docs.count()
        some = docs.select(F.col(text).cast("string").alias("t"))
        if n > cache_docs:
            some = some.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(1_000_000 * cache_docs / n))
        split = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(self.pattern), F.lit(0))
        words = some.select(F.explode(F.array_distinct(split)).alias("k")).where(F.length("k") <= 64).groupBy("k").agg(F.count("*").alias("n")).where("n >= 2")
        top = words.join(self.tokens.select("k"), "k", "left_anti").orderBy(F.desc("n"), "k").limit(cache_words)
        top = stage(top.repartition(partitions(docs.sparkSession)), "words")
        folded = stage(self.apply(top, ["k"], "v", lambda b: b.fold(F.col("k"))), "words")
        every = self.tokens.union(folded)
        self.known_table, self.known_size = _table(stage(every, "words"), self.size + folded.count())
        return self


def encode_documents(docs: DataFrame, path: str, pattern: str, cache_words: int = 200_000, cache_docs: int = 40_000) -> DataFrame:
    """doc_id, ids and the decoded bytes of every text."""
    bpe = ByteBPE(docs.sparkSession, path, pattern).learn(docs, cache_words=cache_words, cache_docs=cache_docs)
    both = lambda b: let(b.encode(F.col("text").cast("string")), lambda i: F.struct(i.alias("ids"), b.decode(i).alias("decoded")))
    return bpe.apply(docs.select("doc_id", "text"), ["doc_id"], "e", both).select("doc_id", "e.*")
