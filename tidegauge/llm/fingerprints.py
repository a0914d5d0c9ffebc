"""Order MinHash fingerprints of documents with DataFrame functions only (operator 1).

A text is read as a sequence of pieces: up to six characters of a word, with the white space in front. Its k-mers are
k pieces in a row (fewer at its start), and a k-mer that comes again carries the number of its occurrence, so that
repetition counts. Every numbered k-mer has a hash, whose first bits choose one of 64 slots and whose other bits rank it
there. Of each slot the two minimal k-mers are selected and put back into the order in which they stand in the text;
the hash of that ordered pair is the slot's entry. Two texts agree in a slot if the same k-mers won it in the same order,
which needs few edits between them: moved passages change entries as well as new ones do.

The likeness of two fingerprints is the share of slots that agree among those that either text fills.

Defined results: a null text is empty; empty texts have 64 empty slots, likeness 1 to each other and 0 to any other;
equal texts have equal fingerprints; rows that share a doc_id follow each other by a hash of their text; the only row
of a table is its own next document. Positions are kept in 24 bits, so texts over 16 million pieces (some 50 MB) compare
the order of their k-mers modulo that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .order import with_next

SLOTS = 64
PIECE = r"\s*+\S{1,6}|\s++"
PLACE = (1 << 24) - 1
FIRST = ~PLACE
EMPTY = "...."


def _same(a: Column, b: Column, mask: int) -> Column:
    return a.bitwiseXOR(b).bitwiseAND(F.lit(mask)) == 0


def _occurrence(s: Column, x: Column, j: Column) -> Column:
    """How many entries before j of the sorted array have x's k-mer: bisection, as equal ones lie side by side."""
    steps = F.lit([1 << i for i in reversed(range(24))])
    first = F.aggregate(steps, j, lambda at, step: F.when((at >= step) & _same(F.get(s, F.greatest(at - step, F.lit(0))), x, FIRST), at - step).otherwise(at))
    return F.when((j > 0) & _same(F.get(s, F.greatest(j - 1, F.lit(0))), x, FIRST), j - first).otherwise(F.lit(0))


def _numbered(codes: Column) -> Column:
    """Hash of (k-mer, occurrence) in the first 40 bits, place in the others, ascending."""
    code = lambda s: F.transform(s, lambda x, j: F.xxhash64(x.bitwiseAND(F.lit(FIRST)), _occurrence(s, x, j)).bitwiseAND(F.lit(FIRST)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))
    return F.sort_array(let(F.sort_array(codes), code))


SLOT_BITS = 63 << 58


def _entries(sorted_codes: Column) -> Column:
    """(slot, entry) of each slot that has a k-mer."""
    slot_mask = SLOT_BITS - (1 << 64)

    def entry(t: Column, x: Column, j: Column) -> Column:
        y = F.get(t, j + 1)
        pair = y.isNotNull() & _same(x, y, slot_mask)
        a, b = x.bitwiseAND(F.lit(FIRST)), y.bitwiseAND(F.lit(FIRST))
        ahead = x.bitwiseAND(F.lit(PLACE)) <= y.bitwiseAND(F.lit(PLACE))
        h = F.when(~F.coalesce(pair, F.lit(False)), F.xxhash64(a)).when(ahead, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        return F.struct(F.shiftrightunsigned(x, 58).cast("int").alias("slot"), h.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("entry"))

    opens = lambda t, x, j: (j == 0) | ~_same(x, F.get(t, F.greatest(j - 1, F.lit(0))), slot_mask)
    return let(sorted_codes, lambda t: F.filter(F.transform(t, lambda x, j: F.when(opens(t, x, j), entry(t, x, j))), lambda e: e.isNotNull()))


def fingerprint(text: Column, k: int = 3) -> Column:
    """64 slots as array<int>: an entry of 16 bits, or -1 for an empty slot."""

    def codes(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.xxhash64(x, *[F.get(p, i - n) for n in range(1, k)]).bitwiseAND(F.lit(FIRST)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE))))

    found = let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), codes)
    return let(F.map_from_entries(_entries(_numbered(found))), lambda m: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.coalesce(F.try_element_at(m, s), F.lit(-1))))


def as_string(slots: Column) -> Column:
    """Four hexadecimal digits for each slot, dots for an empty one."""
    return F.array_join(F.transform(slots, lambda e: F.when(e < 0, F.lit(EMPTY)).otherwise(F.lpad(F.lower(F.hex(e)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots that agree among those that either fills; 1 if both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), F.lit(0)).when(x == y, F.lit(1 << 16 | 1)).otherwise(F.lit(1))), F.lit(0), lambda n, x: n + x)
    share = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.shiftright(n, 16).cast("double") / n.bitwiseAND(F.lit(0xFFFF)).cast("double"))
    return let(both, share)


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by the first as many of the following text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def with_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text, slots, and ``next`` with the text and the slots of the next document in the order of doc_id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    add = lambda df: df.withColumn("slots", fingerprint(F.col("text"), k))
    return with_next(rows, "doc_id", "tie", "next", ["text", "slots"], add).drop("tie")


def compare_with_edits(docs: DataFrame, k: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    rows = with_fingerprints(docs, k).withColumn("other", edited(F.col("text"), F.col("next.text"))).withColumn("other_slots", fingerprint(F.col("other"), k))
    return rows.select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("other", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("slots")).alias("fingerprint"),
        as_string(F.col("other_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("other_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next.slots")).alias("near_next"),
    )
