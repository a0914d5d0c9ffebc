"""Quality classifier from weak labels (operator 9).

Heuristic labellers look at every text and vote good, bad or nothing. Their votes overlap and err, so how often each is
right is estimated from agreement alone: expectation-maximisation over a model in which each labeller has, for good and for bad documents, its own chances of each
vote. It needs only how often each pattern of votes occurs over all documents (a table whose size depends on the number
of labellers). The posterior of a document's pattern is its label for a logistic scorer over hashed word shapes and pairs of
them, which sees what no labeller looks at. The scorer is fitted on a bounded sample (``sample`` documents, chosen by a hash
of their id and text), statistics and scores cover all documents.

Defined results: a null or blank text scores 0 and is rejected; repeated rows score alike; in an empty table, or where labellers never
disagree, the scorer leans on the votes' prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEPT, lean

BUCKETS = 1024
#: Words added to the length that shares are taken of, so that a few words are weak evidence.
DAMP = 8
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you one "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec sont aux "
    "el y los las del una con por para como su al lo más o pero sus le ya".split()
)
_SYMBOLS = b"#$%&*^~|<>{}[]\\=+@_"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LABELLERS = ("symbols", "capitals", "stutter", "lines", "function_words", "punctuation", "word_length", "variety")


def votes(text: str, words: list[str]) -> list[int]:
    """0 nothing, 1 good, 2 bad for each labeller."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(1, len(raw) - raw.count(b" ")), len(words)

    def two(value: float, good: bool, bad: bool) -> int:
        return 2 if bad else 1 if good else 0

    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / size
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    capitals = upper / max(1, upper + lower)
    out = [two(symbols, symbols < 0.01, symbols > 0.06), two(capitals, capitals < 0.12, capitals > 0.4)]
    stutter = sum(map(eq, words, words[1:])) / max(1, n)
    out.append(two(stutter, n >= 10 and stutter < 0.05, n >= 4 and stutter > 0.3))
    lines = [x for x in text.split("\n") if x]
    same = 1 - len(set(lines)) / max(1, len(lines))
    out.append(two(same, len(lines) >= 3 and same < 0.1, len(lines) >= 4 and same > 0.4))
    common = sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, n)
    out.append(two(common, n >= 5 and common > 0.12, n >= 15 and common < 0.04))
    ends = sum(w[-1] in ".,;:?" for w in words) / max(1, n)
    out.append(two(ends, n >= 5 and 0.03 <= ends <= 0.35, n >= 30 and not 0.005 <= ends <= 0.6))
    mean = len(text) / max(1, n) - 1
    out.append(two(mean, 3 <= mean <= 9, mean > 14 or mean < 2))
    starts = [*range(0, n - 2000, 2000), max(0, n - 2000)]  # the part of a long text that repeats itself most counts
    variety = min(len(set(words[i : i + 2000])) / max(1, min(n, 2000)) for i in starts)
    return [*out, two(variety, n >= 20 and variety > 0.3, n >= 20 and variety < 0.1)]


class _Shapes(dict):
    """word -> number of its shape: letters and digits by kind, runs shortened, other signs as they are."""

    def __missing__(self, word: str) -> int:
        shape, last, run = [], "", 0
        for c in word:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            run = run + 1 if k == last else 1
            last = k
            if run <= (2 if k in "Aa0" else 3):
                shape.append(k)
        number = xxhash.xxh32_intdigest("".join(shape))
        if len(word) <= 64:  # longer words are rare: they are told anew each time, so that the table stays small
            if len(self) >= 100_000:
                self.clear()
            self[word] = number
        return number


_SHAPES = KEPT["quality"] = _Shapes()


def features(words: list[str]) -> np.ndarray:
    """Shares of hashed shapes and of pairs of neighbouring shapes."""
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    for back in (1, 2):  # a word that repeats the one, or the one but one, before it
        s[back:][np.fromiter(map(eq, words[back:], words), bool, max(0, len(words) - back))] = np.uint64(back)
    pairs = (s[:-1] * np.uint64(0x9E3779B1) + s[1:]) % np.uint64(0xFFFFFFFB) if len(s) > 1 else s[:0]
    half = BUCKETS // 2
    one = np.bincount((s % np.uint64(half)).astype(np.int64), minlength=half) / (len(s) + DAMP)
    two = np.bincount((pairs % np.uint64(half)).astype(np.int64), minlength=half) / (len(pairs) + DAMP)
    return np.concatenate([one, two])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Share of good documents, and chances[class, labeller, vote], by expectation-maximisation."""
    k = patterns.shape[1]
    good, bad = (patterns == 1).sum(1), (patterns == 2).sum(1)
    post = np.clip((good + 0.5) / (good + 3.0 * bad + 1), 0.02, 0.98)  # one clear fault outweighs three things in order
    chances = np.zeros((2, k, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        for c in (0, 1):
            for v in (1, 2):
                chances[c, :, v] = ((patterns == v) * weight[c][:, None]).sum(0) + 1
        chances /= chances.sum(2, keepdims=True)
        chances[:, :, 0] = 1  # a labeller that is silent (mostly on short texts) tells nothing
        new = posterior(patterns, prior, chances)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior), chances


def posterior(patterns: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """Chance that a document with these votes is good."""
    picked = [np.log(chances[c][np.arange(patterns.shape[1]), patterns]).sum(1) for c in (0, 1)]
    z = np.log(prior) - np.log1p(-prior) + picked[1] - picked[0]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft labels over square roots of shares."""
    x = np.sqrt(np.hstack([x, np.ones((len(x), 1))])).astype(np.float32)
    w, step, m, v = np.zeros(x.shape[1]), 0.1, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    mass = np.full(len(y), 1.0 / len(y))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (mass * (p - y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _map(docs: DataFrame, names: list[str], types: list, each) -> DataFrame:
    """Columns made from (doc_id, text) by ``each``, which takes a list of texts."""
    schema = ", ".join(["doc_id long", *[f"{n} {t}" for n, t in zip(names, types)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *each(part.column(1).to_pylist())], ["doc_id", *names])

    return docs.mapInArrow(lean(run, "quality"), schema)


def sampled(total: float, sample: int) -> Column:
    """Whether a row is one of about ``sample`` of ``total``: its 63-bit hash against a bound, so that any total can be sampled from.

    The expected number is at least 200 where there are as many rows, since none at all would leave nothing to fit.
    """
    bound = min((1 << 63) - 1, int(max(sample, 200) / max(1.0, total) * (1 << 63)))
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= F.lit(bound)


def train(docs: DataFrame, sample: int = 6000) -> np.ndarray:
    """The scorer's weights. Votes of all documents are counted by pattern; the fit sees ``sample`` documents at most (about)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def patterns(texts):
        return [pa.array([bytes(votes(t, t.split())) if t and not t.isspace() else None for t in texts], pa.binary())]

    found = [(np.frombuffer(r["p"], np.uint8), r["n"]) for r in _map(rows, ["p"], ["binary"], patterns).where("p is not null").groupBy("p").agg(F.count("*").alias("n")).collect()]
    if not found:
        return np.zeros(BUCKETS + 1)
    table, counts = np.stack([p for p, _ in found]).astype(np.int64), np.array([n for _, n in found], float)
    prior, chances = fit_labellers(table, counts)
    chosen = rows.where(sampled(counts.sum(), sample) & F.col("text").rlike(r"\S"))

    def both(texts):
        split = [t.split() for t in texts]
        return [pa.array([bytes(votes(t, w)) for t, w in zip(texts, split)], pa.binary()), pa.array([features(w).astype(np.float16).tobytes() for w in split], pa.binary())]

    got = _map(chosen, ["p", "x"], ["binary", "binary"], both).select("p", "x").toPandas()
    if got.empty:
        raise ValueError(f"no document was sampled of {counts.sum():.0f}: the scorer can't be fitted")
    y = posterior(np.stack([np.frombuffer(p, np.uint8) for p in got["p"]]).astype(np.int64), prior, chances)
    return fit_scorer(np.stack([np.frombuffer(x, np.float16) for x in got["x"]]).astype(np.float32), y)


def score(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """The documents with a column ``name``, the chance that they are good; all their columns stay."""
    w, bias = weights[:-1].astype(np.float32), float(weights[-1])
    out_schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def chance(text: str | None) -> float:
        words = text.split() if text else []
        return float(1 / (1 + np.exp(-np.clip(np.sqrt(features(words)) @ w + bias, -40, 40)))) if words else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values = pa.array([chance(t) for t in part.column(at).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])

    return docs.mapInArrow(lean(run, "quality"), out_schema)


def classify(docs: DataFrame, sample: int = 6000, threshold: float = 0.5) -> DataFrame:
    """doc_id, quality_score and keep of every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return score(rows, train(docs, sample)).select("doc_id", "quality_score", (F.col("quality_score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, sample: int = 6000, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return score(docs, train(docs, sample), "__llm_score").where(F.col("__llm_score") >= threshold).select(*docs.columns)
