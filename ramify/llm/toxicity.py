"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

The text is folded (lower case, homoglyphs, digits that stand for letters inside a word) and padded
so that every word is preceded by a space. The lexicon's terms are whole words and beginnings of words, each
with a weight; exception phrases (a longer word, or a term's word and its neighbour before or after) have none. Of all
patterns that begin at one word the longest counts, and a pair of words also exempts what its second word holds, so an
exception overrides the terms it holds. The score is a logistic
function of the weights' sum normalised by length, the number of hits and of distinct terms.

Everything is learned from labelled rows, of which a bounded sample is taken: at most
SAMPLE_PER_LABEL per label, by a hash of doc_id, and of the terms and the exceptions of each kind at most MAX_TERMS. A term's weight is its smoothed log-odds over the
documents that hold it. Pairs are counted in a second pass over the sample, only around words that hold a term. Rows whose crc32(doc_id as text) mod 3 is 1 are held out.

Edge cases: a null, empty or blank text has no hits and the lowest score. Without labelled rows of both kinds
nothing is learned: every score is 0. Labels without a document and null labels don't count; a doc_id with both labels
counts as toxic, and of several texts under one doc_id the least is learned from. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ids_and_text, ship, text_or_empty, tidy

SAMPLE_PER_LABEL = 4000
MAX_TERMS = 3000
MIN_DOCS = 4
MIN_WEIGHT = 2.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8, 10, 12)
#: Characters that look like a Latin letter; digits and signs that stand for one.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ν": "v", "к": "k", "м": "m", "т": "t",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
_FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD)}
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SUBSTITUTES = str.maketrans(SUBSTITUTES)
_STANDING_IN = re.compile(r"[0-9@$!]+")
_REST = re.compile(r"[^\W_]*(?:[@$!]+[^\W_]*)*")
_MIXED = re.compile(r"[^\W\d_]*(?:[0-9@$!]+[^\W\d_]+)+[0-9$!]*|[^\W\d_]+[0-9$]+")
_APART = re.compile(r"[\W_]+")


def unmixed(low: str) -> str:
    """Digits and signs inside words replaced by the letters they stand for. Only runs of such characters and letters are searched."""
    out, at = [], 0
    for m in _STANDING_IN.finditer(low):
        begin, end = m.span()
        if begin < at:
            continue  # in the run before
        while begin > at and low[begin - 1].isalnum():
            begin -= 1
        end = _REST.match(low, end).end()  # type: ignore[union-attr]
        if end - begin > len(m[0]):
            out += [low[at:begin], _MIXED.sub(lambda x: x[0].translate(_SUBSTITUTES), low[begin:end])]
            at = end
    return "".join(out) + low[at:] if out else low


def fold(text: str) -> str:
    """Words, lower-cased and folded, each with a space before it, and one at the end."""
    low = text.lower()
    if not low.isascii() and _ODD.search(low):
        low = low.translate(_FOLD).lower()
    return " " + _APART.sub(" ", unmixed(low)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """weights: pattern -> weight (a beginning of a word is ' abc', a whole word ' abc ', a pair ' abc de '); 0.0 is an exception."""

    weights: tuple[tuple[str, float], ...] = ()
    model: tuple[float, ...] = field(default=())


@lru_cache(maxsize=2)
def _automaton(weights: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, weight in weights:
        a.add_word(pattern, (len(pattern), weight, pattern, max(0, pattern.find(" ", 1, -1))))
    a.make_automaton()
    return a


def features(text: str, weights: tuple[tuple[str, float], ...]) -> tuple[float, float, float]:
    """(weight per root of words, distinct terms, greatest weight)."""
    if not weights:
        return 0.0, 0.0, 0.0
    folded = fold(text)
    longest: dict[int, tuple[int, float, str, int]] = {}
    exempt: set[int] = set()
    for end, found in _automaton(weights).iter(folded):
        start = end + 1 - found[0]
        if start not in longest or longest[start][0] < found[0]:
            longest[start] = found
        if found[3]:
            exempt.add(start + found[3])
    hits = [x for start, x in longest.items() if x[1] > 0 and start not in exempt]
    if not hits:
        return 0.0, 0.0, 0.0
    n = max(10, folded.count(" ") - 1)
    return sum(x[1] for x in hits) / math.sqrt(n), math.log1p(len({x[2] for x in hits})), max(x[1] for x in hits)


def score(text: str, lexicon: Lexicon) -> float:
    if not lexicon.model:
        return 0.0
    z = lexicon.model[0] + sum(c * x for c, x in zip(lexicon.model[1:], features(text, lexicon.weights), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    words = fold(text).split()
    out: set[str] = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


def _pairs(text: str, holds: Callable[[str], bool]) -> set[str]:
    """Neighbouring words of which one holds a term."""
    words = fold(text).split()
    return {f" {a} {b} " for a, b in pairwise(words) if holds(a) or holds(b)}


@lru_cache(maxsize=1)
def _holder(terms: tuple[tuple[str, float], ...]) -> Callable[[str], bool]:
    """Whether the longest pattern that begins at a word is a term."""
    weights = dict(terms)

    @lru_cache(maxsize=1 << 18)
    def holds(word: str) -> bool:
        starts = (f" {word[:n]}" for n in reversed(PREFIXES) if n < len(word))
        return next((weights[x] > 0 for x in (f" {word} ", *starts) if x in weights), False)

    return holds


def _count(batches: Iterator[pa.RecordBatch], found_in: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    of: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of[label].update(found_in(text))
    terms = list(of[0].keys() | of[1].keys())
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([of[1][t] for t in part], pa.int64()), pa.array([of[0][t] for t in part], pa.int64())], ["term", "d1", "d0"])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge; weight: the rows that each row stands for."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 0.05 * w * np.r_[0, np.ones(len(w) - 1)]
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Lexicon:
    """The lexicon and its model, from labelled rows that aren't held out. A row of the sample counts in the fit for as many as its label has."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_LABEL)
        picked = part if picked is None else picked.unionByName(part)
    picked = scratch.put(picked, "picked")  # at most 2 * SAMPLE_PER_LABEL rows of 12 bytes
    sample = ids_and_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = scratch.put(sample.select("text", "label"), "sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon()

    def counted(found_in: Callable[[str], set[str]]) -> DataFrame:
        return sample.mapInArrow(tidy(lambda batches: _count(batches, found_in)), "term string, d1 long, d0 long").groupBy("term").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))

    weight = F.log((F.col("d1") + 0.5) / (n1 + 1.0)) - F.log((F.col("d0") + 0.5) / (n0 + 1.0))
    gain = F.col("d1") / F.lit(float(n1)) - 4 * F.col("d0") / F.lit(float(n0))
    terms = scratch.put(counted(_terms).withColumn("w", weight).withColumn("gain", gain), "terms")
    top = terms.where((F.col("d1") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT)).orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()
    weights = {r["term"]: r["w"] for r in top}
    # a beginning that is told by a longer one alone, at the same weight, adds nothing; an exception is a frequent extension without weight
    starts = tuple(sorted(t for t in weights if not t.endswith(" ")))
    if starts:
        longer = terms.where((F.col("d0") >= MIN_DOCS) & (F.col("w") < 0.5))
        longer = longer.where(F.substring("term", 1, 1 + PREFIXES[0]).isin(sorted({t[: 1 + PREFIXES[0]] for t in starts})))
        for r in longer.orderBy(F.desc("d0"), "term").limit(MAX_TERMS).collect():
            if r["term"].startswith(starts):
                weights.setdefault(r["term"], 0.0)
    if weights:
        known = tuple(sorted(weights.items()))

        def around(text: str) -> set[str]:
            return _pairs(text, _holder(known))

        pairs = counted(around).withColumn("w", weight).where((F.col("d0") >= MIN_DOCS) & (F.col("w") < 0.5))
        for r in pairs.orderBy(F.desc("d0"), "term").limit(MAX_TERMS).collect():
            weights[r["term"]] = 0.0
    frozen = tuple(sorted(weights.items()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, frozen) for t in batch.column(0).to_pylist()]
            columns = zip(*got, strict=True) if got else ([],) * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), batch.column(1)], ["x0", "x1", "x2", "label"])

    data = np.array(sample.mapInArrow(tidy(measured), "x0 double, x1 double, x2 double, label int").collect(), float)  # 2 * SAMPLE_PER_LABEL rows at most
    data = data[np.lexsort(data.T)]
    # both kinds weigh what they do among all labelled rows, however many of them the sample has
    return Lexicon(frozen, _fit(data[:, :3], data[:, 3], np.where(data[:, 3] == 1, labelled[1] / n1, labelled[0] / n0)))


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = ids_and_text(docs).mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs whose score is below the threshold; all columns stay, and each row is judged where it is, without a join."""
    ship(docs.sparkSession)
    names = docs.columns

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(lambda texts: (pa.array([score(t.as_py(), lexicon) for t in batch], pa.float64()) for batch in texts))(batches)

    return docs.where(toxicity(text_or_empty()) < THRESHOLD).select(*names)


def learn_from(spark: SparkSession, sf_dir: str) -> Lexicon:
    ship(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return learn(read("documents"), read("labels"), Scratch(spark))
