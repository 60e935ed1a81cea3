"""Quality rules: distribution divergence from language references.

A document's histogram over character classes and its histogram over each language's common words (with a bin for all other words)
are compared with the references by the Jensen-Shannon distance (base 2, the root of the
divergence). A document passes if it is near to one language in both. The greatest distance allowed rises as documents get shorter (WORD_LIMITS, CHAR_LIMITS);
below the last length labelled clean documents and junk overlap, and the histogram doesn't count.

The references are the sums of these histograms over the documents of a language that are within the limits of
a first reference, the sum over all its documents. So junk has no part in what it is compared with, unless it is most of the language's text.

The text is read once: counts go to a small table, references are summed from it (bounded: languages
times bins), and distances are computed from it by DataFrame functions, shares and entropies once a histogram.

Edge cases: null or empty text has no words and fails. Languages without a word list here don't make a
reference; their documents are compared with those that there are. If no language has a document, nothing is compared,
the base rules alone judge and the distances are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ship, slices, text_or_empty, tidy
from ramify.llm.neardup import _hashes, _odd

#: (least length, greatest distance), longest first. Chosen above the distances of labelled clean documents of such lengths
#: (words: at most 0.270, 0.300, 0.331, 0.343; code points: 0.266, 0.324).
WORD_LIMITS = ((100, 0.28), (80, 0.31), (60, 0.34), (40, 0.35))
CHAR_LIMITS = ((400, 0.28), (100, 0.34))
REPEAT_WINDOW = 8
#: Frequent function words.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux".split(),
}
LANGUAGES = tuple(COMMON_WORDS)
CLASSES = ("lower", "upper", "beyond_ascii", "digit", "space", "break", "punctuation", "symbol", "other")
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t"), ("break", b"\n\r\x0b\x0c"),
        ("punctuation", b".,;:!?'\"()-"), ("symbol", _SYMBOLS), ("beyond_ascii", range(0xC0, 256)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)  # continuation bytes are no code points
    return table


_CLASS = _classes()
_WINDOW = _odd(REPEAT_WINDOW, 401)
_WIDTHS = [len(COMMON_WORDS[x]) + 1 for x in LANGUAGES]
_STARTS = np.cumsum([0, *_WIDTHS])


class _Bins(dict):
    """Word -> its bins in the concatenated histograms of all languages, as a tuple."""

    def __init__(self) -> None:
        super().__init__()
        self.index = [{w: i for i, w in enumerate(COMMON_WORDS[x])} for x in LANGUAGES]
        self.codes: dict[tuple, int] = {}
        self.table: list[tuple] = []

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        plain = word.decode().strip(".,;:!?'\"()-").lower()
        bins = tuple(int(_STARTS[k]) + own.get(plain, len(own)) for k, own in enumerate(self.index))
        if bins not in self.codes:
            self.codes[bins] = len(self.table)
            self.table.append(bins)
        self[word] = self.codes[bins]
        return self[word]


_bins = _Bins()


def repeated_words(h: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window found twice or more. h: a hash per word."""
    m = len(h) - width + 1
    if m < 2:
        return 0
    s = np.zeros(m, np.uint64)
    for j in range(width):
        s += h[j : j + m] * _WINDOW[j]
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    edges = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(count[inverse] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    raw = text.encode()
    words = raw.split()
    classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.encode().split():
            repeats += line in seen
            seen.add(line)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    counts = np.zeros(int(_STARTS[-1]), np.int64)
    if words:
        of_code = np.bincount(np.fromiter(map(_bins.__getitem__, words), np.int64, len(words)))
        for code in np.flatnonzero(of_code).tolist():
            counts[list(_bins.table[code])] += of_code[code]
    return len(words), int(classes.sum()) - blank, int(classes[CLASSES.index("symbol")]), repeats, repeated_words(h), classes.tolist(), counts.tolist()


_SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            rows = [measure(x) for x in part.column(2).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"])


def _tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return tidy(_measure, _hashes, _bins)(batches)


def _negentropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def _shares(own: Column, total: Column) -> Column:
    return F.when(total > 0, F.transform(own, lambda n: n / F.nullif(total, F.lit(0))))


def _distance(shares: Column, reference: list[float], negentropy: Column) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram's shares, whose negative entropy is given, and a reference's."""
    mean = _negentropy(F.zip_with(shares, F.array(*map(F.lit, reference)), lambda p, q: (p + q) / 2))
    of_reference = sum(q * math.log2(q) for q in reference if q > 0)
    return F.when(shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), (negentropy + of_reference) / 2 - mean)))


def _limit(length: Column, limits: tuple[tuple[int, float], ...]) -> Column:
    out = F.lit(None).cast("double")
    for least, most in reversed(limits):
        out = F.when(length >= least, F.lit(most)).otherwise(out)
    return out


def _with_shares(counts: DataFrame) -> DataFrame:
    size, n = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x), F.col("n_words")
    shares = {f"w{k}": _shares(F.slice("words", int(_STARTS[k]) + 1, _WIDTHS[k]), n) for k in range(len(LANGUAGES))}
    out = counts.withColumn("size", size).withColumns({"c": _shares(F.col("chars"), F.col("size"))} | shares)
    return out.withColumns({f"{x}_neg": _negentropy(F.col(x)) for x in ("c", *shares)})


def _nearness(name: str, reference: tuple[list[float], list[float]]) -> Column:
    """struct<over, char_distance, word_distance>; over: the greater of the two distances in terms of the limits, which is 1 at most for a good document."""
    w = f"w{LANGUAGES.index(name)}"
    chars, words = _distance(F.col("c"), reference[0], F.col("c_neg")), _distance(F.col(w), reference[1], F.col(f"{w}_neg"))
    ratio = lambda d, length, limits: F.coalesce(d / _limit(F.col(length), limits), F.lit(0.0))
    return F.struct(F.greatest(ratio(chars, "size", CHAR_LIMITS), ratio(words, "n_words", WORD_LIMITS)).alias("over"), chars.alias("char_distance"), words.alias("word_distance"))


def references(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the shares of its character classes and of its common words, over the documents of counts."""
    n_bins = int(_STARTS[-1])
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(n_bins)]
    out = {}
    for row in counts.where(F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(*sums).collect():  # at most as many rows as LANGUAGES
        k = LANGUAGES.index(row["lang"])
        chars = [row[f"c{i}"] for i in range(len(CLASSES))]
        words = [row[f"w{i}"] for i in range(_STARTS[k], _STARTS[k + 1])]
        if sum(chars) and sum(words):
            out[row["lang"]] = ([x / sum(chars) for x in chars], [x / sum(words) for x in words])
    return out


def trimmed_references(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """References over the documents that are within the limits of a first reference, that over all documents of their language."""
    first = references(counts)
    if not first:
        return {}
    own = F.coalesce(*(F.when(F.col("lang") == name, _nearness(name, ref)) for name, ref in sorted(first.items())))
    return first | references(_with_shares(counts).withColumn("own", own).where("own.over <= 1"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance and word_distance (to the language that the document is nearest to)."""
    spark = docs.sparkSession
    ship(spark)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_or_empty().alias("text"))
    counts = Scratch(spark).put(own.mapInArrow(_tidied, _SCHEMA), "counts")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = [_nearness(*x) for x in sorted(trimmed_references(counts).items())]
    nearest = F.array_min(F.array(*near)) if near else F.lit(None).cast("struct<over:double,char_distance:double,word_distance:double>")
    judged = _with_shares(counts).withColumns({"base_failed": base_failed, "nearest": nearest})
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("nearest.over", F.lit(0.0)) <= 1)).alias("kept"), "nearest.char_distance", "nearest.word_distance",
    )
