"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard verification.

Circulant MinHash needs two permutations only. A first permutation sigma scatters the shingles over
a universe of 2**20 places; a second one, pi, is a table over the same universe. Coordinate k of
a signature is the least ``pi[(sigma(x) + k) mod 2**20]`` over the document's shingles, i.e. pi
shifted circularly by k. All coordinates of a shingle are thus one contiguous slice of pi.

Equal shingle sets are one class before anything is compared. Classes meet in buckets (a band of a
signature). In each bucket a pivot is compared with all others, links are confirmed on the full
sets, and only buckets that still hold several components go on with further pivots, until
none is left. So a bucket of n near copies costs n comparisons, not n squared, and no pair of a
bucket that could still connect two components is left out.

Two sets share at most what each of them shares with anybody. How many shingles of a set no other
candidate has is counted once over all candidates; pairs (and whole documents) that can't reach the
threshold for that reason aren't compared, and a bucket's pivot is the member with the smallest share of such shingles.
After each round the count is made anew for what is left, by component: shingles that
no other component has. Texts around a common passage end there.

Near copies of one text, many of them just below the threshold, end by their differences from a
common pivot, their home. What two of them share lies inside the home's set, where it is at most what
the one with less of it has, or outside. So a pair is compared only if what lies inside can suffice, or
if both have a shingle outside; those pairs come from an index of the shingles outside.

What is linked are classes of equal sets, each with a number of its own, so rows that share a doc_id are judged by their own texts.

Edge cases: null, empty or blank text has an empty set and links with nothing. Rows with equal doc_id and different texts may be in
different components. A row without a doc_id gets its component's least doc_id, or null if there is none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.common import WHITESPACE, Scratch, ids_and_text, ship, slices, text_or_empty, tidy

SHINGLE = 5
BANDS, ROWS = 40, 5
THRESHOLD = 75  # per cent
UNIVERSE_BITS = 20
SEED = 20240607
_CACHE_WORDS = 1 << 18


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(seed, seed + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) | np.uint64(1)


_COEFFICIENTS = _odd(SHINGLE, 101)
_LENGTHS = _odd(SHINGLE + 1, 211)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles (the whole text if shorter)."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    m = n - k + 1
    s = np.full(m, _LENGTHS[k], np.uint64)
    for j in range(k):
        s += h[j : j + m] * _COEFFICIENTS[j]
    return np.unique(_mix(s))


@lru_cache(maxsize=2)
def _windows(width: int) -> np.ndarray:
    size = 1 << UNIVERSE_BITS
    pi = np.random.Generator(np.random.PCG64(SEED)).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(shingles: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    view = _windows(width)
    sigma = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full(width, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 2048):
        np.minimum(out, view[sigma[at : at + 2048]].min(axis=0), out=out)
    return out


_BAND_SALT = _odd(BANDS, 307)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(bands, rows).astype(np.uint64)
    h = _odd(bands, 307) if bands != BANDS else _BAND_SALT
    for j in range(rows):
        h = _mix(h ^ (parts[:, j] + np.uint64(j + 1)))
    return h.view(np.int64)


_SIGNED = "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        n, keys, bands, at = [], [], [], [0]
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                bands.append(band_keys(signature(s)))
            at.append(at[-1] + (BANDS if len(s) else 0))
        flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)],
            ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
        )


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingle) rows of the texts."""
    for batch in batches:
        for part in slices(batch, 1, 2_000_000):
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), list(map(len, sets)))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much the full sets share, and whether they reach the threshold. Columns: a, b, text_a, text_b."""
    last, last_set = None, None
    for batch in batches:
        shared, linked = [], []
        for i in range(batch.num_rows):
            text_b = batch.column(3)[i].as_py()
            if text_b != last:
                last, last_set = text_b, shingle_set(text_b)
            mine = shingle_set(batch.column(2)[i].as_py())
            both = len(np.intersect1d(mine, last_set, assume_unique=True))
            shared.append(both)
            linked.append(bool(both and 100 * both >= THRESHOLD * (len(mine) + len(last_set) - both)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_tidied(_compare), "a long, b long, both long, linked boolean")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of links(a, b): alternating large and small stars.

    The minimum of each neighbourhood is written before it is joined, so that both sides of the
    join are plain exchanges and adaptive execution can split a hub. Rounds are logarithmic.
    """
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.put(large, "star")
        hooked = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hooked.select("u", F.col("m").alias("v")))
        edges = scratch.put(small.where("u <> v").distinct(), "edges")
        # done when all are stars: nobody has two centres, and no centre has one
        more = edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        if more.isEmpty():
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.put(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")


#: Whether a set can reach the threshold with any other.
_HOPEFUL = f"100 * (n - own) >= {THRESHOLD} * n"


def _tidied(run):  # noqa: ANN001, ANN202
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(run, _hashes)(batches)

    return wrapped


def _facts(texts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, n, own): the size of each set, and how many of its shingles no other of the texts has."""
    spelled = texts.mapInArrow(_tidied(_spell), "rep long, shingle long")
    found = spelled.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    alone = found.where("rep = last").groupBy("rep").agg(F.count("*").alias("own"))
    sizes = classes.select("rep", "n").join(wanted, "rep", "left_semi")
    return sizes.join(alone, "rep", "left").select("rep", "n", F.coalesce("own", F.lit(0)).alias("own"))


def _reach(most: str) -> str:
    """Whether a set and p can reach the threshold if they share at most so many shingles."""
    return f"(100 * {most} >= {THRESHOLD} * (n + p.n - {most}))"


def _owned_by_component(rows: DataFrame, texts: DataFrame, homes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rep, n, own, comp, home, inside) of the documents of rows, own counted anew: those shingles that nobody outside the component has.

    And (rep, shingle) of all other shingles.

    Pairs of two components can't share those. Only the documents of rows are looked at, as only they meet.
    """
    ids = scratch.put(rows.select("rep", "n", "own", "comp").distinct(), "residual")
    spelled = texts.join(ids.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(_tidied(_spell), "rep long, shingle long")
    spelled = scratch.put(spelled.join(ids.select("rep", "comp"), "rep"), "spelled")
    held = spelled.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").select("shingle")
    held = scratch.put(held, "held")
    owned = scratch.put(spelled.join(held, "shingle", "left_semi").groupBy("rep").agg(F.count("*").alias("owned")), "owned")
    known = ids.join(owned, "rep", "left").withColumn("own", F.coalesce("owned", F.lit(0))).drop("owned").where(_HOPEFUL).join(homes, "rep", "left")
    return scratch.put(known, "known"), spelled.join(held, "shingle", "left_anti").select("rep", "shingle")


def _homes(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """(rep, home, inside): the first of the pivots that a document has met and shares half its set with, and how much.

    The order of the pivots is the same everywhere, so that near copies mostly have one home.
    """
    met = rows.select("rep", "n", "pivot").distinct()
    pair = (F.greatest("rep", "pivot.rep") == F.col("a")) & (F.least("rep", "pivot.rep") == F.col("b"))
    met = met.join(compared, pair, "left").withColumn("inside", F.when(F.col("rep") == F.col("pivot.rep"), F.col("n")).otherwise(F.col("both")))
    first = F.min(F.struct("pivot.e", "pivot.h", F.col("pivot.rep").alias("home"), "inside"))
    return met.where("2 * inside >= n").groupBy("rep").agg(first.alias("f")).select("rep", "f.home", "f.inside")


def _outside(rows: DataFrame, shared: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of two components with one home that share a shingle which the home hasn't, unless they can't reach the threshold.

    A document has to share at least ``needed`` of its shingles outside; so one of those is among
    its rarest, all but needed - 1 of them, and among the other's.
    """
    members = scratch.put(rows.where("home is not null").select("rep", "n", "own", "comp", "home", "inside").distinct(), "at-home")
    spelled = texts.join(members.select(F.col("home").alias("rep")).distinct(), "rep", "left_semi").select("rep", "text").mapInArrow(_tidied(_spell), "home long, shingle long")
    out = scratch.put(shared.join(members.select("rep", "home"), "rep").join(scratch.put(spelled, "homes-spelled"), ["home", "shingle"], "left_anti"), "outside")
    often = scratch.put(out.groupBy("home", "shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    of_rep = Window.partitionBy("rep")
    out = out.join(often, ["home", "shingle"]).withColumn("out", F.count("*").over(of_rep)).withColumn("rank", F.row_number().over(of_rep.orderBy("often", "shingle")))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * THRESHOLD / 100) - F.col("inside"))
    out = scratch.put(out.join(members.drop("home"), "rep").where(F.col("rank") <= F.col("out") - needed + 1).drop("often", "rank"), "rarest")
    other = out.select("home", "shingle", F.struct("rep", "n", "own", "comp", "inside", "out").alias("p"))
    most = "least(least(inside, p.inside) + least(out, p.out), n - own, p.n - p.own)"
    pairs = out.join(other, ["home", "shingle"]).where("rep > p.rep and comp <> p.comp").where(_reach(most))
    return pairs.select(F.col("p.rep").alias("b"), F.col("rep").alias("a"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a digest of the text), text."""
    return ids_and_text(docs).select("doc_id", F.unhex(F.md5("text")).alias("text_key"), "text")


def _linked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, n_shingles, first (the component's least (no_id, doc_id, text_key); null without words) for every row of docs."""
    docs = _keyed(docs)
    signed = scratch.put(docs.mapInArrow(_tidied(_sign), _SIGNED), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = scratch.put(
        signed.where("set_key is not null").groupBy("set_key").agg(least.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id()),  # as written, so it stays
        "classes",
    )
    members = classes.select(F.explode("bands").alias("bucket"), "rep")
    shared = scratch.put(members.groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    rows = scratch.put(members.join(shared, "bucket"), "members")
    wanted = scratch.put(rows.select("rep").distinct(), "wanted")
    where = classes.join(wanted, "rep", "left_semi").select("rep", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key"))
    found = docs.join(where, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    texts = scratch.put(found.select("rep", "text").dropDuplicates(), "texts")
    facts = scratch.put(_facts(texts, classes, wanted), "facts").where(_HOPEFUL)
    rows = rows.join(facts, "rep").withColumn("comp", F.col("rep"))

    def active(rows: DataFrame, turn: int) -> DataFrame:
        """Members of buckets that hold several components, with their bucket's size and a pivot."""
        rows = scratch.put(rows, "rows")  # it's read twice
        buckets = rows.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.struct((F.col("own") / F.col("n")).alias("e"), F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "own", "comp")).alias("pivot"),
        ).where("lo < hi").select("bucket", "size", "pivot")
        return scratch.put(rows.join(buckets, "bucket").select(*rows.columns, "size", "pivot"), "buckets")

    rows = active(rows, 0)
    # what both hold is at most what the smaller one shares with anybody; if nothing is shared outside a common home, it lies inside
    most = "least(n - own, p.n - p.own)"
    inside = f"case when home = p.home then least(inside, p.inside, {most}) else {most} end"
    turn, width, comps, homes, extra = 0, 1, None, None, None
    while True:
        is_pivot = F.col("rep") == F.col("pivot.rep")
        if turn == 0:
            pairs = rows.select("rep", "n", "own", F.col("pivot").alias("p")).where("rep <> p.rep").where(_reach(most))
        else:
            is_pivot = is_pivot | (F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("size")) < width)
            pivots = rows.where(is_pivot).select("bucket", F.struct("rep", "n", "own", "comp", "home", "inside").alias("p"))
            pairs = rows.drop("pivot", "size").join(pivots, "bucket").where("comp <> p.comp").where(_reach(inside))
        pairs = pairs.select(F.least("rep", "p.rep").alias("b"), F.greatest("rep", "p.rep").alias("a"))
        if extra is not None:
            pairs, extra = pairs.unionByName(extra), None
        compared = scratch.put(_compared(scratch.put(pairs.distinct(), "pairs"), texts), "compared")
        if turn == 0:
            homes = scratch.put(_homes(rows, compared), "homes")
        links = compared.where("linked").select("a", "b").distinct()
        if comps is not None:
            links = links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comps = components(links, scratch)
        rest = rows.where(~is_pivot).select("bucket", "rep", "n", "own").join(comps, F.col("rep") == F.col("node"), "left")
        turn, width = turn + 1, width * 8
        rest = rest.select("bucket", "rep", "n", "own", F.coalesce("component", "rep").alias("comp"))
        rows = active(rest, turn)
        if rows.isEmpty():
            break
        known, shared = _owned_by_component(rows, texts, homes, scratch)
        rows = active(rows.select("bucket", "rep").join(known, "rep"), turn)
        if rows.isEmpty():
            break
        if turn == 1:  # later rounds have fewer components, so those pairs are among these
            extra = _outside(rows, shared, texts, scratch)
    labels = comps.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("label"))
    labels = scratch.put(labels, "labels")
    of_class = classes.join(comps.join(labels, "component").select(F.col("node").alias("rep"), "label"), "rep", "left")
    of_class = scratch.put(of_class.select("set_key", F.coalesce("label", "first").alias("first")), "of_class")
    return signed.select("doc_id", "text_key", "n_shingles", "set_key").join(of_class, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (see the module's notes)."""
    ship(docs.sparkSession)
    linked = _linked(docs, Scratch(docs.sparkSession))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the least doc_id (any of them where id and text repeat); all columns stay.

    Rows without words are in no component and stay. So does each text of a doc_id that is in no other's component, and
    of a component without any doc_id one row.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    stay = _linked(docs, scratch).where(own == F.col("first")).select(F.col("doc_id").alias("__ramify_id"), F.col("text_key").alias("__ramify_key")).distinct()
    stay = scratch.put(stay, "kept")
    text = text_or_empty()
    blank = F.btrim(text, F.lit(WHITESPACE)) == ""
    keyed = docs.withColumn("__ramify_own", F.unhex(F.md5(text)))
    same = docs["doc_id"].cast("long").eqNullSafe(stay["__ramify_id"]) & (F.col("__ramify_own") == stay["__ramify_key"])
    one = keyed.where(~blank).join(stay, same, "left_semi").dropDuplicates(["doc_id", "__ramify_own"])
    return one.drop("__ramify_own").unionByName(docs.where(blank))
