"""Exact line deduplication across documents over levelled, sorted runs of line hashes.

A run is a table (h1, h2, n, keep), bucketed and sorted by hash: for each line key, in how many documents of a
batch it was found and the largest doc_id among them. ``LevelledRuns.add`` merge-joins a new
batch with the runs (a key that is settled there has nothing to add), writes what is left as the
batch's own run, and merges a level's runs into one of the next level when it is full. All runs have the same buckets, one sorted file
each, so no step moves or sorts a run again. Within a call batches come by descending doc_id, so most frequent keys are settled by the first of them.

Runs stay where they are written: given a path (``store``), later calls and sessions go on from there, and lines count as
repeated over all documents added so far. Adding documents a second time counts them twice. A manifest, written
last, names the runs that count; what a lost driver left unfinished is not in it.

A key is a line without white space at its ends, A-Z lower-cased. Keys of at least 20 code
points found in at least 3 documents lose all their lines but those of the largest doc_id holding them.

Edge cases: null or empty text is one empty line. Rows with equal doc_id each count as a document;
where theirs is the largest doc_id, all of them keep the line. Null doc_ids are smaller than any other: such rows
count as documents but keep a line only where no row with an id has it.
Keys are compared by two independent 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm.common import WHITESPACE, Scratch, delete, ids_and_text, names_in, ship, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 3
FANOUT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), _UPPER, _LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_key(text: Column) -> Column:
    """Tells rows without a doc_id apart; null for others."""
    return F.when(F.col("doc_id").isNull(), F.unhex(F.md5(text)))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, h1, h2), one row per document and distinct key that is long enough."""
    keys = F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= MIN_CHARS)
    hashed = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    return hashed.select("doc_id", "text_key", "h.h1", "h.h2")


@contextmanager
def _sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a scan of a run counts as sorted, which it is: a file per bucket. Another thread's plans of sorted tables see it too."""
    before = spark.conf.get(_ORDERED, "false")
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class LevelledRuns:
    """Runs by level under a path; level k holds at most fanout - 1 runs between two calls of add()."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.min_docs, self.fanout = spark, path.rstrip("/"), min_docs, fanout
        self.tables: dict[str, str] = {}
        done = sorted(x for x in names_in(spark, self.path) if x.startswith("manifest-") and "_SUCCESS" in names_in(spark, f"{self.path}/{x}"))
        self.number = int(done[-1].split("-")[1]) if done else 0
        state = json.loads(spark.read.text(f"{self.path}/{done[-1]}").first()[0]) if done else {}
        self.buckets = state.get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = state.get("levels", [])
        atexit.register(self.close)

    def close(self) -> None:
        """Forget the tables' names in the session's catalog; the files stay."""
        for table in self.tables.values():
            with suppress(Exception):  # the session may be gone
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}

    def runs(self) -> list[DataFrame]:
        return [self._read(name) for level in self.levels for name in level]

    def _read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"ramify_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.tables[name]} (h1 BIGINT, h2 BIGINT, n BIGINT, keep BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self.tables[name])

    def _write(self, run: DataFrame, name: str) -> None:
        self.tables[name] = f"ramify_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(self.tables[name])

    def _commit(self) -> None:
        self.number += 1
        state = json.dumps({"buckets": self.buckets, "levels": self.levels})
        self.spark.range(1, numPartitions=1).select(F.lit(state).alias("value")).write.text(f"{self.path}/manifest-{self.number:08d}")

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """(h1, h2, n, keep) of several runs by merge joins of their buckets."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("h1", "h2", F.col("n").alias("n_other"), F.col("keep").alias("keep_other"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_other", F.lit(0))
            out = out.hint("merge").join(other, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("keep", "keep_other").alias("keep"))
        return out

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch's run without those that the runs settle: found often enough there, and kept by a document of no smaller id."""
        n, keep = F.lit(0).cast("long"), F.lit(None).cast("long")
        for i, run in enumerate(self.runs()):
            known = run.select("h1", "h2", F.col("n").alias(f"n{i}"), F.col("keep").alias(f"keep{i}"))
            batch = batch.hint("merge").join(known, ["h1", "h2"], "left")
            n, keep = n + F.coalesce(f"n{i}", F.lit(0)), F.greatest(keep, F.col(f"keep{i}")) if i else F.col("keep0")
        settled = (n >= self.min_docs) & (F.col("keep").isNull() | F.coalesce(keep >= F.col("keep"), F.lit(False)))
        return batch.where(~settled).select("h1", "h2", "n", "keep")

    def add(self, hashes: DataFrame) -> None:
        """hashes: (doc_id, h1, h2), a row per document and key."""
        batch = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        name = f"run-{uuid.uuid4().hex}"
        old: list[str] = []
        with _sorted_runs(self.spark):
            self._write(self.unsettled(batch).repartition(self.buckets, "h1", "h2"), name)
            level = 0
            while True:
                if len(self.levels) <= level:
                    self.levels.append([])
                if len(self.levels[level]) + 1 < self.fanout:
                    self.levels[level].append(name)
                    break
                full = [*self.levels[level], name]
                name = f"run-{uuid.uuid4().hex}"
                self._write(self.merged([self._read(x) for x in full]), name)
                old += full
                self.levels[level] = []
                level += 1
        self._commit()
        for x in old:  # no manifest that counts names them any more
            delete(self.spark, f"{self.path}/{x}")

    def repeated(self) -> DataFrame:
        """(h1, h2, keep) of the keys found in min_docs documents or more."""
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2", "keep")


def _dropped(docs: DataFrame, batches: int, store: str | None) -> DataFrame:
    """(__ramify_id, __ramify_key, __ramify_drop): the hashes that each document loses."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    hashes = scratch.put(line_hashes(docs), "hashes")
    cuts = hashes.select(F.percentile_approx("doc_id", [1 - k / batches for k in range(1, batches)], 1000)).first()[0] or []
    runs = LevelledRuns(spark, store or f"{scratch.path}/runs")
    bounds = [None, *cuts, None]
    for hi, lo in zip(bounds, bounds[1:], strict=False):
        part = hashes
        if hi is not None:
            part = part.where((F.col("doc_id") < hi) | F.col("doc_id").isNull() if lo is None else F.col("doc_id") < hi)
        if lo is not None:
            part = part.where(F.col("doc_id") >= lo)
        runs.add(part)
    with _sorted_runs(spark):
        repeated = scratch.put(runs.repeated(), "repeated")
    runs.close()
    lost = hashes.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    per_doc = lost.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("h1", "h2")).alias("__ramify_drop"))
    return scratch.put(per_doc.withColumnsRenamed({"doc_id": "__ramify_id", "text_key": "__ramify_key"}), "dropped")


def _with_dropped(docs: DataFrame, doc_id: Column, text: Column, dropped: DataFrame) -> DataFrame:
    key = F.when(doc_id.isNull(), F.unhex(F.md5(text)))
    return docs.join(dropped, doc_id.eqNullSafe(dropped["__ramify_id"]) & key.eqNullSafe(dropped["__ramify_key"]), "left")


def _kept_lines(text: Column) -> Column:
    """The lines that stay, as an array; for rows joined with _dropped()."""
    drop = F.col("__ramify_drop")
    kept = F.filter(_lines(text), lambda x: (F.length(_key(x)) < MIN_CHARS) | ~F.array_contains(drop, _hash(_key(x))))
    return F.when(drop.isNull(), _lines(text)).otherwise(kept)


def dedup_report(docs: DataFrame, batches: int = BATCHES, store: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row. store: a shared folder whose runs are gone on from."""
    ship(docs.sparkSession)
    docs = ids_and_text(docs)
    joined = _with_dropped(docs, docs["doc_id"], docs["text"], _dropped(docs, batches, store))
    kept = joined.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), _kept_lines(F.col("text")).alias("kept"))
    return kept.select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES, store: str | None = None) -> DataFrame:
    """docs without the repeated lines; text and n_chars (where there) are those of what stays."""
    columns = docs.columns
    joined = _with_dropped(docs, docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")), _dropped(ids_and_text(docs), batches, store))
    text = F.when(F.col("__ramify_drop").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(text_or_empty()), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__ramify_drop").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*columns)
