"""Sequence packing: concatenate all documents' tokens and cut at fixed windows.

Pass one tokenizes each document once and writes its ids with the number of ids before it in its
partition. Two levels of prefix sums over the partitions' totals (blocks of partitions, then
partitions of a block) give each partition its global offset. Pass two cuts every document at
multiples of the window; the records it returns are the windows' boundaries. Only the last
sequence is padded, whatever the sizes of the documents.

Edge cases: a null or empty text is one end token. Repeated rows and null doc_ids are documents like
any other. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ids_and_text, ship, slices, tidy

WINDOW = 4096
END_ID = 2
BLOCK = 1024
MAX_BROADCAST_PARTITIONS = 1 << 18  # rows of 24 bytes
SLICE_BYTES = 6_000_000
CACHE_BYTES = 200_000_000
PART_WORDS = 400_000
CALL_WORDS = 2048
_SIGNS = b'.,;:!?|%*#$&()[]{}/+=@^~"<>\\_-'  # not the apostrophe, which may belong to letters after it


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Ids of each text (UTF-8) as little-endian 16-bit integers, by whitespace-separated words that are kept in a cache.

    No token of the vocabulary crosses white space, so the words of a text can be encoded one by one.
    A text is split PART_WORDS words at a time, a call encodes CALL_WORDS at most, and the cache begins
    anew beyond CACHE_BYTES: what a worker holds beside its rows, and goes on holding between tasks, is bounded.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    known: dict[bytes, bytes] = {}
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    held = 0

    def one_by_one(words: list[bytes]) -> None:
        for at in range(0, len(words), CALL_WORDS):
            part = words[at : at + CALL_WORDS]
            for w, e in zip(part, encode([x.decode() for x in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u2").tobytes()

    def together(words: list[bytes]) -> None:
        """Words of letters only, many in one text: each ends with the one token that marks a word's end."""
        for first in range(0, len(words), 8 * CALL_WORDS):
            runs = [words[at : at + 256] for at in range(first, min(first + 8 * CALL_WORDS, len(words)), 256)]
            for run, e in zip(runs, encode([b" ".join(r).decode() for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u2")
                cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
                if len(cuts) != len(run):  # a letter that isn't one once it is lower-cased
                    one_by_one(run)
                    continue
                raw = ids.tobytes()
                known.update((w, raw[2 * a : 2 * b]) for w, a, b in zip(run, [0, *cuts], cuts))  # noqa: B905

    def learn(new: set[bytes]) -> None:
        letters, tails, others, ended = set(), set(), [], []
        for w in new:
            if w.isalpha() or w.decode().isalpha():
                letters.add(w)
            elif (core := w.rstrip(_SIGNS)) and core.decode().isalpha():
                ended.append((w, core, tail := w[len(core) :]))  # signs after letters are encoded apart from them
                letters.add(core)
                tails.add(tail)
            else:
                others.append(w)
        together(list(letters.difference(known)))
        one_by_one(others + list(tails.difference(known)))
        known.update((w, known[core] + known[tail]) for w, core, tail in ended)

    def several(split: list[list[bytes]]) -> list[bytes]:
        nonlocal held
        new = set(chain.from_iterable(split)).difference(known)
        if new:
            size = sum(map(len, new)) + 250 * len(new)  # two objects and an entry of the dictionary a word
            if known and held + size > CACHE_BYTES:
                known.clear()
                new = set(chain.from_iterable(split))
            held = size + (held if known else 0)
            learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def run(raw: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        split: list[list[bytes]] = []
        n = 0
        for x in raw:
            # lower case for ASCII saves entries; not where a special token's string would come about
            rest = x if b"<|" in x else x.lower()
            words = rest.split(None, PART_WORDS)
            if len(words) <= PART_WORDS:
                split.append(words)
                n += len(words)
                if n >= PART_WORDS:
                    out += several(split)
                    split, n = [], 0
                continue
            out += several(split)
            split, n, ids = [], 0, []
            while words:  # a text of more words than are held at once
                rest = words.pop() if len(words) > PART_WORDS else b""
                ids += several([words])
                words = rest.split(None, PART_WORDS)
            out.append(b"".join(ids))
        return out + several(split)

    run.forget = known.clear
    return run


def _tokenize(path: str, end: int, keep: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, encode = TaskContext.get().partitionId(), 0, _encoder(path)
        tail = np.array([end], "<u2").tobytes()
        try:
            for batch in batches:
                for piece in slices(batch, 1, SLICE_BYTES):
                    ids = [x + tail for x in encode(piece.column(1).cast(pa.binary()).to_pylist())]
                    n = np.array([len(x) // 2 for x in ids], np.int64)
                    start = before + np.cumsum(n) - n
                    before += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(start)],
                        ["doc_id", "ids", "n", "part", "before"],
                    )
        finally:
            if not keep:
                encode.forget()

    return tidy(run)


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for i, (ids, first) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(ids.as_py(), "<u2").astype("<u4")
                start = 0
                while start < len(own):
                    seq, off = divmod(first + start, window)
                    length = min(window - off, len(own) - start)
                    for k, v in zip(out, (i, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), seq, off), strict=True):
                        out[k].append(v)
                    start += length
            rows = pa.array(out.pop("row"), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array(v, pa.int64()) for v in out.values())], ["doc_id", *out])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    keep_words: a worker's next task goes on with the words learnt, up to CACHE_BYTES. Without it they go with the task, for workers that other operators need.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    tokens = ids_and_text(docs).mapInArrow(_tokenize(vocabulary or default_vocabulary(), end_id, keep_words), "doc_id long, ids binary, n long, part long, before long")
    tokens = scratch.put(tokens, "tokens", 4000)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", F.expr(f"part div {BLOCK}"))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("sum"))
    blocks = blocks.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("ahead"))
    within = F.sum("total").over(Window.partitionBy("block").orderBy("part")) - F.col("total")
    offsets = scratch.put(totals.withColumn("within", within).join(blocks, "block").select("part", (F.col("within") + F.col("ahead")).alias("base")), "offsets")
    if offsets.count() <= MAX_BROADCAST_PARTITIONS:  # one row per partition of the first pass
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("first"))
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
