"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern; pieces not seen before are encoded together. They
lie in matrices by length (the width of a bucket is a power of two), one piece per row, padded
with -1. In each round every row looks up the ranks of its pairs in a hash table, merges the
leftmost pair of least rank, and closes the gap; rows without a pair that merges leave the matrix. In rows of
over LONG bytes a round merges all occurrences of that pair, from the left, unless the merged id can bring
about a pair of lower rank: the rounds of single merges would take just these, one after the other.

Edge cases: null or empty text has no ids. Special tokens are ordinary text. A piece of any length is encoded in full.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ramify.llm.common import ids_and_text, ship, slices, tidy

LONG = 64
MATRIX_CELLS = 1 << 20
_CACHE_PIECES = 900_000
_NONE = np.int64(1 << 40)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PairTable:
    """Open addressing over (left id, right id) -> merged id, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int64)
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.depth = 0
        at = self._slots(keys)
        while len(keys):
            self.depth += 1
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, _NONE where there is none (ids of -1 have none)."""
        keys = left << 20 | right
        at = self._slots(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], _NONE)
        todo = np.flatnonzero(((seen != keys) & (seen != -1)).ravel())
        flat_out, flat_keys, flat_at = out.reshape(-1), keys.reshape(-1), at.reshape(-1)
        for step in range(1, self.depth):
            if not len(todo):
                break
            slot = (flat_at[todo] + step) & (len(self.keys) - 1)
            seen, want = self.keys[slot], flat_keys[todo]
            hit = seen == want
            flat_out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (seen != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class BytePairCoder:
    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.ranks = ranks
        pairs = {}
        for token, merged in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = merged
        self.table = PairTable(pairs)
        #: Ids whose making can bring about a pair of lower rank than their own.
        self.risky = np.zeros(max(self.tokens) + 1, bool)
        self.risky[[x for (a, b), c in pairs.items() for x in (a, b) if x > c]] = True
        self.known: dict[str, bytes] = {}
        #: A single space between two characters that aren't white space always begins a piece.
        self.irregular = regex.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$|[\x1c-\x1f\x85]")

    def merge_rows(self, ids: np.ndarray, every: bool) -> list[np.ndarray]:
        """ids: rows padded with -1. every: merge all occurrences of a row's best pair in a round."""
        done: list[np.ndarray | None] = [None] * len(ids)
        row = np.arange(len(ids))
        while len(ids):
            ranks = self.table.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), _NONE)
            best = ranks.min(axis=1)
            over = best == _NONE
            if over.any():
                for r, x in zip(row[over], ids[over], strict=True):
                    done[r] = x[x >= 0].astype("<u4")
                ids, row, ranks, best = ids[~over], row[~over], ranks[~over], best[~over]
                if not len(ids):
                    break
            hit = ranks == best[:, None]
            at = hit.argmax(axis=1)
            keep = np.ones(ids.shape, bool)
            if every:
                r, c = np.nonzero(hit)
                fresh = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)]
                offset = np.arange(len(c)) - np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))
                take = (offset % 2 == 0) & (~self.risky[best[r]] | (c == at[r]))
                r, c = r[take], c[take]
            else:
                r, c = np.arange(len(ids)), at
            ids = ids.copy()
            ids[r, c] = best[r]
            keep[r, c + 1] = False
            # close the gaps: kept cells move left in order
            lengths = keep.sum(axis=1)
            out = np.full((len(ids), int(lengths.max())), -1, np.int64)
            rr, cc = np.nonzero(keep)
            out[rr, (np.cumsum(keep, axis=1) - 1)[rr, cc]] = ids[rr, cc]
            ids = out[:, : max(2, int((out >= 0).sum(axis=1).max()))]
        return done  # type: ignore[return-value]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], "<u4")
            else:
                buckets.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                flat = self.single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                lengths = np.array([len(pieces[i]) for i in part])
                ids = np.full((len(part), width), -1, np.int64)
                ids[np.arange(width) < lengths[:, None]] = flat
                for i, x in zip(part, self.merge_rows(ids, width > LONG), strict=True):
                    out[i] = x
        return out  # type: ignore[return-value]

    def _chunks(self, text: str) -> list[str]:
        if not text or self.irregular.search(text):
            return [text] if text else []
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._chunks(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > _CACHE_PIECES:
            self.known.clear()
            new = set(chain.from_iterable(split))
        chunks = list(new)
        pieces = [[p.encode() for p in self.pattern.findall(c)] for c in chunks]
        distinct = list(set(chain.from_iterable(pieces)))
        coded = {p: x.tobytes() for p, x in zip(distinct, self.encode_pieces(distinct), strict=True)}
        self.known.update((c, b"".join(map(coded.__getitem__, ps))) for c, ps in zip(chunks, pieces, strict=True))
        out = [b"".join(map(self.known.__getitem__, cs)) for cs in split]
        for c in chunks:
            if len(c) > 64:  # such chunks seldom come again
                del self.known[c]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def encode_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, 1, 12_000_000):
                ids = own.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(own.decode(x)) for x in ids), pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidy(run, coder(path).known)(batches)

    return ids_and_text(docs).mapInArrow(tidied, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
