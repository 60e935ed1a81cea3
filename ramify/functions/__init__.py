"""Column functions: ids of sub-vertices, the level hash, set similarity."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "_"


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash with base 31, signed. ASCII texts only."""
    unsigned = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % F.lit(1 << 32))
    return F.shiftright(F.shiftleft(unsigned, 32), 32)  # sign extension


def level_hash(neighbour: Column, level: int) -> Column:
    """Level 0 hashes the neighbour's id; each level more hashes the SHA-256 of the hash before."""
    h = string_hash(neighbour.cast("string"))
    for _ in range(level):
        h = string_hash(F.sha2(h.cast("string"), 256))
    return h


def string_hashes(numbers: np.ndarray) -> np.ndarray:
    """string_hash of numbers as they are written, for arrays."""
    out = np.zeros(len(numbers), np.int64)
    rest = np.where(numbers < 0, np.uint64(0) - numbers.astype(np.uint64), numbers.astype(np.uint64))
    power, left = np.ones(len(numbers), np.int64), np.ones(len(numbers), bool)
    while left.any():  # from the last digit on
        out = (out + np.where(left, (rest % np.uint64(10)).astype(np.int64) + 48, 0) * power) & 0xFFFFFFFF
        power = np.where(left, (power * 31) & 0xFFFFFFFF, power)
        rest = rest // np.uint64(10)
        left = rest > 0
    out = (out + np.where(numbers < 0, ord("-"), 0) * power) & 0xFFFFFFFF
    return np.where(out >= 1 << 31, out - (1 << 32), out)


def level_hashes(neighbours: np.ndarray, level: int) -> np.ndarray:
    """level_hash for arrays of numbers."""
    known, where = np.unique(neighbours, return_inverse=True)
    h = string_hashes(known)
    for _ in range(level):
        h = np.array([_text_hash(sha256(str(x).encode()).hexdigest()) for x in h.tolist()], np.int64)
    return h[where]


def _text_hash(text: str) -> int:
    h = 0
    for c in text.encode():
        h = (h * 31 + c) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def child_number(neighbour: Column, level: int, alpha: int) -> Column:
    return F.abs(level_hash(neighbour, level)) % alpha


def child_id(vertex: Column, number: Column) -> Column:
    return F.concat(vertex, F.lit(SEPARATOR), number.cast("string"))


def checked_id(vertex: Column) -> Column:
    """A vertex's id as a string; one that holds the separator can't be told from a sub-vertex's and fails."""
    text = vertex.cast("string")
    message = F.concat(F.lit(f"the id of a vertex to be split holds {SEPARATOR!r}: "), text)
    return F.when(F.contains(text, F.lit(SEPARATOR)), F.raise_error(message).cast("string")).otherwise(text)


def root_of(vertex: Column) -> Column:
    """The id without any suffix."""
    return F.substring_index(vertex, SEPARATOR, 1)


def parent_of(vertex: Column) -> Column:
    """The id without its last suffix; ids without one stay."""
    return F.regexp_replace(vertex, f"{SEPARATOR}[^{SEPARATOR}]*$", "")


def is_split(vertex: Column) -> Column:
    return F.instr(vertex, SEPARATOR) > 0


def set_jaccard(x: Column, y: Column) -> Column:
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))
