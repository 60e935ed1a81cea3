"""Label propagation with scores over packed blocks of vertices, without a row per message.

Vertices fall into blocks by hash. A block is one row of compressed arrays: its vertices, and for each the slots of its neighbours,
a slot being a vertex's place in all blocks put together. The state, a label and a score per vertex, is a row per block too. In a
superstep each block gets all states, groups its messages by vertex and label by a sort of integers, and returns its own new state;
edges are neither moved nor written again. The state of all vertices goes to every task: up to about 8 bytes a vertex packed, 24 unpacked.

Sums are exact and rounded once, whatever order the messages come in, as long as the scores that meet lie within about a factor of 500;
beyond that they are added from the smallest up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ramify.operators.cells import _ODD, _pack, _release, _unpack
from ramify.operators.graph import endpoints
from ramify.operators.split import deal
from ramify.plans.checkpoint import cut, drop
from ramify.plans.workers import ship

FINE = 192  # blocks in which edges are packed first; a block is as many of them as needed
BLOCKS = 24  # at least, from so many times LEAST_MESSAGES on
LEAST_MESSAGES, BLOCK_MESSAGES = 100_000, 3_000_000
_ROWS = 1_000_000  # packed at once
_CHUNK = 1 << 19  # messages grouped at once

_PART = "block int, n long, id binary, near binary, weight binary, m long, alone binary"
_BLOCK = "block int, n long, size long, id binary, degree binary, near binary, weight binary"
_EDGES = "block int, n long, size long, subs long, id binary, root binary, degree binary, near binary, weight binary"
_STATE = "block int, size long, label binary, score binary, code binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _doubles(values: np.ndarray) -> bytes:
    """One value if all are equal, else all."""
    return (values[:1] if len(values) and (values == values[0]).all() else values).astype(np.float64).tobytes()


def _read_doubles(data: pa.BinaryScalar, n: int) -> np.ndarray:
    values = np.frombuffer(data.as_buffer(), np.float64)
    return np.broadcast_to(values[:1].reshape(()), (n,)) if len(values) == 1 else values


def _taken(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values at those places; equal ones stay one."""
    return np.broadcast_to(values[0], (len(places),)) if values.strides == (0,) and len(values) else values[places]


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by (a, b)."""
    bits = int(b.max() - b.min()).bit_length() if len(b) else 0
    if len(a) and -(1 << 62) < min(a.min(), b.min()) and max(a.max(), b.max()) < 1 << 62 and int(a.max() - a.min()).bit_length() + bits < 63:
        return np.argsort(((a - a.min()) << bits) | (b - b.min()))
    return np.lexsort((b, a))


def _planes(values: np.ndarray) -> bytes:
    """Numbers from 0 below 2**32 as zstd of their byte planes: larger than what _pack makes of them, but read much faster, as every superstep does."""
    if int(values.max(initial=0)) >> 32:
        raise ValueError("more than 2**32 vertices or messages in a block")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _read_planes(data: pa.BinaryScalar, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if n:
        data = data.as_buffer()
        planes = np.frombuffer(pa.decompress(data.slice(1), decompressed_size=data[0] * n, codec="zstd"), np.uint8).reshape(data[0], n)
        for k in range(data[0]):
            out[:, k] = planes[k]
    out = out.reshape(-1).view("<u4")
    return out.view("<i4") if int(out.max(initial=0)) < 1 << 31 else out.astype(np.int64)


def _blocks_of(ids: np.ndarray) -> np.ndarray:
    return (((ids.view(np.uint64) * _ODD) >> np.uint64(40)) % np.uint64(FINE)).astype(np.uint8)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst, value, alone) packed by the fine block of either end, so many rows at a time."""

    def flush(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        src, dst, value, alone = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("src", "dst", "value", "alone"))
        lone = np.unique(np.concatenate([src[alone], dst[alone]]))
        src, dst, value = src[~alone], dst[~alone], value[~alone]
        ids, near, value = np.concatenate([dst, src]), np.concatenate([src, dst]), np.concatenate([value, value])
        at, lone_at = _blocks_of(ids), _blocks_of(lone)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(FINE + 1))
        rows = []
        for k in range(FINE):
            own, apart = order[ends[k] : ends[k + 1]], lone[lone_at == k]
            if len(own) or len(apart):
                own = own[_pair_order(ids[own], near[own])]
                rows.append((k, len(own), _pack(ids[own]), _pack(near[own]), _doubles(value[own]), len(apart), _pack(apart)))
        return _table(_PART, rows).to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


def _gather(once: bool):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        n, m = table.column("n").to_pylist(), table.column("m").to_pylist()
        ids, near = (np.concatenate([_unpack(table.column(c)[i], n[i]) for i in range(len(n))]) for c in ("id", "near"))
        weights = [_read_doubles(table.column("weight")[i], n[i]) for i in range(len(n)) if n[i]]
        if all(w.strides == (0,) and w[0] == weights[0][0] for w in weights):
            weight = np.broadcast_to(weights[0][0], (len(ids),)) if weights else np.zeros(0)
        else:
            weight = np.concatenate(weights)
        lone = np.concatenate([_unpack(table.column("alone")[i], m[i]) for i in range(len(m))])
        order = _pair_order(ids, near)
        ids, near, weight = ids[order], near[order], _taken(weight, order)
        del order
        if once and len(ids):
            first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])])
            ids, near, weight = ids[first], near[first], _taken(weight, first)
        known = np.unique(np.concatenate([ids, lone]))
        degree = np.diff(np.searchsorted(ids, known), append=len(ids))
        return _table(_BLOCK, [(table.column("block")[0].as_py(), len(ids), len(known), _pack(known), _pack(degree), _pack(near), _doubles(weight))])

    return run


def _rows_of(nested: pa.ListScalar) -> list[tuple[int, pa.StructScalar]]:
    """The blocks' rows by block."""
    return sorted(((x["block"].as_py(), x) for x in nested), key=lambda r: r[0])


def _slots(split: tuple | None):  # noqa: ANN202
    """Neighbours' ids become slots; with split, a hub's neighbours are dealt to its sub-vertices, which lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.concatenate([_unpack(x["id"], x["size"].as_py()) for _, x in _rows_of(batch.column("names")[i])])
                slot = np.argsort(ids)
                sorted_ids = ids[slot]
                n, size = batch.column("n")[i].as_py(), batch.column("size")[i].as_py()
                degree, near = _unpack(batch.column("degree")[i], size), _unpack(batch.column("near")[i], n)
                weight, owner = _read_doubles(batch.column("weight")[i], n), np.repeat(np.arange(size), degree)
                sub, root = deal(owner, near, *split) if split else (owner, np.arange(size))
                near = slot[np.searchsorted(sorted_ids, near)]
                order = _pair_order(sub, near)
                data = (_planes(root), _planes(np.bincount(sub, minlength=len(root))), _planes(near[order]), _doubles(_taken(weight, order)))
                yield from _table(_EDGES, [(batch.column("block")[i].as_py(), n, size, len(root), batch.column("id")[i].as_py(), *data)]).to_batches()

    return run


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex's own label, which is its place in the order of ids (or that of its first twin), and score 1."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.sort(np.concatenate([_unpack(x["id"], x["size"].as_py()) for _, x in _rows_of(batch.column("names")[i])]))
            size = batch.column("size")[i].as_py()
            own = _unpack(batch.column("id")[i], size)
            twin = {x["id"]: x["first"] for x in batch.column("twins")[i].as_py()}
            if twin:
                own = np.array([twin.get(x, x) for x in own.tolist()], np.int64)
            yield from _state(batch.column("block")[i].as_py(), np.searchsorted(ids, own), np.ones(size))


def _state(block: int, label: np.ndarray, score: np.ndarray) -> list[pa.RecordBatch]:
    known, code = np.unique(score, return_inverse=True)
    return _table(_STATE, [(block, len(label), _pack(label), known.tobytes(), _pack(code))]).to_batches()


def _states(nested: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """All slots' labels and the places of their scores among the distinct ones, these, and the first slot of each block."""
    rows = _rows_of(nested)
    sizes = [x["size"].as_py() for _, x in rows]
    dictionaries = [np.frombuffer(x["score"].as_buffer(), np.float64) for _, x in rows]
    scores = np.unique(np.concatenate(dictionaries))
    label = np.concatenate([_unpack(x["label"], n) for (_, x), n in zip(rows, sizes, strict=True)])
    code = np.concatenate([np.searchsorted(scores, own)[_unpack(x["code"], n)] for (_, x), n, own in zip(rows, sizes, dictionaries, strict=True)])
    return label, code, scores, dict(zip((b for b, _ in rows), np.cumsum([0, *sizes[:-1]]).tolist(), strict=True))


def _exact(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int] | None:
    """values as (high, low, e): high * 2**(e - 30) + low * 2**(e - 62) in integers; None if they can't be."""
    if not len(values) or not np.isfinite(values).all():
        return None
    e = int(np.frexp(np.abs(values).max())[1])
    high = np.floor(np.ldexp(values, 30 - e))
    low = np.ldexp(values - np.ldexp(high, e - 30), 62 - e)
    return (high.astype(np.int64), low.astype(np.int64), e) if (low == np.floor(low)).all() else None


class _Sums:
    """Messages grouped by (sub-vertex, label): merged to roots, and the best label of each."""

    def __init__(self, group: np.ndarray, message: np.ndarray, exact: tuple | None):
        """Sorted by (group, message)."""
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.group, self.high = group[first], message[np.r_[first[1:], len(group)] - 1]
        self.e = exact[2] if exact else None
        self.total = [np.add.reduceat(x, first) for x in (exact[:2] if exact else (message,))]

    @staticmethod
    def merged(parts: list[_Sums], group: np.ndarray) -> _Sums:
        """The partial sums of sub-vertices added by their roots' groups."""
        out = _Sums.__new__(_Sums)
        order = np.argsort(group, kind="stable")
        group = group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out.group, out.e = group[first], parts[0].e
        out.high = np.maximum.reduceat(np.concatenate([p.high for p in parts])[order], first)
        out.total = [np.add.reduceat(np.concatenate(x)[order], first) for x in zip(*(p.total for p in parts), strict=True)]
        return out

    def best(self, labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vertex, label and highest message: of the greatest total, of equal ones the smallest label."""
        vertex = self.group // labels
        total = self.total[0] if self.e is None else np.ldexp(self.total[0].astype(np.float64), self.e - 30) + np.ldexp(self.total[1].astype(np.float64), self.e - 62)
        first = np.flatnonzero(np.r_[True, vertex[1:] != vertex[:-1]])
        top = np.flatnonzero(total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.r_[first, len(vertex)])))
        top = top[np.r_[True, vertex[top[1:]] != vertex[top[:-1]]]]
        return vertex[top], self.group[top] % labels, self.high[top]


def _superstep(label: np.ndarray, code: np.ndarray, scores: np.ndarray, root: np.ndarray, degree: np.ndarray, near: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vertices with messages, their best labels and highest messages, chunk by chunk. Messages come in the order of sub-vertices; a root's follow each other."""
    labels, bits = len(label), (len(scores) - 1).bit_length()
    at = np.concatenate([[0], np.cumsum(degree, dtype=np.int64)])
    root = root.astype(np.int64)
    uniform = len(weight) and weight.strides == (0,) and weight[0] > 0 and (len(root) * labels << bits) < 1 << 62
    if uniform:
        value = scores * weight[0]
        sent = (label << bits) | code
    else:
        value = scores[code[near]] * weight
    exact = _exact(value)
    begin, parts = 0, []
    while begin < len(degree):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + _CHUNK, side="right")) - 1)
        edge = slice(at[begin], at[end])
        if at[end] > at[begin]:
            if uniform:
                key = np.repeat(np.arange(begin, end) * (labels << bits), degree[begin:end])
                key += sent[near[edge]]
                key.sort()
                place = key & ((1 << bits) - 1)
                part = _Sums(key >> bits, value[place], exact and (exact[0][place], exact[1][place], exact[2]))
            else:
                group = np.repeat(np.arange(begin, end) * labels, degree[begin:end]) + label[near[edge]]
                place = np.lexsort((value[edge], group))
                group, place = group[place], place + at[begin]
                part = _Sums(group, value[place], exact and (exact[0][place], exact[1][place], exact[2]))
            parts.append(part)
        begin = end
        # a root whose sub-vertices go on in the next chunk waits for them
        if parts and (begin == len(degree) or root[begin] != root[begin - 1]):
            group = np.concatenate([p.group for p in parts])
            sub = group // labels
            group += (root[sub] - sub) * labels
            if len(parts) == 1 and (group[1:] > group[:-1]).all():  # nothing to merge
                parts[0].group = group
                yield parts[0].best(labels)
            else:
                yield _Sums.merged(parts, group).best(labels)
            parts = []


def _step(delta: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, n, size, subs = (batch.column(c)[i].as_py() for c in ("block", "n", "size", "subs"))
                label, code, scores, first = _states(batch.column("states")[i])
                own = slice(first[block], first[block] + size)
                new_label, new_score = label[own].copy(), scores[code[own]]
                arrays = [_read_planes(batch.column(c)[i], k) for c, k in (("root", subs), ("degree", subs), ("near", n))]
                for vertex, best, high in _superstep(label, code, scores, *arrays, _read_doubles(batch.column("weight")[i], n)):
                    new_score[vertex] = high - np.where(best != new_label[vertex], delta, 0.0)
                    new_label[vertex] = best
                yield from _state(block, new_label, new_score)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.sort(np.concatenate([_unpack(x["id"], x["size"].as_py()) for _, x in _rows_of(batch.column("names")[i])]))
            size = batch.column("size")[i].as_py()
            label, code = (_unpack(batch.column(c)[i], size) for c in ("label", "code"))
            score = np.frombuffer(batch.column("score")[i].as_buffer(), np.float64)[code]
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(batch.column("id")[i], size)), pa.array(ids[label]), pa.array(score)], ["id", "label", "score"])


def _nested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row that holds all."""
    return rows.agg(F.collect_list(F.struct(*columns)).alias(name))


def _in_order(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges with longs for ids, and (id, label, number, first) if the ids aren't integers: numbers in the order of labels, first the
    number of the first id with the same label."""
    if all(isinstance(edges.schema[c].dataType, (ByteType, ShortType, IntegerType, LongType)) for c in ("src", "dst")):
        return edges, None
    edges = cut(edges)
    ids = endpoints(edges).where("id is not null").distinct().select("id", F.col("id").cast("long").alias("label"))
    ids = cut(ids.orderBy("label", "id").withColumn("number", F.monotonically_increasing_id()))
    ids = cut(ids.join(ids.groupBy("label").agg(F.min("number").alias("first")), "label"))
    for end in ("src", "dst"):
        numbers = ids.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number"))
        edges = edges.join(numbers, end, "left").drop(end).withColumnRenamed(f"{end}_number", end)
    return edges, ids


def propagate_labels(edges: DataFrame, steps: int, delta: float, once: bool = False, split: tuple | None = None) -> DataFrame:
    """(id, label, score) of the ends of the edges (src, dst, value) after exactly so many supersteps, edges taken both ways. A table.

    Ids are integers or can be cast to such; a label is a long. An edge without one of its ends or its value sends nothing. once: edges
    given more than once, or both ways, count once. split: (alpha, level, threshold), as of a tree split.
    """
    ship(edges.sparkSession)
    kind = edges.schema["src"].dataType
    numbered, names = _in_order(edges.select("src", "dst", F.col("value").cast("double").alias("value")))
    alone = F.col("src").isNull() | F.col("dst").isNull() | F.col("value").isNull()
    ends = (F.coalesce(*c).cast("long").alias(c[0]) for c in (("src", "dst"), ("dst", "src")))
    rows = numbered.where("src is not null or dst is not null").select(*ends, F.coalesce("value", F.lit(0.0)).alias("value"), alone.alias("alone"))
    parts = cut(rows.mapInArrow(_parts, _PART))
    _release(parts)
    messages = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, min(FINE, max(min(BLOCKS, -(-messages // LEAST_MESSAGES)), -(-messages // BLOCK_MESSAGES))))
    whole = parts.withColumn("block", F.expr(f"cast(block * {count} div {FINE} as int)")).repartitionByRange(count, "block")
    blocks = cut(whole.groupBy("block").applyInArrow(_gather(once), _BLOCK), instead_of=parts)
    all_names = _nested(blocks, "names", "block", "size", "id")
    if names is None:
        twins = blocks.limit(0).select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("first"))
    else:
        twins = names.where("number <> first").select(F.col("number").alias("id"), "first")
    state = cut(blocks.select("block", "size", "id").crossJoin(all_names).crossJoin(_nested(twins, "twins", "id", "first")).mapInArrow(_start, _STATE))
    linked = cut(blocks.crossJoin(all_names).mapInArrow(_slots(split), _EDGES))
    _release(linked)
    for step in range(1, steps + 1):
        sent = linked.crossJoin(_nested(state, "states", "block", "size", "label", "score", "code"))
        state = cut(sent.mapInArrow(_step(delta / step), _STATE), instead_of=state)
    drop(linked)
    found = blocks.select("block", "size", "id").join(state.drop("size"), "block").crossJoin(all_names).mapInArrow(_named, "id long, label long, score double")
    found = cut(found, instead_of=state)
    if names is None:
        return found.withColumn("id", F.col("id").cast(kind))
    labels = names.select(F.col("number").alias("label"), F.col("label").alias("named"))
    own = names.select(F.col("number").alias("id"), F.col("id").alias("own"))
    return found.join(labels, "label").join(own, "id").select(F.col("own").alias("id"), F.col("named").alias("label"), "score")
