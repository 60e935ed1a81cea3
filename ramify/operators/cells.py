"""Triangles and shared neighbours without a row per wedge.

Vertices fall into blocks by hash. Edges are gathered by the blocks of their ends, each distinct pair once, and packed: a block
pair is one row of compressed arrays. Three blocks make a cell, which gets the block pairs between its blocks and finds the
triangles that have a vertex in each of them, so every triangle is found in one cell and a hub's edges are spread over many.
Inside a cell edges lead from the end of lower (degree, id) to that of higher, so a hub has few edges out.

The number of blocks grows with the square root of the edges, and what moves is the packed edges times the number of blocks,
not the wedges. Cells are dealt in waves, so that no more than about WAVE_BYTES of that lie on disk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ramify.operators.graph import endpoints
from ramify.operators.split import deal
from ramify.plans.checkpoint import cut, drop
from ramify.plans.workers import ship

FINE = 24  # blocks in which edges are packed; a cell's blocks are as many of them each, so their number divides this
CELL_EDGES = 4_000_000
WAVE_BYTES = 800_000_000
_WEDGES = 1 << 20  # at once
_FILTER_BITS = 25
_ODD = np.uint64(0x9E3779B97F4A7C15)

_PACKED = "fi int, fj int, n long, u binary, v binary, there binary, back binary"


def _pack(values: np.ndarray) -> bytes:
    """Integers as zstd of the byte planes of their zigzag differences."""
    d = np.diff(values.astype(np.int64), prepend=0)
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    width = max(1, (int(z.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(z.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: pa.BinaryScalar, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    data = data.as_buffer()
    width = data[0]
    planes = np.frombuffer(pa.decompress(data.slice(1), decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    z = planes[0].astype(np.uint64)
    for k in range(1, width):
        z |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def _gather(table: pa.Table) -> pa.Table:
    """One block pair's edges (u, v, turned): each distinct pair once, with how often it is given as u-v (there) and as v-u (back)."""
    u, v = (table.column(c).to_numpy() for c in ("u", "v"))
    turned = table.column("turned").to_numpy()
    order = np.lexsort((v, u))
    u, v, turned = u[order], v[order], turned[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    back = np.add.reduceat(turned.astype(np.int64), first)
    there = np.diff(np.r_[first, len(u)]) - back
    columns = [_pack(x) for x in (u[first], v[first], there, back)]
    return pa.table({"fi": table.column("fi")[:1].cast(pa.int32()), "fj": table.column("fj")[:1].cast(pa.int32()), "n": pa.array([len(first)], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip(("u", "v", "there", "back"), columns, strict=True)}})


def packed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst as longs) by block pair; those with a null end drop out. A table."""
    block = {c: F.pmod(F.xxhash64(c), F.lit(FINE)).cast("int") for c in ("src", "dst")}
    placed = edges.where("src is not null and dst is not null").select("src", "dst", block["src"].alias("bs"), block["dst"].alias("bd"))
    turned = (F.col("bs") > F.col("bd")) | ((F.col("bs") == F.col("bd")) & (F.col("src") > F.col("dst")))
    rows = placed.select(
        F.least("bs", "bd").alias("fi"), F.greatest("bs", "bd").alias("fj"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("u"),
        F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("v"), turned.alias("turned"),
    )
    out = cut(rows.groupBy("fi", "fj").applyInArrow(_gather, _PACKED))
    _release(out)
    return out


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more."""
    df.sparkSession.sparkContext._jvm.System.gc()


class _Cell:
    """The simple graph of one cell: ends as ranks by (degree, id), edges sorted by them. order: the edges' places in the rows as given.

    split (alpha, level, threshold, how often an edge counts): the edges of a vertex that has too many in this cell are dealt to its sub-vertices.
    """

    def __init__(self, us: list[np.ndarray], vs: list[np.ndarray], split: tuple | None = None):
        ids = np.unique(np.concatenate([np.unique(x) for x in (*us, *vs)]))
        self.n = n = len(ids)
        a = np.concatenate([np.searchsorted(ids, x).astype(np.int32) for x in us])
        b = np.concatenate([np.searchsorted(ids, x).astype(np.int32) for x in vs])
        by_degree = np.argsort(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), kind="stable")
        self.vertex = by_degree  # index in ids by rank
        rank = np.empty(n, np.int64)
        rank[by_degree] = np.arange(n)
        a, b = rank[a], rank[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        del a, b
        key = low * n + high
        self.order = np.argsort(key)
        self.key, self.low, self.high = key[self.order], low[self.order], high[self.order]
        self.out = np.searchsorted(self.low, np.arange(n + 1))
        self.parts = self._dealt(ids, split) if split else None
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._hash(self.key)] = True

    def _dealt(self, ids: np.ndarray, split: tuple) -> tuple[np.ndarray, ...] | None:
        """The sub-vertex of each edge's lower end, each sub-vertex's vertex, its first place in held, and held: the edges out of sub-vertices, one after the other.

        None if no vertex has too many edges here."""
        if not ((np.bincount(self.low, minlength=self.n) + np.bincount(self.high, minlength=self.n)) * split[3] > split[2]).any():
            return None
        m, name = len(self.key), ids[self.vertex]
        # both ends' edges decide what is split; the edges out are those by the lower end
        sub, root = deal(np.concatenate([self.low, self.high]), np.concatenate([name[self.high], name[self.low]]), *split)
        held = np.argsort(sub[:m], kind="stable")
        return sub[:m], root, np.searchsorted(sub[:m][held], np.arange(len(root) + 1)), held

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _ODD) >> np.uint64(64 - _FILTER_BITS)

    def triangles(self, forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The three edges of each triangle a < b < c (ranks): a-b, then b-c and a-c, or if not forward in either order.

        forward: the higher neighbours of b are forwarded to a, whose edges close. Otherwise that or the rest of a's own, whichever are fewer.
        """
        if self.parts:
            yield from self._split_triangles()
            return
        m = len(self.key)
        start, size, base = self.out[self.high], self.out[self.high + 1] - self.out[self.high], self.low
        if not forward:
            rest = self.out[self.low + 1] - 1 - np.arange(m)
            fewer = rest < size
            start, size, base = np.where(fewer, np.arange(m) + 1, start), np.where(fewer, rest, size), np.where(fewer, self.high, base)
        total, base = np.cumsum(size), base * self.n
        shift = start - (total - size)
        at = 0
        while at < m:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + _WEDGES, side="right")))
            place = np.arange(before, total[end - 1]) + np.repeat(shift[at:end], size[at:end])
            query = np.repeat(base[at:end], size[at:end]) + self.high[place]
            maybe = np.flatnonzero(self.filter[self._hash(query)])
            query = query[maybe]
            found = np.minimum(np.searchsorted(self.key, query), m - 1)
            hit = self.key[found] == query
            maybe = maybe[hit]
            yield at + np.searchsorted(total[at:end], before + maybe, side="right"), place[maybe], found[hit]
            at = end


    def _split_triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same by sub-vertices: each of b's gathers the higher neighbours on its own edges and is sent each edge a-b that closes them."""
        _, root, begins, held = self.parts
        first_sub = np.searchsorted(root, np.arange(self.n + 1))
        subs = np.diff(first_sub)[self.high]  # of each edge's higher end
        edge = np.repeat(np.arange(len(self.key)), subs)
        sub = np.arange(len(edge)) - np.repeat(np.cumsum(subs) - subs, subs) + first_sub[self.high[edge]]
        size = np.diff(begins)[sub]
        edge, sub, size = edge[size > 0], sub[size > 0], size[size > 0]
        total = np.cumsum(size)
        shift = begins[sub] - (total - size)
        at = 0
        while at < len(edge):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + _WEDGES, side="right")))
            place = held[np.arange(before, total[end - 1]) + np.repeat(shift[at:end], size[at:end])]
            ab = np.repeat(edge[at:end], size[at:end])
            query = self.low[ab] * self.n + self.high[place]
            maybe = np.flatnonzero(self.filter[self._hash(query)])
            query = query[maybe]
            found = np.minimum(np.searchsorted(self.key, query), len(self.key) - 1)
            hit = self.key[found] == query
            yield ab[maybe[hit]], place[maybe[hit]], found[hit]
            at = end

    def merged(self, counts: np.ndarray) -> int:
        """Closed wedges by the sub-vertex of a that got them, added at its root and then over the roots."""
        sub, root = self.parts[:2]
        by_sub = np.bincount(sub, weights=counts, minlength=len(root))
        return int(np.bincount(root, weights=by_sub).sum())


def _cell(table: pa.Table, what: str, forward: bool, split: tuple | None = None) -> tuple[np.ndarray | int, list[int]]:
    """What a cell finds: the number of triangles, that of paths over multiple edges, or per edge as given its triangles; and the rows' lengths."""
    rows = table.num_rows
    blocks = [tuple(table.column(c)[i].as_py() for c in ("ci", "cj")) for i in range(rows)]
    n = table.column("n").to_pylist()
    us, vs = ([_unpack(table.column(c)[i], n[i]) for i in range(rows)] for c in ("u", "v"))
    loops = [u == v for u, v in zip(us, vs, strict=True)]
    keep = np.flatnonzero(~np.concatenate(loops))
    mult = None
    if what == "paths":
        mult = np.concatenate([_unpack(table.column("there")[i], n[i]) + _unpack(table.column("back")[i], n[i]) for i in range(rows)])[keep]
    # of two blocks, one of them twice: triangles inside that one are another cell's
    inside = np.repeat([i == j for i, j in blocks], n)[keep]
    if table.column("whole")[0].as_py() or not inside.any():
        inside = None
    us, vs = ([x[~loop] for x, loop in zip(xs, loops, strict=True)] for xs in (us, vs))
    per_edge = np.zeros(sum(n), np.int64) if what == "edges" else None
    count, pending, held = 0, [], 0
    if len(keep):
        cell = _Cell(us, vs, split)
        del us, vs
        for ab, second, third in cell.triangles(forward):
            if inside is not None:
                outer = ~(inside[cell.order[ab]] & inside[cell.order[second]] & inside[cell.order[third]])
                ab, second, third = ab[outer], second[outer], third[outer]
            if what == "triangles" and cell.parts:
                count += cell.merged(np.bincount(ab, minlength=len(keep))) if len(ab) else 0
            elif what == "triangles":
                count += len(ab)
            elif what == "paths":  # forward: a-b, b-c, a-c; the two edges at the greatest id count as often as they are there
                a, b, c = (cell.vertex[x] for x in (cell.low[ab], cell.high[ab], cell.high[second]))
                e_ab, e_bc, e_ac = (mult[cell.order[x]] for x in (ab, second, third))
                top = np.maximum(np.maximum(a, b), c)
                count += int(np.where(top == c, e_bc * e_ac, np.where(top == b, e_ab * e_bc, e_ab * e_ac)).sum())
            else:
                pending += [ab, second, third]
                held += 3 * len(ab)
                if held > 4_000_000:
                    per_edge[keep[cell.order]] += np.bincount(np.concatenate(pending), minlength=len(keep))
                    pending, held = [], 0
        if pending:
            per_edge[keep[cell.order]] += np.bincount(np.concatenate(pending), minlength=len(keep))
    return (per_edge if what == "edges" else count), n


def _over_cells(pairs: DataFrame, what: str, schema: str, forward: bool, columns: tuple[str, ...], split: tuple | None = None) -> DataFrame:
    """Rows of each cell of the packed block pairs, wave by wave; a table."""
    sizes = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(sum(F.length(c) for c in columns)), F.lit(0))).first()
    wanted = min(FINE, sqrt(6 * sizes[0] / CELL_EDGES)) if sizes[0] > CELL_EDGES else 1  # a cell of three blocks has 6 / p**2 of the edges
    p = next(k for k in range(1, FINE + 1) if FINE % k == 0 and k >= wanted)
    waves = max(1, ceil(p * sizes[1] / WAVE_BYTES))

    def run(table: pa.Table) -> pa.Table:
        found, n = _cell(table, what, forward, split)
        if what != "edges":
            return pa.table({"n": pa.array([found], pa.int64())})
        at = np.cumsum([0, *n])
        parts = [found[at[i] : at[i + 1]] for i in range(len(n))]
        some = [i for i, x in enumerate(parts) if x.any()]
        return pa.table({"fi": table.column("fi").take(pa.array(some, pa.int64())), "fj": table.column("fj").take(pa.array(some, pa.int64())), "kind": pa.array([1] * len(some), pa.int32()),
                         "n": pa.array([n[i] for i in some], pa.int64()), "data": pa.array([[_pack(parts[i])] for i in some], pa.list_(pa.binary()))})

    coarse = pairs.select("fi", "fj", "n", *columns, *(F.expr(f"cast({f} * {p} div {FINE} as int)").alias(c) for f, c in (("fi", "ci"), ("fj", "cj"))))
    cells = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: F.array_sort(F.array(F.col("ci"), F.col("cj"), k)))
    dealt = coarse.withColumn("cell", F.explode(cells)).withColumn("whole", F.col("cell")[0] == F.col("cell")[2])
    dealt = dealt.withColumn("cell", (F.col("cell")[0] * p + F.col("cell")[1]) * p + F.col("cell")[2])
    out = None
    for wave in range(waves):
        part = dealt.where(F.pmod(F.xxhash64("cell"), F.lit(waves)) == wave) if waves > 1 else dealt
        done = cut(part.groupBy("cell").applyInArrow(run, schema))
        out = done if out is None else out.unionByName(done)
        _release(out)
    return out


def _total(edges: DataFrame, what: str, forward: bool, split: tuple | None = None) -> DataFrame:
    spark = edges.sparkSession
    ship(spark)
    pairs = packed(_numbered(edges)[0])
    columns = ("u", "v", "there", "back") if what == "paths" else ("u", "v")
    found = _over_cells(pairs, what, "n long", forward, columns, split)
    drop(pairs)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triangles"))


def count_triangles(edges: DataFrame, forward: bool = False, split: tuple | None = None) -> DataFrame:
    """One row (triangles): those of the simple graph, 0 if there are none. Ids are of any type. split: as for a cell."""
    return _total(edges, "triangles", forward, split)


def count_paths(edges: DataFrame) -> DataFrame:
    """One row (triangles): each triangle as often as its two edges at the greatest id, taken together, occur, whichever way. Ids are longs."""
    return _total(edges, "paths", True)


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges with longs for ids, and (id, number) if the ids aren't integers."""
    if all(isinstance(edges.schema[c].dataType, (ByteType, ShortType, IntegerType, LongType)) for c in ("src", "dst")):
        return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), None
    edges = cut(edges.select("src", "dst"))
    ids = cut(endpoints(edges).where("id is not null").distinct().withColumn("number", F.monotonically_increasing_id()))
    src, dst = (ids.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number")) for c in ("src", "dst"))
    return edges.join(src, "src").join(dst, "dst").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst")), ids


_ROW = "fi int, fj int, kind int, n long, data array<binary>"


def _degrees_of(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row and end: the block, its vertices there, their neighbours and loops there."""
    for i in range(table.num_rows):
        n = table.column("n")[i].as_py()
        u, v = (_unpack(table.column(c)[i], n) for c in ("u", "v"))
        loop = u == v
        fi, fj = (table.column(c)[i].as_py() for c in ("fi", "fj"))
        for f, own, counted in ((fi, u, np.ones(n, bool)), (fj, v, ~loop)):
            ids, where = np.unique(own[counted], return_inverse=True)
            if len(ids):
                yield f, ids, np.bincount(where), np.bincount(where, weights=loop[counted]).astype(np.int64)


def _partial_degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, ids, d, loop in _degrees_of(batch):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([[_pack(x) for x in (ids, d, loop)]], pa.list_(pa.binary()))], ["f", "n", "data"])


def _block_degrees(table: pa.Table) -> pa.Table:
    """The degrees of a block's vertices, for every block pair that the block is in: kind 2 for its first end, 3 for its second."""
    n = table.column("n").to_pylist()
    ids, d, loop = (np.concatenate([_unpack(table.column("data")[i][k], n[i]) for i in range(len(n))]) for k in range(3))
    known, where = np.unique(ids, return_inverse=True)
    sums = [np.bincount(where, weights=x, minlength=len(known)).astype(np.int64) for x in (d, loop)]
    f, data = table.column("f")[0].as_py(), [_pack(x) for x in (known, *sums)]
    to = [(f, g, 2) for g in range(f, FINE)] + [(g, f, 3) for g in range(f + 1)]
    return pa.table({"fi": pa.array([x[0] for x in to], pa.int32()), "fj": pa.array([x[1] for x in to], pa.int32()), "kind": pa.array([x[2] for x in to], pa.int32()),
                     "n": pa.array([len(known)] * len(to), pa.int64()), "data": pa.array([data] * len(to), pa.list_(pa.binary()))})


def _similar(both_ways: bool):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        u = v = there = back = None
        shared, of = 0, {}
        for i in range(table.num_rows):
            kind, n, data = table.column("kind")[i].as_py(), table.column("n")[i].as_py(), table.column("data")[i]
            if kind == 0:
                u, v, there, back = (_unpack(data[k], n) for k in range(4))
            elif kind == 1:
                shared = shared + _unpack(data[0], n)
            else:
                of[kind] = [_unpack(data[k], n) for k in range(3)]
        if u is None:  # a pair without edges
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "jaccard": pa.array([], pa.float64())})
        (du, lu), (dv, lv) = ([x[np.searchsorted(of[k][0], ids)] for x in of[k][1:]] for k, ids in ((2, u), (3, v)))
        both = shared + lu + lv
        value = np.where(u == v, 1.0, both / np.where(u == v, 1, du + dv - both))
        if both_ways:
            there, back = np.ones(len(u), np.int64), (u != v).astype(np.int64)
        a, b = np.repeat(np.arange(len(u)), there), np.repeat(np.arange(len(u)), back)
        return pa.table({"src": np.concatenate([u[a], v[b]]), "dst": np.concatenate([v[a], u[b]]), "jaccard": np.concatenate([value[a], value[b]])})

    return run


def jaccard_over_cells(edges: DataFrame, both_ways: bool = False, split: tuple | None = None) -> DataFrame:
    """(src, dst, jaccard) per edge as given; both_ways: of distinct pairs, once in each direction. Ids are of any type. split: as for a cell."""
    ship(edges.sparkSession)
    numbered, ids = _numbered(edges)
    pairs = packed(numbered)
    shared = _over_cells(pairs, "edges", _ROW, False, ("u", "v"), split)
    of = pairs.select("fi", "fj", "n", "u", "v").mapInArrow(_partial_degrees, "f int, n long, data array<binary>").groupBy("f").applyInArrow(_block_degrees, _ROW)
    own = pairs.select("fi", "fj", F.lit(0).alias("kind"), "n", F.array("u", "v", "there", "back").alias("data"))
    found = own.unionByName(shared).unionByName(of).groupBy("fi", "fj").applyInArrow(_similar(both_ways), "src long, dst long, jaccard double")
    if ids is None:
        return found.select(*(F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("src", "dst")), "jaccard")
    src, dst = (ids.select(F.col("number").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    return found.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "jaccard")
