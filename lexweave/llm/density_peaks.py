"""Clusters of mutually similar vectors by density peaks over blocked neighbour joins.

A row's density is the number of rows with at least ``similarity`` to it; it points to its most similar denser neighbour; rows
without one are the peaks, and whatever leads to a peak is its cluster.

All vectors are compared (``complete``): densities count every neighbour, no link is left out, and what single precision leaves in doubt
is decided in double. Slices of the rows are the blocks; the work is half the square of the rows, the second pass only takes those with a
neighbour. ``neighbour_pairs`` lists the pairs themselves.

With a ``miss`` above 0, ``clusters`` looks for neighbours in blocks of similar rows instead, whose work grows about as the rows do.
Such a block is a pair of Gaussian directions, one of each of two sets; a row goes to the ``copies``
blocks with the largest sums of its two projections, where similar rows meet with a good chance. The number of blocks grows with
the rows, so a block keeps its size, and the comparisons grow as the rows do; the directions, which a row is projected on, grow as
the square root of the rows. A pair met in several blocks counts in the first of them.
What the first round misses, later rounds look for: they join only the rows that found no denser neighbour, on other directions
and in more blocks each. The chance that two similar rows meet falls as the blocks become more, so the number of later rounds isn't
fixed: they go on until two rows just at ``similarity`` would have missed each other in all of them with a chance of at most ``miss``,
and then until a round finds nothing new.

Hot groups: equal vectors (after rounding to 8 bits) are one weighted row; a block that a sample of bounded size shows to be larger
than ``block_rows`` is cut into parts, and each pair of parts is joined in a task of its own, so all its pairs are still met. Only
counts and pointers leave a block, never its pairs. Similarities in blocks come from 8-bit vectors. They decide the order of density and
which neighbour is nearest, but not whether a pointer holds: one whose similarity is within ``slack`` of the bound is computed again
from the full vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import cut, lookup_join, pinned
from . import complete
from .unit_vectors import DIM, float_rows, full_rows, usable

MET = "key bigint, part int, row_id bigint, vec binary, n bigint, density bigint, met binary"
TILE = 2048


def byte_rows(rows: DataFrame) -> DataFrame:
    """``row_id, vec`` (128 signed bytes in the direction of the vector) of the usable rows of ``row_id, embedding``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable(b.column(0), b.column(1))
            packed = np.rint(x / np.abs(x).max(axis=1, initial=1e-30, keepdims=True) * 127).astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([packed[i : i + DIM] for i in range(0, len(packed), DIM)], pa.binary())], names=["row_id", "vec"])

    return rows.select("row_id", "embedding").mapInArrow(run, "row_id bigint, vec binary")


def _vectors(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIM).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Blocks:
    """The blocks of one round: ``side`` directions in each of the two sets, ``copies`` blocks a row."""

    def __init__(self, rows: int, copies: int, block_rows: int, seed: int):
        self.side = max(2, round(math.sqrt(max(1, rows) * copies / block_rows)))
        self.copies = min(copies, self.side * self.side)
        self.g = np.random.default_rng(seed).standard_normal((DIM, 2 * self.side)).astype(np.float32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The blocks of each row, ascending."""
        p, m = x @ self.g, min(self.side, self.copies)
        a, b = p[:, : self.side], p[:, self.side :]
        ia, ib = np.argpartition(-a, m - 1, 1)[:, :m], np.argpartition(-b, m - 1, 1)[:, :m]
        total = np.take_along_axis(a, ia, 1)[:, :, None] + np.take_along_axis(b, ib, 1)[:, None, :]
        code = (ia[:, :, None] * self.side + ib[:, None, :]).reshape(len(x), m * m)
        best = np.argpartition(-total.reshape(len(x), -1), self.copies - 1, 1)[:, : self.copies]
        return np.sort(np.take_along_axis(code, best, 1), 1).astype(np.int32)

    def meeting(self, similarity: float, pairs: int = 2000) -> float:
        """The share of ``pairs`` random pairs of rows at this cosine that meet in a block (one pair at least counts as met)."""
        rng = np.random.default_rng(7)
        x, y = rng.standard_normal((2, pairs, DIM))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (y * x).sum(1, keepdims=True) * x
        y *= math.sqrt(max(0.0, 1 - similarity * similarity)) / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = self.of(x.astype(np.float32)), self.of((similarity * x + y).astype(np.float32))
        return max(1, int((a[:, :, None] == b[:, None, :]).any((1, 2)).sum())) / pairs


def _spread(rows: DataFrame, blocks: Blocks, count: int, block_rows: int, sample: int, with_blocks: bool = False) -> DataFrame:
    """Each row of ``row_id, vec, n, density`` once in each of its blocks, or in each pair of parts of a cut block; ``met``: its blocks."""
    every = max(1, -(-count // sample))
    seen = rows.filter(F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(every)) == 0).select("vec").limit(2 * sample).toArrow()
    sizes = np.bincount(blocks.of(_vectors(seen.column(0))).ravel(), minlength=1) * every if seen.num_rows else np.zeros(1, int)
    parts = {int(b): min(65_535, -(-int(sizes[b]) // (4 * block_rows))) for b in np.flatnonzero(sizes > 8 * block_rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            met = blocks.of(_vectors(b.column(1)))
            at = np.repeat(np.arange(len(met)), met.shape[1])
            key, part = met.ravel().astype(np.int64) << 32, np.zeros(met.size, np.int32)
            if parts:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                more_at, more_key, more_part = [], [], []
                whole = ~np.isin(met.ravel(), list(parts))
                for k in np.flatnonzero(~whole).tolist():
                    n = parts[int(key[k] >> 32)]
                    own = int(ids[at[k]]) * 2654435761 // 128 % n
                    for other in range(n):
                        i, j = min(own, other), max(own, other)
                        more_at.append(at[k])
                        more_key.append(int(key[k]) | i << 16 | j)
                        more_part.append(own)
                at, key = np.concatenate([at[whole], np.array(more_at, np.int64)]), np.concatenate([key[whole], np.array(more_key, np.int64)])
                part = np.concatenate([part[whole], np.array(more_part, np.int32)])
            listed = pa.array([m.tobytes() for m in met], pa.binary()) if with_blocks else pa.nulls(len(met), pa.binary())
            row = pa.RecordBatch.from_arrays([*b.columns, listed], names=["row_id", "vec", "n", "density", "met"])
            for start in range(0, len(at), 20_000):
                some = row.take(pa.array(at[start : start + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(key[start : start + 20_000]), pa.array(part[start : start + 20_000]), *some.columns], names=["key", "part", *some.schema.names])

    return rows.select("row_id", "vec", "n", "density").mapInArrow(run, MET)


def _tiles(key: int, part: np.ndarray, x: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, cosine) of the similar pairs of a block, each in both orders, tile by tile. Rows of one part of a cut block meet in the block of that part alone."""
    i_part, j_part = key >> 16 & 65_535, key & 65_535
    left = right = np.arange(len(x))
    if i_part != j_part:
        left, right = np.flatnonzero(part == i_part), np.flatnonzero(part == j_part)
    for a in range(0, len(left), TILE):
        la = left[a : a + TILE]
        for b in range(0, len(right), TILE):
            rb = right[b : b + TILE]
            cos = x[la] @ x[rb].T
            i, j = np.nonzero(cos >= similarity)
            u, v, c = la[i], rb[j], cos[i, j]
            if i_part == j_part:
                keep = u != v
                yield u[keep], v[keep], c[keep]
            else:
                yield np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([c, c])


def _density(similarity: float, slack: float):
    """Counts of the neighbours of a block's rows; a row that only has a doubtful one is listed too, as it may find a pointer."""

    def run(table: pa.Table) -> pa.Table:
        ids, x, n = table.column("row_id").to_numpy(), _vectors(table.column("vec")), table.column("n").to_numpy()
        key, part = table.column("key")[0].as_py(), table.column("part").to_numpy()
        met = np.frombuffer(b"".join(table.column("met").to_pylist()), np.int32).reshape(len(ids), -1)
        count, met_any = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for u, v, c in _tiles(key, part, x, similarity - slack):
            met_any[u] = True
            u, v = u[c >= similarity], v[c >= similarity]
            for a in range(0, len(u), 200_000):
                p, q = u[a : a + 200_000], v[a : a + 200_000]
                shared = (met[p][:, :, None] == met[q][:, None, :]).any(2)
                first = np.where(shared, met[p], np.iinfo(np.int32).max).min(1) == key >> 32
                np.add.at(count, p[first], n[q[first]])
        some = np.flatnonzero(met_any)  # where a second pass may find a pointer
        return pa.table([pa.array(ids[some]), pa.array(np.full(len(some), key)), pa.array(count[some]), pa.array(n[some])], names=["row_id", "key", "near", "n"])

    return run


def _pointers(key: int, part: np.ndarray, ids: np.ndarray, x: np.ndarray, density: np.ndarray, similarity: float) -> pa.Table:
    """Each row's most similar denser row in a block; of equally dense rows the one with the smaller id counts as denser."""
    parent, best = np.full(len(ids), -1, np.int64), np.full(len(ids), -2, np.float32)
    for u, v, c in _tiles(key, part, x, similarity):
        up = (density[v] > density[u]) | ((density[v] == density[u]) & (ids[v] < ids[u]))
        u, v, c = u[up], v[up], c[up]
        order = np.lexsort((-ids[v], c, u))
        u, v, c = u[order], v[order], c[order]
        last = np.flatnonzero(np.append(u[1:] != u[:-1], True)) if len(u) else np.zeros(0, int)
        better = c[last] > best[u[last]]
        best[u[last[better]]], parent[u[last[better]]] = c[last[better]], ids[v[last[better]]]
    some = np.flatnonzero(best > -2)
    return pa.table([pa.array(ids[some]), pa.array(parent[some]), pa.array(best[some].astype(np.float64))], names=["row_id", "parent", "cos"])


LINKS = "row_id bigint, parent bigint, cos double"


def _first_round(rows: DataFrame, count: int, similarity: float, slack: float, copies: int, block_rows: int, sample: int) -> DataFrame:
    """``row_id, density, parent, cos`` of the rows that met a neighbour; both passes read the same shuffle of the blocks."""
    spread = _spread(rows, Blocks(count, copies, block_rows, 101), count, block_rows, sample, with_blocks=True)
    near = spread.groupBy("key").applyInArrow(_density(similarity, slack), "row_id bigint, key bigint, near bigint, n bigint")
    dense = near.groupBy("row_id").agg(F.collect_list("key").alias("keys"), (F.sum("near") + F.max("n") - 1).alias("density"))
    dense = cut(dense)

    def link(data: pa.Table, known: pa.Table) -> pa.Table:
        if not data.num_rows or not known.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["row_id", "parent", "cos"])
        ids = data.column("row_id").to_numpy()
        order = np.argsort(known.column("row_id").to_numpy(), kind="stable")
        have, value = known.column("row_id").to_numpy()[order], known.column("density").to_numpy()[order]
        at = np.minimum(np.searchsorted(have, ids), len(have) - 1)
        on = np.flatnonzero(have[at] == ids)
        key, part = data.column("key")[0].as_py(), data.column("part").to_numpy()[on]
        return _pointers(key, part, ids[on], _vectors(data.column("vec").take(pa.array(on))), value[at[on]], similarity - slack)

    by_key = dense.select(F.explode("keys").alias("key"), "row_id", "density")
    links = spread.groupBy("key").cogroup(by_key.groupBy("key")).applyInArrow(link, LINKS)
    return dense.select("row_id", "density").join(_best_links(links), "row_id", "left")


def _best_links(links: DataFrame) -> DataFrame:
    return links.groupBy("row_id").agg(F.max_by("parent", F.struct("cos", -F.col("parent"))).alias("parent"), F.max("cos").alias("cos"))


def held(links: DataFrame, rows: DataFrame, similarity: float, slack: float) -> DataFrame:
    """The links ``row_id, parent`` of ``row_id, parent, cos`` with a cosine of at least ``similarity``; it is computed from the vectors of
    ``row_id, embedding`` where ``cos`` is within ``slack`` of it. Of several versions of a row the most similar counts."""
    unsure = cut(links.filter(F.col("cos") < similarity + slack).select("row_id", "parent"))
    ids = unsure.select("row_id").union(unsure.select("parent")).distinct()
    full = lookup_join(rows.filter(F.size("embedding") == DIM).select("row_id", "embedding"), ids, ["row_id"], "left_semi")
    both = unsure.join(full, "row_id").join(full.select(F.col("row_id").alias("parent"), F.col("embedding").alias("_other")), "parent")
    good = both.filter(vectors.cosine(F.col("embedding"), F.col("_other")) >= similarity).select("row_id", "parent").distinct()
    return links.filter(F.col("cos") >= similarity + slack).select("row_id", "parent").unionAll(good)


def follow(links: DataFrame) -> DataFrame:
    """``row_id, root`` of ``row_id, parent`` (a forest; a root is its own parent), by pointer jumping: the depth halves each round."""
    state = cut(links.select("row_id", F.col("parent").alias("root")))
    while True:
        up = state.select(F.col("row_id").alias("root"), F.col("root").alias("next")).filter(F.col("root") != F.col("next"))
        # rows that share a root may be most rows: the roots that still move are broadcast or salted
        jumped = cut(lookup_join(state, up, ["root"], "left").select("row_id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if jumped.filter("moved").isEmpty():
            return state
        state = jumped.drop("moved")


def neighbour_pairs(rows: DataFrame, similarity: float = 0.65, smallest: int = 5, slice_rows: int = complete.SLICE_ROWS) -> DataFrame:
    """``row_a, row_b``, row_a < row_b: all pairs of usable rows of ``row_id, embedding`` with a cosine of at least ``similarity`` whose first
    row has at least ``smallest`` - 1 such neighbours.

    Where groups are apart and alike within, these are the pairs of rows of a cluster. A repeated row counts once; of a row with several
    vectors each counts, and a pair that several of them make is listed as often, as in the SQL.
    """
    each = cut(full_rows(rows).dropDuplicates(["row_id", "vec"]))

    def run(batches: Iterator[pa.RecordBatch], held: complete.Side) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = complete.side(batch)
            own = side.more[-1] == 1
            for i, j, _ in complete.similar(side, held, similarity):
                u, v = side.ids[i], held.ids[j]
                keep = np.where(own[i], u < v, u != v)  # two rows of the slice meet twice
                u, v = u[keep], v[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["row_a", "row_b"])

    near = complete.by_slices(each, each, each.count(), run, "row_a bigint, row_b bigint", slice_rows, later=True)
    ends = near.select(F.explode(F.array("row_a", "row_b")).alias("row_a"))
    dense = ends.groupBy("row_a").count().filter(F.col("count") >= smallest - 1).select("row_a")
    return lookup_join(near, dense, ["row_a"], "left_semi")


def _compared(base: DataFrame, count: int, similarity: float, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """``row_id, density`` of the rows of ``row_id, vec, n`` that have a neighbour, and their links ``row_id, parent``, by comparing all vectors."""

    def counted(batches: Iterator[pa.RecordBatch], held: complete.Side) -> Iterator[pa.RecordBatch]:
        def listed(ids: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(near)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near[some].astype(np.int64))], names=["row_id", "near"])

        theirs = np.zeros(len(held.ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            side = complete.side(batch)
            n, own = side.more[0], side.more[-1] == 1
            near = np.zeros(len(side.ids))
            for i, j, _ in complete.similar(side, held, similarity):
                other = side.ids[i] != held.ids[j]
                i, j = i[other], j[other]
                near += np.bincount(i, held.more[0][j], len(near))
                i, j = i[~own[i]], j[~own[i]]
                theirs += np.bincount(j, n[i], len(theirs))
            yield listed(side.ids, near)
        yield listed(held.ids, theirs)

    rows = base.select("row_id", "vec", "n")
    near = complete.by_slices(rows, rows, count, counted, "row_id bigint, near bigint", slice_rows, later=True)
    sums = pinned(near.groupBy("row_id").agg(F.sum("near").alias("near")))
    dense = lookup_join(rows, sums, ["row_id"]).select("row_id", "vec", (F.col("near") + F.col("n") - 1).alias("density"))
    if not sums.few:  # where they are few, the join with the broadcast sums is cheaper than keeping the vectors twice
        dense = cut(dense)

    def linked(batches: Iterator[pa.RecordBatch], held: complete.Side) -> Iterator[pa.RecordBatch]:
        theirs = _Parents(len(held.ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            side = complete.side(batch)
            density, own = side.more[0], side.more[-1] == 1
            parents = _Parents(len(side.ids))
            for i, j, c in complete.similar(side, held, similarity):
                u, v, du, dv = side.ids[i], held.ids[j], density[i], held.more[0][j]
                up = (dv > du) | ((dv == du) & (v < u))
                down = ~up & ~own[i]
                parents.add(i[up], v[up], c[up])
                theirs.add(j[down], u[down], c[down])
            yield parents.listed(side.ids)
        yield theirs.listed(held.ids)

    links = complete.by_slices(dense, dense, sums.df.count(), linked, LINKS, slice_rows, later=True)
    return dense.select("row_id", "density"), _best_links(links).select("row_id", "parent")


class _Parents:
    """The most similar denser row of each row so far; of equally similar ones the one with the smallest id."""

    def __init__(self, n: int):
        self.parent, self.cos = np.full(n, -1, np.int64), np.full(n, -2.0)

    def add(self, row: np.ndarray, parent: np.ndarray, cos: np.ndarray) -> None:
        order = np.lexsort((-parent, cos, row))
        row, parent, cos = row[order], parent[order], cos[order]
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, int)
        row, parent, cos = row[last], parent[last], cos[last]
        better = (cos > self.cos[row]) | ((cos == self.cos[row]) & (parent < self.parent[row]))
        self.parent[row[better]], self.cos[row[better]] = parent[better], cos[better]

    def listed(self, ids: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(self.cos > -2)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(self.parent[some]), pa.array(self.cos[some])], names=["row_id", "parent", "cos"])


def clusters(
    rows: DataFrame,
    similarity: float = 0.65,
    smallest: int = 5,
    copies: int = 4,
    later_copies: int = 8,
    rounds: int = 3,
    block_rows: int = 1500,
    sample: int = 20_000,
    miss: float = 0.0,
    slack: float = 0.006,
    slice_rows: int = complete.SLICE_ROWS,
) -> DataFrame:
    """``row_id, cluster, density`` of the usable rows of ``row_id, embedding`` that are in a cluster of at least ``smallest`` rows.

    ``cluster`` is the row id of the peak. Rows without id or with an unusable vector (not 128 finite numbers, all zero), and rows in
    smaller groups, are in no cluster. A repeated row id counts once; of versions with different vectors the smallest (by its bytes) holds.
    All vectors are compared, ``slice_rows`` with the rest at a time.

    A ``miss`` above 0 looks for neighbours in blocks instead, and densities only count those met. ``rounds``: later rounds, at least, over
    the rows still without a denser neighbour; they go on while two rows just at ``similarity`` have missed each other in all of them with a
    larger chance than ``miss``, and as long as a round finds a neighbour. ``slack``: more than the rounding to 8 bits changes a cosine (its
    standard deviation is about 0.0008).
    """
    # one vector a row id, so that the pointers can't lead in a circle
    units = (byte_rows if miss > 0 else full_rows)(rows).groupBy("row_id").agg(F.min("vec").alias("vec"))
    base = cut(units.groupBy("vec").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")))
    count = base.count()
    if miss > 0:
        dense, links = _in_blocks(base, count, rows, similarity, copies, later_copies, rounds, block_rows, sample, miss, slack)
    else:
        dense, links = _compared(base, count, similarity, slice_rows)
    known = base.select("row_id", "n").join(dense, "row_id", "left").select("row_id", "n", F.coalesce("density", F.col("n") - 1).alias("density"))
    everyone = cut(known.join(links, "row_id", "left").select("row_id", "n", "density", F.coalesce("parent", "row_id").alias("parent")))
    labelled = everyone.join(follow(everyone.select("row_id", "parent")), "row_id")
    big = labelled.groupBy("root").agg(F.sum("n").alias("size")).filter(F.col("size") >= smallest).select("root")
    kept = cut(lookup_join(labelled, big, ["root"], "left_semi").select("row_id", "n", F.col("root").alias("cluster"), "density"))
    single = kept.filter("n = 1").select("row_id", "cluster", "density")
    # rows whose vector others share take the label of its first row
    several = kept.filter("n > 1")
    if several.isEmpty():
        return single
    shared = several.join(base.select("row_id", "vec"), "row_id").select("vec", "cluster", "density")
    return single.unionAll(lookup_join(units, shared, ["vec"], rows=100_000).select("row_id", "cluster", "density"))


def _in_blocks(base: DataFrame, count: int, rows: DataFrame, similarity: float, copies: int, later_copies: int, rounds: int, block_rows: int, sample: int, miss: float, slack: float) -> tuple[DataFrame, DataFrame]:
    """As ``_compared``, for vectors of 8 bits, with the neighbours that are met in blocks."""
    base = base.withColumn("density", F.lit(0).cast("bigint"))
    state = cut(_first_round(base, count, similarity, slack, copies, block_rows, sample))
    density = F.coalesce("density", F.col("n") - 1).alias("density")
    peaks = cut(base.drop("density").join(state, "row_id", "left").filter("parent is null").select("row_id", "vec", "n", density))
    late, missed, found = [], 1.0, True
    while len(late) < rounds or missed > miss or found:
        left = peaks.count()
        blocks = Blocks(left, later_copies, block_rows, 202 + len(late))
        spread = _spread(peaks, blocks, left, block_rows, sample)

        def link(table: pa.Table) -> pa.Table:
            key, part, ids = table.column("key")[0].as_py(), table.column("part").to_numpy(), table.column("row_id").to_numpy()
            return _pointers(key, part, ids, _vectors(table.column("vec")), table.column("density").to_numpy(), similarity - slack)

        late.append(cut(_best_links(spread.groupBy("key").applyInArrow(link, LINKS))))
        missed *= 1 - blocks.meeting(similarity)
        found = not late[-1].isEmpty()
        if found:
            peaks = cut(peaks.join(late[-1].select("row_id"), "row_id", "left_anti"))
    first = state.filter(F.col("parent").isNotNull()).select("row_id", "parent", "cos")
    return state.select("row_id", "density"), held(reduce(DataFrame.unionAll, late, first), rows, similarity, slack)


def _parted(labels: DataFrame, part_rows: int) -> DataFrame:
    """``cluster, row_id, parts, part``: clusters of more than ``part_rows`` rows cut into parts by a hash of the row."""
    parts = labels.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    return lookup_join(labels, parts, ["cluster"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))


def pairs(labels: DataFrame, part_rows: int = 2000) -> DataFrame:
    """``row_a, row_b``: all pairs of rows of a cluster, row_a < row_b.

    A cluster of more than ``part_rows`` rows is cut into parts: each row is the first of its pairs in one part and goes to every
    part as the second, so that no task meets the whole. ``clusters`` and ``described`` say the same in one row a member or cluster.
    """
    parted = _parted(cut(labels.select("cluster", "row_id")), part_rows)
    a = parted.select("cluster", F.col("row_id").alias("row_a"), "part")
    b = parted.select("cluster", F.col("row_id").alias("row_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["cluster", "part"]).filter(F.col("row_a") < F.col("row_b")).select("row_a", "row_b")


def density_within(labels: DataFrame, rows: DataFrame, similarity: float = 0.65, part_rows: int = 2000) -> DataFrame:
    """``row_id, cluster, density`` of ``labels``: the number of other rows of its cluster with at least ``similarity`` to each row, from the
    full vectors of ``row_id, embedding`` (of several versions of a row the smallest holds).

    The counts of ``clusters`` only know the neighbours that were met; these are complete. ``cluster`` is the id of the densest row by these
    counts (of equally dense ones the smallest). Clusters are cut as in ``pairs``.
    """
    labels = cut(labels.select("cluster", "row_id"))
    vec = float_rows(rows).groupBy("row_id").agg(F.min("vec").alias("vec"))
    q = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = _parted(labels, part_rows).join(vec, "row_id").select("cluster", "part", "row_id", "vec", q.alias("q"))
    placed = sent.select("cluster", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "row_id", "vec")
    by_block = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    counted = by_block.mapInArrow(_within(similarity), "row_id bigint, cluster bigint, density bigint")
    known = cut(counted.groupBy("row_id", "cluster").agg(F.sum("density").alias("density")))
    peaks = known.groupBy("cluster").agg(F.max_by("row_id", F.struct("density", -F.col("row_id"))).alias("peak"))
    return lookup_join(known, peaks, ["cluster"]).select("row_id", F.col("peak").alias("cluster"), "density")


def _within(similarity: float):
    """Counts of the rows of each block, which come one after another."""

    def counted(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part, ids = block.column("part").to_numpy(), block.column("row_id").to_numpy()
        x = np.frombuffer(b"".join(block.column("vec").to_pylist()), np.float32).reshape(-1, DIM)
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        n = np.zeros(len(ids), np.int64)
        for a in range(0, len(left), TILE):
            near = x[left[a : a + TILE]] @ x[right].T >= similarity
            n[left[a : a + TILE]] += near.sum(axis=1)
            if i != j:
                n[right] += near.sum(axis=0)
        return ids, block.column("cluster").to_numpy(), n - (i == j)  # a row is not its own neighbour

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([now.column(c).to_numpy() for c in ("cluster", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            held = now.slice(int(cuts[-1])) if len(cuts) else now
            blocks = [counted(now.slice(a, z - a)) for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*blocks)], names=["row_id", "cluster", "density"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in counted(held)], names=["row_id", "cluster", "density"])

    return run


def described(labels: DataFrame, words: DataFrame, typical: int = 3) -> DataFrame:
    """``cluster, size, words``: each cluster with the words of its ``typical`` densest rows (of equally dense rows the smaller ids); rows without a word are passed over."""
    labels = cut(labels)
    names = words.filter(F.col("word").isNotNull()).groupBy("row_id").agg(F.min("word").alias("word"))
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("density"), "row_id"))
    top = labels.join(names, "row_id").withColumn("r", rank).filter(F.col("r") <= typical)
    listed = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias("words"))
    return sizes.join(listed, "cluster", "left").select("cluster", "size", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
