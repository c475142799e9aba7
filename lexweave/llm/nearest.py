"""The most similar vectors of every vector: by blocks of similar rows where there is a floor, by complete comparison where there is none.

``mutual_neighbours``, whose floor is high, takes its candidates from ``block_neighbours``: two rows as near as the floor share a block but
for a chance of ``miss``, and a row is in a few blocks, hardly more in a large table than in a small one. ``neighbours`` is the kd-tree
that it used before and that ``nearest_rows`` takes where a ``miss`` is allowed; a row there visits the more cells, the more there are.

For unit vectors cosine and distance order alike: |a - b|^2 = 2 (1 - cos). Projected on independent Gaussian directions, the
difference of two vectors at distance d has independent N(0, d^2) coordinates, whatever the vectors. A kd-tree splits the
projected space, one direction a level; cells of the upper levels are spread over the cluster, leaves of the lower levels lie in
a cell. A query visits leaves in the order of their distance and verifies their vectors. A leaf beyond k splits at squared
projected gap g holds a vector nearer than d with a chance below P(chi2_k > g / d^2); the search stops at the leaves where this
is below ``miss``, d being the k-th best distance so far or, if that is nearer, the one of ``min_similarity``.

1. The upper tree is fitted on a sample of at most ``sample`` rows; its splits follow the density, so cells are about equally full.
2. In its own cell every vector finds its first neighbours and with their distance the other cells that the test leaves open.
3. Only there it is sent, with its bound; the cells' vectors come from the same shuffle as before.
4. ``exact_order`` computes again, from the full vectors, the similarities that half precision leaves in doubt: those near the lowest
   one asked for and those between the k-th and the next neighbour.
5. Where more rows are as near as the k-th than candidates were kept, ``settled`` compares the query with all vectors (``complete``).

Without a floor few leaves can be left out, so ``nearest_rows`` compares its queries with all vectors unless a ``miss`` is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import cut, lookup_join
from . import complete, density_peaks
from .complete import Best
from .unit_vectors import DIM, ROUNDING, first_rows, full_rows, half_rows, turned_rows, unpack

VISITS = "cell int, row_id bigint, vec binary, bound float, found binary"
FOUND = np.dtype([("id", "<i8"), ("cos", "<f4")])
#: More than rounding to 8 bits after a rotation changes a cosine (its standard deviation is about 0.0008).
BYTE_ROUNDING = 6e-3
TILE = 2048


def directions(m: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((DIM, m)).astype(np.float32)


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom > x), by the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-12:
        n += 1
        term *= x / n
        total += term
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def quantiles(k: int, miss: float) -> np.ndarray:
    """[0, the values that chi-square with 1..k degrees of freedom exceeds with chance ``miss``]; infinite for 0."""
    if miss <= 0:
        return np.array([0.0, *[np.inf] * k])
    out = [0.0]
    for j in range(1, k + 1):
        lo, hi = 0.0, 50.0 + 4 * j
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if chi2_tail(mid, j) > miss else (lo, mid)
        out.append(hi)
    return np.array(out)


class KdTree:
    """Balanced splits at medians, level i along coordinate first + i."""

    def __init__(self, points: np.ndarray, levels: int, first: int = 0):
        self.first, self.cuts = first, []
        node = np.zeros(len(points), np.int64)
        for i in range(levels):
            x = points[:, first + i]
            order = np.lexsort((x, node))
            ends = np.searchsorted(node[order], np.arange(2**i + 1))
            middle = (ends[:-1] + ends[1:]) // 2
            cut = np.where(ends[1:] > ends[:-1], x[order[np.minimum(middle, max(0, len(x) - 1))]] if len(x) else 0, 0)
            self.cuts.append(cut.astype(np.float32))
            node = 2 * node + (x >= self.cuts[i][node])

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for i, cut in enumerate(self.cuts):
            node = 2 * node + (points[:, self.first + i] >= cut[node])
        return node

    def visits(self, points: np.ndarray, d2: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, squared gap, splits crossed) of all leaves that the stopping test with squared distances ``d2`` leaves open."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        gap, crossed = np.zeros(len(points), np.float32), np.zeros(len(points), np.int64)
        for i, cut in enumerate(self.cuts):
            x = points[at, self.first + i] - cut[node]
            near = 2 * node + (x >= 0)
            far = gap + x * x
            go = far <= d2[at] * q[crossed + 1]
            at, node = np.concatenate([at, at[go]]), np.concatenate([near, (near ^ 1)[go]])
            gap, crossed = np.concatenate([gap, far[go]]), np.concatenate([crossed, crossed[go] + 1])
        return at, node, gap, crossed


def search(ids, data, queries, query_ids, best: Best, first: int, q: np.ndarray, g: np.ndarray, leaf_rows: int) -> None:
    """Add to ``best`` the hits of ``queries`` among ``data``, leaf by leaf in the order of their gap, until the test holds."""
    if not len(data) or not len(queries):
        return
    levels = max(0, math.ceil(math.log2(len(data) / leaf_rows)))
    levels = min(levels, g.shape[1] - first)
    points = data @ g
    versions = int(np.unique(ids, return_counts=True)[1].max())  # the k best rows besides the query are among the best (k + 1) * versions
    tree = KdTree(points, levels, first)
    leaf = tree.leaf(points)
    order = np.argsort(leaf, kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(2**levels + 1))
    at, node, gap, crossed = tree.visits(queries @ g, best.d2(), q)
    order_of = np.lexsort((gap, at))
    at, node, gap, crossed = at[order_of], node[order_of], gap[order_of], crossed[order_of]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    turn = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    for t in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero(turn == t)
        now = now[gap[now] <= best.d2()[at[now]] * q[crossed[now]]]
        now = now[np.argsort(node[now], kind="stable")]
        hits: list[tuple] = []
        cuts = np.searchsorted(node[now], np.arange(2**levels + 1))
        for v in np.flatnonzero(np.diff(cuts)):
            rows = order[ends[v] : ends[v + 1]]
            members = at[now[cuts[v] : cuts[v + 1]]]
            for a in range(0, len(members), 4096):
                some = members[a : a + 4096]
                cos = queries[some] @ data[rows].T
                least = best.floor[some][:, None]
                if np.count_nonzero(cos >= least) > 64 * len(some):  # a dense region: only those that can be among the k best are handed on
                    place = max(0, len(rows) - (best.k + 1) * versions)
                    least = np.maximum(least, np.partition(cos, place, axis=1)[:, place : place + 1])
                i, j = np.nonzero(cos >= least)
                other = ids[rows[j]] != query_ids[some[i]]
                i, j = i[other], j[other]
                hits.append((some[i], ids[rows[j]], cos[i, j]))
        if hits:
            best.add(*(np.concatenate(x) for x in zip(*hits)))


def neighbours(
    units: DataFrame,
    rows: int,
    k: int = 5,
    min_similarity: float = 0.96,
    miss: float = 0.005,
    cell_rows: int = 16_384,
    leaf_rows: int = 512,
    sample: int = 20_000,
    asked: int = 1,
) -> DataFrame:
    """``row_id, other, cos``: up to ``k`` most similar other rows of each row, those with a cosine of at least ``min_similarity``.

    ``units``: ``row_id, vec``; ``rows``: about how many. Equal similarities come in the order of the row ids. Versions of a row id
    with different vectors count as one row, by their most similar pair. The lower ``min_similarity``, the more of the collection
    a query without near neighbours has to see; -1 sets no bound. ``miss``: the chance to overlook a leaf with a neighbour; 0 makes the
    search exact (but for rounding), as every leaf is seen. ``asked``: only the rows whose id it divides are queries, against all rows.
    """
    levels = max(0, math.ceil(math.log2(max(1, rows) / cell_rows)))
    depth = levels + math.ceil(math.log2(cell_rows / leaf_rows)) + 4
    g = directions(depth)
    q = quantiles(depth, miss)
    near2 = 2 * (1 - min_similarity)
    every = max(1, -(-rows // sample))
    fit = units.filter(F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(every)) == 0).select("vec").limit(2 * sample).toArrow() if levels else None
    tree = KdTree(unpack(fit.column(0)) @ g if levels else np.zeros((0, depth), np.float32), levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = tree.leaf(unpack(b.column(1)) @ g).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), b.column(0), b.column(1)], names=["cell", "row_id", "vec"])

    def at_home(table: pa.Table) -> pa.Table:
        ids, x = table.column("row_id").to_numpy(), unpack(table.column("vec"))
        home = table.column("cell")[0].as_py()
        vecs = table.column("vec").combine_chunks()
        some = np.flatnonzero(ids % asked == 0)
        data_ids, data = ids, x
        ids, x, vecs = ids[some], x[some], vecs.take(pa.array(some))
        best = Best(len(ids), k, min_similarity)
        search(data_ids, data, x, ids, best, levels, q, g, leaf_rows)
        found = np.empty(len(best.query), FOUND)
        found["id"], found["cos"] = best.id, best.cos
        ends = np.searchsorted(best.query, np.arange(len(ids) + 1))
        at, cell, _, _ = tree.visits(x @ g, np.minimum(best.d2(), near2), q)
        own = cell == home
        keep = np.concatenate([np.flatnonzero(own & (ends[at + 1] > ends[at])), np.flatnonzero(~own)])
        n_own = int((own & (ends[at + 1] > ends[at])).sum())
        at, cell = at[keep], cell[keep]
        # the own cell only hands on what was found there; other cells get the vector
        lists = [found[ends[i] : ends[i + 1]].tobytes() for i in at[:n_own].tolist()] + [None] * (len(at) - n_own)
        sent = pa.concat_arrays([pa.nulls(n_own, pa.binary()), vecs.take(pa.array(at[n_own:])).cast(pa.binary())])
        return pa.table(
            [pa.array(cell.astype(np.int32)), pa.array(ids[at]), sent, pa.array(best.floor[at]), pa.array(lists, pa.binary())],
            names=["cell", "row_id", "vec", "bound", "found"],
        )

    def abroad(data: pa.Table, visits: pa.Table) -> pa.Table:
        handed = visits.filter(visits.column("vec").is_null())
        lists = [np.frombuffer(x, FOUND) for x in handed.column("found").to_pylist()]
        out = [(np.repeat(handed.column("row_id").to_numpy(), [len(x) for x in lists]), *((np.concatenate([x[f] for x in lists]) if lists else np.zeros(0, FOUND[f])) for f in ("id", "cos")))]
        guests = visits.filter(visits.column("vec").is_valid())
        if data.num_rows and guests.num_rows:
            ids, x = data.column("row_id").to_numpy(), unpack(data.column("vec"))
            who = guests.column("row_id").to_numpy()
            best = Best(len(who), k, min_similarity)
            best.floor = np.maximum(best.floor, guests.column("bound").to_numpy())
            search(ids, x, unpack(guests.column("vec")), who, best, levels, q, g, leaf_rows)
            out.append((who[best.query], best.id, best.cos))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c.astype(np.float64))], names=["row_id", "other", "cos"])

    cells = units.mapInArrow(place, "cell int, row_id bigint, vec binary")
    visits = cells.groupBy("cell").applyInArrow(at_home, VISITS)
    found = cells.groupBy("cell").cogroup(visits.groupBy("cell")).applyInArrow(abroad, "row_id bigint, other bigint, cos double")
    # versions of a row meet again here
    best = found.groupBy("row_id", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("cos"), "other"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


class EvenBlocks(density_peaks.Blocks):
    """Blocks whose directions are equally long, so that none draws more rows than others."""

    def __init__(self, rows: int, copies: int, block_rows: int, seed: int):
        super().__init__(rows, copies, block_rows, seed)
        self.g /= np.linalg.norm(self.g, axis=0)

    @classmethod
    def for_miss(cls, rows: int, min_similarity: float, miss: float, block_rows: int) -> EvenBlocks:
        """With as few copies of a row as let two rows just at ``min_similarity`` miss each other with a chance of at most ``miss``; blocks
        are larger where 32 copies don't do."""
        while True:
            for copies in range(2, 33):
                blocks = cls(rows, copies, block_rows, 307)
                if 1 - blocks.meeting(min_similarity, 500) <= 4 * miss and 1 - blocks.meeting(min_similarity, 8000) <= miss:
                    return blocks
            block_rows *= 2


def block_neighbours(units: DataFrame, rows: int, k: int, min_similarity: float, miss: float, block_rows: int = 6000, sample: int = 20_000) -> DataFrame:
    """``row_id, other, cos``: up to ``k`` most similar other rows of each row of ``units`` (``row_id, vec`` of ``turned_rows``, materialised),
    those with a cosine of at least ``min_similarity`` (as the bytes have it); ``rows``: how many there are.

    Rows meet in blocks, each being a pair of Gaussian directions. A row is in the blocks with the largest sums of its projections, in as
    many as ``miss`` asks for, and the blocks keep their size, so what is shuffled and compared grows hardly faster than the rows.
    ``miss`` is the chance that two rows just at ``min_similarity`` meet nowhere, whatever the vectors; it falls quickly above. A block
    that is far larger than the others is cut into parts, each pair of which meets in a task of its own.
    """

    def met(table: pa.Table) -> pa.Table:
        ids, x = table.column("row_id").to_numpy(), density_peaks._vectors(table.column("vec"))
        key, part = table.column("key")[0].as_py(), table.column("part").to_numpy()
        best, versions = Best(len(ids), k, min_similarity), int(np.unique(ids, return_counts=True)[1].max())
        i_part, j_part = key >> 16 & 65_535, key & 65_535
        one = i_part == j_part
        left = right = np.arange(len(ids))
        if not one:
            left, right = np.flatnonzero(part == i_part), np.flatnonzero(part == j_part)
        hits: list[tuple] = []

        def offer(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> None:
            if np.count_nonzero(cos >= best.floor[a][:, None]) > 64 * len(a):  # only those that can be among the k best
                place = max(0, cos.shape[1] - (k + 1) * versions)
                i, j = np.nonzero(cos >= np.maximum(best.floor[a][:, None], np.partition(cos, place, axis=1)[:, place : place + 1]))
            else:
                i, j = np.divmod(complete._true((cos >= min_similarity).ravel()), cos.shape[1])
            other = ids[a[i]] != ids[b[j]]
            i, j = i[other], j[other]
            hits.append((a[i], ids[b[j]], cos[i, j]))
            if sum(len(h[0]) for h in hits) > 200_000:
                settle()

        def settle() -> None:
            if hits:
                best.add(*(np.concatenate(h) for h in zip(*hits)))
                hits.clear()

        for s in range(0, len(left), TILE):
            a = left[s : s + TILE]
            for t in range(s if one else 0, len(right), TILE):
                b = right[t : t + TILE]
                cos = x[a] @ x[b].T
                if cos.max(initial=-1) < min_similarity:
                    continue
                offer(a, b, cos)
                if not one or t > s:
                    offer(b, a, np.ascontiguousarray(cos.T))
        settle()
        return pa.table([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.cos.astype(np.float64))], names=["row_id", "other", "cos"])

    blocks = EvenBlocks.for_miss(rows, min_similarity, miss, block_rows)
    known = units.select("row_id", "vec", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("density"))
    spread = density_peaks._spread(known, blocks, rows, block_rows, sample)
    found = spread.groupBy("key").applyInArrow(met, "row_id bigint, other bigint, cos double")
    best = found.groupBy("row_id", "other").agg(F.max("cos").alias("cos"))  # a pair may meet in several blocks
    rank = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("cos"), "other"))
    return best.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def exact_order(near: DataFrame, rows: DataFrame, k: int, min_similarity: float, rounding: float = ROUNDING) -> DataFrame:
    """``row_id, other, cos``: the ``k`` best of the candidates ``near`` (as from ``neighbours``, some more than ``k`` of each row; materialised).

    A similarity within ``rounding`` (that of the candidates) of ``min_similarity``, or of the k-th where the next one comes as near, is
    computed again from the vectors of ``rows``, which are joined to these pairs only.
    """
    by_row = W.partitionBy("row_id")
    placed = near.withColumn("_r", F.row_number().over(by_row.orderBy(F.desc("cos"), "other")))
    edge = lambda r: F.max(F.when(F.col("_r") == r, F.col("cos"))).over(by_row)
    last, after = edge(k), edge(k + 1)
    doubt = (F.abs(F.col("cos") - min_similarity) <= rounding) | ((last - after <= 2 * rounding) & (F.abs(F.col("cos") - last) <= 2 * rounding))
    unsure = cut(placed.withColumn("_d", F.coalesce(doubt, F.lit(False))).filter("_d").select("row_id", "other"))
    ids = unsure.select("row_id").union(unsure.select("other")).distinct()
    full = lookup_join(rows.filter(F.size("embedding") == DIM).select("row_id", "embedding"), ids, ["row_id"], "left_semi")
    a, b = full.withColumnRenamed("embedding", "a"), full.select(F.col("row_id").alias("other"), F.col("embedding").alias("b"))
    exact = unsure.join(a, "row_id").join(b, "other").groupBy("row_id", "other").agg(F.max(vectors.cosine(F.col("a"), F.col("b"))).alias("_c"))
    both = near.join(exact, ["row_id", "other"], "left").select("row_id", "other", F.coalesce("_c", "cos").alias("cos")).filter(F.col("cos") >= min_similarity)
    return both.withColumn("_r", F.row_number().over(by_row.orderBy(F.desc(F.round("cos", 12)), "other"))).filter(F.col("_r") <= k).drop("_r")


def compared(queries: DataFrame, data: DataFrame, k: int, min_similarity: float) -> DataFrame:
    """``row_id, other, cos``: the ``k`` most similar other rows of each row of ``queries`` among ``data`` (both ``row_id, vec`` as packed by
    ``full_rows``, materialised; of the copies of a vector ``data`` needs the k + 1 smallest ids), by comparing it with all of them."""
    once = cut(queries.select("vec").distinct().select(F.monotonically_increasing_id().alias("query"), "vec"))
    found = cut(complete.nearest(once, data, k + 1, min_similarity))  # one more, as a row meets itself
    named = lookup_join(queries, once, ["vec"], rows=100_000).select("query", "row_id")
    others = lookup_join(named, found, ["query"]).filter(F.col("row_id") != F.col("other")).groupBy("row_id", "other").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("cos"), "other"))
    return others.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def settled(
    near: DataFrame, kept: int, queries: DataFrame, data: Callable[[], DataFrame], rows: DataFrame, k: int, min_similarity: float, others: DataFrame | None = None, rounding: float = ROUNDING
) -> DataFrame:
    """``row_id, other, cos``: the ``k`` best of the candidates ``near``, of which up to ``kept`` a row were kept, off by up to ``rounding``.

    A row whose last candidate comes within rounding of its k-th may have others as near that weren't kept: it is compared with all of
    ``data`` (only called for then), and so are those of ``others`` (``row_id``). The rest is put in order by ``exact_order``.
    """
    near = cut(near)
    placed = near.withColumn("_r", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("cos"), "other")))
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("cos")))
    crowded = placed.groupBy("row_id").agg(at(k).alias("a"), at(kept).alias("z")).filter(F.col("a") - F.col("z") <= 2 * rounding).select("row_id")
    crowded = cut(crowded if others is None else crowded.union(others).distinct())
    clear = exact_order(lookup_join(near, crowded, ["row_id"], "left_anti"), rows, k, min_similarity, rounding)
    if crowded.isEmpty():
        return clear
    return clear.unionByName(compared(lookup_join(queries, crowded, ["row_id"], "left_semi"), data(), k, min_similarity))


def mutual_neighbours(rows: DataFrame, k: int = 5, min_similarity: float = 0.96, miss: float | None = None, block_rows: int = 6000, **tree) -> DataFrame:
    """``row_a, row_b, cos``: pairs of usable rows of ``row_id, embedding``, row_a < row_b, each among the other's ``k`` most similar, with a cosine of at least ``min_similarity``.

    Of the copies of one vector only the k + 1 smallest row ids can be in such a pair (ties go to smaller ids), so the others are
    left out beforehand. Rows without id or with an unusable vector (not 128 finite numbers, all zero) are in no pair.

    Candidates come from ``block_neighbours``, with a chance of ``miss`` (0.002 unless given) to overlook a pair just at ``min_similarity``;
    0 compares all vectors. With options of ``neighbours`` (``tree``) they come from the kd-tree, ``miss`` being the one there.
    """
    first = first_rows(rows, k + 1)
    kept = 2 * k + 1  # as many more candidates as one vector has copies, as rounding may put its copies before those of a nearer vector
    if tree:
        first = cut(first)
        options = tree if miss is None else tree | {"miss": miss}
        near = settled(neighbours(half_rows(first), first.count(), kept, min_similarity - ROUNDING, **options), kept, first, lambda: first, rows, k, min_similarity)
    elif miss is not None and miss <= 0:
        first = cut(first)
        near = compared(first, first, k, min_similarity)
    else:
        units = cut(turned_rows(first))  # read by the sample and the blocks
        found = block_neighbours(units, units.count(), kept, min_similarity - BYTE_ROUNDING, 0.002 if miss is None else miss, block_rows)
        near = settled(found, kept, first, lambda: cut(first), rows, k, min_similarity, rounding=BYTE_ROUNDING)
    pair = near.select(F.least("row_id", "other").alias("row_a"), F.greatest("row_id", "other").alias("row_b"), "cos")
    return pair.groupBy("row_a", "row_b").agg(F.count(F.lit(1)).alias("n"), F.max("cos").alias("cos")).filter("n = 2").drop("n")


def nearest_rows(rows: DataFrame, k: int = 5, min_similarity: float = -1.0, asked: int = 20, miss: float = 0.0, **options) -> DataFrame:
    """``row_id, other, cos``: the ``k`` most similar other rows of every usable row whose id ``asked`` divides, among all usable rows of
    ``row_id, embedding``; cosines equal in 12 digits come in the order of the row ids. Versions of a row count as one, by their most
    similar pair.

    Each vector asked for is compared with all vectors. With a ``miss`` above 0 they are looked for in the kd-tree instead, which
    overlooks a leaf with a neighbour at this chance; ``options``: those of ``neighbours``.
    """
    first = cut(first_rows(rows, k + 1))
    queries = cut(full_rows(rows.filter(F.col("row_id") % asked == 0)).dropDuplicates(["row_id", "vec"]))
    if miss <= 0:
        return compared(queries, first, k, min_similarity)
    kept = 2 * k + 1
    near = neighbours(half_rows(first), first.count(), kept, max(-1.0, min_similarity - ROUNDING), miss, asked=asked, **options)
    later = queries.join(first, ["row_id", "vec"], "left_anti").select("row_id")  # copies that the tree doesn't hold
    return settled(near, kept, queries, lambda: first, rows, k, min_similarity, later)
