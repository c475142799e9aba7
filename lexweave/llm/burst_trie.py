"""Occurrences and documents of every distinct term, counted in burst tries.

A burst trie keeps terms in small containers and bursts a container by the next character when it grows too large, so that
frequent prefixes get deep nodes and rare ones stay together. Every term in it has a slot with two counters: its occurrences, and
the set of its documents (32-bit ids). Here:

1. The rows are shuffled once, by line and content, so that copies of a line meet in one task, those of one input task as a single
   one. A task counts its rows in its own trie and hands out the trie in compact packs, depth first: sorted terms, occurrences, sorted
   documents. They are written once.
2. ``skeleton`` finds from the packs the prefixes with a large share of the weight, of any length. What lies below them are the
   routes: adaptive prefixes of bounded weight. Packs are cut along the routes. A term that is as heavy as a whole route (or any
   route, if the collection is so large that routes are heavy) is cut further, by blocks of the id range.
3. Matching subtrees, those of one route and block from all tasks, meet in one task and are merged into one trie.

The empty prefix, the root of every trie, has counters like any other: the documents of the whole table. Occurrences are summed,
documents united, so it doesn't matter how rows are spread over tasks or how often a task runs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import MAX_ID, cut, shuffle_width

PACKS = "terms array<string>, occurrences binary, n_docs array<bigint>, docs binary"
CONTAINERS = f"route string, block int, {PACKS}"
COUNTS = "term string, occurrences bigint, documents bigint"
LOW, HIGH = np.uint64(MAX_ID), np.uint64(32)


class Node:
    """A burst container: the slot of the term that ends here (or -1), and what follows by the next character."""

    __slots__ = ("children", "own")

    def __init__(self):
        self.own, self.children = -1, {}


class BurstTrie:
    """Terms with their counters. A container is a dict from the rest of a term to its slot, of at most ``limit`` terms."""

    def __init__(self, limit: int = 64):
        self.limit, self.root, self.slots = limit, {}, 0
        self.occurrences = np.zeros(64, np.int64)
        self.pairs: list[np.ndarray] = []  # slot << 32 | document
        self.size = self.fresh = 0  # pairs held, and those that came since documents were last united

    def slot(self, term: str) -> int:
        """The slot of a term, a new one if the trie hasn't got it."""
        parent, node, depth = None, self.root, 0
        while type(node) is Node:
            if depth == len(term):
                if node.own < 0:
                    node.own, self.slots = self.slots, self.slots + 1
                return node.own
            parent = node
            node = parent.children.get(term[depth])
            if node is None:
                node = parent.children[term[depth]] = {}
            depth += 1
        rest = term[depth:]
        at = node.get(rest)
        if at is None:
            at = node[rest] = self.slots
            self.slots += 1
            if len(node) > self.limit:
                burst = Node()
                for r, s in node.items():
                    if r:
                        burst.children.setdefault(r[0], {})[r[1:]] = s
                    else:
                        burst.own = s
                if parent is None:
                    self.root = burst
                else:
                    parent.children[term[depth - 1]] = burst
        return at

    def add(self, slots: np.ndarray, occurrences: np.ndarray, n_docs: np.ndarray, docs: np.ndarray) -> None:
        """Count: for each of ``slots`` (they may repeat) its occurrences and the next ``n_docs`` of ``docs``."""
        if self.slots > len(self.occurrences):
            self.occurrences = np.concatenate([self.occurrences, np.zeros(max(self.slots, len(self.occurrences)), np.int64)])
        np.add.at(self.occurrences, slots, occurrences)
        self.pairs.append(np.repeat(slots, n_docs).astype(np.uint64) << HIGH | docs.astype(np.uint64))
        self.size += len(docs)
        self.fresh += len(docs)

    def merge(self, terms: list[str], occurrences: np.ndarray, n_docs: np.ndarray, docs: np.ndarray) -> None:
        """Add another trie's subtree."""
        self.add(np.array([self.slot(t) for t in terms], np.int64), occurrences, n_docs, docs)

    def compact(self) -> np.ndarray:
        """Keep each document of a term once; the sorted pairs."""
        self.pairs = [np.unique(np.concatenate(self.pairs))] if self.pairs else [np.zeros(0, np.uint64)]
        self.size, self.fresh = len(self.pairs[0]), 0
        return self.pairs[0]

    def walk(self) -> Iterator[tuple[str, int]]:
        """(term, slot), depth first in the order of the terms."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is Node:
                if node.own >= 0:
                    yield prefix, node.own
                stack += [(prefix + c, node.children[c]) for c in sorted(node.children, reverse=True)]
            else:
                for rest in sorted(node):
                    yield prefix + rest, node[rest]

    def documents(self) -> np.ndarray:
        return np.bincount((self.compact() >> HIGH).astype(np.int64), minlength=self.slots)

    def packs(self, terms: int = 4096, docs: int = 500_000) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, occurrences, numbers of documents, documents) of the whole trie, up to ``terms`` terms and about ``docs`` documents each."""
        pairs = self.compact()
        ends = np.searchsorted(pairs, np.arange(self.slots + 1, dtype=np.uint64) << HIGH)
        ids = (pairs & LOW).astype(np.uint32)
        held, slots, size = [], [], 0
        for term, s in self.walk():
            n = int(ends[s + 1] - ends[s])
            if held and (size + n > docs or len(held) >= terms):
                yield held, self.occurrences[slots], ends[np.array(slots) + 1] - ends[slots], np.concatenate([ids[ends[x] : ends[x + 1]] for x in slots])
                held, slots, size = [], [], 0
            held.append(term)
            slots.append(s)
            size += n
        if held:
            yield held, self.occurrences[slots], ends[np.array(slots) + 1] - ends[slots], np.concatenate([ids[ends[x] : ends[x + 1]] for x in slots])


def _batch(rows: list[tuple], *, routed: bool) -> pa.RecordBatch:
    """Packs (with or without route and block in front) as a batch."""
    at = 2 if routed else 0
    columns = [pa.array([r[at] for r in rows], pa.list_(pa.string())), pa.array([np.ascontiguousarray(r[at + 1]).tobytes() for r in rows], pa.binary())]
    columns += [pa.array([r[at + 2] for r in rows], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(r[at + 3]).tobytes() for r in rows], pa.binary())]
    names = ["terms", "occurrences", "n_docs", "docs"]
    if routed:
        columns, names = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), *columns], ["route", "block", *names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _count(flush: int):
    """Rows ``term, idxs``, each line once -> packs of the task's trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column(0).fill_null("").dictionary_encode()
            slots = np.array([trie.slot(t) for t in word.dictionary.to_pylist()], np.int64)[word.indices.to_numpy(zero_copy_only=False)]
            lists = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            good = (ids >= 0) & (ids <= MAX_ID)
            row, ids = row[good], ids[good]
            n = np.bincount(row, minlength=b.num_rows)
            trie.add(slots, n, n, ids)
            every = np.unique(ids)  # the root counts the documents of all rows, also of those without a term
            trie.add(np.array([trie.slot("")]), np.zeros(1, np.int64), np.array([len(every)]), every)
            if trie.fresh > flush:
                trie.compact()
                if trie.size > flush:
                    yield from (_batch([p], routed=False) for p in trie.packs())
                    trie = BurstTrie()
        if trie.slots:
            yield from (_batch([p], routed=False) for p in trie.packs())

    return run


def skeleton(packs: DataFrame, routes: int = 2048, step: int = 16) -> tuple[frozenset[str], int]:
    """(the prefixes with more than 1/``routes`` of the weight, the weight): at most ``routes`` of each length come to the driver.

    The weight of a term is one for each pack plus its documents. Prefixes are looked at in rounds of ``step`` lengths; a further
    round only follows those still heavy at its end, and starts where the terms below one of them part, however long they are.
    """
    each = packs.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("x"))
    live = each.groupBy(F.col("x.terms").alias("term")).agg(F.sum(F.col("x.n_docs") + 1).alias("w")).withColumn("start", F.lit(0))
    total, burst = 0, set()
    while True:
        lengths = F.sequence("start", F.least(F.length("term"), F.col("start") + (step - 1)))
        prefixes = live.select("w", (F.col("start") + (step - 1)).alias("edge"), F.explode(F.transform(lengths, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("p"))
        sums = prefixes.groupBy("p").agg(F.sum("w").alias("w"), F.max("edge").alias("edge"))
        if not total:
            live, sums = cut(live), cut(sums)
            total = (sums.filter("p = ''").select("w").first() or [0])[0]
        heavy = sums.filter(F.col("w") * routes > total).select("p", "edge").collect()
        burst.update(r[0] for r in heavy)
        at_edge = [(r[0],) for r in heavy if len(r[0]) == r[1]]
        if not at_edge:
            return frozenset(burst), total
        below = live.withColumn("q", F.expr(f"substring(term, 1, start + {step - 1})"))
        below = below.join(F.broadcast(packs.sparkSession.createDataFrame(at_edge, "q string")), "q")
        ends = below.groupBy("q").agg(F.min("term").alias("a"), F.max("term").alias("z"))
        part = ends.mapInArrow(_parting, "q string, next int").collect()
        live = below.join(F.broadcast(packs.sparkSession.createDataFrame(part, "q string, next int")), "q").filter(F.length("term") >= F.col("next")).select("term", "w", F.col("next").alias("start"))
        if not part:
            return frozenset(burst), total


def _parting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each prefix the length at which the first and the last term below it part, if that is longer."""
    for b in batches:
        q, a, z = (c.to_pylist() for c in b.columns)
        n = [max(len(p) + 1, len(os.path.commonprefix([x, y]))) for p, x, y in zip(q, a, z)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["q", "next"])


class Routes:
    """The route of a term: its longest prefix in ``burst`` and one character more, or the term itself if it is such a prefix."""

    def __init__(self, burst: frozenset[str]):
        self.burst, self.lengths = burst, sorted({len(p) for p in burst})

    def of(self, term: str) -> tuple[str, bool]:
        best = -1
        for n in self.lengths:
            if n > len(term):
                break
            if term[:n] in self.burst:
                best = n
        return term[: best + 1], best == len(term)


def _route(burst: frozenset[str], every_block: bool, block_bits: int):
    """Packs -> containers: packs cut along the routes and, where these are heavy, by blocks of ids."""
    routes = Routes(burst)

    def blocks(route: str, terms: list[str], occ: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
        owner, block = np.repeat(np.arange(len(terms)), n), (docs >> np.uint32(block_bits)).astype(np.int64)
        first = True  # the occurrences go with the first block
        for k in np.unique(block).tolist() or [0]:
            mine = block == k
            counts = np.bincount(owner[mine], minlength=len(terms))
            some = np.arange(len(terms)) if first else np.flatnonzero(counts)
            yield route, k, [terms[i] for i in some], occ[some] if first else np.zeros(len(some), np.int64), counts[some], docs[mine]
            first = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for terms, occ, n, docs in zip(*(c.to_pylist() for c in b.columns)):
                occ, n, docs = np.frombuffer(occ, np.int64), np.array(n, np.int64), np.frombuffer(docs, np.uint32)
                ends = np.concatenate([[0], np.cumsum(n)])
                i = 0
                while i < len(terms):  # terms are sorted, so those of a route stand together
                    (route, own), j = routes.of(terms[i]), i + 1
                    while j < len(terms) and not own and routes.of(terms[j]) == (route, False):
                        j += 1
                    part = (route, terms[i:j], occ[i:j], n[i:j], docs[ends[i] : ends[j]])
                    out += blocks(*part) if own or every_block else [(route, -1, *part[1:])]
                    i = j
            for k in range(0, len(out), 1000):
                yield _batch(out[k : k + 1000], routed=True)

    return run


def _merge(hold: int):
    """Merge the subtrees of each route and block, which come one after another; documents are united whenever ``hold`` and half of those held have come anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, at = BurstTrie(), None, 0
        ready: list[tuple[list[str], np.ndarray, np.ndarray]] = []

        def counted() -> tuple[list[str], np.ndarray, np.ndarray]:
            n = trie.documents()
            terms, slots = zip(*trie.walk())
            return list(terms), trie.occurrences[list(slots)], n[list(slots)]

        def result() -> pa.RecordBatch:
            terms, occ, n = zip(*ready)
            return pa.RecordBatch.from_arrays([pa.array([t for x in terms for t in x], pa.string()), pa.array(np.concatenate(occ)), pa.array(np.concatenate(n).astype(np.int64))], names=["term", "occurrences", "documents"])

        for b in batches:
            for route, block, terms, occ, n, docs in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and last != (route, block):
                    ready.append(counted())
                    at += len(ready[-1][0])
                    trie = BurstTrie()
                    if at > 10_000:
                        yield result()
                        ready, at = [], 0
                last = (route, block)
                trie.merge(terms, np.frombuffer(occ, np.int64), np.array(n, np.int64), np.frombuffer(docs, np.uint32))
                if trie.fresh > max(hold, trie.size // 2):
                    trie.compact()
        if last is not None:
            ready.append(counted())
        if ready:
            yield result()

    return run


def count_terms(index: DataFrame, routes: int = 2048, block_bits: int = 18, flush: int = 2_000_000, hold: int = 2_000_000, heavy_route: int = 20_000_000) -> DataFrame:
    """``term, occurrences, documents`` of every distinct term of index rows ``line_id, shard, term, idxs, written_at``, and of the root.

    Occurrences are the valid entries of each line once (a redelivered row has the same ``line_id``, term and ids; without a
    ``line_id`` all of its content has to be the same), documents the distinct valid ids of all rows of a term. Terms compare exactly; null and empty ones
    aren't counted. The row with the empty term is the root: its ``documents`` are those of the whole table. An empty table has no rows.
    """
    content = F.when(F.col("line_id").isNull(), F.xxhash64("shard", "idxs", "written_at")).otherwise(F.xxhash64("idxs"))
    lines = index.select(F.xxhash64("line_id", "term").alias("k1"), content.alias("k2"), "term", "idxs").dropDuplicates(["k1", "k2"])
    packs = cut(lines.select("term", "idxs").mapInArrow(_count(flush), PACKS))
    burst, weight = skeleton(packs, routes)
    parts = packs.mapInArrow(_route(burst, weight > routes * heavy_route, block_bits), CONTAINERS)
    merged = parts.repartition(shuffle_width(index.sparkSession), "route", "block").sortWithinPartitions("route", "block").mapInArrow(_merge(hold), COUNTS)
    return merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def term_frequencies(index: DataFrame, rare_below: int = 3, common_from: float = 0.25, **options) -> DataFrame:
    """``term, occurrences, documents, rare, common`` of every term that isn't null or empty.

    ``rare``: fewer than ``rare_below`` distinct valid documents, none included. ``common``: at least ``common_from`` of the
    distinct valid documents of the whole table. A term of a very small table may be both.
    """
    counts = cut(count_terms(index, **options))
    total = counts.filter("term = ''").select(F.max("documents")).scalar()
    return (
        counts.filter("term <> ''")
        .withColumn("rare", F.col("documents") < rare_below)
        .withColumn("common", (F.col("documents") > 0) & (F.col("documents") >= total * common_from))
    )
