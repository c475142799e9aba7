"""Passages of held-out evaluation texts inside a corpus, found by an FM-index of each shard of the corpus.

Texts are reduced to what counts: letters, combining marks and digits, decomposed and case-folded, without anything between.
The passages looked for are all runs of ``words`` consecutive words of an item (``chars`` consecutive characters for Chinese and
Japanese). Every task indexes its documents in shards of bounded size and searches all passages backwards at once.

The corpus is never shuffled and no fingerprint of it leaves its task: only hits do. The items are the stated query set. Their
distinct passages are made on the cluster and measured: up to ``broadcast_chars`` characters are broadcast, in slices that are
searched one by one in the same shard index; more are searched in several passes over the corpus, each with a share of that size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce as fold

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .fm_index import FMIndex
from .texts import strings

_OTHER = regex.compile(r"(?:[^\p{L}\p{M}\p{Nd}]|\p{Default_Ignorable_Code_Point})+")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")
SPANS = "doc_id bigint, item_id bigint, start bigint, end bigint"


def reduce(text: str) -> str:
    """Letters, combining marks and digits of a text in compatibility decomposition and case-folded."""
    if text.isascii():
        return _OTHER.sub("", text.lower())
    plain = _OTHER.sub("", unicodedata.normalize("NFKD", text))  # before reordering marks across what is left out
    return unicodedata.normalize("NFKD", _OTHER.sub("", unicodedata.normalize("NFKD", plain).casefold()))


def passages(text: str | None, lang: str | None, words: int = 12, chars: int = 24) -> list[str]:
    """The distinct reduced passages of an item; none where it is shorter. An item without language is taken by its script."""
    if not text:
        return []
    code = (lang or "").strip().lower()[:2] or ("zh" if 2 * len(_HAN.findall(text)) > len(reduce(text)) else "")
    if code in ("zh", "ja"):
        units, size = list(reduce(text)), chars
    else:
        units, size = [reduce(w) for w in text.split()], words
    return [p for p in dict.fromkeys("".join(units[i : i + size]) for i in range(len(units) - size + 1)) if p]


def _original(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the reduced text the code points [start, end) it comes from. ``known``: how many characters a base with its
    marks is reduced to, of those seen before."""
    start, end = [], []
    for m in _CLUSTER.finditer(text):
        c = m.group()
        n = known.get(c)
        if n is None:
            if len(known) > 100_000:
                known.clear()
            n = known[c] = len(reduce(c))
        if n == 1:
            start.append(m.start())
            end.append(m.end())
        elif n:
            start += [m.start()] * n
            end += [m.end()] * n
    return np.array(start, np.int64), np.array(end, np.int64)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def search_shard(ids: list, texts: list[str], slices: Iterator[tuple[list[list[int]], list[str]]]) -> Iterator[tuple]:
    """(doc id, item id, start, end) of every passage found, spans of an item merged; ``slices``: the items of each passage, and the passages."""
    same: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if r := reduce(t):
            same.setdefault(r, []).append(i)  # copies of a text are indexed once
    if not same:
        return
    distinct = list(same)
    points = np.frombuffer("\0".join(["", *distinct, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    index = FMIndex(codes + 1)
    starts = np.cumsum([1, *[len(t) + 1 for t in distinct]])
    hits: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for items, phrases in slices:
        sought = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in phrases]
        place = [np.searchsorted(alphabet, p) for p in sought]
        place = [np.where(alphabet[np.minimum(k, len(alphabet) - 1)] == p, k + 1, 0) for k, p in zip(place, sought)]
        lo, hi = index.ranges(place)
        found = np.flatnonzero(hi > lo)
        for k in range(0, len(found), 4096):
            part = found[k : k + 4096]
            counts = hi[part] - lo[part]
            rows = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            at = index.positions(rows)
            which = np.repeat(part, counts)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, p, a in zip(doc.tolist(), which.tolist(), (at - starts[doc]).tolist()):
                for item in items[p]:
                    hits.setdefault(d, {}).setdefault(item, []).append((a, a + len(phrases[p])))
    known: dict[str, int] = {}
    for d, by_item in hits.items():
        for i in same[distinct[d]]:
            start, end = _original(texts[i], known)
            exact = len(start) == len(distinct[d])  # marks reordered across clusters: the whole text is the span
            for item, spans in by_item.items():
                for a, b in _merged(spans):
                    yield (ids[i], item, int(start[a]), int(end[b - 1])) if exact else (ids[i], item, 0, len(texts[i]))


def passage_table(items: DataFrame, words: int = 12, chars: int = 24) -> DataFrame:
    """``passage, items``: every distinct passage of ``item_id, text, lang`` with the items that hold it. A null ``item_id`` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, lang in zip(b.column(0).to_pylist(), strings(b.column(1)), strings(b.column(2))):
                found = passages(t, lang, words, chars)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([i] * len(found), pa.int64())], names=["passage", "item_id"])

    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text", "lang")
    return rows.mapInArrow(run, "passage string, item_id bigint").groupBy("passage").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def find_leaks(
    docs: DataFrame, items: DataFrame, words: int = 12, chars: int = 24, shard: int = 2_000_000, slice_size: int = 50_000, broadcast_chars: int = 100_000_000
) -> DataFrame:
    """``doc_id, item_id, start, end``: every document and item that share a passage, with the code points [start, end) of the text it covers.

    Null and empty texts and items hold no passage. A null ``item_id`` or ``doc_id`` is left out: it can't be reported. Equal
    ids with different texts are reported together. ``shard``: characters indexed at a time (a longer text is a shard of its
    own), ``slice_size``: passages searched at a time, ``broadcast_chars``: characters of passages that are broadcast for a pass; they
    bound memory and don't change results: the spans of an item in a document are merged over all passes.
    """
    spark = docs.sparkSession
    table = cut(passage_table(items, words, chars))
    total = table.agg(F.sum(F.length("passage"))).first()[0] or 0
    passes = max(1, -(-total // broadcast_chars))
    found = []
    for k in range(passes):
        share = table.filter(F.pmod(F.xxhash64("passage"), F.lit(passes)) == k).toArrow()
        parts = [share.slice(i, slice_size) for i in range(0, share.num_rows, slice_size)]
        shared = [spark.sparkContext.broadcast((p.column("items").to_pylist(), p.column("passage").to_pylist())) for p in parts]
        found.append(docs.select("doc_id", "text").mapInArrow(_search(shared, shard), SPANS))
    if passes == 1:
        return found[0]
    spans = fold(DataFrame.unionAll, found).distinct().groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))

    def joined(acc, x):
        last = F.element_at(acc, -1)
        apart = F.when(F.size(acc) == 0, True).otherwise(x["start"] > F.try_element_at(acc, F.lit(-1))["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

    merged = F.aggregate("s", F.array().cast("array<struct<start:bigint,end:bigint>>"), joined)
    return spans.select("doc_id", "item_id", F.explode(merged).alias("x")).select("doc_id", "item_id", "x.start", "x.end")


def _search(shared: list, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(ids, texts):
            rows = list(search_shard(ids, texts, (s.value for s in shared)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "start", "end"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                if i is None or not t:
                    continue
                if texts and size + len(t) > shard:
                    yield from search(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield from search(ids, texts)

    return run
