"""Token ids of whole texts by a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

The BPE encoding of a byte string is fixed by the last token of each of its prefixes: the encoding of a prefix is that of the
prefix without its last token, followed by that token, and a token may follow another exactly if the pair, encoded by itself,
stays that pair. So a depth-first walk over the trie of the distinct words needs one step for each trie node: the last token at
the node follows from those above it, and whatever words share is encoded once. The trie is held as the sorted list of its
words; the path to the current node is the stack of last tokens, cut back to the common prefix from word to word.

Tokenising is a map over partitions: nothing is shuffled. The vocabulary is broadcast; its size is fixed (about 1 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .texts import strings

#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class TrieEncoder:
    """Encodes sets of words with shared prefixes. ``ranks``: token bytes -> id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        ends: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 1:
                ends.setdefault(b[-2:], {1}).add(len(b))
        # by the last two bytes: the lengths of the tokens that end so, longest first
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by the definition: merge the neighbours with the lowest rank until none can be merged."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``; ``a`` = -1: may begin the word."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:  # only a cache
                self.pairs.clear()
            known = self.merge((self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]) == ([a, b] if a >= 0 else [b])
            self.pairs[a, b] = known
        return known

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of each distinct word, in the order of the trie."""
        ranks, lengths, size, pairs, follows = self.ranks, self.lengths, {i: len(b) for i, b in self.bytes_of.items()}, self.pairs, self._follows
        last = [-1]  # last token of the first n bytes of the current path
        path = b""
        for word in sorted(words):
            n = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                n += 1
            del last[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                for k in lengths.get(word[max(0, end - 2) : end], (1,)):
                    if k > end:
                        continue
                    token = ranks.get(word[end - k : end])
                    if token is not None:
                        before = last[end - k]
                        ok = pairs.get((before, token))
                        if ok or ok is None and follows(before, token):
                            last.append(token)
                            break
            path, ids, at = word, [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            ids.reverse()
            yield word, ids


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = 1_000_000) -> DataFrame:
    """``<id_col>, ids array<int>``: the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list; strings of special tokens in a text are ordinary text. Rows come out as they come
    in, repeated and null ids included. ``window``: characters of text whose distinct words share one trie; it bounds memory,
    not results (a longer text is one window).
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = dict(docs.dtypes)[id_col]
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.update(encoder=TrieEncoder(shared.value), split=regex.compile(PATTERN), known={})
        encoder, split, known = state["encoder"], state["split"], state["known"]

        def flush(words: list[list[str]]) -> pa.Array:
            new = {w for ws in words for w in ws if w not in known}
            if len(known) + len(new) > 500_000:
                known.clear()
                new = {w for ws in words for w in ws}
            known.update((w.decode(), ids) for w, ids in encoder.encode([w.encode() for w in new]))
            return pa.array([[i for w in ws for i in known[w]] for ws in words], pa.list_(pa.int32()))

        for b in batches:
            ids, held, size, start = b.column(0), [], 0, 0
            for text in strings(b.column(1)):
                held.append(split.findall(text) if text else [])
                size += len(text or "")
                if size > window:
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), flush(held)], names=[id_col, "ids"])
                    start, held, size = start + len(held), [], 0
            if held:
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), flush(held)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
