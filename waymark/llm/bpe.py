"""Byte-level BPE over a corpus: encoding by replaying merges, and decoding.

A task gathers the distinct words of its block of documents. An inverted index leads from
each merge to the places where its pair of tokens stands, in all words at once. Merges are
applied in the order of their ranks; only pairs beside a merged place are looked up anew.
Words come back to their documents by number, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from waymark.llm.blocks import blocks, gather, one_array
from waymark.llm.tables import picked, schema

#: Bytes of text whose words form one corpus.
CORPUS_BYTES = 8 << 20
_NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a tiktoken file: token bytes, and the rank of every pair that merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.single = np.full(256, -1, np.int64)
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in sorted(pairs)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or a number above all ranks."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merged[at], _NONE)

    def encode_alone(self, word: bytes) -> list[int]:
        """One word by its own merges, the lowest rank first, the leftmost of equals."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words one after the other, and how many each word has."""
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    n = len(data)
    # one more place stands for "none" at either side
    owner = np.append(np.repeat(np.arange(len(words)), sizes), -1)
    token = np.append(vocab.single[data], -1)
    places = np.arange(n, dtype=np.int64)
    after = np.append(np.where(owner[1:] == owner[:-1], places + 1, n), n)
    before = np.full(n + 1, n, np.int64)
    linked = after[:n] < n
    before[after[:n][linked]] = places[linked]
    alive = np.append(np.ones(n, bool), False)
    rank = np.full(n + 1, _NONE)
    rank[:n][linked] = vocab.pair_ranks(token[:n][linked], token[after[:n][linked]])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(places: np.ndarray) -> None:
        ranks = rank[places]
        some = ranks < _NONE
        places, ranks = places[some], ranks[some]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        firsts = np.concatenate([[0], edges]) if len(ranks) else edges
        ends = np.append(edges, len(ranks))
        for r, low, high in zip(ranks[firsts].tolist(), firsts.tolist(), ends.tolist(), strict=False):
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(places[low:high])

    note(np.flatnonzero(rank[:n] < _NONE))
    odd = np.zeros(len(words) + 1, bool)
    while queue:
        r = heapq.heappop(queue)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(at) > 1:
            # of places that overlap, every second one merges, from the left
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                start = np.maximum.accumulate(np.where(np.append(True, ~chained), np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        if len(at) > 1:
            # where merges stand side by side, the left one comes first and may make a better pair
            side = np.flatnonzero(beyond[:-1] == at[1:])
            if len(side):
                worse = vocab.pair_ranks(np.full(len(side), r), token[beyond[side]]) > r
                odd[owner[at[side[~worse]]]] = True
        token[at] = r
        after[at] = beyond
        before[beyond] = at
        before[n] = n
        alive[gone] = False
        rank[gone] = _NONE
        left = before[at]
        left = left[left < n]
        touched = np.concatenate([left, at])
        rank[touched] = np.where(after[touched] < n, vocab.pair_ranks(token[touched], token[after[touched]]), _NONE)
        early = rank[touched] <= r
        if early.any():
            # a pair that should have merged before others of this rank: the word goes alone
            odd[owner[touched[early]]] = True
        note(touched)
    counts = np.bincount(owner[:n][alive[:n]], minlength=len(words)).astype(np.int64)
    tokens = token[:n][alive[:n]]
    again = np.flatnonzero(odd[: len(words)])
    if len(again):
        starts = np.cumsum(counts) - counts
        parts, last = [], 0
        for i in again.tolist():
            parts += [tokens[last : starts[i]], np.array(vocab.encode_alone(words[i]), np.int64)]
            last = starts[i] + counts[i]
            counts[i] = len(parts[-1])
        tokens = np.concatenate([*parts, tokens[last:]])
    return tokens, counts


def encode(texts: list[str], vocab: Vocabulary, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts one after the other, and how many each text has."""
    numbers: dict[str, int] = {}
    sequences, counts = [], []
    for text in texts:
        found = pattern.findall(text)
        for word in found:
            if word not in numbers:
                numbers[word] = len(numbers)
        sequences.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        counts.append(len(found))
    every = np.concatenate(sequences) if sequences else np.zeros(0, np.int64)
    if not len(every):
        return every, np.zeros(len(texts), np.int64)
    tokens, sizes = replay([w.encode() for w in numbers], vocab)
    starts = np.cumsum(sizes) - sizes
    out = gather(tokens, starts[every], sizes[every])
    edges = np.concatenate([[0], np.cumsum(sizes[every])])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return out, np.diff(edges[bounds])


def decode(tokens: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, and how many each token has."""
    lengths = vocab.lengths[tokens]
    return gather(vocab.bytes, vocab.starts[tokens], lengths), lengths


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    keep_ids: bool = True,
    keep_rows: bool = False,
) -> DataFrame:
    """Every text as token ids, and decoded again.

    ``path`` names a rank file that every machine has, ``pattern`` the expression whose matches
    are encoded each for itself. Result: doc_id, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit numbers), decoded_sha256, and with ``keep_ids`` the ids themselves; with
    ``keep_rows`` also ``row``. Null and empty texts have no tokens. Rows are independent.
    """
    path, pattern = path or _default_path(), pattern or _default_pattern()
    docs = picked(docs, id_col, text_col, keep_rows=keep_rows)
    columns = ["doc_id bigint", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
    made = schema(*columns, *["ids array<int>"] * keep_ids, rows=docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, compiled = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            for block in blocks(batch["_text"], CORPUS_BYTES):
                part = batch.slice(block.first, len(block))
                texts = part["_text"].fill_null("").to_pylist()
                tokens, counts = encode(texts, vocab, compiled)
                plain, lengths = decode(tokens, vocab)
                edges = np.concatenate([[0], np.cumsum(counts)])
                ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
                words = tokens.astype("<u4").tobytes()
                out = {
                    "doc_id": one_array(part["_id"]),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": [hashlib.sha256(words[4 * a : 4 * b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)],
                    "decoded_sha256": [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)],
                }
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens.astype(np.int32)))
                if keep_rows:
                    out["row"] = part["row"]
                yield pa.record_batch(out)

    return docs.mapInArrow(work, made)
