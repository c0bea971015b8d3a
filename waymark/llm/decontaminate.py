"""Passages of benchmark items in documents, also when some words were changed.

Documents and items are sequences of words (letters and digits, A-Z in lower case). A CGK
random walk reads a window of words and, at every step, repeats the word or moves on, by a
random bit of the word and the step; two windows a few edits apart soon walk in step again,
so their walks differ in few places. Each repetition samples some steps of a walk of its own
and looks the sampled words up among those of the items. Every candidate is verified by exact
edit distance over words.

Windows start at every eighth word; items are embedded at eight offsets, so that one of them
starts where a window does. A window is as long as its items, rounded down to 6, 12 or 24
words; longer items have several windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.blocks import Block, blocks, mix, one_array, u64, whole
from waymark.llm.tables import picked

#: Least similarity: 1 - edits / words of the item.
SIMILARITY = 0.8
REPETITIONS = 14
SAMPLED_STEPS = 4
#: Bytes of item text that all tasks hold at once; larger benchmarks take several passes.
BENCHMARK_BYTES = 1 << 20
_SIZES = (6, 12, 24)
_STRIDE = 8
_WALK = 2
_TABLE = 1 << 16
_SHIFT = 20
_SLOTS = 4096


def word_sequence(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of a block."""
    block = block.lowered()
    data = block.data
    starts, ends, rows = block.runs(((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128))
    return block.hashes(starts, ends), rows


@dataclass
class WindowClass:
    """Windows of one length: how they start, and per repetition the sampled steps' tables."""

    size: int
    stride: int
    steps: list[np.ndarray]
    allowed: list[list[np.ndarray]]
    keys: list[np.ndarray]
    windows: list[np.ndarray]
    items: np.ndarray
    offsets: np.ndarray


@dataclass
class Benchmark:
    ids: list
    words: list[np.ndarray]
    classes: list[WindowClass]
    similarity: float
    #: Which of so many slots the words of each item fill.
    slots: np.ndarray


def _seed(repetition: int) -> np.uint64:
    return u64(0xA0761D6478BD642F * (repetition + 1))


def walk(words: np.ndarray, starts: np.ndarray, limits: np.ndarray, steps: np.ndarray, allowed=None):
    """Walk from every start; which starts survive, and a key of the words at the sampled steps.

    ``allowed`` has for each sampled step which words (by 16 bits) any item shows there; other
    walks are given up at once, as their key can match no item.
    """
    alive = np.arange(len(starts))
    at, key = starts.copy(), np.zeros(len(starts), np.uint64)
    for step in range(int(steps[-1]) + 1):
        word = np.where(at < limits, words[np.minimum(at, len(words) - 1)], u64(0))
        sampled = np.searchsorted(steps, step)
        if sampled < len(steps) and steps[sampled] == step:
            if allowed is not None:
                fits = allowed[sampled][(word & u64(_TABLE - 1)).astype(np.int64)]
                alive, at, key, limits, word = alive[fits], at[fits], key[fits], limits[fits], word[fits]
            key = mix(key ^ word)
        at += ((word >> u64(16 + step % 48)) & u64(1)).astype(np.int64)
    return alive, key


def _classed(ids: list, words: list[np.ndarray], repetitions: int, sampled: int) -> list[WindowClass]:
    """Item windows by length, embedded."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for item, sequence in enumerate(words):
        n = len(sequence)
        fitting = [size for size in _SIZES if size + _STRIDE - 1 <= n]
        if fitting:
            size = fitting[-1]
            bases = range(0, n - size - _STRIDE + 2, size)
            found.setdefault((size, _STRIDE), []).extend((item, b + t) for b in bases for t in range(_STRIDE))
        elif n:
            found.setdefault((n, 1), []).append((item, 0))
    classes = []
    every = np.concatenate([*words, np.zeros(1, np.uint64)])
    firsts = np.cumsum([0, *map(len, words)])
    for (size, stride), windows in sorted(found.items()):
        items, offsets = np.array(windows).T
        starts = firsts[items] + offsets
        made = WindowClass(size, stride, [], [], [], [], items, offsets)
        for repetition in range(repetitions):
            chance = np.random.default_rng([size, repetition])
            steps = np.sort(chance.choice(_WALK * size, min(sampled, _WALK * size), replace=False))
            hashed = mix(every ^ _seed(repetition))
            # the words at every sampled step, kept as tables of 16 bits
            tables = []
            for last in range(1, len(steps) + 1):
                at = starts.copy()
                for step in range(int(steps[last - 1])):
                    word = np.where(at < starts + size, hashed[at.clip(max=len(every) - 1)], u64(0))
                    at += ((word >> u64(16 + step % 48)) & u64(1)).astype(np.int64)
                word = np.where(at < starts + size, hashed[at.clip(max=len(every) - 1)], u64(0))
                table = np.zeros(_TABLE, bool)
                table[(word & u64(_TABLE - 1)).astype(np.int64)] = True
                tables.append(table)
            _, keys = walk(hashed, starts, starts + size, steps)
            order = np.argsort(keys, kind="stable")
            made.steps.append(steps)
            made.allowed.append(tables)
            made.keys.append(keys[order])
            made.windows.append(order)
        classes.append(made)
    return classes


def prepare(ids: list, texts: list, similarity: float, repetitions: int, sampled: int) -> Benchmark:
    block = whole(pa.array(texts, pa.string()))
    hashed, rows = word_sequence(block)
    words = np.split(hashed, np.searchsorted(rows, np.arange(1, len(block))))
    kept = [i for i, w in enumerate(words) if len(w)]
    ids, words = [ids[i] for i in kept], [words[i] for i in kept]
    slots = np.zeros((len(ids), _SLOTS), bool)
    for i, w in enumerate(words):
        slots[i, (w & u64(_SLOTS - 1)).astype(np.int64)] = True
    return Benchmark(ids, words, _classed(ids, words, repetitions, sampled), similarity, slots)


def candidates(words: np.ndarray, rows: np.ndarray, n_rows: int, bench: Benchmark) -> np.ndarray:
    """Pairs of the LSH: row, item, and the word where the item would begin."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    found = []
    rounds = max((len(c.steps) for c in bench.classes), default=0)
    into = np.arange(len(words)) - bounds[rows]
    for repetition in range(rounds):
        hashed = mix(words ^ _seed(repetition))
        for kind in bench.classes:
            starts = np.flatnonzero(into % kind.stride == 0)
            limits = np.minimum(starts + kind.size, bounds[rows[starts] + 1])
            alive, keys = walk(hashed, starts, limits, kind.steps[repetition], kind.allowed[repetition])
            low = np.searchsorted(kind.keys[repetition], keys, "left")
            high = np.searchsorted(kind.keys[repetition], keys, "right")
            counts = high - low
            at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            window = kind.windows[repetition][at]
            start = np.repeat(starts[alive], counts)
            found.append(np.stack([rows[start], kind.items[window], start - kind.offsets[window]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    return np.unique(np.concatenate(found), axis=0)


def verified(words: np.ndarray, rows: np.ndarray, n_rows: int, pairs: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Candidates whose best piece of text is similar enough: row, item, edits, first word, end."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    sizes = np.array([len(w) for w in bench.words])
    budget = np.floor((1 - bench.similarity) * sizes + 1e-9).astype(np.int64)
    out = []
    for at in range(0, len(pairs), 2048):
        row, item, start = pairs[at : at + 2048].T
        n, k = sizes[item], budget[item]
        low = np.maximum(start - k - _STRIDE, bounds[row])
        high = np.minimum(start + n + k + _STRIDE, bounds[row + 1])
        # words of the text that the item lacks too can't make up for the others
        length = int((high - low).max())
        column = low[:, None] + np.arange(length)
        slot = (words[column.clip(0, len(words) - 1)] & u64(_SLOTS - 1)).astype(np.int64)
        shared = (bench.slots[item[:, None], slot] & (column < high[:, None])).sum(axis=1)
        could = shared >= n - k
        row, item, n, k, low, high = (x[could] for x in (row, item, n, k, low, high))
        if not len(row):
            continue
        length, width = int((high - low).max()), int(n.max())
        column = low[:, None] + np.arange(length)
        text = np.where(column < high[:, None], words[column.clip(0, len(words) - 1)], u64(1))
        asked = np.zeros((len(row), width), np.uint64)
        for i, x in enumerate(item):
            asked[i, : n[i]] = bench.words[x]
        # edits in the upper bits, the first column of the piece in the lower ones
        one = np.int64(1 << _SHIFT)
        columns = np.arange(length + 1, dtype=np.int64)
        cost = np.broadcast_to(columns, (len(row), length + 1)).copy()
        best = np.zeros(len(row), np.int64)
        last = np.zeros(len(row), np.int64)
        outside = columns[None, :] > (high - low)[:, None]
        for i in range(1, width + 1):
            new = cost + one
            step = np.where(text == asked[:, i - 1 : i], cost[:, :-1], cost[:, :-1] + one)
            new[:, 1:] = np.minimum(new[:, 1:], step)
            cost = np.minimum.accumulate(new - columns * one, axis=1) + columns * one
            done = n == i
            if done.any():
                final = np.where(outside[done], np.int64(1) << 60, cost[done])
                last[done] = final.argmin(axis=1)
                best[done] = final.min(axis=1)
        edits, first = best >> _SHIFT, best & (one - 1)
        good = edits <= k
        base = bounds[row]
        out.append(np.stack([row, item, edits, low + first - base, low + last - base], axis=1)[good])
    if not out:
        return np.zeros((0, 5), np.int64)
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def matches(column: pa.Array, bench: Benchmark) -> np.ndarray:
    """All matches in a column of texts: row, item, edits, first word, word after the last."""
    found = [np.zeros((0, 5), np.int64)]
    for block in blocks(column):
        words, rows = word_sequence(block)
        if len(words) and bench.words:
            pairs = candidates(words, rows, len(block), bench)
            some = verified(words, rows, len(block), pairs, bench)
            found.append(some + np.array([block.first, 0, 0, 0, 0]))
    return np.concatenate(found)


def _passes(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of about ``limit`` bytes, dealt by a hash of the item."""
    items = picked(benchmark, id_col, text_col).filter("_text is not null")
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        some = items.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k).collect()
        yield [row["_id"] for row in some], [row["_text"] for row in some]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    repetitions: int = REPETITIONS,
    sampled: int = SAMPLED_STEPS,
    limit: int = BENCHMARK_BYTES,
) -> DataFrame:
    """Pairs of documents and the items they contain, with the best place of each.

    Result: doc_id, item_id, n_words (of the item), edits, first_word, end_word (words of the
    document from 0, end excluded), similarity. Null and empty texts and items without words
    match nothing; equal items all match; every row of a repeated document is reported. Extra
    columns are left out.
    """
    made = "doc_id long, item_id long, n_words long, edits long, first_word long, end_word long, similarity double"
    spark, docs = docs.sparkSession, picked(docs, id_col, text_col)
    result = spark.createDataFrame([], T.StructType.fromDDL(made))
    for ids, texts in _passes(benchmark, item_col, item_text_col, limit):
        held = spark.sparkContext.broadcast(prepare(ids, texts, similarity, repetitions, sampled))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                row, item, edits, first, end = matches(batch["_text"], bench).T
                n = np.array([len(w) for w in bench.words], np.int64)[item] if len(item) else item
                yield pa.record_batch(
                    {
                        "doc_id": one_array(batch["_id"]).take(pa.array(row)),
                        "item_id": pa.array([bench.ids[i] for i in item], pa.int64()),
                        "n_words": n, "edits": edits, "first_word": first, "end_word": end,
                        "similarity": 1 - edits / np.maximum(n, 1),
                    }
                )

        result = result.union(docs.mapInArrow(scan, made))
    return result


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    repetitions: int = REPETITIONS,
    sampled: int = SAMPLED_STEPS,
    limit: int = BENCHMARK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, that contain no item."""
    spark, names = docs.sparkSession, docs.columns
    text_at = names.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may hold dots
    for ids, texts in _passes(benchmark, item_col, item_text_col, limit):
        held = spark.sparkContext.broadcast(prepare(ids, texts, similarity, repetitions, sampled))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(text_at)
                clean = np.ones(batch.num_rows, bool)
                clean[matches(column, held.value)[:, 0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs.toDF(*names)
