"""Phrases whose words stand together more often than apart, per language.

Frequent n-grams are found with mergeable Misra-Gries summaries, one per hash partition of the
n-grams. A summary's capacity exceeds its mass (the occurrences it stands for) divided by the
threshold. Dropping the smallest counts takes at least capacity + 1 occurrences for each one
that an n-gram loses, in whatever order summaries merge; so no n-gram loses as many as the
threshold, and every frequent one survives; those whose count cannot reach the threshold even
with all that was lost are left out. Words and pairs are summarised first; longer n-grams only
where all their pairs survived, since a phrase is no more frequent than its parts.
A second pass counts the survivors exactly, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, counted, gather, mix, one_array, u64
from waymark.llm.tables import stored

THRESHOLD = 100
MOST_WORDS = 5
TOP = 2000
#: Bytes of text scanned at once.
_SCAN_BYTES = 1 << 20
#: Entries of a task's summary before it is sent on.
_TASK_ENTRIES = 1 << 21
#: Mass of one hash partition: bounds what one group holds.
PART_MASS = 1 << 22
#: Largest filter of survivors, in bits. A fuller one lets more n-grams through to the exact
#: count, which drops them.
MAX_FILTER_BITS = 28
#: Bits of one piece of a filter.
_PIECE_BITS = 14
#: Languages sent to every executor.
MAX_LANGUAGES = 10_000
#: Phrases of a task's exact counts before they are sent on.
_TASK_PHRASES = 1 << 19


class _Words:
    """Words of a block with their hashes, and where n-grams start."""

    def __init__(self, block: Block, langs: np.ndarray) -> None:
        self.block = block = block.lowered()
        data = block.data
        breaks = np.isin(data, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
        self.starts, self.ends, self.rows = block.runs(~(breaks | (data == 32) | (data == 9)))
        self.hashes = block.hashes(self.starts, self.ends)
        self.first = mix(self.hashes ^ langs[self.rows])
        piece = np.cumsum(breaks)[self.starts] if len(self.starts) else self.starts
        #: whether a word follows in the same piece
        self.goes_on = np.zeros(len(self.starts), bool)
        self.goes_on[:-1] = (self.rows[1:] == self.rows[:-1]) & (piece[1:] == piece[:-1])

    def longer(self, at: np.ndarray, grams: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """From n-grams of ``words`` words at some places to those with one word more."""
        fits = self.goes_on[at + words - 1]
        at, grams = at[fits], grams[fits]
        return at, mix(grams * u64(0x9E3779B97F4A7C15) + self.hashes[at + words])

    def phrases(self, at: np.ndarray, words: np.ndarray) -> pa.Array:
        """The n-grams at some places as text, joined by single spaces."""
        which = np.repeat(at - (np.cumsum(words) - words), words) + np.arange(words.sum())
        sizes = self.ends[which] - self.starts[which] + 1
        data = gather(np.append(self.block.data, np.uint8(32)), self.starts[which], sizes)
        stops = np.cumsum(sizes)
        data[stops - 1] = 32
        ends = stops[np.cumsum(words) - 1]
        starts = np.append(0, ends[:-1])
        data = gather(data, starts, ends - starts - 1)
        offsets = np.append(0, np.cumsum(ends - starts - 1)).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return made.cast(pa.string())


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, pa.Array]]:
    """Words of all rows, and the rows' languages."""
    for batch in batches:
        for block in blocks(batch.column("_text"), _SCAN_BYTES):
            langs = batch.column("_lang").slice(block.first, len(block))
            names, at = np.unique(np.array(langs.to_pylist(), object), return_inverse=True)
            data = [str(name).encode() for name in names]
            offsets = np.cumsum([0, *map(len, data)])
            held = Block(np.frombuffer(b"".join(data), np.uint8), offsets)
            yield _Words(block, held.hashes(offsets[:-1], offsets[1:], seed=2)[at]), langs


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per language: lang, n."""
    total: dict[str, int] = {}
    for words, langs in _scanned(batches):
        each = np.bincount(words.rows, minlength=len(langs))
        for lang, n in zip(langs.to_pylist(), each.tolist(), strict=True):
            total[lang] = total.get(lang, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "n"])


def reduced(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """What a summary subtracts from all its counts to keep at most ``capacity`` of them."""
    if len(counts) <= capacity:
        return counts, 0
    least = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    return counts - least, least


def _held(filter_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which n-grams a filter holds."""
    slot = grams >> u64(64 - (len(filter_) * 8).bit_length() + 1)
    return (filter_[(slot >> u64(3)).astype(np.int64)] >> (slot & u64(7)).astype(np.uint8) & 1).astype(bool)


def _short(words: _Words, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places and hashes of all words and pairs."""
    at, grams = np.arange(len(words.starts)), words.first
    yield at, grams, 1
    yield *words.longer(at, grams, 1), 2


def _long(most: int):
    def run(words: _Words, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places and hashes of longer n-grams all of whose pairs survived."""
        at, grams = words.longer(np.arange(len(words.starts)), words.first, 1)
        alive = np.zeros(len(words.starts) + 1, bool)
        held = _held(filters[0].value, grams)
        at, grams = at[held], grams[held]
        alive[at] = True
        for size in range(3, most + 1):
            at, grams = words.longer(at, grams, size - 1)
            held = alive[at + size - 2]
            at, grams = at[held], grams[held]
            yield at, grams, size

    return run


def _survivors_of(most: int):
    def run(words: _Words, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places and hashes of all n-grams that the filters hold."""
        for at, grams, size in _short(words, filters):
            held = _held(filters[0].value, grams)
            yield at[held], grams[held], size
        for at, grams, size in _long(most)(words, filters):
            held = _held(filters[1].value, grams)
            yield at[held], grams[held], size

    return run


def _summaries(source, filters: list, capacity: int, parts: int):
    """A task's summaries, one per hash partition: part, mass, lost, grams, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        for words, _ in _scanned(batches):
            waiting += [found for _, found, _ in source(words, filters)]
            if sum(map(len, waiting)) >= _TASK_ENTRIES:
                grams, counts = _taken(grams, counts, waiting)
                waiting = []
                if len(grams) >= _TASK_ENTRIES:
                    yield _sent(grams, counts, capacity, parts)
                    grams, counts = grams[:0], counts[:0]
        grams, counts = _taken(grams, counts, waiting)
        if len(grams):
            yield _sent(grams, counts, capacity, parts)

    return run


def _taken(grams: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, times = np.unique(np.concatenate([grams[:0], *more]), return_counts=True)
    return counted(np.concatenate([grams, found]), np.concatenate([counts, times]))


def _sent(grams: np.ndarray, counts: np.ndarray, capacity: int, parts: int) -> pa.RecordBatch:
    part = (grams >> u64(20)) % u64(parts)
    order = np.argsort(part, kind="stable")
    grams, counts, part = grams[order], counts[order], part[order]
    found, first = np.unique(part, return_index=True)
    rows: list[tuple] = []
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        some, lost = reduced(counts[low:high], capacity)
        left = some > 0 if lost else slice(None)
        mass = int(counts[low:high].sum())
        rows.append((mass, lost, grams[low:high][left].tobytes(), some[left].astype(np.uint32 if mass < 1 << 32 else np.uint64).tobytes()))
    masses, losses, keys, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found.astype(np.int32)), pa.array(masses, pa.int64()), pa.array(losses, pa.int64()),
            pa.array(keys, pa.binary()), pa.array(values, pa.binary()),
        ],
        ["part", "mass", "lost", "grams", "counts"],
    )


def _merged(threshold: int):
    """Merges the summaries of one hash partition: the n-grams that survive."""

    def merge(group: pa.Table) -> pa.Table:
        capacity = sum(group["mass"].to_pylist()) // threshold + 1
        grams, counts = [], []
        for keys, values in zip(group["grams"].to_pylist(), group["counts"].to_pylist(), strict=True):
            grams.append(np.frombuffer(keys, np.uint64))
            wide = np.uint64 if len(values) == len(keys) else np.uint32
            counts.append(np.frombuffer(values, wide).astype(np.int64))
        found, total = counted(np.concatenate(grams), np.concatenate(counts))
        left, lost = reduced(total, capacity)
        # an n-gram has at most its count and all that any summary took from it
        most = left + lost + sum(group["lost"].to_pylist())
        return pa.table({"gram": found[(left > 0) & (most >= threshold)].view(np.int64)})

    return merge


def _survivors(texts: DataFrame, source, filters: list, mass: int, threshold: int) -> DataFrame:
    """Hashes of n-grams, among them all that occur ``threshold`` times: gram."""
    parts = mass // PART_MASS + 1
    made = _summaries(source, filters, mass // threshold + 1, parts)
    summaries = texts.mapInArrow(made, "part int, mass long, lost long, grams binary, counts binary")
    return stored(summaries.groupBy("part").applyInArrow(_merged(threshold), "gram long"))


def _filter(survivors: DataFrame) -> Broadcast:
    """A set of bits that holds all survivors, of bounded size."""
    bits = min(max((16 * survivors.count()).bit_length(), _PIECE_BITS), MAX_FILTER_BITS)
    slot = F.expr(f"shiftrightunsigned(gram, {64 - bits})")
    dealt = survivors.select(slot.alias("slot"), F.shiftright(slot, _PIECE_BITS).cast("int").alias("piece"))

    def pack(group: pa.Table) -> pa.Table:
        held = np.zeros(1 << _PIECE_BITS, np.uint8)
        held[one_array(group["slot"]).to_numpy() & ((1 << _PIECE_BITS) - 1)] = 1
        packed = np.packbits(held, bitorder="little").tobytes()
        return pa.table({"piece": group["piece"][:1], "bits": pa.array([packed], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << _PIECE_BITS) // 8
    for row in dealt.groupBy("piece").applyInArrow(pack, "piece int, bits binary").collect():
        out[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return survivors.sparkSession.sparkContext.broadcast(out)


def _exact(source, filters: list):
    """A task's exact counts of what a source yields: lang, words, phrase, f."""

    def send(keys: np.ndarray, counts: np.ndarray, known: np.ndarray, shown: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(shown).combine_chunks()
        counts = counts[np.searchsorted(keys, known)]
        return table.append_column("f", pa.array(counts)).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        keys, counts, known, shown = none, np.zeros(0, np.int64), [none], []
        for words, langs in _scanned(batches):
            parts = list(source(words, filters))
            at = np.concatenate([p[0] for p in parts])
            grams = np.concatenate([p[1] for p in parts])
            sizes = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
            found, first, times = np.unique(grams, return_index=True, return_counts=True)
            new = first if not len(keys) else first[keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] != found]
            if len(new):
                known.append(grams[new])
                shown.append(
                    pa.RecordBatch.from_arrays(
                        [langs.take(pa.array(words.rows[at[new]])), pa.array(sizes[new].astype(np.int32)), words.phrases(at[new], sizes[new])],
                        ["lang", "words", "phrase"],
                    )
                )
            keys, counts = counted(np.concatenate([keys, found]), np.concatenate([counts, times]))
            if len(keys) >= _TASK_PHRASES:
                yield send(keys, counts, np.concatenate(known), shown)
                keys, counts, known, shown = none, counts[:0], [none], []
        if len(keys):
            yield send(keys, counts, np.concatenate(known), shown)

    return run


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, threshold: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Words per language (lang, n), and phrases found ``threshold`` times: lang, words, phrase, f."""
    texts = docs.select(
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("_lang"),
    )
    sizes = stored(texts.mapInArrow(_numbered, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    short = _survivors(texts, _short, [], 2 * total, threshold)
    filters = [_filter(short)]
    filters.append(_filter(_survivors(texts, _long(most), filters, max(most - 2, 0) * total, threshold)))
    found = texts.mapInArrow(_exact(_survivors_of(most), filters), "lang string, words int, phrase string, f long")
    counts = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return sizes, stored(counts.filter(F.col("f") >= threshold))


def _joined(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    threshold: int = THRESHOLD,
    most_words: int = MOST_WORDS,
    top: int = TOP,
) -> DataFrame:
    """Each language's phrases of 2 to ``most_words`` words with the highest scores.

    Result: lang, rank, phrase, a, l, r, n, score. ``a`` is the phrase's count, ``n`` the
    language's number of words; the phrase cut after its first words, whose count is ``l``, with
    ``r`` for the rest, scores floor(1000 * a * n / (l * r)), and its lowest-scoring cut counts
    (ties: the earliest). Phrases below ``threshold`` are no candidates; one that always stands
    inside a longer candidate is dropped. Order: score and ``a`` descending, then the phrase's
    bytes; ``top`` phrases are reported. Null texts count as empty, a null language as ``und``;
    repeated rows count every time, extra columns are left out, and an empty table gives an
    empty one. Products are decimals of 38 digits.
    """
    sizes, counts = phrase_counts(docs, text_col, lang_col, threshold, most_words)
    if sizes.count() <= MAX_LANGUAGES:
        sizes = F.broadcast(sizes)
    grams = counts.filter("words > 1")
    parts = F.split("phrase", " ")
    # a phrase inside a longer one with the same count stands also inside one just one word longer
    around = grams.filter("words > 2").select(
        "lang", F.col("f").alias("outer"),
        F.explode(F.array(_joined(parts, 1, F.col("words") - 1), _joined(parts, 2, F.col("words") - 1))).alias("phrase"),
    )
    around = around.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    grams = grams.join(around, ["lang", "phrase"], "left").filter("outer is null or outer < f").drop("outer")
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        _joined(parts, 1, F.col("k")).alias("head"), _joined(parts, F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(sizes, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
