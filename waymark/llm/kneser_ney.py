"""Quality rules: counts per text, and perplexity under a language model of its own corpus.

The model is a modified Kneser-Ney model over the bytes of all texts, one per language.
Spark counts the n-grams, derives continuation counts, discounts and interpolated
probabilities of every order, and stores the highest order as sorted hash arrays. Each
language gets a lower and an upper band of perplexity from its own texts: below lie loops,
above lie noise and foreign matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, counted, mix, one_array, places, totals, u64
from waymark.llm.tables import BROADCAST_BYTES, picked, probe_sorted, probed, schema, small_batches, sorted_arrays, stored

ORDER = 5
#: Bands reach so many times the distance between the median and the outer tenths.
BAND_WIDTH = 2.0
#: Room below and above the bands for short texts, in bits by the root of a text's bytes.
SLACK = (5.0, 2.0)
#: Bits per byte are counted in bins of this width for medians and tenths.
BIN = 0.001
#: Most languages whose bands are broadcast; more are joined.
MAX_LANGUAGES = 10_000
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_WINDOW = 8
#: Bytes of text looked at together: arrays that fit into the processor's cache.
_SCAN_BYTES = 1 << 18
_FLUSH = 2_000_000
_DISCOUNTS = ("d1", "d2", "d3")


@cache
def _language(name: str | None) -> int:
    digest = hashlib.blake2b(("" if name is None else "=" + name).encode(), digest_size=8)
    return int.from_bytes(digest.digest(), "little")


def grams(block: Block) -> np.ndarray:
    """For every byte, itself and the bytes before it in its row (zeros before the start)."""
    data = block.data.astype(np.uint64)
    out = data.copy()
    into = np.arange(len(data)) - block.offsets[block.rows_of(np.arange(len(data)))]
    for back in range(1, ORDER):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[:-back]
        shifted[into < back] = 0
        out |= shifted << u64(8 * back)
    return out


def _keys(block: Block, languages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and hash key at every byte."""
    rows = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    salts = np.array([_language(x) for x in languages[block.first : block.first + len(block)]], np.uint64)
    found = grams(block)
    return rows, found, mix(found ^ salts[rows] if len(rows) else found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, (found, n) in held.items():
            columns = {
                "lang": pa.array([name] * len(found), pa.string()),
                "gram": found.astype(np.int64),
                "key": mix(found ^ u64(_language(name))).view(np.int64),
                "n": n,
            }
            yield from pa.table(columns).to_batches()
        held.clear()

    for batch in batches:
        languages = batch["_lang"].to_pylist()
        for block in blocks(batch["_text"]):
            names = languages[block.first : block.first + len(block)]
            found, rows = grams(block), np.repeat(np.arange(len(block)), np.diff(block.offsets))
            for name in set(names):
                mine = found[np.array([x == name for x in names])[rows]]
                keys, n = np.unique(mine, return_counts=True)
                if name in held:
                    old = held[name]
                    keys, n = counted(np.concatenate([old[0], keys]), np.concatenate([old[1], n]))
                held[name] = keys, n
        if sum(len(found) for found, _ in held.values()) > _FLUSH:
            yield from flush()
    yield from flush()


def ngram_counts(docs: DataFrame) -> DataFrame:
    """Counts of all n-grams of the highest order: lang, gram, key, n."""
    partial = docs.select("_text", "_lang").mapInArrow(_count, "lang string, gram long, key long, n long")
    return partial.groupBy("lang", "gram", "key").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> dict[str, float]:
    """Discounts for counts of one, two and more, from the counts of counts."""
    seen = level.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (max(float(seen[f"n{k}"]), 1.0) for k in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return {name: min(max(d, 0.1), k) for name, d, k in zip(_DISCOUNTS, raw, (0.9, 1.8, 2.7), strict=True)}


def probabilities(counts: DataFrame) -> DataFrame:
    """Log2 probability of the last byte of every counted n-gram: key bigint, value double.

    Lower orders count the distinct bytes seen before an n-gram instead of its occurrences.
    All orders are interpolated down to the uniform distribution over bytes.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")
        levels[k] = levels[k + 1].groupBy("lang", suffix).agg(F.count(F.lit(1)).alias("n"))
    lower = None
    for k in range(1, ORDER + 1):
        level, d = levels[k], _discounts(levels[k])
        n = F.col("n")
        less = F.when(n == 1, d["d1"]).when(n == 2, d["d2"]).otherwise(d["d3"])
        context = F.shiftright("gram", 8)
        sums = level.groupBy(F.col("lang").alias("of"), context.alias("context"))
        sums = sums.agg(F.sum("n").alias("total"), F.sum(less).alias("mass"))
        same = F.col("lang").eqNullSafe(F.col("of")) & (context == F.col("context"))
        level = level.join(sums, same).drop("of", "context")
        below = F.lit(1 / 256)
        if lower is not None:
            suffix = F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)
            same = F.col("lang").eqNullSafe(F.col("of")) & (suffix == F.col("tail"))
            level, below = level.join(lower, same).drop("of", "tail"), F.col("below")
        p = (n - less) / F.col("total") + F.col("mass") / F.col("total") * below
        level = level.withColumn("p", p)
        lower = level.select(F.col("lang").alias("of"), F.col("gram").alias("tail"), F.col("p").alias("below"))
    return level.select("key", F.log2("p").alias("value"))


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def features(block: Block) -> dict[str, np.ndarray]:
    """Counts per row of a block."""
    n, data = len(block), block.data
    starts, ends, rows = block.words()
    salt = mix(np.arange(n, dtype=np.uint64) + u64(1))
    inside = np.repeat(rows, ends - starts)
    letters = (data & 0xC0) != 0x80
    spaces = np.ones(len(data), bool)
    spaces[np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange(len(inside))] = False
    at = np.flatnonzero(letters & ~spaces)
    line_starts, line_ends, line_rows = block.lines()
    filled = np.concatenate([[0], np.cumsum(~spaces)])
    full = filled[line_ends] > filled[line_starts]
    lines = mix(block.hashes(line_starts[full], line_ends[full]) ^ salt[line_rows[full]])
    line_rows = line_rows[full]
    _, first = np.unique(lines, return_index=True)
    window = mix(block.hashes(starts, ends) ^ salt[rows]) if len(rows) else np.zeros(0, np.uint64)
    for step in (1, 2, 4):
        window = mix(window[:-step] * u64(0x9E3779B97F4A7C15) + window[step:])
    fits = rows[: len(window)] == rows[_WINDOW - 1 :]
    repeated = np.flatnonzero(fits)[_repeated(window[fits])]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + _WINDOW, -1)
    return {
        "n_words": totals(rows, n),
        "word_chars": totals(block.rows_of(at), n),
        "n_symbols": totals(block.rows_of(np.flatnonzero(_SYMBOLS[data])), n),
        "n_dup_lines": totals(line_rows, n) - totals(line_rows[first], n),
        "n_repeat_words": totals(rows[np.cumsum(cover)[:-1] > 0], n),
    }


def _gram_keys(table: pa.Table) -> np.ndarray:
    languages = table["_lang"].to_pylist()
    found = [np.unique(_keys(block, languages)[2]) for block in blocks(table["_text"], _SCAN_BYTES)]
    return np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]))[:, None]


def _features(table: pa.Table, find) -> pa.Table:
    languages = table["_lang"].to_pylist()
    parts: list[dict] = []
    for block in blocks(table["_text"], _SCAN_BYTES):
        rows, _, keys = _keys(block, languages)
        distinct = np.unique(keys)
        logs = find(distinct[:, None])[places(distinct, keys)]
        size = np.diff(block.offsets)
        bits = -totals(rows, len(block), logs) / np.maximum(size, 1)
        parts.append(features(block) | {"n_bytes": size, "bits": np.where(size > 0, bits, np.nan)})
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "bits")
    columns = {"doc_id": one_array(table["_id"]), "lang": one_array(table["_lang"])}
    for name in names:
        kind = pa.float64() if name == "bits" else pa.int64()
        columns[name] = pa.array(np.concatenate([p[name] for p in parts]) if parts else [], kind)
    columns["bits"] = pa.array(columns["bits"].to_numpy(), from_pandas=True)
    if "row" in table.column_names:
        columns |= {"text": table["_text"], "row": table["row"]}
    return pa.table(columns)


def _bands(found: DataFrame, width: float) -> DataFrame:
    """Bands per language around the median of bits, from exact counts of narrow bins."""
    bins = found.groupBy("lang", F.floor(F.col("bits") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    tenth = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))) * BIN
    bands = bins.groupBy(F.col("lang").alias("of")).agg(
        tenth(0.1).alias("p10"), tenth(0.5).alias("p50"), tenth(0.9).alias("p90")
    )
    return bands.select(
        "of",
        (F.col("p50") - width * F.greatest(F.col("p50") - F.col("p10"), F.lit(0.02))).alias("low"),
        (F.col("p50") + width * F.greatest(F.col("p90") - F.col("p50"), F.lit(0.02))).alias("high"),
    )


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep_rows: bool = False,
    band_width: float = BAND_WIDTH,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Counts, base verdict, perplexity and verdict of every text.

    Result: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_bytes, base_failed, bits (per byte; 2**bits is the perplexity), low, high, kept; with
    ``keep_rows`` also ``text`` and ``row``, a struct of the other input columns. A null text counts as empty,
    fails the base rules and has null bits. Null is a language of its own. Repeated rows are
    judged one by one; an empty table gives an empty one. Bands come from texts that pass the
    base rules: the median, and ``band_width`` times the distance to the outer tenths, wider
    for short texts by ``SLACK``.
    """
    docs = picked(docs, id_col, text_col, lang_col, keep_rows=keep_rows)
    docs = docs.withColumnRenamed(f"_{lang_col}", "_lang")
    with small_batches(docs.sparkSession):
        counts = stored(ngram_counts(docs))
    index, shards = sorted_arrays(stored(probabilities(counts)))
    made = schema(
        "doc_id bigint", "lang string", "n_words bigint", "word_chars bigint", "n_symbols bigint",
        "n_dup_lines bigint", "n_repeat_words bigint", "n_bytes bigint", "bits double",
        *["text string"] * keep_rows, rows=docs,
    )
    found = probed(docs, index, shards, _gram_keys, probe_sorted, np.nan, _features, made, limit=limit)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    with small_batches(docs.sparkSession):
        found = stored(found.withColumn("base_failed", failed))
    bands = stored(_bands(found.filter("not base_failed"), band_width))
    if bands.count() <= MAX_LANGUAGES:
        bands = F.broadcast(bands)
    judged = found.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    for name, slack in zip(("low", "high"), (-SLACK[0], SLACK[1]), strict=True):
        judged = judged.withColumn(name, F.col(name) + slack / F.sqrt(F.nullif("n_bytes", F.lit(0))))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)
