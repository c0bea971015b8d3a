"""Context-tree weighting of bytes: code length under a mixture over all context depths.

The next byte is eight binary decisions, each with a context tree of its own: a node is known
by the bytes before (its depth many) and the bits decided so far. Spark counts zeros and ones
at the deepest nodes, sums them towards the root, and gives every node

* ``Pe``, the Krichevsky-Trofimov estimate of its own counts, and
* ``Pw``, half ``Pe`` and half the product of its children's ``Pw`` (at full depth: ``Pe``).

From the root down, a node's share of ``Pw`` that is its own weighs its estimate of the next
bit; what is left goes to its child. That gives each seen (context, byte) one probability,
which texts look up. Nodes seen in scored texts only enter with zero counts.

A text is coded with its end, a byte that UTF-8 never has, so all texts together have
probability one at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, counted, mix, one_array, places, totals, u64
from waymark.llm.tables import picked, probe_sorted, probed, schema, sorted_arrays, stored

DEPTH = 4
#: Bytes of text in one group: larger groups send fewer words and contexts twice.
GROUP_BYTES = 24 << 20
_FLUSH = 2_000_000
_WORD, _GRAM = 0, 1
#: The end of a text.
_END = 0xFF


def ended(block: Block) -> Block:
    """Every row with the end behind its last byte."""
    data = np.insert(block.data, block.offsets[1:], np.uint8(_END))
    return Block(data, block.offsets + np.arange(len(block.offsets)), block.first)


def grams(block: Block, depth: int) -> np.ndarray:
    """For every byte, itself under the ``depth`` bytes before it in its row (zeros before)."""
    data = block.data.astype(np.uint64)
    out = data.copy()
    into = np.arange(len(data)) - np.repeat(block.offsets[:-1], np.diff(block.offsets))
    for back in range(1, depth + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[back:] = data[:-back]
        shifted[into < back] = 0
        out |= shifted << u64(8 * back)
    return out


def _gram_keys(found: np.ndarray) -> np.ndarray:
    return mix(found ^ u64(0x2545F4914F6CDD1D))


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = block.words()
    return block.hashes(starts, ends), rows


def _count(depth: int):
    """Partial counts over a task: kind, item (word hash or n-gram), n (in training texts)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[np.zeros(0, np.uint64), np.zeros(0, np.int64)] for _ in range(2)]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (items, n) in enumerate(held):
                yield pa.record_batch(
                    {
                        "kind": pa.array(np.full(len(items), kind, np.int32)),
                        "item": pa.array(items.view(np.int64)),
                        "n": pa.array(n, pa.int64()),
                    }
                )
                held[kind] = [items[:0], n[:0]]

        for batch in batches:
            trains = ~one_array(batch["_held"]).to_numpy(zero_copy_only=False)
            for block in blocks(batch["_text"]):
                block = block.lowered()
                train = trains[block.first : block.first + len(block)]
                words, rows = _words(block)
                found = grams(ended(block), depth)
                training = np.repeat(train, np.diff(block.offsets) + 1)
                some = [np.unique(words[train[rows]], return_counts=True)]
                items, n = np.unique(found[training], return_counts=True)
                unseen = np.setdiff1d(np.unique(found[~training]), items, assume_unique=True)
                some.append((np.concatenate([items, unseen]), np.append(n, np.zeros(len(unseen), np.int64))))
                for kind, (items, n) in enumerate(some):
                    old = held[kind]
                    held[kind] = list(counted(np.concatenate([old[0], items]), np.concatenate([old[1], n])))
            if sum(len(items) for items, _ in held) > _FLUSH:
                yield from flush()
        yield from flush()

    return count


def _log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function, for x of 1/2 and more."""
    z = x + 8
    shift = reduce(lambda a, b: a * b, [x + k for k in range(8)])
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - F.ln(shift)


def _estimated(nodes: DataFrame) -> DataFrame:
    """Adds the logarithm of the KT estimate of all of a node's counts."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    log_pe = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - 1.1447298858494002
    return nodes.withColumn("pe", F.when(F.col("a") + F.col("b") == 0, 0.0).otherwise(log_pe))


def probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """Log10 probability of the last byte of every n-gram: item, value.

    ``counts`` has item (n-gram) and n. Nodes are numbered by context and decided bits.
    """
    byte = F.col("item").bitwiseAND(255)
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    steps = counts.select("item", "n", byte.cast("int").alias("byte"), bits)
    decided = F.expr("(1 << i) | (byte >> (8 - i))")
    bit = F.expr("(byte >> (7 - i)) & 1")
    node = F.expr("(item & ~255L)").bitwiseOR(decided.cast("bigint")).alias("node")
    steps = steps.select("item", node, bit.alias("bit"), "n")
    nodes = steps.groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"),
    )
    levels = {depth: stored(_estimated(nodes).withColumn("pw", F.col("pe")))}
    above = lambda d: F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1)
    for d in range(depth - 1, -1, -1):
        sums = levels[d + 1].groupBy(above(d).alias("node"))
        sums = sums.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("split"))
        # ln(exp(pe) / 2 + exp(split) / 2), from the larger of both
        large, small = F.greatest("pe", "split"), F.least("pe", "split")
        mixed = large + F.ln((1 + F.exp(small - large)) / 2)
        levels[d] = stored(_estimated(sums).withColumn("pw", mixed))
    passed = None
    for d in range(depth + 1):
        own = F.when(F.lit(d == depth), 1.0).otherwise(F.exp(F.col("pe") - F.col("pw") - F.lit(0.6931471805599453)))
        one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
        level = levels[d].select("node", F.least(own, F.lit(1.0)).alias("own"), one.alias("one"))
        if passed is None:
            level = level.withColumn("given", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            level = level.join(passed, above(d - 1) == F.col("parent")).drop("parent")
        p = F.col("given") + F.col("left") * F.col("own") * F.col("one")
        left = F.col("left") * (1 - F.col("own"))
        passed = level.select(F.col("node").alias("parent"), p.alias("given"), left.alias("left"))
    leaves = passed.select(F.col("parent").alias("node"), F.col("given").alias("p"))
    told = steps.join(leaves, "node")
    chosen = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return told.groupBy("item").agg(F.sum(F.log10(chosen)).alias("value"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _gram_keys(batch["item"].to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "value": batch["value"]})


def _keys_of(depth: int):
    def keys_of(table: pa.Table) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for block in blocks(table["_text"]):
            block = block.lowered()
            found.append(np.unique(_words(block)[0]))
            found.append(_gram_keys(np.unique(grams(ended(block), depth))))
        return np.unique(np.concatenate(found))[:, None]

    return keys_of


def _scored(depth: int, train_tokens: int, base: float, end: float, known_end: int):
    """Scores of texts; ``base`` is log10 of a token's share without a count, ``end`` of the end."""

    def score(table: pa.Table, find) -> pa.Table:
        columns: dict[str, list] = {name: [] for name in ("n_tokens", "n_known", "base_score", "score")}
        for block in blocks(table["_text"]):
            block, n = block.lowered(), len(block)
            words, rows = _words(block)
            distinct = np.unique(words)
            values = find(distinct[:, None])[places(distinct, words)]
            known = ~np.isnan(values)
            keys = _gram_keys(grams(ended(block), depth))
            distinct = np.unique(keys)
            logs = find(distinct[:, None])[places(distinct, keys)]
            at = np.repeat(np.arange(n), np.diff(block.offsets) + 1)
            columns["n_tokens"].append(totals(rows, n) + 1)
            columns["n_known"].append(totals(rows[known], n) + known_end)
            columns["base_score"].append(totals(rows, n, np.where(known, values, base)) + end)
            columns["score"].append(totals(at, n, logs))
        out = {"doc_id": one_array(table["_id"]), "held_out": one_array(table["_held"])}
        for name, parts in columns.items():
            kind = pa.float64() if name.endswith("score") else pa.int64()
            out[name] = pa.array(np.concatenate(parts) if parts else [], kind)
        out["train_tokens"] = pa.array(np.full(table.num_rows, train_tokens), pa.int64())
        out["n_bytes"] = pa.compute.binary_length(out_text(table)).cast(pa.int64())
        return pa.table(out)

    return score


def out_text(table: pa.Table) -> pa.Array:
    return one_array(table["_text"]).fill_null("")


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    folds: int = 5,
    held_fold: int = 1,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Code lengths of all texts under a model of the texts outside the held-out fold.

    A text is held out if crc32 of its id, as text, leaves ``held_fold`` by ``folds``; a null id
    is never held out. A-Z count as lower case. Result: doc_id, held_out, n_tokens, n_known,
    base_score, score (log10 probability of the text: all its bytes, then the end), train_tokens,
    n_bytes, bits_per_byte (the end's bits included; null for empty texts). Null texts count as
    empty: one token, the end. Without training texts all contexts have zero counts: every bit
    costs one bit. Extra columns are left out.
    """
    docs = picked(docs, id_col, text_col)
    fold = F.crc32(F.col("_id").cast("string")) % folds == held_fold
    docs = docs.withColumn("_held", F.coalesce(fold, F.lit(False)))
    partial = docs.select("_text", "_held").mapInArrow(_count(depth), "kind int, item long, n long")
    counts = stored(partial.groupBy("kind", "item").agg(F.sum("n").alias("n")))
    words = counts.filter(f"kind = {_WORD}")
    ends = docs.agg(F.count_if(~F.col("_held"))).first()[0]
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, distinct = total + ends, distinct + (ends > 0)
    share = train_tokens + 0.5 * (distinct + 1)
    known = words.select(F.col("item").alias("key"), F.log10((F.col("n") + 0.5) / share).alias("value"))
    trees = probabilities(counts.filter(f"kind = {_GRAM}"), depth)
    index, shards = sorted_arrays(stored(known.union(trees.mapInArrow(_keyed, "key long, value double"))))
    made = schema(
        "doc_id bigint", "held_out boolean", "n_tokens bigint", "n_known bigint", "base_score double",
        "score double", "train_tokens bigint", "n_bytes bigint",
    )
    base, end = np.log10(0.5 / share), np.log10((ends + 0.5) / share)
    finish = _scored(depth, train_tokens, float(base), float(end), int(ends > 0))
    # the table of words grows with the corpus, so texts always meet it in groups
    found = probed(docs, index, shards, _keys_of(depth), probe_sorted, np.nan, finish, made, limit=-1, chunk_bytes=group_bytes)
    bits = -F.col("score") * 3.321928094887362 / F.nullif(F.col("n_bytes"), F.lit(0))
    return found.withColumn("bits_per_byte", bits)
