"""Exact join of documents whose sets of word shingles have a high Jaccard similarity.

1. Documents become sets of 64-bit shingle hashes; equal sets count once.
2. A sketch of fixed size tells rare shingles from frequent ones. Each set puts its rarest
   shingles into an inverted index, as many as any set similar enough must share one of.
3. Sets on a common list meet in buckets of bounded size, first with histograms of their
   hashes, whose distance bounds the sets' distance from below: that splits buckets into
   groups that may link. Groups that repeat are searched once.
4. Each group gets its whole sets. A T-occurrence search with DivideSkip finds the links:
   occurrences on short lists are merged, long lists are probed by binary search for
   candidates only.
5. A longer list is searched from one pivot first, in blocks of bounded size. Sets not
   connected to the pivot afterwards are searched against all of the list, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, mix, one_array, u64
from waymark.llm.components import components
from waymark.llm.tables import BROADCAST_BYTES, picked, probe_sorted, probed, schema, small_batches, sorted_arrays, stored

WORDS = 3
SIMILARITY_PERCENT = 90
#: Buckets of the frequency sketch: 2 MB of counts, whatever the input.
SKETCH_BUCKETS = 1 << 18
#: Longest list on which all sets search all others at once.
BUCKET_SETS = 64
#: Sets and shingles in one block of a longer list. Two blocks meet in a bucket, so larger
#: blocks repeat fewer rows.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 20
#: Rows of buckets, and bytes of their histograms, that one task narrows at once.
_PART_ROWS = 50_000
_PART_BYTES = 16 << 20
#: Bytes of text scanned at once: arrays that fit into the processor's cache.
_SCAN_BYTES = 1 << 18
#: Sets a task remembers, to put each into the index once.
_SEEN_SETS = 1 << 19
_DESCRIBED = ["doc_id", "set_id", "n_shingles", "histogram", "bucket", "n"]


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block: row and hash, sorted by row, then hash.

    A row with some words, but fewer than ``words``, has its whole sequence as one shingle.
    """
    block = block.lowered()
    starts, ends, rows = block.words()
    word = block.hashes(starts, ends)
    counts = np.bincount(rows, minlength=len(block))
    hashed = word.copy() if len(word) else np.zeros(0, np.uint64)
    for step in range(1, words):
        hashed = mix(hashed[: len(word) - step] * u64(0x9E3779B97F4A7C15) + word[step:])
    fits = rows[: len(hashed)] == rows[words - 1 :] if len(hashed) else np.zeros(0, bool)
    parts, owners = [hashed[fits]], [rows[: len(hashed)][fits]]
    first = np.cumsum(counts) - counts
    for row in np.flatnonzero((counts > 0) & (counts < words)):
        value = u64(int(counts[row]) * 0xD6E8FEB86659FD93)
        for w in word[first[row] : first[row] + counts[row]]:
            value = mix(np.array([value ^ w]))[0]
        parts.append(np.array([value]))
        owners.append(np.array([row]))
    rows, hashed = np.concatenate(owners), np.concatenate(parts)
    order = np.lexsort((hashed, rows))
    rows, hashed = rows[order], hashed[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])
    return rows[new], hashed[new]


def _set_ids(rows: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit number per set of a block, from all its sorted shingles; 0 for empty ones."""
    edges = np.searchsorted(rows, np.arange(n + 1))
    total = np.zeros(len(rows) + 1, np.uint64)
    np.cumsum(mix(hashed + u64(0x51ED270B)), out=total[1:])
    out = total[edges[1:]] - total[edges[:-1]]
    sizes = np.diff(edges).astype(np.uint64)
    return np.where(sizes > 0, mix(out ^ (sizes << u64(48))), u64(0))


def _histograms(rows: np.ndarray, hashed: np.ndarray, n: int) -> list[bytes]:
    """For each set, counts of hashes in a power of two of equal ranges, as many as its size.

    A count takes two bits and ends at three: that can only bring two histograms closer.
    """
    sizes = np.bincount(rows, minlength=n)
    bits = np.clip(np.log2(np.maximum(sizes, 1)).astype(np.int64), 4, 18)
    ends = np.cumsum(1 << bits)
    base = ends - (1 << bits)
    at = base[rows] + (hashed >> (u64(64) - bits[rows].astype(np.uint64))).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=ends[-1] if n else 0), 3)
    packed = (counts.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8).tobytes()
    return [packed[a // 4 : b // 4] for a, b in zip(base.tolist(), ends.tolist(), strict=True)]


_UNPACKED = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int8)


def may_link(sizes: np.ndarray, histograms: list[np.ndarray], u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (u, v) of sets are not ruled out by their sizes and histograms."""
    small, large = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
    fits = np.flatnonzero(100 * small >= percent * large)
    widths = np.array([len(h) for h in histograms])
    out = np.zeros(len(u), bool)
    shape = widths[u[fits]] * (1 << 20) + widths[v[fits]]
    for kind in np.unique(shape):
        pairs = fits[shape == kind]
        width = int(min(kind >> 20, kind & ((1 << 20) - 1)))
        for at in range(0, len(pairs), max(1, (1 << 20) // width)):
            some = pairs[at : at + max(1, (1 << 20) // width)]
            a, b = (np.stack([histograms[i] for i in side[some]]) for side in (u, v))
            if a.shape != b.shape:
                a, b = (x.reshape(len(some), width, -1).sum(axis=2, dtype=np.int16) for x in (a, b))
            distance = np.abs(a - b).sum(axis=1, dtype=np.int64)
            out[some] = distance * (100 + percent) <= (sizes[u[some]] + sizes[v[some]]) * (100 - percent)
    return out


def _narrowed(percent: int):
    """Splits buckets into groups that may link two components: group, set_id, asks.

    Gets the buckets of a part and, once each, the sets in them.
    """

    def narrow(part: pa.Table, known: pa.Table) -> pa.Table:
        names = one_array(known["name"]).to_numpy()
        by = np.argsort(names)
        bucket, ids = (one_array(part[c]).to_numpy() for c in ("bucket", "set_id"))
        asks = one_array(part["asks"]).to_numpy(zero_copy_only=False)
        # one row per bucket and set; those who ask come first
        order = np.lexsort((~asks, ids, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[new]
        order = order[np.lexsort((~asks[order], bucket[order]))]
        bucket, ids, asks = bucket[order], ids[order], asks[order]
        at = by[np.searchsorted(names[by], ids)]
        roots = one_array(known["root"]).to_numpy()[at]
        sizes = one_array(known["n_shingles"]).to_numpy()[at]
        unpacked = [_UNPACKED[np.frombuffer(b.as_buffer(), np.uint8)].ravel() for b in one_array(known["histogram"])]
        histograms = [unpacked[i] for i in at]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(edges[1:], len(bucket))
        later = np.repeat(ends, ends - edges) - np.arange(len(bucket)) - 1
        later[~asks] = 0
        parent = np.arange(len(bucket))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        touched = np.zeros(len(bucket), bool)
        upto = np.cumsum(later)
        low = 0
        while low < len(bucket):
            # a slice of rows whose pairs fit into memory
            base = upto[low] - later[low]
            high = max(low + 1, int(np.searchsorted(upto, base + (1 << 20), "right")))
            n = later[low:high]
            u = np.repeat(np.arange(low, high), n)
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            cross = roots[u] != roots[v]
            u, v = u[cross], v[cross]
            good = may_link(sizes, histograms, u, v, percent)
            for a, b in zip(u[good].tolist(), v[good].tolist(), strict=True):
                touched[a] = touched[b] = True
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            low = high
        some = np.flatnonzero(touched)
        tops = np.array([root(i) for i in some.tolist()], np.int64)
        group = mix(ids[tops].view(np.uint64) ^ mix(bucket[tops].view(np.uint64))).view(np.int64)
        return pa.table({"group": pa.array(group, pa.int64()), "set_id": pa.array(ids[some], pa.int64()), "asks": pa.array(asks[some], pa.bool_())})

    return narrow


def _described(words: int):
    """Per document id, set id, size and histogram; and once per task the sketch's counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_BUCKETS, np.int64)
        for batch in batches:
            sets, sizes, histograms = [], [], []
            for block in blocks(batch["_text"], _SCAN_BYTES):
                rows, hashed = shingle_sets(block, words)
                histograms += _histograms(rows, hashed, len(block))
                np.add.at(sketch, (hashed % u64(SKETCH_BUCKETS)).astype(np.int64), 1)
                sets.append(_set_ids(rows, hashed, len(block)))
                sizes.append(np.bincount(rows, minlength=len(block)))
            n = batch.num_rows
            if n:
                sets, sizes = np.concatenate(sets).view(np.int64), np.concatenate(sizes).astype(np.int64)
                columns = [one_array(batch["_id"]), pa.array(sets), pa.array(sizes), pa.array(histograms, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _DESCRIBED)
        some = np.flatnonzero(sketch)
        empty = pa.nulls(len(some), pa.int64())
        columns = [empty, empty, empty, pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(sketch[some])]
        yield pa.RecordBatch.from_arrays(columns, _DESCRIBED)

    return describe


def _indexed(words: int, percent: int, sketch):
    """Rarest shingles of each set: token, set_id, n."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > _SEEN_SETS:
                seen.clear()
            for block in blocks(batch["_text"], _SCAN_BYTES):
                rows, hashed = shingle_sets(block, words)
                ids = _set_ids(rows, hashed, len(block))
                new = np.zeros(len(block), bool)
                for i, x in enumerate(ids.tolist()):
                    new[i] = x != 0 and x not in seen
                    seen.add(x)
                rows, hashed = rows[new[rows]], hashed[new[rows]]
                sizes = np.bincount(rows, minlength=len(block))
                keep = sizes - -(-percent * sizes // 100) + 1
                order = np.lexsort((hashed, counts[(hashed % u64(SKETCH_BUCKETS)).astype(np.int64)], rows))
                rows, hashed = rows[order], hashed[order]
                rank = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
                first = rank < keep[rows]
                rows = rows[first]
                yield pa.record_batch(
                    {
                        "token": pa.array(hashed[first].view(np.int64)),
                        "set_id": pa.array(ids[rows].view(np.int64)),
                        "size": pa.array(sizes[rows], pa.int32()),
                    }
                )

    return index


def divide_skip(query: int, sets: list[np.ndarray], index: tuple, percent: int) -> np.ndarray:
    """Numbers of the sets after ``query`` in a bucket that link with it.

    ``index`` has the sizes of the sets, the bucket's distinct shingles, where each one's list
    starts, the lists (numbers of sets, ascending) one after the other, and the same as
    (shingle, set) keys.
    """
    sizes, tokens, starts, members, keys = index
    mine = sets[query]
    lists = np.searchsorted(tokens, mine)
    low, high = starts[lists], starts[lists + 1]
    least = -(-percent * len(mine) // 100)
    order = np.argsort(high - low, kind="stable")
    longest = int(high[order[-1]] - low[order[-1]])
    aside = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
    short, long = order[: len(order) - aside], order[len(order) - aside :]
    lengths = high[short] - low[short]
    at = np.repeat(low[short] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    found = np.bincount(members[at], minlength=len(sets))
    candidates = np.flatnonzero(found >= least - aside)
    candidates = candidates[candidates > query]
    if not len(candidates):
        return candidates
    if len(long):
        # the keys of all lists ascend, so one binary search serves every long list
        wanted = lists[long][:, None] * len(sets) + candidates[None, :]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found[candidates] += (keys[place] == wanted).sum(axis=0)
    common = found[candidates]
    union = len(mine) + sizes[candidates] - common
    return candidates[100 * common >= percent * union]


def bucket_links(ids: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list, list]:
    """Links in a bucket between sets of which one at least asks; only those that connect more."""
    # those who ask come first, so that each pair is met once
    order = np.argsort(~asks, kind="stable")
    ids, sets, n_asks = ids[order], [sets[i] for i in order], int(asks.sum())
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.lexsort((owner, every))
    tokens, starts = np.unique(every[by], return_index=True)
    starts, members = np.append(starts, len(every)), owner[by]
    keys = np.repeat(np.arange(len(tokens)), np.diff(starts)) * len(sets) + members
    index = sizes, tokens, starts, members, keys
    root = np.arange(len(sets))
    u, v = [], []
    for query in range(n_asks):
        for other in divide_skip(query, sets, index, percent).tolist():
            a, b = root[query], root[other]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                u.append(int(ids[query]))
                v.append(int(ids[other]))
    return u, v


def _searched(percent: int):
    def search(group: pa.Table) -> pa.Table:
        ids = one_array(group["set_id"]).to_numpy()
        asks = one_array(group["asks"]).to_numpy(zero_copy_only=False)
        order = np.lexsort((~asks, ids))
        keep = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        blobs = group["shingles"]
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in keep]
        u, v = bucket_links(ids[keep], asks[keep], sets, percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return search


def _search(buckets: DataFrame, docs: DataFrame, known: DataFrame, words: int, percent: int, limit: int) -> DataFrame:
    """Links found in buckets (bucket, set_id, asks) between sets of different roots.

    ``known`` has set_id, root, n_shingles, histogram and doc_id of every set.
    """
    met = stored(buckets.select(F.xxhash64("bucket").alias("bucket"), "set_id", "asks").distinct())
    known = known.withColumn("bytes", F.octet_length("histogram"))
    weights = met.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).join(known.select("set_id", "bytes"), "set_id")
    rows, size = weights.agg(F.sum("n"), F.sum(F.col("n") * F.col("bytes"))).first()
    parts = max(-(-(rows or 0) // _PART_ROWS), -(-(size or 0) // _PART_BYTES), 1)
    met = met.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)))
    # histograms are large: each goes to a part once, whatever the buckets it is in there
    sets = met.select(F.col("part").alias("at"), F.col("set_id").alias("name")).distinct()
    sets = sets.join(known.select(F.col("set_id").alias("name"), "root", "n_shingles", "histogram"), "name")
    met = met.groupBy("part").cogroup(sets.groupBy("at"))
    groups = stored(met.applyInArrow(_narrowed(percent), "group long, set_id long, asks boolean"))
    marks = groups.groupBy("group").agg(
        F.count(F.lit(1)).alias("k"), F.min("set_id").alias("a"), F.expr("bit_xor(xxhash64(set_id, asks))").alias("x"),
    )
    single = marks.groupBy("k", "a", "x").agg(F.min("group").alias("group")).select("group")
    groups = stored(groups.join(single, "group"))
    wanted = stored(groups.select("set_id").distinct().join(known.select("set_id", "doc_id"), "set_id"))
    sets = _sets_of(docs, wanted, words, limit)
    met = groups.join(sets, "set_id")
    return stored(met.groupBy("group").applyInArrow(_searched(percent), "u long, v long"))


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int, limit: int) -> DataFrame:
    """Whole sets of the wanted sets (set_id, doc_id): set_id, shingles (sorted hashes)."""
    size, unnamed = wanted.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    if not unnamed and 8 * size <= limit:
        docs = docs.join(F.broadcast(wanted.select(F.col("doc_id").alias("_id"))), "_id", "left_semi")
    index, shards = sorted_arrays(wanted.select(F.col("set_id").alias("key"), F.lit(1.0).alias("value")))

    def keys_of(table: pa.Table) -> np.ndarray:
        found = [_set_ids(*shingle_sets(b, words), len(b)) for b in blocks(table["_text"], _SCAN_BYTES)]
        return np.concatenate(found or [np.zeros(0, np.uint64)])[:, None]

    def finish(table: pa.Table, find) -> pa.Table:
        done: set[int] = set()
        ids, blobs = [], []
        for block in blocks(table["_text"], _SCAN_BYTES):
            rows, hashed = shingle_sets(block, words)
            names = _set_ids(rows, hashed, len(block))
            edges = np.searchsorted(rows, np.arange(len(block) + 1))
            for i in np.flatnonzero(~np.isnan(find(names[:, None]))):
                if int(names[i]) not in done:
                    done.add(int(names[i]))
                    ids.append(names[i])
                    blobs.append(hashed[edges[i] : edges[i + 1]].tobytes())
        ids = np.array(ids, np.uint64).view(np.int64)
        return pa.table({"set_id": pa.array(ids, pa.int64()), "shingles": pa.array(blobs, pa.binary())})

    made = schema("set_id bigint", "shingles binary")
    found = probed(docs, index, shards, keys_of, probe_sorted, np.nan, finish, made, limit=limit)
    return found.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def _blocks(n: str, mass: str, block_sets: int) -> str:
    """How many blocks hold ``n`` sets with ``mass`` shingles altogether, as SQL."""
    return f"cast(ceil(greatest({n} / {block_sets}, {mass} / {BLOCK_SHINGLES})) as bigint)"


def _number(name: str, n: str):
    """The block of a set, out of ``n``."""
    return F.expr(f"pmod(xxhash64(set_id), {n})").alias(name)


def _every(name: str, n: str):
    return F.explode(F.expr(f"sequence(0L, {n} - 1)")).alias(name)


def _buckets(lists: DataFrame, size: int, block_sets: int) -> DataFrame:
    """Short lists as buckets where all ask; longer ones in blocks where only the pivot asks."""
    bucket = F.struct("token", "block").alias("bucket")
    n = _blocks("k", "mass", block_sets)
    block = F.when(F.col("k") <= size, F.lit(0).cast("bigint")).otherwise(_number("block", n)).alias("block")
    members = lists.select("token", block, "set_id", (F.col("k") <= size).alias("asks"))
    heads = lists.filter((F.col("k") > size) & (F.col("set_id") == F.col("pivot")))
    heads = heads.select("token", _every("block", n), "set_id", F.lit(True).alias("asks"))
    return members.union(heads).select(bucket, "set_id", "asks")


def _rest(lists: DataFrame, size: int, block_sets: int) -> DataFrame:
    """Buckets for the lists (token, set_id, size, k, mass, pivot, root) with several roots.

    On a list longer than a bucket, sets apart from the pivot's component ask all others.
    """
    mixed = lists.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    lists = stored(lists.join(mixed.select("token"), "token"))
    main = lists.filter("set_id = pivot").select("token", F.col("root").alias("main"))
    lists = lists.join(main, "token").withColumn("apart", (F.col("k") <= size) | (F.col("root") != F.col("main")))
    counts = lists.filter("apart").groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("m_mass"))
    lists = stored(lists.join(counts, "token"))
    bucket = F.struct("token", "block", "asker").alias("bucket")
    n = f"if(k <= {size}, 1L, {_blocks('k', 'mass', block_sets)})"
    m = f"if(k <= {size}, 1L, {_blocks('m', 'm_mass', block_sets)})"
    asking = lists.filter("apart").select("token", _every("block", n), _number("asker", m), "set_id", F.lit(True).alias("asks"))
    asked = lists.filter("not apart").select("token", _number("block", n), _every("asker", m), "set_id", F.lit(False).alias("asks"))
    # sets apart also meet each other: as askers of one block and as asked of every block
    among = lists.filter((F.col("k") > size) & F.col("apart"))
    among = among.select("token", _number("block", n), _every("asker", m), "set_id", F.lit(False).alias("asks"))
    return asking.union(asked).union(among).select(bucket, "set_id", "asks")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = SIMILARITY_PERCENT,
    bucket_sets: int = BUCKET_SETS,
    block_sets: int = BLOCK_SETS,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Size of every document's shingle set and the component it belongs to.

    Result: doc_id, n_shingles, component_id (the smallest id reachable by links, its own
    included). Null, empty and wordless texts have no shingles and link with nothing; a text of
    fewer words than a shingle has one, its sequence of words. Repeated rows are equal texts. A
    null id is ignored as smallest id; a component of null ids has a null one. Extra columns
    are left out.
    """
    spark = docs.sparkSession
    docs = picked(docs, id_col, text_col)
    made = "doc_id long, set_id long, n_shingles long, histogram binary, bucket int, n long"
    with small_batches(spark):
        described = stored(docs.mapInArrow(_described(words), made))
    sketch = described.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH_BUCKETS, np.int64)
    counts[sketch["bucket"].to_numpy()] = sketch["n"].to_numpy()
    held = spark.sparkContext.broadcast(counts)
    named = described.filter("bucket is null").select("doc_id", "set_id", "n_shingles")
    index = docs.select("_text").mapInArrow(_indexed(words, percent, held), "token long, set_id long, size int")
    with small_batches(spark):
        index = stored(index)
    # copies of one set may count more than once here; lists of one set go below
    shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = index.join(shared.select("token"), "token").distinct()
    # two sets of too different sizes are no list; of tokens with equal lists, one is enough
    sums = lists.groupBy("token").agg(
        F.count(F.lit(1)).alias("k"), F.min("set_id").alias("pivot"), F.expr("bit_xor(xxhash64(set_id))").alias("x"),
        F.min("size").alias("low"), F.max("size").alias("high"), F.sum("size").alias("mass"),
    )
    sums = sums.filter(f"k > 2 or k = 2 and 100 * low >= {percent} * high")
    sums = sums.groupBy("k", "pivot", "x", "mass").agg(F.min("token").alias("token")).drop("x")
    lists = stored(lists.join(sums, "token"))
    known = described.filter("n_shingles > 0").groupBy("set_id").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("histogram").alias("histogram"), F.min("doc_id").alias("doc_id")
    )
    known = stored(known.join(lists.select("set_id").distinct(), "set_id", "left_semi"))
    # first each set on one of its lists, the same for sets that share their least token
    own = lists.groupBy("set_id").agg(F.min("token").alias("token"))
    own = lists.join(own, ["set_id", "token"]).select("set_id", "token", "size")
    again = own.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("set_id").alias("pivot"), F.sum("size").alias("mass"))
    first = _buckets(stored(own.drop("size").join(again.filter("k > 1"), "token")), bucket_sets, block_sets)
    links = _search(first, docs, known.withColumn("root", F.col("set_id")), words, percent, limit)
    roots = components(links)
    # then all lists on which more than one component is left
    known = known.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    known = stored(known.withColumn("root", F.coalesce("root", "set_id")))
    rest = _rest(lists.join(known.select("set_id", "root"), "set_id"), bucket_sets, block_sets)
    links = stored(links.union(_search(rest, docs, known, words, percent, limit)))
    roots = components(links)
    named = named.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = stored(named.withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id"))))
    least = named.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


