"""SimHash near-duplicates by the popcounts of fingerprint segments.

A fingerprint of 64 bits is cut into 32 segments of two bits. The popcounts of the segments
are a point on a grid, and the Manhattan distance of two points is at most the Hamming
distance of their fingerprints. Of the two halves of a point, one lies within half of the
distance looked for: each point visits, for both halves, its own grid cell and those one step
away, and points that far apart share a cell. Pairs on a cell are held to the Manhattan
distance of whole points first, then to the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, gather, one_array
from waymark.llm.components import components
from waymark.llm.tables import picked, stored

WORDS = 4
DISTANCE = 4
SEED = 42
#: Bytes of text scanned at once: arrays that fit into the processor's cache.
_SCAN_BYTES = 1 << 18
#: Shingles hashed at once.
_HASHED = 1 << 16
_LANES = np.uint64(0x5555555555555555)
#: For every byte, its bits as eight counters of eight bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _majorities(hashed: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of hashes; runs are not empty and follow each other."""
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    out = np.zeros(len(starts), np.uint64)
    octets = hashed.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").ravel()
        out |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(block: Block, words: int = WORDS) -> np.ndarray:
    """One fingerprint per row, from all its shingles of ``words`` words, repeats included.

    A row with fewer words has its whole sequence as one shingle; one without words gets zero.
    """
    block = block.lowered()
    starts, ends, rows = block.words()
    out = np.zeros(len(block), np.uint64)
    if not len(starts):
        return out
    # words of each row, joined by single spaces
    sizes = ends - starts + 1
    joined = gather(np.append(block.data, np.uint8(32)), starts, sizes)
    stops = np.cumsum(sizes) - 1
    joined[stops] = 32
    starts = stops - sizes + 1
    counts = np.bincount(rows, minlength=len(block))
    filled = np.flatnonzero(counts)
    counts = counts[filled]
    first = np.cumsum(counts) - counts
    shingles = np.maximum(counts - words + 1, 1)
    begin = np.cumsum(shingles) - shingles
    low = np.repeat(first - begin, shingles) + np.arange(shingles.sum())
    high = low + np.repeat(np.minimum(counts, words), shingles) - 1
    data, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashed = np.empty(len(low), np.uint64)
    for at in range(0, len(low), _HASHED):
        some = slice(at, at + _HASHED)
        edges = zip(starts[low[some]].tolist(), stops[high[some]].tolist(), strict=True)
        hashed[some] = np.fromiter((digest(data[a:b], SEED) for a, b in edges), np.uint64)
    out[filled] = _majorities(hashed, begin, shingles)
    return out


def unary(values: np.ndarray) -> np.ndarray:
    """Each segment's popcount as so many set bits: xor and popcount give Manhattan distances."""
    some = (values | (values >> np.uint64(1))) & _LANES
    both = values & (values >> np.uint64(1)) & _LANES
    return some | (both << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are near: the bound by popcounts first, then the exact distance."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= distance
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= distance
    return near


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the given ones, at most one per node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


#: Fingerprints of a bucket that are compared by shifting whole columns.
_SHIFTED = 64
#: Pairs compared at once in larger buckets.
_COMPARED = 1 << 20


def _linked(distance: int):
    """Finds the links within the buckets of one part: u, v as bigints, a forest of them."""

    def link(part: pa.Table) -> pa.Table:
        columns = [one_array(part[c]).to_numpy() for c in ("cell", "block", "asker")]
        values = one_array(part["fp"]).to_numpy().view(np.uint64)
        asks = one_array(part["asks"]).to_numpy(zero_copy_only=False)
        order = np.lexsort((values, *columns[::-1]))
        columns, values, asks = [c[order] for c in columns], values[order], asks[order]
        new = np.ones(len(values), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(values)))
        left = np.repeat(first + sizes, sizes) - np.arange(len(values))
        found_u, found_v = [], []
        small = np.flatnonzero(np.repeat(sizes <= _SHIFTED, sizes))
        for step in range(1, _SHIFTED):
            small = small[left[small] > step]
            if not len(small):
                break
            pair = small[asks[small] | asks[small + step]]
            pair = pair[_near(values[pair], values[pair + step], distance)]
            found_u.append(values[pair])
            found_v.append(values[pair + step])
        for at in np.flatnonzero(sizes > _SHIFTED):
            inside = slice(first[at], first[at] + sizes[at])
            every, asking = values[inside], values[inside][asks[inside]]
            # not all links of a bucket are kept at once, only what connects them
            u, v = every[:0], every[:0]
            rows = max(1, _COMPARED // len(every))
            for low in range(0, len(asking), rows):
                some = np.repeat(asking[low : low + rows], len(every))
                others = np.tile(every, len(asking[low : low + rows]))
                near = np.flatnonzero(_near(some, others, distance))
                u, v = _forest(np.concatenate([u, some[near]]), np.concatenate([v, others[near]]))
            found_u.append(u)
            found_v.append(v)
        none = np.zeros(0, np.uint64)
        u, v = _forest(np.concatenate([none, *found_u]), np.concatenate([none, *found_v]))
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return link


#: SQL: the grid point of a fingerprint, 32 popcounts of two bits, by halves.
_HALVES = "array(fp & 4294967295L, shiftrightunsigned(fp, 32))"
_HOMES = f"transform({_HALVES}, (h, at) -> h - (shiftright(h, 1) & 1431655765L) + at * 4294967296L)"
_LANE = "(shiftright(c, 2 * i) & 3L)"
_VISITED = (
    "concat(array(c), "
    f"transform(filter(sequence(0, 15), i -> {_LANE} < 2), i -> c + shiftleft(1L, 2 * i)), "
    f"transform(filter(sequence(0, 15), i -> {_LANE} > 0), i -> c - shiftleft(1L, 2 * i)))"
)
#: Most cells that a point visits per half.
_VISITS = 33


def _visits(known: DataFrame) -> DataFrame:
    """Every fingerprint on the cells it visits: cell, fp."""
    return known.select(F.explode(F.expr(f"flatten(transform({_HOMES}, c -> {_VISITED}))")).alias("cell"), "fp")


def _crowded(known: DataFrame, bucket_rows: int) -> DataFrame | None:
    """Cells with more than ``bucket_rows`` fingerprints: cell, n, pivot; None without any.

    Such a cell has a home near it that holds a 33rd of them, so only cells next to such homes
    are counted.
    """
    homes = known.select(F.explode(F.expr(_HOMES)).alias("c"))
    heavy = homes.groupBy("c").count().filter(F.col("count") > bucket_rows // _VISITS).select("c")
    heavy = stored(heavy)
    if heavy.isEmpty():
        return None
    around = heavy.select(F.explode(F.expr(_VISITED)).alias("cell")).distinct()
    counted = _visits(known).join(around, "cell", "left_semi").groupBy("cell")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("pivot"))
    return stored(counted.filter(F.col("n") > bucket_rows))


def _bucketed(known: DataFrame, distance: int, bucket_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets of bounded size: cell, block, asker, fp, asks; and links to pivots, if any.

    A crowded cell is searched from its pivot first. Fingerprints near the pivot are connected
    by it; the others ask all fingerprints of the cell, in blocks of askers and of asked ones.
    """
    visits = _visits(known)
    whole = [F.lit(0).alias("block"), F.lit(0).alias("asker")]
    crowded = _crowded(known, bucket_rows)
    if crowded is None:
        return visits.select("cell", *whole, "fp", F.lit(True).alias("asks")), None
    plain = visits.join(crowded, "cell", "left_anti").select("cell", *whole, "fp", F.lit(True).alias("asks"))
    members = visits.join(crowded, "cell").withColumn("apart", F.expr(f"bit_count(fp ^ pivot) > {distance}"))
    members = stored(members)
    askers = members.filter("apart").groupBy("cell").agg(F.count(F.lit(1)).alias("askers"))
    members = members.join(askers, "cell")  # a cell without askers is done
    size = lambda n: f"cast(ceil({n} / {bucket_rows}) as int)"
    mine = lambda n: F.expr(f"cast(pmod(xxhash64(fp), {size(n)}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {size(n)} - 1)"))
    asked = members.select("cell", mine("n").alias("block"), every("askers").alias("asker"), "fp", F.lit(False).alias("asks"))
    asking = members.filter("apart").select("cell", every("n").alias("block"), mine("askers").alias("asker"), "fp", F.lit(True).alias("asks"))
    links = members.filter("not apart and fp <> pivot").select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    return plain.union(asked).union(asking), links


#: Fingerprints of a cell that one bucket may hold.
BUCKET_ROWS = 1 << 14
#: Rows of buckets that one group searches.
PART_ROWS = 200_000


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Fingerprint of every document and the component it belongs to.

    Result: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest id
    reachable by links, its own included). Null, empty and wordless texts have fingerprint
    zero and link like any other; a text of fewer words than a shingle is one shingle.
    Repeated rows are equal texts. A null id is ignored as smallest id; a component of null
    ids has a null one. Extra columns are left out; an empty table gives an empty one.
    ``distance`` can be up to 5.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be between 0 and 5")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("_text"), _SCAN_BYTES):
                made = fingerprints(block, words).view(np.int64)
                ids = batch.column("_id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(made)], ["doc_id", "fp"])

    named = stored(picked(docs, id_col, text_col).mapInArrow(described, "doc_id long, fp long"))
    known = stored(named.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    buckets, links = _bucketed(known.select("fp"), distance, bucket_rows)
    parts = 2 * _VISITS * known.count() // PART_ROWS + 1
    part = F.pmod(F.xxhash64("cell", "block", "asker"), F.lit(parts)).alias("part")
    found = buckets.select("*", part).groupBy("part").applyInArrow(_linked(distance), "u long, v long")
    roots = components(found if links is None else found.union(links))
    owned = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    owned = stored(owned)
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    owned = owned.join(least, "root").select("fp", "component_id")
    return named.join(owned, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
