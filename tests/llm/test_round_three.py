"""SimHash near-duplicates, centroid clustering and collocations against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import collocations as phrases
from waymark.llm.blocks import whole
from waymark.llm.centroids import clusters
from waymark.llm.kneser_ney import quality
from waymark.llm.simhash import fingerprints, near_duplicates, unary

SMALL = "/root/testdata/sf0.001"

_LONG = " ".join(f"w{i % 977}" for i in range(60_000))
_ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, _LONG), (6, _LONG + " end"), (7, "ONE  two"),
    (8, "Ünï ćode 中文 🙂 ‑ text\n\n"), (9, "x" * 300), (10, "a\0b c\x85d e f g"), (None, "one two"), (None, None), (4, "one two"),
]


def documents(spark, rows, lang="en"):
    made = "doc_id long, text string, lang string, fp long, cell int, `a.b` int, f int, part int"
    return spark.createDataFrame([(d, t, lang, 1, 2, 3, 4, 5) for d, t in rows], made)


def plain_fingerprint(text):
    words = brute.WORD.findall(brute.lowered(text or ""))
    size = min(4, len(words))
    hashed = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]), 42) for k in range(len(words) - size + 1)] if size else []
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def plain_components(prints, ids, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            root[find(j)] = find(i)
    groups = defaultdict(list)
    for i, doc in enumerate(ids):
        groups[find(i)].append(doc)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprints_are_those_of_the_jvm_hash(spark):
    texts = [t for _, t in _ODD]
    import pyarrow as pa

    assert fingerprints(whole(pa.array(texts, pa.string()))).tolist() == [plain_fingerprint(t) for t in texts]
    row = spark.range(1).select(F.xxhash64(F.lit("one two three four")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("one two three four", 42)


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 1000), np.uint64)
    counts = lambda x: np.bitwise_count((x[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (np.bitwise_count(unary(a) ^ unary(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 40}, {"distance": 5}, {"distance": 1}, {"distance": 0}])
def test_near_duplicates(spark, options):
    rng = random.Random(5)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    words = [f"w{rng.random()}" for _ in range(400)]
    for i in range(150):
        copy = list(words)
        for at in rng.sample(range(400), rng.choice([0, 1, 2, 4, 8])):
            copy[at] = f"x{rng.random()}"
        rows.append((50_000 + i, " ".join(copy)))
    rows += [(None if d is None else d + 60_000, t) for d, t in _ODD]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints, [d for d, _ in rows], options.get("distance", 4))
    found = near_duplicates(documents(spark, rows), **options).collect()
    assert Counter(map(tuple, found)) == Counter((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want, strict=True))


def test_near_duplicates_of_nothing(spark):
    table = documents(spark, _ODD)
    assert near_duplicates(table.filter("false")).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(table, distance=6)


def plain_clusters(rows, rounds, count=8):
    vectors = []
    for vec, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            made = [math.floor(v * 1024) for v in x]
            if sum(v * v for v in made) < 2**60:
                vectors.append((vec, made))
    named = [(hashlib.sha256(f"3:{vec}".encode()).hexdigest(), x) for vec, x in vectors if vec is not None]
    now = [x for _, x in sorted(named)[:count]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    place = lambda x: min((square(x, c), k) for k, c in enumerate(now))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, x in vectors:
            held[place(x)[1]].append(x)
        now = [[sum(column) // len(held[k]) for column in zip(*held[k], strict=True)] if held[k] else c for k, c in enumerate(now)]
    placed = [(vec, *place(x)) for vec, x in vectors]
    total = Counter()
    for _, d, k in placed:
        total[k] += d
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return Counter((vec, k, d, total[k], sum(total.values()), sha(now[k])) for vec, d, k in placed)


_VECTORS = "vec_id long, embedding array<double>, x int, cluster string, `a.b` int"


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters(spark, rounds):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [v + rng.gauss(0, 0.3) for v in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(150)]  # one very common vector
    rows += [rows[3], rows[3], (None, rows[5][1]), (900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65)]
    rows += [(904, [0.0] * 63 + [None]), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [1e300] * 64), (908, [3e5] * 64)]
    table = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], _VECTORS)
    assert Counter(map(tuple, clusters(table, rounds=rounds).collect())) == plain_clusters(rows, rounds)


def test_clusters_of_few_rows(spark):
    empty = spark.createDataFrame([], _VECTORS)
    assert clusters(empty).collect() == []
    two = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    table = spark.createDataFrame(two, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, clusters(table).collect())) == plain_clusters(two, 10)
    assert clusters(table.withColumn("vec_id", F.lit(None).cast("long"))).collect() == []


def plain_collocations(rows, threshold, most, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, most + 1):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        grams = {p: f for p, f in found.items() if f >= threshold and len(p) > 1}
        inside = defaultdict(int)
        for p, f in grams.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inside[p[k : k + size]] = max(inside[p[k : k + size]], f)
        scored = []
        for p, a in grams.items():
            if 100 * inside[p] >= 100 * a:
                continue
            cuts = [(1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("options", [(3, 5, 2000), (2, 3, 10), (5, 2, 50)])
def test_collocations(spark, options, monkeypatch):
    # many partitions and full filters give the same rows; the workers get these by closure or argument
    monkeypatch.setattr(phrases, "PART_MASS", 500)
    monkeypatch.setattr(phrases, "MAX_FILTER_BITS", 15)
    threshold, most, top = options
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").limit(60)
    rows = [tuple(r) for r in table.collect()]
    rows += [("en", t) for _, t in _ODD] + [(None, "a b a b a b. a\tb  a!b,c d;c d c d"), ("und", "A B a b"), (None, None)] * 3
    made = "lang string, text string, n int, f int, phrase string, `a.b` int"
    frame = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in rows], made)
    found = phrases.collocations(frame, threshold=threshold, most_words=most, top=top).collect()
    assert sorted(map(tuple, found)) == plain_collocations(rows, threshold, most, top)


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(frame).collect() == []


def test_summaries_keep_frequent_ones():
    rng = np.random.default_rng(2)
    for _ in range(50):
        threshold = int(rng.integers(2, 20))
        parts = [np.unique(rng.zipf(1.3, 2000) % 5000, return_counts=True) for _ in range(8)]
        mass = sum(int(c.sum()) for _, c in parts)
        capacity = mass // threshold + 1
        held = Counter()
        for keys, counts in parts:
            left, _ = phrases.reduced(counts, capacity)
            both = held + Counter(dict(zip(keys.tolist(), left.tolist(), strict=True)))
            left, _ = phrases.reduced(np.array(list(both.values())), capacity)
            held = Counter({k: c for k, c in zip(both, left.tolist(), strict=True) if c > 0})
            assert len(held) <= capacity
        exact = Counter()
        for keys, counts in parts:
            exact.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        assert {k for k, c in exact.items() if c >= threshold} <= set(held)


def test_scores_pass_64_bits(spark):
    wide = lambda c: f"cast({c} as decimal(19,0))"
    big = spark.range(1).selectExpr("10000000000000L a", "9000000000000000L n", "3000000000L l", "70000000000000L r")
    score = big.selectExpr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')}) s").first().s
    assert score == 1000 * 10**13 * 9 * 10**15 // (3 * 10**9 * 7 * 10**13)


def test_quality_of_empty_texts_beside_prose(spark):
    prose = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank today"
    rows = [(1, prose), (2, ""), (3, None), (4, prose + " again")]
    found = {r.doc_id: r for r in quality(documents(spark, rows)).collect()}
    assert [found[d].base_failed for d in (1, 2, 3, 4)] == [False, True, True, False]
    assert not found[2].kept and not found[3].kept and found[2].n_words == found[3].n_words == 0
