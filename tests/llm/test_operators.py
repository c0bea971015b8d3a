"""Operators against plain versions, over whole small tables and over odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import queries
from waymark.llm.bpe import encoded
from waymark.llm.bwt import drop_repeated_bytes
from waymark.llm.context_tree import scores
from waymark.llm.decontaminate import leaks, without_leaks
from waymark.llm.jaccard import similar_documents
from waymark.llm.kneser_ney import quality
from waymark.llm.licenses import PHRASES, licenses
from waymark.llm.line_dedup import drop_shared_lines
from waymark.llm.secrets import secrets
from waymark.llm.surrogates import entities, pseudonymised

SMALL = "/root/testdata/sf0.001"

_LONG = " ".join(f"w{i % 977}" for i in range(60_000))
_LINE = "This line stands in many documents."
_ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, _LONG), (6, _LONG + " end"),
    (7, f"{_LINE}\nseven"), (8, f"  {_LINE.upper()} \neight"), (9, f"{_LINE}\nnine\n{_LINE}"),
    (10, "Ünï ćode 中文 🙂 ‑ text\n\n"), (11, "MIT license, under the mit  License."), (12, "x" * 300), (13, "y" + "x" * 300),
    (14, "Anna Weber wrote to anna.weber@example.com from 10.1.2.3; Anna Weber again."),
]


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def frame(spark, rows):
    """Documents with further columns, whose names operators use inside."""
    made = "doc_id long, text string, lang string, source string, _id string, _text int, row int, `a.b` int, key int, shard int"
    return spark.createDataFrame([(d, t, "en", "web", "_", 1, 2, 3, 4, 5) for d, t in rows], made)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, _ODD).cache()


@pytest.fixture(scope="module")
def messy(spark):
    """Repeated rows, a null id twice, null everywhere."""
    again = frame(spark, [*_ODD, (4, "one two"), (7, _ODD[6][1]), (None, "one two"), (None, None)])
    return again.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


OPERATORS = {
    "quality": lambda d: quality(d, keep_rows=True),
    "lines": lambda d: drop_shared_lines(d, keep_rows=True),
    "secrets": secrets,
    "licenses": licenses,
    "tree": scores,
    "similar": similar_documents,
    "bytes": drop_repeated_bytes,
    "surrogates": lambda d: pseudonymised(d, b"key", keep_rows=True),
    "bpe": lambda d: encoded(d, keep_rows=True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_and_messy_tables(messy, empty, name):
    assert OPERATORS[name](empty).collect() == []
    found = OPERATORS[name](messy).collect()
    if name != "secrets":
        assert len(found) == messy.count()


def test_quality(spark, rows, odd):
    for data, table in ((rows, frame(spark, rows)), (_ODD, odd)):
        found = {r.doc_id: r for r in quality(table).collect()}
        for doc, text in data:
            r = found[doc]
            n, *_, repeat = want = brute.base_quality(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
            assert not (r.base_failed and r.kept)


def test_quality_rejects_noise_and_keeps_prose(spark, rows):
    rng = random.Random(1)
    letters = [chr(c) for c in range(33, 127)]
    noise = [(10_000 + i, " ".join("".join(rng.choices(letters, k=7)) for _ in range(80))) for i in range(5)]
    found = {r.doc_id: r for r in quality(frame(spark, rows + noise)).collect()}
    assert not any(found[doc].kept for doc, _ in noise)
    passed = [found[doc].kept for doc, _ in rows if not found[doc].base_failed]
    assert sum(passed) >= 0.9 * len(passed)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_shared_lines(odd, limit):
    found = drop_shared_lines(odd, limit=limit).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == brute.shared_lines(_ODD)


def test_licenses(spark, rows, odd):
    for data, table in ((rows, frame(spark, rows)), (_ODD, odd)):
        found = {r.doc_id: r for r in licenses(table).collect()}
        for doc, text in data:
            r = found[doc]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(text, PHRASES)
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(spark):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    table = frame(spark, [(1, "code\n" + notice + "\ncode"), (2, notice[:60]), (3, "nothing here")])
    assert {r.doc_id: r.labels for r in licenses(table).collect()} == {1: "bsd", 2: "", 3: ""}


def test_license_blocks_cross_lines(spark):
    words = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ).split()
    wrapped = "\n".join("// " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    apart = ("\n\n" + "filler " * 40).join(words)
    rows = [(1, wrapped), (2, "x " * 500 + wrapped + " y" * 500), (3, apart), (4, None)]
    assert {r.doc_id: r.labels for r in licenses(frame(spark, rows)).collect()} == {1: "mit", 2: "mit", 3: "", 4: ""}
    own = spark.createDataFrame([("house", "the owls watch the old river bank"), ("none", None), (None, "x")], "label string, text string")
    found = licenses(frame(spark, [(1, "see how\nThe owls watch\nthe old River; bank"), (2, "the old bank")]), templates=own).collect()
    assert {r.doc_id: (r.labels, r.score) for r in found} == {1: ("house", 1.0), 2: ("", 0.0)}
    assert {r.labels for r in licenses(frame(spark, rows), templates=own.filter("false")).collect()} == {""}


@pytest.mark.parametrize("depth", [2, 4])
def test_context_tree(spark, rows, depth):
    data = [(doc, text[:300]) for doc, text in rows[:12]] + [(900, None), (901, ""), (902, "é"), (903, "\0\0")]
    found = {r.doc_id: r for r in scores(frame(spark, data), depth=depth, group_bytes=200).collect()}
    base, tree = brute.base_scores(data), brute.context_tree_score(data, depth)
    assert found[900].score == found[901].score < 0
    for doc, _ in data:
        r = found[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == base[doc][:4]
        assert r.base_score == pytest.approx(base[doc][4], rel=1e-9)
        assert r.score == pytest.approx(tree[doc], rel=1e-6, abs=1e-9)


def test_context_tree_beats_words(spark, rows):
    found = scores(frame(spark, rows)).filter("held_out and n_tokens > 20").agg(F.avg("bits_per_byte")).first()[0]
    assert found < 4


@pytest.mark.parametrize("options", [{}, {"bucket_sets": 3, "block_sets": 5}])
def test_similar_documents(spark, rows, options):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    near = []
    for i in range(25):
        copy = list(words)
        for at in rng.sample(range(200), rng.choice([0, 1, 2, 3])):
            copy[at] = f"x{rng.random()}"
        near.append((50_000 + i, " ".join(copy)))
    data = rows + near + [(doc + 60_000, text) for doc, text in _ODD]
    found = similar_documents(frame(spark, data), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.similar(data)


@pytest.mark.parametrize("options", [{}, {"limit": 0, "shard_bytes": 5000}])
def test_repeated_bytes(spark, rows, options):
    data = rows[:80] + [(doc + 60_000, text if doc not in (5, 6) else text[-3000:]) for doc, text in _ODD if text != ""]
    found = drop_repeated_bytes(frame(spark, data), **options).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.repeated_bytes(data)


def test_leaks(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    data = rows[:60]
    rng = random.Random(3)
    for i, (_, text) in enumerate(items[:6]):
        words = (text or "").split()
        if len(words) >= 20:
            words[rng.randrange(len(words))] = "other"
            data.append((70_000 + i, "before it " + " ".join(words) + " after it"))
    table = frame(spark, data)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(table, bench).collect()}
    want = brute.leaks(data, items)
    assert found <= want and len(found) >= 0.95 * len(want)
    kept = {r.doc_id for r in without_leaks(table, bench).collect()}
    assert kept == {doc for doc, _ in data} - {doc for doc, _ in found}
    assert leaks(table, bench.filter("false")).collect() == leaks(table.filter("false"), bench).collect() == []


def test_byte_pairs(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = rows + [(doc + 60_000, text) for doc, text in _ODD]
    for r in encoded(frame(spark, data)).collect():
        text = dict(data)[r.doc_id] or ""
        assert list(r.ids) == plain.encode_ordinary(text)
        assert r.decoded_sha256 == brute.sha(text.encode())


def test_surrogates(odd):
    first, again = (
        {r.doc_id: r for r in pseudonymised(odd, key).collect()} for key in (b"key", b"other")
    )
    text = dict(_ODD)[14]
    made = first[14].replaced_text
    kinds = lambda t: [kind for _, _, kind, _ in entities(t)]
    names = [value for _, _, kind, value in entities(made) if kind == "person"]
    assert kinds(made) == kinds(text) and names[0] == names[-1]
    assert "anna.weber@example.com" not in made and "10.1.2.3" not in made and made != again[14].replaced_text
    assert first[4].replaced_text == "one two" and first[1].replaced_text is None


def test_surrogates_stay_distinct(spark):
    data = [(i, f"mail user{i}@example.com now") for i in range(500)]
    found = [r.replaced_text for r in pseudonymised(frame(spark, data), b"key").collect()]
    assert len(set(found)) == 500


def test_secrets(spark):
    rng = random.Random(4)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    data = [(i, f"config api_key = {token()} for the service\nsee page {i}00.12.5 of the manual") for i in range(60)]
    found = secrets(frame(spark, data)).filter("kept").collect()
    assert {r.doc_id for r in found} == set(range(60)) and {r.length for r in found} == {40}


def test_every_run_of_a_word_is_a_candidate(spark):
    one, two, letters = "0a" * 20, "1b" * 20, "qwertzuiopasdfghjklyxcvbnmqwertzuiopasdf"
    url = f"https://example.com/longpathwithoutdigits?token={one}"
    data = [(1, f"a={one},b={two}"), (2, url), (3, f"key = {letters}"), (4, "password=hunter2hunter2"), (5, "x" * 11)]
    docs = frame(spark, data).select("doc_id", "text", "source")
    found = lambda **options: {(r.doc_id, r.candidate_sha256) for r in secrets(docs, **options).collect()}
    want = {(1, one), (1, two), (2, one), (3, letters)}
    assert {(d, brute.sha(t.encode())) for d, t in want} <= found()
    short = (4, brute.sha(b"hunter2hunter2"))
    assert short not in found() and short in found(min_length=12)


def test_queries_have_contract_columns(spark):
    found = queries.op1_quality_rules(spark, SMALL)
    assert {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"} <= set(found.columns)
    assert set(queries.QUERIES) == {f.__name__ for f in queries.QUERIES.values()} and len(queries.QUERIES) == 13
