"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for at in range(len(words) - 7):
        windows[tuple(words[at : at + 8])].append(at)
    covered = {at + k for places in windows.values() if len(places) > 1 for at in places for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def shared_lines(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_lines, n_dropped, kept_sha256, for rows with distinct ids."""
    key = lambda line: lowered(line.strip(SPACE))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and doc != max(holders[key(x)])
        kept = [line for line in lines if not gone(line)]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def license_base(text: str | None, phrases: dict[str, str]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
    at, labels = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def base_scores(rows: list[tuple]) -> dict[int, tuple]:
    """held_out, n_tokens, n_known, train_tokens, base_score per id."""
    tokens = {doc: WORD.findall(lowered(text or "")) + [None] for doc, text in rows}
    held = {doc: zlib.crc32(str(doc).encode()) % 5 == 1 for doc in tokens}
    counts = Counter(w for doc, words in tokens.items() if not held[doc] for w in words)
    total = sum(counts.values())
    log = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1)))
    return {
        doc: (held[doc], len(words), sum(counts[w] > 0 for w in words), total, sum(map(log, words)))
        for doc, words in tokens.items()
    }


def context_tree_score(rows: list[tuple], depth: int) -> dict[int, float]:
    """Log10 probability of every text under context-tree weighting of the training texts."""
    counts: dict = defaultdict(lambda: [0, 0])

    def steps(text: str):
        data = lowered(text or "").encode() + b"\xff"
        for at, byte in enumerate(data):
            context = (b"\0" * depth + data)[at : at + depth]
            for i in range(8):
                yield context, (1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1

    children = defaultdict(set)
    for doc, text in rows:
        trains = zlib.crc32(str(doc).encode()) % 5 != 1
        for context, decided, bit in steps(text):
            for d in range(depth + 1):
                tail = context[depth - d :]
                counts[tail, decided][bit] += trains
                if d < depth:
                    children[tail, decided].add((context[depth - d - 1 :], decided))
    memo: dict = {}

    def pe(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(node):
        if node not in memo:
            own = pe(node)
            if len(node[0]) < depth:
                split = sum(map(pw, children[node]))
                large, small = max(own, split), min(own, split)
                own = large + math.log((1 + math.exp(small - large)) / 2)
            memo[node] = own
        return memo[node]

    def one(context, decided):
        given, left = 0.0, 1.0
        for d in range(depth + 1):
            node = context[depth - d :], decided
            own = 1.0 if d == depth else min(1.0, math.exp(pe(node) - pw(node) - math.log(2)))
            a, b = counts[node]
            given += left * own * (b + 0.5) / (a + b + 1)
            left *= 1 - own
        return given

    out = {}
    for doc, text in rows:
        out[doc] = sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in steps(text))
    return out


def similar(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id per id."""
    sets = {}
    for doc, text in rows:
        words = WORD.findall(lowered(text or ""))
        sets[doc] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and 100 * min(len(x), len(y)) >= 90 * max(len(x), len(y)) and 100 * len(x & y) >= 90 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


def repeated_bytes(rows: list[tuple], length: int = 50) -> dict[int, tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256 per id."""
    first: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            first[w] = min(doc, first.get(w, doc))
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < doc:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def leaks(texts: list[tuple], items: list[tuple], similarity: float = 0.8) -> set[tuple[int, int]]:
    """Pairs of documents and items within the edit distance over words, anywhere in a text."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = set()
    for doc, text in texts:
        have = word.findall(lowered(text or ""))
        for item, passage in items:
            want = word.findall(lowered(passage or ""))
            if not want:
                continue
            row = list(range(len(want) + 1))
            least = row[-1]
            for w in have:
                before, row = row, [0]
                for j, x in enumerate(want, 1):
                    row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (w != x)))
                least = min(least, row[-1])
            if 1 - least / len(want) >= similarity - 1e-9:
                found.add((doc, item))
    return found
