"""Personal data replaced by keyed surrogates of the same kind and look.

Entities are e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, IBANs,
national ids (US, UK, Spain) and the given and family names of persons. A surrogate depends on a
secret key and the entity only, so every mention of an entity gets the same one; as the parts of a
name are entities of their own, a full name, a first name and a family name after a title stay
one person. All different entities of a corpus are then held against each other: if two share a
surrogate, or a surrogate is itself an entity of the corpus, those concerned are drawn anew until
all differ.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import one_array
from waymark.llm.persons import FIRST_NAMES, LAST_NAMES, Part, feminine, persons, script_of
from waymark.llm.tables import BROADCAST_BYTES, picked, probe_sorted, probed, schema, sorted_arrays, stored

_MAX_ROUNDS = 50
_GENDERS = ("", "f", "m")

_PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<national>(?<![\w-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-HJ-NP-TV-Z])(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d{4}(?:[ \-]?\d{4}){3}(?!\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ \-.]?(?:\(\d{1,4}\)[ \-.]?)?\d{2,4}(?:[ \-.]?\d{2,4}){1,3}(?!\d)"
    r"|(?<![\w(])\(\d{2,5}\)[ \-]?\d{3,4}[ \-]?\d{3,5}(?!\d)"
    r"|(?<![\w.\-])\d{3}(?P<gap>[\-. ])\d{3}(?P=gap)\d{4}(?![\w\-])"
    r"|(?<![\w.\-])0\d{2,4}[ /\-]\d{3,4}(?:[ \-]?\d{3,5})(?![\w\-]))"
)
#: Texts without any of these hold no entity but persons.
_QUICK = re.compile(r"[@\d]")
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values: check letters of Spanish ids


class Mention(NamedTuple):
    """A place in a text with its kind and the entities it consists of."""

    start: int
    end: int
    kind: str
    parts: list[Part]


def mentions(text: str | None) -> list[Mention]:
    """All mentions of entities in a text, in order and apart from each other."""
    if not text:
        return []
    out = []
    for found in _PATTERN.finditer(text) if _QUICK.search(text) else ():
        kind, start, end = found.lastgroup, found.start(), found.end()
        if kind == "iban":
            end = _iban_end(text, start, end)
        elif kind == "national" and not _is_national(found.group()):
            continue
        if end > start:
            out.append(Mention(start, end, kind, [Part(start, end, kind, normal(kind, text[start:end]), "")]))
    for parts in persons(text, [(m.start, m.end) for m in out]):
        out.append(Mention(parts[0].start, parts[-1].end, "person", parts))
    return sorted(out)


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and normal form of every mention of a text."""
    for m in mentions(text):
        yield m.start, m.end, m.kind, " ".join(p.value for p in m.parts)


def normal(kind: str, value: str) -> str:
    """One form for all spellings of an entity that is no name."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card"):
        return re.sub(r"\D", "", value)
    return re.sub(r"[ \-]", "", value) if kind in ("iban", "national") else value


def _rest97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban_end(text: str, start: int, end: int) -> int:
    """The end of the longest IBAN with right check digits that ends at a space or at ``end``."""
    while end > start:
        value = normal("iban", text[start:end])
        if len(value) >= 15 and _rest97(value) == 1:
            return end
        end = max(text.rfind(" ", start, end), start)
    return start


def _is_national(value: str) -> bool:
    """Eight digits and a letter are a Spanish id only if the letter checks."""
    value = normal("national", value)
    return len(value) != 9 or not value[:8].isdigit() or value.isdigit() or value[8] == _DNI[int(value[:8]) % 23]


class _Stream:
    """Numbers drawn from a key and an entity."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed = hmac.new(key, f"{kind}\0{attempt}\0{value}".encode(), hashlib.sha256).digest()
        self.pool, self.round = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.round.to_bytes(4, "big")).digest()
            self.round += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the same class: digit, small or capital letter."""
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c.lower() <= "z":
            drawn = chr(97 + self.below(26))
            return drawn.upper() if c.isupper() else drawn
        return c

    def neighbour(self, c: str) -> str:
        """A letter of the same category among the 64 code points around, for scripts without a list."""
        base = ord(c) & ~63
        near = [chr(k) for k in range(base, base + 64) if unicodedata.category(chr(k)) == unicodedata.category(c)]
        return near[self.below(len(near))]


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


# Beginnings, vowels and endings of invented names by script.
_SOUNDS = {
    "latin": ("b d f g k l m n r s t v", "a e i o u", {"f": "a ia ina", "m": "o an or", "family": "er en ini ard"}),
    "cyrillic": ("б в г д ж к л м н р с т", "а е и о у", {"f": "а ия ина", "m": "ан ор им", "family": "ов ин ев"}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο", {"f": "ια ινα", "m": "ος ης", "family": "ίδης άκης όπουλος"}),
}


def _invented(draw: _Stream, script: str, ending: str, length: int) -> str:
    """A name of ``length`` syllables and an ending."""
    first, vowels, endings = _SOUNDS[script]
    first, vowels, endings = first.split(), vowels.split(), endings[ending].split()
    body = "".join(first[draw.below(len(first))] + vowels[draw.below(len(vowels))] for _ in range(length))
    return (body + first[draw.below(len(first))] + endings[draw.below(len(endings))]).capitalize()


def _name(draw: _Stream, kind: str, value: str, gender: str, attempt: int) -> str:
    """A given or family name of the same script; given names keep the gender, if it is known."""
    script = script_of(value)
    if script == "han":
        signs = LAST_NAMES["han"].split()
        return "".join(signs[draw.below(len(signs))] for _ in range(len(value) + attempt // 4))
    if script == "other":
        return "".join(map(draw.neighbour, value)) + "".join(draw.neighbour(value[-1]) for _ in range(attempt // 4))
    gender = gender or _GENDERS[1 + draw.below(2)]
    if attempt > 2:
        # the lists run out: longer and longer invented names
        return _invented(draw, script, "family" if kind == "family" else gender, 1 + attempt // 3)
    names = (LAST_NAMES[script] if kind == "family" else FIRST_NAMES[gender, script]).split()
    return names[draw.below(len(names))]


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, value: str, gender: str, attempt: int) -> str:
    """The surrogate of an entity in normal form.

    A keyed draw in the entity's own shape: address parts keep their lengths and classes, the
    last domain part stays; numbers keep their lengths, telephone numbers the leading digit;
    card numbers stay valid or invalid by their check digit, IBANs keep their country and get
    right check digits, as do Spanish ids; names keep script and gender. Addresses that were
    drawn in vain for some rounds become longer.
    """
    draw = _Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        rest, _, top = domain.rpartition(".")
        more = "".join(draw.like("a") for _ in range(attempt // 4))
        return "".join(map(draw.like, local)) + more + "@" + "".join(map(draw.like, rest)) + "." + top
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "phone":
        return value[0] + "".join(map(draw.like, value[1:]))
    if kind == "card":
        body = str(1 + draw.below(9)) + "".join(draw.like(c) for c in value[1:-1])
        valid = [d for d in "0123456789" if (_luhn(body + d) == 0) == (_luhn(value) == 0)]
        return body + valid[draw.below(len(valid))]
    if kind == "iban":
        body = "".join(map(draw.like, value[4:]))
        return f"{value[:2]}{98 - _rest97(value[:2] + '00' + body):02d}{body}"
    if kind == "national":
        if value.isdigit():
            return "".join(map(draw.like, value))
        if value[0].isdigit():
            body = "".join(map(draw.like, value[:8]))
            return body + _DNI[int(body) % 23]
        return value[:2] + "".join(map(draw.like, value[2:-1])) + "ABCD"[draw.below(4)]
    return _name(draw, kind, value, gender, attempt)


def worn(kind: str, mention: str, drawn: str) -> str:
    """The surrogate in the spelling of a mention: its separators, capitals and feminine form."""
    if kind in ("phone", "card", "iban", "national"):
        signs = iter(drawn)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email" and len(mention) == len(drawn):
        return "".join(d.upper() if m.isupper() else d for m, d in zip(mention, drawn, strict=True))
    if kind == "family" and feminine(mention) and script_of(drawn) == "cyrillic":
        drawn += "а"
    return drawn.upper() if kind in ("given", "family") and len(mention) > 1 and mention.isupper() else drawn


def compared(kind: str, drawn: str) -> str:
    """What tells surrogates of a kind apart: the form that entities of the kind have."""
    return drawn.casefold() if kind in ("given", "family") else drawn


def entity_key(kind: str, value: str) -> int:
    digest = hashlib.blake2b(f"{kind}\0{value}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["_text"].to_pylist():
            seen.update((p.kind, p.value, p.gender) for m in mentions(text) for p in m.parts)
        some = sorted(seen)
        column = lambda i: pa.array([x[i] for x in some], pa.string())  # noqa: B023, E731
        yield pa.record_batch({"kind": column(0), "value": column(1), "gender": column(2), "n": pa.array([seen[x] for x in some], pa.int64())})


def _drawn(key: bytes):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in _ENTITY), strict=True)
            made = [surrogate(key, *x) for x in rows]
            same = [compared(k, x) for k, x in zip(batch["kind"].to_pylist(), made, strict=True)]
            yield pa.record_batch({c: batch[c] for c in _ENTITY} | {"surrogate": pa.array(made, pa.string()), "same": pa.array(same, pa.string())})

    return draw


_ENTITY = ("kind", "value", "gender", "attempt")


def assigned(docs: DataFrame, key: bytes) -> DataFrame:
    """All entities of ``docs`` (_text) with surrogates of their own: kind, value, gender, attempt, surrogate.

    A given name has the gender that most of its mentions tell (a title, a list); f where both
    are equal, empty where none tells. No two entities of a kind share a surrogate, and no
    surrogate is an entity of its kind. Of those that clash, the one with the smallest value
    keeps its draw, unless it clashes with an entity.
    """
    seen = docs.select("_text").mapInArrow(_found, "kind string, value string, gender string, n long")
    votes = {g: F.sum(F.when(F.col("gender") == g, F.col("n")).otherwise(0)) for g in ("f", "m")}
    found = seen.groupBy("kind", "value").agg(votes["f"].alias("f"), votes["m"].alias("m"))
    gender = F.when(F.col("f") + F.col("m") == 0, "").when(F.col("f") >= F.col("m"), "f").otherwise("m")
    found = stored(found.select("kind", "value", gender.alias("gender")))
    columns = "kind string, value string, gender string, attempt int, surrogate string, same string"
    table = stored(found.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), columns))
    for _ in range(_MAX_ROUNDS):
        keepers = table.groupBy("kind", "same").agg(F.min("value").alias("keeper"))
        taken = found.select("kind", F.col("value").alias("same"), F.lit(True).alias("taken"))
        marked = table.join(keepers, ["kind", "same"]).join(taken, ["kind", "same"], "left")
        clash = (F.col("value") != F.col("keeper")) | F.coalesce("taken", F.lit(False))
        marked = stored(marked.withColumn("clash", clash).select(*_ENTITY, "surrogate", "same", "clash"))
        again = marked.filter("clash")
        if again.isEmpty():
            return table.drop("same")
        redrawn = again.select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), columns)
        table = stored(marked.filter("not clash").drop("clash").union(redrawn))
    raise RuntimeError("surrogates ran out")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [entity_key(k, v) for k, v in zip(batch["kind"].to_pylist(), batch["value"].to_pylist(), strict=True)]
        codes = [4.0 * a + _GENDERS.index(g) for a, g in zip(batch["attempt"].to_pylist(), batch["gender"].to_pylist(), strict=True)]
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "value": pa.array(codes, pa.float64())})


def _keys_of(table: pa.Table) -> np.ndarray:
    keys = {entity_key(p.kind, p.value) for t in table["_text"].to_pylist() for m in mentions(t) for p in m.parts}
    return np.array(sorted(keys), np.int64).view(np.uint64)[:, None]


def replaced(text: str, found: list[Mention], drawn: dict[tuple[str, str], str]) -> str:
    """The text with every part of its mentions replaced."""
    pieces, last = [], 0
    for mention in found:
        for p in mention.parts:
            pieces += [text[last : p.start], worn(p.kind, text[p.start : p.end], drawn[p.kind, p.value])]
            last = p.end
    return "".join([*pieces, text[last:]])


def _replaced(key: bytes):
    def replace(table: pa.Table, find) -> pa.Table:
        texts = table["_text"].to_pylist()
        spots = [mentions(t) for t in texts]
        names = sorted({(p.kind, p.value) for row in spots for m in row for p in m.parts})
        keys = np.array([entity_key(*n) for n in names], np.int64).view(np.uint64)[:, None]
        codes = np.nan_to_num(find(keys)).astype(int).tolist() if names else []
        drawn = {n: surrogate(key, *n, _GENDERS[code % 4], code // 4) for n, code in zip(names, codes, strict=True)}
        out = [replaced(t, row, drawn) if row else t for t, row in zip(texts, spots, strict=True)]
        made = {
            "doc_id": one_array(table["_id"]),
            "n_entities": pa.array(map(len, spots), pa.int64()),
            "kinds": pa.array([",".join(sorted({m.kind for m in row})) for row in spots], pa.string()),
            "text_sha256": pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in out], pa.string()),
            "replaced_text": pa.array(out, pa.string()),
        }
        return pa.table(made | {c: table[c] for c in table.column_names if c == "row"})

    return replace


def pseudonymised(
    docs: DataFrame,
    key: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_rows: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every text with its entities replaced by keyed surrogates.

    Result: doc_id, n_entities (mentions), kinds, text_sha256, replaced_text; with ``keep_rows``
    also ``row``. Null texts stay null and count as empty; texts without entities stay as they
    are; an empty table gives an empty one. Equal rows get equal texts. The same key gives the
    same surrogates for the same corpus. Names in other cases than the one first mentioned
    (Анны for Анна) and persons that no list, title, phrase or label points at are not found.
    """
    docs = picked(docs, id_col, text_col, keep_rows=keep_rows)
    table = assigned(docs, key)
    # the key alone says the rest: first draws without a gender
    again = table.filter("attempt > 0 or gender <> ''").mapInArrow(_keyed, "key long, value double")
    index, shards = sorted_arrays(stored(again))
    made = schema(
        "doc_id bigint", "n_entities bigint", "kinds string", "text_sha256 string", "replaced_text string", rows=docs
    )
    return probed(docs, index, shards, _keys_of, probe_sorted, np.nan, _replaced(key), made, limit=limit)
