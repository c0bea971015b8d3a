"""Surrogates: identity across spellings, formats, and assignment against a plain version."""

import re

import pytest
from pyspark.sql import functions as F

from waymark.llm.surrogates import assigned, compared, entities, mentions, pseudonymised, replaced, surrogate
from waymark.llm.tables import picked

KEY = b"key of the tests"


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_assignment(texts):
    """Surrogates by (kind, value), drawn in rounds with dictionaries."""
    votes = {}
    for text in texts:
        for m in mentions(text):
            for p in m.parts:
                f, male = votes.get((p.kind, p.value), (0, 0))
                votes[p.kind, p.value] = f + (p.gender == "f"), male + (p.gender == "m")
    gender = {e: "" if f + m == 0 else "f" if f >= m else "m" for e, (f, m) in votes.items()}
    attempt = dict.fromkeys(votes, 0)
    while True:
        drawn = {e: surrogate(KEY, *e, gender[e], attempt[e]) for e in votes}
        keeper = {}
        for (kind, value), name in sorted(drawn.items()):
            keeper.setdefault((kind, compared(kind, name)), value)
        clash = [
            (k, v) for (k, v), name in drawn.items()
            if keeper[k, compared(k, name)] != v or (k, compared(k, name)) in votes
        ]
        if not clash:
            return drawn, max(attempt.values(), default=0)
        for e in clash:
            attempt[e] += 1


def test_one_person_one_surrogate(spark):
    text = "Anna Weber met John Smith. Anna said hello. Mr Smith left. Ms. Weber stayed. ANNA WEBER'S book."
    made = pseudonymised(documents(spark, [text, "Priya Patel said that Dr. Wei Zhang left. Zhang met Priya."]), KEY)
    one, two = (r.replaced_text for r in made.orderBy("doc_id").collect())
    found = re.fullmatch(r"(\w+) (\w+) met (\w+) (\w+)\. (\w+) said hello\. Mr (\w+) left\. Ms\. (\w+) stayed\. (\w+) (\w+)'S book\.", one)
    a, weber, john, smith, anna, mr, ms, first, last = found.groups()
    assert (anna, mr, ms, first, last) == (a, smith, weber, a.upper(), weber.upper()) and john != a and smith != weber
    assert not {"Anna", "Weber", "John", "Smith"} & set(re.findall(r"\w+", one))
    assert not {"Priya", "Patel", "Wei", "Zhang"} & set(re.findall(r"\w+", two))
    found = re.fullmatch(r"(\w+) (\w+) said that Dr\. (\w+) (\w+) left\. (\w+) met (\w+)\.", two).groups()
    assert found[4] == found[3] and found[5] == found[0]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("call 555-123-4567 or (030) 123 4567 or 020 7946 0958", ["phone"] * 3),
        ("IBAN DE89 3704 0044 0532 0130 00 BANK", ["iban"]),
        ("wrong IBAN DE88 3704 0044 0532 0130 00", []),
        ("SSN 123-45-6789, DNI 12345678Z, not 12345678A", ["national", "national"]),
        ("г-жа Волкова и Волков", ["person", "person"]),
        ("我叫王伟。王伟女士来了，王女士好", ["person"] * 3),
        ("Name: Eve O'Brien; Herr van der Berg; me llamo Ximena Ruiz", ["person"] * 3),
        ("The Baker Street in New York, 2020-10-12, 100-2000, 3.14159 and 1,000,000", []),
    ],
)
def test_kinds_and_formats(spark, text, kinds):
    assert [kind for _, _, kind, _ in entities(text)] == kinds
    made = pseudonymised(documents(spark, [text]), KEY).first().replaced_text
    shape = lambda t: [c.isdigit() or c for c in t if not c.isalpha() and c != "'"]
    if "IBAN" not in text:
        assert shape(made) == shape(text)
    for start, end, kind, _ in entities(text):
        if kind != "person":
            assert text[start:end] not in made
            assert [k for _, _, k, _ in entities(made)] == kinds


def test_given_names_keep_gender(spark):
    texts = ["Mrs Priya Patel and Mr Arjun Rao", "Priya Patel said hi", "my name is Arjun"]
    drawn = {(r.kind, r.value): r.gender for r in assigned(picked(documents(spark, texts), "doc_id", "text"), KEY).collect()}
    assert drawn["given", "priya"] == "f" and drawn["given", "arjun"] == "m"


def test_forced_collisions_against_plain_version(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{a.upper()}{b}lan" for a in letters[:12] for b in "aeiou"]
    texts = [f"Mr {n} wrote to {n[0].lower()}@{n[1]}.io and Ms. {n}a" for n in names]
    texts += [f"{a}@{b}.io" for a in letters for b in letters[:20]]
    texts += ["Anna Weber, Maria Weber, Nina Rossi", None, "", "Иван Волков и Анна Волкова", "name " * 20_000 + "Anna Weber"]
    plain, rounds = plain_assignment(texts)
    assert rounds > 3
    found = {(r.kind, r.value): r.surrogate for r in assigned(picked(documents(spark, texts), "doc_id", "text"), KEY).collect()}
    assert found == plain
    assert len({(k, compared(k, s)) for (k, _), s in plain.items()}) == len(plain)
    assert not {(k, compared(k, s)) for (k, _), s in plain.items()} & set(plain)
    for limit in (1 << 26, 0):
        rows = pseudonymised(documents(spark, texts), KEY, limit=limit).collect()
        assert {r.doc_id: r.replaced_text for r in rows} == {
            i: replaced(t, mentions(t), plain) if t else t for i, t in enumerate(texts)
        }


def test_empty_table(spark):
    assert pseudonymised(documents(spark, ["x"]).filter(F.lit(False)), KEY).collect() == []
