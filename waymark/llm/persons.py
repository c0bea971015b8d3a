"""Names of persons in texts: by lists of first names, by titles, by phrases and labels around.

A name counts as parts: given names and a family name. Once a document names somebody, every
later word of that document equal to a part is a mention too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import regex

# First names by gender and script, and last names by script.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Clara Diana Elena Emma Eva Helen Julia Laura Lucia Maria Marta Nina Olivia Paula Sarah Sofia Vera",
    ("m", "latin"): "Adam Albert Bruno Carlos Daniel David Eric Felix Hugo James John Louis Martin Michael Oscar Paul Peter Robert Simon Victor",
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Ирина Лариса Мария Надежда Нина Ольга Софья Татьяна",
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Фёдор",
    ("f", "greek"): "Αθηνά Άννα Ελένη Ευα Ζωή Ιωάννα Μαρία Σοφία",
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος",
}
LAST_NAMES = {
    "latin": "Adler Baker Bennett Costa Dubois Ferrari Fischer Garcia Hansen Keller Lambert Meyer Moreau Novak Parker Rossi Santos Silva Turner Weber",
    "cyrillic": "Волков Громов Дорохин Ершов Жуков Зимин Котов Лебедев Морозов Носов Орлов Попов Рыбаков Соколов",
    "greek": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδόπουλος",
    "han": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗",
}
# Titles by gender, words before and after a name, words that are no name.
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Madame Mme Signora Sra г-жа госпожа Κυρία",
    "m": "Mr Herr Señor Monsieur Signor Sr г-н господин Κύριος",
    "": "Dr Prof Professor",
}
INTRODUCED = (
    "my name is", "i am called", "ich heiße", "mein name ist", "je m'appelle", "me llamo", "mi nombre es", "mi chiamo",
    "меня зовут", "με λένε",
)
LABELS = "Name Author From Contact Patient Customer Employee Имя Όνομα"
SPEAKS = "said says told asked replied wrote met sagte schrieb dijo escribió dit écrit сказал сказала написал написала είπε"
PARTICLES = "von van der den de da del di du la le zu bin al"
NO_NAMES = "The A An In On At And But He She It I We They President Chairman Speaker Minister"
HAN_BEFORE = "我叫 我的名字是 名叫 姓名: 姓名："
HAN_AFTER = {"先生": "m", "女士": "f", "小姐": "f"}

GENDERED = {name.casefold(): key for key, names in FIRST_NAMES.items() for name in names.split()}
_TITLES = {title: gender for gender, titles in TITLES.items() for title in titles.split()}
_NO_NAMES = {w.casefold() for w in NO_NAMES.split()}


def _any(words) -> str:
    return "|".join(sorted(map(regex.escape, words), key=len, reverse=True))


_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
_PARTICLES = rf"(?:(?:{_any(PARTICLES.split())}) ){{0,2}}"
_NEXT = rf"(?: {_PARTICLES}{_WORD})"
#: Names after a title, a phrase, a label, a first name (the rest of it); before a verb.
_AFTER = {
    "title": regex.compile(rf"\.? {_PARTICLES}(?P<name>{_WORD}{_NEXT}{{0,2}})(?!\w)"),
    "phrase": regex.compile(rf" {_PARTICLES}(?P<name>{_WORD}{_NEXT}{{0,2}})(?!\w)"),
    "label": regex.compile(rf" ?(?P<name>{_WORD}{_NEXT}{{1,2}})(?!\w)"),
    "first": regex.compile(rf"{_NEXT}{{0,2}}(?!\w)"),
    "han": regex.compile(r"(?P<name>\p{Han}{2,3})(?!\p{Han})"),
}
_BEFORE = regex.compile(rf"(?<!\w){_WORD}{_NEXT}$")
#: Characters before a verb where a name can stand.
_REACH = 80
_TOKEN = regex.compile(r"(?<![\w])(?:\p{Lu}['’])?\p{Lu}(?:\p{Ll}+|\p{Lu}+)(?:-\p{Lu}\p{L}+)*(?!\w)")


@cache
def _needles() -> ahocorasick.Automaton:
    """All that can point at a name, found in one pass over a text."""
    found = ahocorasick.Automaton()
    kinds = {
        "title": _TITLES,
        "phrase": [f(p) for p in INTRODUCED for f in (str, str.capitalize)],
        "label": [f"{w}:" for w in LABELS.split()],
        "first": [n for names in FIRST_NAMES.values() for n in names.split()],
        "verb": [f" {w}" for w in SPEAKS.split()],
        "han": HAN_BEFORE.split(),
    }
    for kind, words in kinds.items():
        for word in words:
            found.add_word(word, (kind, word))
    found.make_automaton()
    return found


def _pointed(text: str) -> dict[str, list[tuple[int, int, str]]]:
    """Spans of possible names by what points at them, and the title if it is one."""
    out: dict[str, list[tuple[int, int, str]]] = {}
    for end, (kind, word) in _needles().iter(text):
        start, end = end + 1 - len(word), end + 1
        if kind == "verb":
            m = None if text[end : end + 1].isalnum() else _BEFORE.search(text, max(0, start - _REACH), start)
            span = m and m.span()
        else:
            m = None if kind != "han" and text[start - 1 : start].isalnum() else _AFTER[kind].match(text, end)
            span = m and ((start, m.end()) if kind == "first" else m.span("name"))
        if span:
            out.setdefault(kind, []).append((*span, word))
    return out


class Part(NamedTuple):
    """A given or family name in a text; ``gender`` (f, m or empty) as far as this place tells."""

    start: int
    end: int
    kind: str
    value: str
    gender: str


def script_of(name: str) -> str:
    code = ord(name[0])
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x4E00 <= code < 0xA000 or 0x3400 <= code < 0x4DC0:
        return "han"
    return "latin" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "other"


def feminine(family: str) -> bool:
    """Whether a Cyrillic family name stands in its feminine form."""
    return family.casefold().endswith(("ова", "ева", "ёва", "ина", "ына"))


def normal_name(kind: str, name: str) -> str:
    """One form for all spellings of a part: lower case, family names in the masculine form."""
    name = name.casefold().replace("’", "'")
    return name[:-1] if kind == "family" and feminine(name) else name


def _parts(text: str, start: int, end: int, alone: str, gender: str) -> list[Part]:
    """The parts of a name; one of a single word is of kind ``alone``."""
    found = [m for m in _TOKEN.finditer(text, start, end) if m.group().casefold() not in _NO_NAMES]
    out = []
    for i, m in enumerate(found):
        last = i == len(found) - 1
        kind = "family" if last and (i > 0 or alone == "family") else "given"
        value = normal_name(kind, m.group())
        known = GENDERED[value][0] if kind == "given" and value in GENDERED else ""
        out.append(Part(m.start(), m.end(), kind, value, (known or gender) if kind == "given" else ""))
    return out


def _han(text: str, names: list[str]) -> list[Part]:
    """All mentions of Chinese names: in full, or the family name before a title."""
    out = []
    for name in dict.fromkeys(names):
        for m in regex.finditer(regex.escape(name), text):
            after = next((g for t, g in HAN_AFTER.items() if text.startswith(t, m.end())), "")
            out.append(Part(m.start(), m.start() + 1, "family", name[0], ""))
            out.append(Part(m.start() + 1, m.end(), "given", name[1:], after))
        for title in HAN_AFTER:
            for m in regex.finditer(regex.escape(name[0] + title), text):
                out.append(Part(m.start(), m.start() + 1, "family", name[0], ""))
    return out


def persons(text: str, taken: list[tuple[int, int]]) -> Iterator[list[Part]]:
    """Mentions of persons outside the spans ``taken``, in order, each as its parts."""
    pointed = _pointed(text)
    if not pointed:
        return
    used = {i for start, end in taken for i in range(start, end)}
    parts: dict[int, Part] = {}

    def add(found: list[Part]) -> None:
        for part in found:
            if part.start not in used:
                used.update(range(part.start, part.end))
                parts[part.start] = part

    for kind in ("title", "phrase", "label", "first", "verb"):
        for start, end, word in pointed.get(kind, ()):
            # a title before a listed first name alone: that is no family name
            first = _TOKEN.search(text, start, end)
            single = "family" if kind == "title" and not (first and first.group().casefold() in GENDERED) else "given"
            add(_parts(text, start, end, single, _TITLES.get(word, "")))
    add(_han(text, [text[start:end] for start, end, _ in pointed.get("han", ())]))
    known = {}
    for kind in ("family", "given"):
        known |= {p.value: p for p in parts.values() if p.kind == kind}
    families = {p.value for p in parts.values() if p.kind == "family"}
    if known:
        for m in _TOKEN.finditer(text):
            value = m.group().casefold().replace("’", "'")
            kind = known[value].kind if value in known else "family"
            if value in known or normal_name("family", value) in families:
                add([Part(m.start(), m.end(), kind, value if value in known else normal_name("family", value), "")])
    mention: list[Part] = []
    for at in sorted(parts):
        gap = text[mention[-1].end : at] if mention else "\n"
        if "\n" not in gap and len(gap) < _REACH and all(w in PARTICLES.split() for w in gap.split()):
            mention.append(parts[at])
            continue
        if mention:
            yield mention
        mention = [parts[at]]
    if mention:
        yield mention
