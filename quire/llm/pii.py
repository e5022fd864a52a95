"""Surrogates for personal data.

Detected entities get keyed, type-consistent replacements. Every replacement is
a keyed permutation of the set of strings of the entity's own format: digits stay
digits, letters keep case, kind (vowel or consonant) and script, separators and
check digits hold, given names stay within their script and gender, family names
outside the given ones and with the endings that tell a gender, addresses of a
reserved range within it and all others outside them all. A permutation cannot map
two entities to one, so distinctness and coreference hold over the whole corpus
without any table of entities; a shift inside the permutation keeps every entity
from mapping to itself.

The collision check of a text looks for a replacement that equals another original
of the text or another replacement; such an entity is drawn again under the next
tweak until it is free, so that no two entities of a text share a name afterwards.
Words of a name that was found stand for the person in the rest of the text too: a
lone family or given name is replaced as in the whole name.

Null text stays null with no entity; rows are independent, repeated rows get equal
texts, and a null id is passed through.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, text_chunks, through

TYPES = ("email", "ip", "card", "phone", "secret", "name")

#: Given names, by script and gender (fixed values).
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Beatrice Camille Carla Caroline Charlotte Clara Claire Daniela Diana Elena Elise Elizabeth Emily Emma Eva Hannah Helen Isabel Jane Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Monica Nadine Nancy Olivia Patricia Paula Rachel Rosa Ruth Sarah Silvia Sofia Sophie Susan Teresa Ursula Victoria",
    ("latin", "m"): "Adam Alan Alexander Andreas Anthony Antonio Arthur Benjamin Bernard Brian Carlos Charles Christian Daniel David Diego Edward Eric Felix Fernando Francis Frank George Hans Henri Henry Hugo Jack Jacques James Jean Johann John Joseph Juan Karl Kevin Louis Lucas Luis Manuel Mark Martin Michael Miguel Nicolas Oliver Oscar Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Simon Stefan Steven Thomas Victor Walter William",
    ("cyrillic", "f"): "Александра Анастасия Анна Валентина Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Марина Мария Надежда Наталья Оксана Ольга Светлана Софья Тамара Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Василий Виктор Владимир Григорий Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Степан Фёдор Юрий",
    ("greek", "f"): "Αγγελική Αικατερίνη Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Παναγιώτα Σοφία Φωτεινή",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνιος Βασίλειος Γεώργιος Δημήτριος Εμμανουήλ Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Σπυρίδων Χρήστος",
}
#: Titles that make the next capitalised words a name (fixed values).
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Madame Monsieur Mme Señor Señora Sr Sra"

#: Letters that are permuted among themselves (fixed values).
_KINDS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_KIND_OF = {c: k for k in _KINDS for c in k}
_HEX = "0123456789abcdef"
#: Endings of family names that tell a gender, longest first (fixed values).
ENDINGS = ("ская", "цкая", "ский", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын", "ая", "ой", "ий", "ου", "ος", "ης", "ας")
#: Reserved ranges of addresses: first address, bits that are fixed (fixed values).
RANGES = ((0, 8), (10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (224 << 24, 3))


class Permutation:
    """Keyed permutations of 0..size-1 without a fixed point (size over 1): balanced Feistel, cycle walking, conjugated shift."""

    def __init__(self, key: bytes, tweak: str):
        self.mac = hmac.new(key, tweak.encode(), hashlib.sha256)

    def _round(self, r: int, x: int, bits: int) -> int:
        m = self.mac.copy()
        m.update(b"%d:%d:%d" % (r, bits, x))
        wide = m.digest()
        while len(wide) * 8 < bits:
            wide += hashlib.sha256(wide).digest()
        return int.from_bytes(wide, "big") >> (len(wide) * 8 - bits)

    def _walk(self, x: int, size: int, rounds) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        forward = rounds[0] == 0
        while True:
            a, b = x >> half, x & low
            for r in rounds:
                if forward:
                    a, b = b, a ^ self._round(r, b, half)
                else:
                    a, b = b ^ self._round(r, a, half), a
            x = a << half | b
            if x < size:
                return x

    def __call__(self, x: int, size: int) -> int:
        if size < 2:
            return x
        return self._walk((self._walk(x, size, range(8)) + 1) % size, size, range(7, -1, -1))


def permute(text: str, key: bytes, tweak: str, kinds: list[str | None] | None = None) -> str:
    """Permute the strings that have the same kinds of characters at the same places."""
    kinds = [_KIND_OF.get(c) for c in text] if kinds is None else kinds
    x, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            x, size = x * len(k) + k.index(c), size * len(k)
    plan = "".join("-" if not k else k[0] for k in kinds)
    x = Permutation(key, f"{tweak}|{plan}|{''.join(c for c, k in zip(text, kinds) if not k)}")(x, size)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if k := kinds[i]:
            x, d = divmod(x, len(k))
            out[i] = k[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    odd = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return -(odd + sum(map(int, digits[-2::-2]))) % 10


@lru_cache(maxsize=1)
def _given() -> dict[str, tuple[str, str, list[str], int]]:
    return {n: (script, gender, names, i) for (script, gender), line in GIVEN.items() for names in [line.split()] for i, n in enumerate(names)}


def _given_name(name: str, key: bytes, draw: str) -> str:
    script, gender, names, i = _given()[name]
    return names[Permutation(key, f"given|{script}|{gender}{draw}")(i, len(names))]


def _family_name(name: str, key: bytes, draw: str) -> str:
    """A name outside the lists of given ones; the walk goes on until it is."""
    end = next((e for e in ENDINGS if name.endswith(e) and len(name) > len(e) + 1), "")
    stem = name[: len(name) - len(end)]
    while True:
        stem = permute(stem, key, f"family|{end}{draw}")
        if stem + end not in _given():
            return stem + end


def _range(x: int) -> tuple[int, int]:
    """The reserved range of an address, or (0, 0)."""
    return next(((first, bits) for first, bits in RANGES if x >> (32 - bits) == first >> (32 - bits)), (0, 0))


def surrogate(kind: str, entity: str, key: bytes, redraw: int = 0) -> str:
    """The replacement of an entity; the same for the same entity everywhere."""
    draw = f"|again {redraw}" if redraw else ""
    if kind == "ip":
        x = 0
        for part in entity.split("."):
            x = x << 8 | int(part)
        first, bits = _range(x)
        if bits:
            x = first | Permutation(key, f"ip|{first}{draw}")(x - first, 1 << (32 - bits))
        else:
            walk = Permutation(key, "ip" + draw)
            x = walk(x, 1 << 32)
            while _range(x)[1]:
                x = walk(x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = "".join(c for c in entity if c.isdigit())
        body = permute(digits[1:-1], key, f"card|{digits[0]}{draw}")
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10  # a valid number stays valid
        new = iter(digits[0] + body + str((luhn(digits[0] + body) + off) % 10))
        return "".join(next(new) if c.isdigit() else c for c in entity)
    if kind == "phone":
        # The country code stays; a first digit of 2 to 9 stays so.
        at = entity.index(" ") if entity.startswith("+") and " " in entity[:5] else 0
        kinds: list[str | None] = [None] * len(entity)
        first = True
        for i in range(at, len(entity)):
            if entity[i].isdigit():
                kinds[i] = ("23456789" if entity[i] >= "2" else "01") if first else _KINDS[0]
                first = False
        return permute(entity, key, "phone" + draw, kinds)
    if kind == "secret":
        if all(c in _HEX for c in entity):
            return permute(entity, key, "hex" + draw, [_HEX] * len(entity))
        return permute(entity, key, "secret" + draw)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        stem, _, top = domain.rpartition(".")
        new = permute(f"{local}@{stem}", key, f"email|{top}{draw}")
        return f"{new}.{top}"
    return " ".join(_given_name(w, key, draw) if w in _given() else _family_name(w, key, draw) for w in entity.split(" "))


@lru_cache(maxsize=1)
def patterns():
    """One pass over a text; alternatives in order of specificity."""
    import regex

    given = "|".join(sorted(_given(), key=len, reverse=True))
    name = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
    return regex.compile(
        r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
        r"|(?:(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)[ \t]*[=:][ \t]*[\"']?)(?P<secret>[A-Za-z0-9_+/=-]{16,})"
        r"|(?P<secret>\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}\b)"
        r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d))"
        r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d))"
        r"|(?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
        r"|(?P<phone>(?<![\w-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-]))"
        rf"|\b(?:{TITLES.replace(' ', '|')})\.? (?P<name>{name}(?: {name})?)"
        rf"|(?P<name>\b(?:{given}) {name})"
    )


@lru_cache(maxsize=1)
def _hints():
    """Finds something in every line that the patterns match: all but names need one of the signs, names a listed word before a space or dot."""
    import regex

    return regex.compile(rf"[@=:\d]|(?:{'|'.join(sorted({*_given(), *TITLES.split()}))})[ .]")


def drawn(found: list[tuple[str, str]], key: bytes) -> tuple[dict[tuple[str, str], str], int]:
    """Replacements of (type, entity) pairs in order, all different and none an original; and how many had to be drawn again."""
    known: dict[tuple[str, str], str] = {}
    originals, used, again = set(found), set(), 0
    for kind, entity in found:
        if (kind, entity) in known:
            continue
        redraw = 0
        while (kind, new := surrogate(kind, entity, key, redraw)) in originals or (kind, new) in used:
            redraw += 1
            if redraw > 100:  # a format of so few strings that all are taken, as a code of one letter
                break
        again += redraw > 0
        used.add((kind, new))
        known[kind, entity] = new
    return known, again


def replace(text: str, key: bytes) -> tuple[str, dict[str, int], int, int]:
    """New text, entities by type, distinct entities, and collisions that the check found and mended.

    No entity spans a line break, so only lines with a hint of one are searched.
    """
    counts: dict[str, int] = {}
    hint = _hints()
    if not hint.search(text):
        return text, counts, 0, 0
    lines, find = text.split("\n"), patterns().finditer
    matches = {i: m for i, line in enumerate(lines) if hint.search(line) and (m := [(x.start(x.lastgroup), x.end(x.lastgroup), x.lastgroup, x[x.lastgroup]) for x in find(line)])}
    if not matches:
        return text, counts, 0, 0
    found = [(kind, entity) for m in matches.values() for _, _, kind, entity in m]
    known, again = drawn(found, key)
    words = {w: n for (kind, entity), new in known.items() if kind == "name" for w, n in zip(entity.split(" "), new.split(" ")) if len(w) > 2}
    lone = _alone(frozenset(words)) if words else None

    def rest(part: str) -> str:
        if lone is None:
            return part
        part, n = lone.subn(lambda m: words[m[0]], part)
        counts["name"] = counts.get("name", 0) + n
        return part

    for kind, _ in found:
        counts[kind] = counts.get(kind, 0) + 1
    for i, line in enumerate(lines):
        out, at = [], 0
        for start, end, kind, entity in matches.get(i, ()):
            out += rest(line[at:start]), known[kind, entity]
            at = end
        lines[i] = "".join(out) + rest(line[at:])
    return "\n".join(lines), counts, len(known), again


def _alone(words: frozenset[str]):
    """Finds the words of names where they stand alone."""
    import regex

    return regex.compile(r"(?<![\p{L}\p{N}_@.-])(?:" + "|".join(sorted(map(regex.escape, words), key=len, reverse=True)) + r")(?![\p{L}\p{N}_@-])")


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """Per row: doc_id, the new text, entities by type (lone words of names among them), distinct entities and mended collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            rows = [(None, {}, 0, 0) if t is None else replace(t, key) for t in part.column("text").to_pylist()]
            cols = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[1].get(k, 0) for r in rows], pa.int64()) for k in TYPES), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", *(f"n_{k}" for k in TYPES), "n_distinct", "n_collisions"])

    return id_text(docs).mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in TYPES) + ", n_distinct long, n_collisions long")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows with all their columns, the text replaced."""

    def change(part: pa.RecordBatch) -> pa.RecordBatch:
        i = part.schema.get_field_index("text")
        new = pa.array([None if t is None else replace(t, key)[0] for t in part.column(i).to_pylist()], part.schema.field(i).type)
        return part.set_column(i, part.schema.field(i), new)

    return through(docs, change)
