"""Word analysis of the stored index: folded, stemmed tokens with places."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")
#: Suffixes by step, with what replaces them (the published algorithm's tables).
STEP_2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP_3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(w: str) -> str:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _kinds(w)))


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replaced(w: str, pairs: list[str], least: int) -> str:
    table = {pairs[i]: pairs[i + 1].replace("-", "") for i in range(0, len(pairs), 2)}
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else w
    return w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words outside ASCII letters and very short or long ones stay."""
    if not 2 < len(w) < 64 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _kinds(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case, without diacritics."""
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")


def analyse(text: str | None) -> list[str]:
    """Stems of the runs of letters and digits; an underscore separates."""
    return [stem(w) for w in _WORD.findall(fold(text or ""))]
