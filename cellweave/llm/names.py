"""Shared helpers for names: folding, slips, abbreviations."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_SILENT = re.compile("['\u2018\u2019`\u00ad\u200b-\u200d\u2060\ufeff]")
_JOIN = {"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i"}


def plain(text: str) -> str:
    """Case, accents and widths folded; everything else stays."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
        text = "".join(_JOIN.get(c, c) for c in text)
    return text.casefold()


def words(text: str) -> list[str]:
    """The letter and digit runs of a folded text; apostrophes and invisible characters don't part words."""
    return _WORD.findall(_SILENT.sub("", plain(text)))


def slips(a: str, b: str, most: int) -> int:
    """Edit distance with exchanged neighbours as one slip (optimal string alignment), or ``most + 1`` beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    low = min(len(a), len(b))
    while start < low and a[start] == b[start]:
        start += 1
    while low > start and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        low -= 1
    a, b = a[start:], b[start:]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if most == 1:
        one = len(a) == len(b) == 1 or len(a) == len(b) == 2 and a == b[::-1]
        return 1 if one else 2
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` can be an abbreviation of ``word``: same first letter, its letters in order, and shorter."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def remnants(text: str, most: int) -> set[str]:
    """``text`` without up to ``most`` letters: texts within as many slips have one in common."""
    every = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        every = every | last
    return every
