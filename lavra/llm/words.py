"""Small text helpers that the workers share."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x20000)) if unicodedata.combining(c)) + "]+")


def fold(text: str) -> str:
    """Lower case without accents; any script is kept."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def words(text: str) -> list[str]:
    """Folded letter-and-digit runs of ``text``."""
    return _WORD.findall(fold(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of :func:`words` stands in ``text`` itself, its accents included, composed or not."""
    folded, origin = [], []
    for at, c in enumerate(text):
        plain = fold(c)
        folded.append(plain)
        origin += [at] * len(plain)
    found = []
    for m in _WORD.finditer("".join(folded)):
        stop = origin[m.end() - 1] + 1
        while stop < len(text) and unicodedata.combining(text[stop]):
            stop += 1
        found.append((origin[m.start()], stop))
    return found


def near(a: str, b: str, most: int = 1) -> bool:
    """Whether at most ``most`` insertions, deletions, replacements or swaps of neighbours lead from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) <= 1:
        return most >= 1
    if len(a) == len(b) == 2 and a == b[::-1]:
        return most >= 1
    if most <= 1:
        return False
    back, last = list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(back[j] + 1, row[-1] + 1, back[j - 1] + (x != y))
            if last and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last[j - 2] + 1)
            row.append(best)
        last, back = back, row
    return back[-1] <= most
