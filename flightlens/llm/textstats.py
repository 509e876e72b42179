"""Counts over one text, used inside Python workers."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
# Character classes, in the order of the histogram.
CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "pause", "symbol", "other")


def class_table() -> np.ndarray:
    """Class of every code point, from its Unicode category and a few ASCII signs."""
    by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    by_major = {"P": 7, "S": 7}
    table = np.full(0x110000, 8, dtype=np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        table[point] = by_category.get(category, by_major.get(category[0], 8))
    table[[9, 10, 11, 12, 13, 32]] = 4
    table[[ord(c) for c in ".!?"]] = 5
    table[[ord(c) for c in ",;:'\"-()"]] = 6
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(table[points], minlength=len(CLASSES))


def word_codes(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Distinct words numbered by first occurrence, and the number of every word."""
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    return numbers, codes


def repeat_words(codes: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more; the first occurrence counts too."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    keys = codes[:n]
    for k in range(1, width):
        if distinct ** 2 >= 2**62 or (k > 1 and int(keys.max()) >= 2**62 // max(1, distinct)):
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * distinct + codes[k : k + n]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                count += 1
            else:
                seen.add(line)
    return count


def symbols(text: str) -> int:
    return sum(text.count(c) for c in SYMBOLS)
