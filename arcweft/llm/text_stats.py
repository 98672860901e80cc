"""Counts over one text that the quality operators share."""

from __future__ import annotations

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?"


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def repeated(ids: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs twice or more."""
    inside = np.zeros(len(ids), dtype=bool)
    n = len(ids) - width + 1
    if n < 2:
        return inside
    key = ids[:n]
    for j in range(1, width):
        base = int(ids.max()) + 1
        if int(key.max()) >= 2**62 // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[j : n + j]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for j in range(width):
        inside[j : n + j] |= twice
    return inside


def histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)


def total(counts: np.ndarray, chars: bytes) -> int:
    return int(counts[list(chars)].sum())


#: What ``text_counts`` returns, in order.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks",
)


def text_counts(text: str) -> tuple[int, ...]:
    """Words and their characters, symbols, repeated lines and words, and counts of some characters.

    Words are what the six ASCII white space characters separate, as ``bytes.split`` does.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0,) * 2 + (0,) * 7
    counts = histogram(raw)
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - total(counts, BLANKS),
        total(counts, SYMBOLS),
        len(lines) - len(set(lines)),
        int(repeated(word_ids(words)).sum()),
        len(lines),
        total(counts, UPPER),
        total(counts, DIGITS),
        total(counts, MARKS),
    )
