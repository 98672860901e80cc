"""License scans: exact phrases, and short notices with a few edits.

A notice of up to k edits is cut into k + 1 parts; by the pigeonhole principle one of them
occurs unchanged, so an exact search for the parts finds all candidates.  The ``regex``
library's bounded-error matching then verifies the surroundings of each and tells the edits
and the span.

Texts are searched as their words, joined by single spaces: A-Z are lower-cased, and a word is
a run of digits, letters a-z and characters beyond ASCII.  Edits are counted in UTF-8 bytes.

Cases: a null or empty text has no words, no labels, null places and score 0; overlapping and
repeated places count each; repeated rows are scanned each; labels found at one place all
count; a very long text is scanned whole; other columns are not read, so their names can't
clash; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts

# Phrases that count wherever their words stand one after another, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices by label, as words.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("epl", "eclipse public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_KEPT = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))

PLACE = T.StructType(
    [T.StructField("label", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("first", "last", "errors")]
)
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("base", T.ArrayType(PLACE)),
        T.StructField("notices", T.ArrayType(PLACE)),
        T.StructField("score", T.DoubleType()),
    ]
)
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int64())]))


def edits(notice: str) -> int:
    """How many edits a notice may have: one in twelve characters."""
    return len(notice) // 12


def parts(notice: str, n: int) -> list[tuple[int, str]]:
    """The notice cut into n parts of about one length, with their offsets."""
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Searches one text at a time."""

    def __init__(self, phrases=PHRASES, notices=NOTICES) -> None:
        self.phrases = [(p.encode(), label) for p, label in phrases]
        self.notices = []
        for label, notice in notices:
            k = edits(notice)
            seeds = [(a, s.encode()) for a, s in parts(notice, k + 1)]
            near = regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(notice).encode(), k))
            self.notices.append((label, len(notice), k, seeds, near))

    def scan(self, text: str) -> tuple[int, list[dict], list[dict], float]:
        words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
        joined = b" ".join(words)
        base, found = [], []
        ends: list[int] = []

        def starts() -> list[int]:
            """Where each word starts in the joined text."""
            if not ends:
                ends.extend(accumulate((len(w) + 1 for w in words), initial=0))
            return ends

        if b" license" in joined:  # all phrases end in that word
            padded = b" " + joined + b" "
            for phrase, label in self.phrases:
                for at in _all(padded, b" " + phrase + b" "):
                    first = bisect_right(starts(), at) - 1
                    base.append({"label": label, "first": first, "last": first + phrase.count(b" "), "errors": 0})
        for label, length, k, seeds, near in self.notices:
            spans = {}
            for offset, seed in seeds:
                for at in _all(joined, seed):
                    start = max(0, at - offset - k)
                    window = joined[start : at - offset + length + k]
                    if m := near.search(window):
                        errors = sum(m.fuzzy_counts)
                        span = (start + m.start(), start + m.end())
                        spans[span] = min(errors, spans.get(span, errors))
            end = -1
            for (a, b), errors in sorted(spans.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
                if a < end:
                    continue  # another reading of the same place
                end = b
                first = bisect_right(starts(), a + (joined[a : a + 1] == b" ")) - 1
                last = max(first, bisect_right(starts(), b - 1 - (joined[b - 1 : b] == b" ")) - 1)
                found.append({"label": label, "first": first, "last": last, "errors": errors, "length": length})
        least: dict[int, int] = {}  # of several notices read in one place, the one with the fewest edits counts
        for x in found:
            for w in range(x["first"], x["last"] + 1):
                least[w] = min(x["errors"], least.get(w, x["errors"]))
        clear = [x for x in found if x["errors"] <= min(least[w] for w in range(x["first"], x["last"] + 1))]
        score = max([0.0, *(1 - x["errors"] / x.pop("length") for x in clear)])
        return len(words), base, clear, 1.0 if base else score


def _all(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Add a struct column of words, exact places, notices (label, first and last word, errors) and score."""

    def make():
        scanner = Scanner()

        def work(texts: list[str]) -> list[pa.Array]:
            n, base, notices, score = zip(*map(scanner.scan, texts), strict=True) if texts else ([],) * 4
            return [pa.array(n, pa.int64()), pa.array(base, _ARROW), pa.array(notices, _ARROW), pa.array(score, pa.float64())]

        return work

    return map_texts(docs, text, FIELDS, make, keep)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: places and labels."""
    rows, s = scan(docs, keep=["doc_id"])
    base, every = f"{s}.base", F.concat(f"{s}.base.label", f"{s}.notices.label")
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return rows.select(
        "doc_id",
        f"{s}.n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(f"{base}.first").alias("first_word"),
        F.array_max(f"{base}.first").alias("last_word"),
        joined(F.col(f"{base}.label")).alias("base_labels"),
        joined(every).alias("labels"),
        f"{s}.score",
    )
