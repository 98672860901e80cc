"""Quality rules: a learned decision list over statistics of each text.

Fixed base rules come first.  The rest is learned by sequential covering: rules that reject are
grown as conjunctions of thresholds on two thirds of the labelled rows, pruned on the other
third, and kept if they are precise; what a rule covers is set aside before the next one.  Every
middle between two neighbouring values is tried as a threshold.  The list becomes one ordered
Spark conditional expression over the statistics.

It is fitted on at most ``SAMPLE`` labelled documents, the first by a hash of their id; all
documents are judged, over their whole texts.

Cases: a null or empty text has no words, so the base rules reject it; without usable labels
the list is empty and only the base rules reject; repeated rows are judged each, and of the
texts of one labelled id the least is learned from; ties between rules go to the first
statistic and the least threshold; a very long text is judged whole; extra columns, whatever
their names, pass through ``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import labelled_sample, map_texts
from .text_stats import COUNTS, text_counts

SAMPLE = 20_000
FIELDS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

#: Statistics that rules may test: name, numerator, denominator (None: the count itself).
RATIOS = (
    ("symbols per character", "n_symbols", "word_chars"),
    ("repeated lines", "n_dup_lines", "n_lines"),
    ("repeated words", "n_repeat_words", "n_words"),
    ("capitals per character", "n_upper", "word_chars"),
    ("digits per character", "n_digits", "word_chars"),
    ("exclamations per word", "n_marks", "n_words"),
    ("characters per word", "word_chars", "n_words"),
    ("words", "n_words", None),
)


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Add the counts of each text as one struct column; returns its name, too."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            columns = zip(*map(text_counts, texts), strict=True) if texts else [[]] * len(COUNTS)
            return [pa.array(c, pa.int64()) for c in columns]

        return work

    return map_texts(docs, text, FIELDS, make, keep)


def base_failed(get) -> Column:
    return (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))


@dataclass(frozen=True)
class Condition:
    ratio: int
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.ratio] >= self.bound if self.above else x[:, self.ratio] <= self.bound

    def column(self, get) -> Column:
        _, top, bottom = RATIOS[self.ratio]
        value = get(top).cast("double")
        if bottom:
            value = F.coalesce(F.try_divide(value, get(bottom).cast("double")), F.lit(0.0))
        return value >= self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{RATIOS[self.ratio][0]} {'>=' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(values: np.ndarray, bad: np.ndarray, old: float) -> tuple[float, float, bool]:
    """Gain, threshold and side of the best cut between neighbouring values; all of them are tried."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    ends = np.flatnonzero(values[1:] > values[:-1])
    if not len(ends):
        return 0.0, 0.0, True
    below = np.cumsum(bad[order])[ends]
    best = (0.0, 0.0, True)
    for above, q, n in ((True, bad.sum() - below, len(values) - 1 - ends), (False, below, ends + 1)):
        gain = np.where(q > 0, q * (np.log2(np.maximum(q, 1) / n) - old), 0.0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), float((values[ends[k]] + values[ends[k] + 1]) / 2), above)
    return best


def grow(x: np.ndarray, bad: np.ndarray, longest: int) -> Rule:
    """Add the condition of the best information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < longest and (p := int((inside & bad).sum())) and (inside & ~bad).any():
        old = np.log2(p / inside.sum())
        tries = [_best(x[inside, k], bad[inside], old) for k in range(x.shape[1])]
        k = max(range(len(tries)), key=lambda k: tries[k][0])  # of equal gains the first statistic's
        gain, bound, above = tries[k]
        if gain <= 1e-9:
            break
        rule += (Condition(k, above, bound),)
        inside &= rule[-1].holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop the last conditions as long as the rule's worth on other rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = covers(r, x)
        return float(((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum()))

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(
    x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 3, longest: int = 3, most: int = 12, tries: int = 48
) -> list[Rule]:
    """Rules that reject, in order.  ``bad`` marks the rows to cover.

    A rule must be precise on all rows that are left and on the third that it wasn't grown on.  The bad rows
    that a refused one covers seed no further rule; other rules may still cover them.
    """
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    seeds = left.copy()
    rules: list[Rule] = []
    while len(rules) < most and tries and (seeds & bad).sum() >= least:
        tries -= 1
        fit, test = seeds & ~third, seeds & third
        rule = prune(grow(x[fit], bad[fit], longest), x[test], bad[test])
        if not rule:
            break
        hit = covers(rule, x) & left
        good = [(hit & part & ~bad).sum() <= (1 - precision) * (hit & part).sum() for part in (left, third)]
        if all(good) and (hit & bad).sum() >= least and (hit & bad & third).any():
            rules.append(rule)
            left &= ~hit
            seeds &= ~hit
        else:
            seeds &= ~(hit & bad)
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from labelled documents that the base rules keep."""
    rows, s = with_counts(labelled_sample(docs, labels, "quality", sample), keep=["doc_id", "y"])
    get = lambda c: F.col(f"{s}.{c}")
    found = rows.where(~base_failed(get)).select("doc_id", "y", f"{s}.*").toPandas().sort_values("doc_id")
    if not len(found):
        return []
    columns = []
    for _, top, bottom in RATIOS:
        value = found[top].to_numpy(dtype=float)
        columns.append(value / np.maximum(1, found[bottom].to_numpy(dtype=float)) if bottom else value)
    return learn(np.column_stack(columns), found["y"].to_numpy() == 0)


def verdict(rules: list[Rule], get) -> Column:
    """The decision list: false from the first rule that holds, else true."""
    keep = F.when(base_failed(get), False)
    for rule in rules:
        condition = rule[0].column(get)
        for c in rule[1:]:
            condition &= c.column(get)
        keep = keep.when(condition, False)
    return keep.otherwise(True)


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: its statistics and verdict."""
    rules = fit(docs, labels, sample)
    rows, s = with_counts(docs, keep=["doc_id"])
    get = lambda c: F.col(f"{s}.{c}")
    shown = [get(c).alias(c) for c in COUNTS[:5]]
    return rows.select("doc_id", *shown, base_failed(get).alias("base_failed"), verdict(rules, get).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that neither the base rules nor a learned rule rejects, with all columns."""
    rules = fit(docs, labels, sample)
    rows, s = with_counts(docs)
    get = lambda c: F.col(f"{s}.{c}")
    return rows.where(verdict(rules, get)).select(*[F.col(f"`{c}`") for c in docs.columns])
