"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is good or bad.  Features describe the line, its neighbours, and what the lines
have in common; transitions tie a line to the next.  The field is trained by gradient ascent
on at most ``SAMPLE`` labelled documents of together at most ``LINES`` lines, whose label all their
lines carry; features are taken on the executors, and only these numbers come to the driver.  Forward-backward
gives each line's probability of being good; their mean, weighted by the lines' lengths, goes
through a logistic curve fitted on the same documents and is the document's score.

Lines are ``\\n``-split; lines of white space alone are passed over.  Recursions run over the
lines of many documents side by side, so a batch costs as many steps as its longest document
has lines.

Cases: a text without a line (null, empty, white space) gets the share of good labels; without
labels of both kinds every score is that share, or 0.5 without any; repeated rows are scored
each, and of the texts of one labelled id the least is learned from; a very long text is scored
whole, but one of more than ``LINES`` lines isn't learned from; other columns are not read, so
their names can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_of, cut, labelled_sample, map_texts
from .text_stats import BLANKS, DIGITS, MARKS, SYMBOLS, UPPER, histogram, repeated, total, word_ids

SAMPLE = 3_000
#: Lines of the documents that the field is trained on, about 140 bytes each on the driver.
LINES = 400_000
ROUNDS = 120
OWN = 9  # features of a line by itself
FEATURES = 1 + OWN + 2 * 3  # a constant, its own, and three of each neighbour
#: A chain is cut after so many lines for training, whose recursions take a step a line; scores come from whole chains.
STRETCH = 256
#: Documents whose lines are held at once.
SIDE_BY_SIDE = 512


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of features and the length of every line that has a word."""
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip(BLANKS)]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0)
    words = [x.split() for x in lines]
    counts = np.array([len(w) for w in words])
    again = repeated(word_ids([w for ws in words for w in ws]))
    often = np.add.reduceat(again, np.r_[0, np.cumsum(counts)[:-1]])
    own = np.zeros((len(lines), OWN))
    seen: set[bytes] = set()
    before = None
    for i, line in enumerate(lines):
        h, n = histogram(line), len(line)
        own[i] = (
            total(h, SYMBOLS) / n,
            total(h, UPPER) / n,
            total(h, DIGITS) / n,
            min(1.0, total(h, MARKS) / counts[i]),
            min(20.0, n / counts[i]) / 20,
            np.log1p(counts[i]) / 8,
            line == before,
            line in seen,
            often[i] / counts[i],
        )
        seen.add(line)
        before = line
    x = np.zeros((len(lines), FEATURES))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    near = own[:, [0, 1, 8]]
    x[1:, 1 + OWN : 4 + OWN] = near[:-1]
    x[:-1, 4 + OWN :] = near[1:]
    return x, np.array([len(line) for line in lines], dtype=float)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def marginals(score: np.ndarray, starts: np.ndarray, counts: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Forward-backward over many chains whose lines lie one after another in ``score`` (lines x 2).

    Returns each line's label probabilities and, with ``pairs``, the expected number of each
    transition.  Chains are ordered by length, so step k works on those that have a line k.
    """
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0])
    alive = [int(np.searchsorted(-counts, -k, side="left")) for k in range(longest + 1)]  # chains longer than k
    forward, backward = np.empty_like(score), np.zeros_like(score)
    forward[starts] = score[starts]
    for k in range(1, longest):
        at = starts[: alive[k]] + k
        forward[at] = score[at] + _logsum(forward[at - 1][:, :, None] + step[None], 1)
    for k in range(longest - 2, -1, -1):
        at = starts[: alive[k + 1]] + k
        backward[at] = _logsum(step[None] + (score[at + 1] + backward[at + 1])[:, None, :], 2)
    norm = np.empty(len(counts))
    norm[:] = _logsum(forward[starts + counts - 1], 1)
    which = np.empty(len(score), dtype=np.int64)
    lines = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(score))
    which[lines] = np.repeat(np.arange(len(counts)), counts)
    gamma = np.exp(forward + backward - norm[which][:, None])
    if not pairs:
        return gamma
    first = np.zeros(len(score), dtype=bool)
    first[starts] = True
    to = np.flatnonzero(~first)
    joint = forward[to - 1][:, :, None] + step[None] + (score[to] + backward[to])[:, None, :] - norm[which[to]][:, None, None]
    return gamma, np.exp(joint).sum(axis=0)


@dataclass
class Field:
    """Weights of the bad and the good label, transitions, and the curve from the mean to the score."""

    weights: np.ndarray
    step: np.ndarray
    slope: float
    shift: float
    empty: float

    def means(self, texts: list[str]) -> np.ndarray:
        """Length-weighted probability of good; NaN for a text without lines."""
        out = np.full(len(texts), np.nan)
        for a in range(0, len(texts), SIDE_BY_SIDE):
            rows = [line_features(t) for t in texts[a : a + SIDE_BY_SIDE]]
            out[a : a + len(rows)] = self._means(rows)
        return out

    def _means(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(rows), np.nan)
        full = [i for i, (x, _) in enumerate(rows) if len(x)]
        if not full:
            return out
        counts = np.array([len(rows[i][0]) for i in full])
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        good = marginals(np.concatenate([rows[i][0] for i in full]) @ self.weights, starts, counts, self.step)[:, 1]
        size = np.concatenate([rows[i][1] for i in full])
        out[full] = np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        means = self.means(texts)
        curve = 1 / (1 + np.exp(-(self.slope * (means - 0.5) + self.shift)))
        return np.where(np.isnan(means), self.empty, curve)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, slightly held towards zero."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hold = np.diag([0.05, 1e-6])
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, a.T @ (y - p) - hold @ w)
    return max(0.0, float(w[0])), float(w[1])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """From the features and lengths of each document's lines, and its label."""
    share = float(labels.mean()) if len(labels) else 0.5
    full = np.array([len(x) > 0 for x, _ in rows], dtype=bool)
    weights, step = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    rows, y = [r for r, f in zip(rows, full, strict=True) if f], labels[full] if len(labels) else labels
    if not rows or len(set(y.tolist())) < 2:
        return Field(weights, step, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), share)
    counts = np.array([len(x) for x, _ in rows])
    x = np.concatenate([r[0] for r in rows])
    label = np.repeat(y, counts)
    starts = np.concatenate([np.arange(end - n, end, STRETCH) for n, end in zip(counts, np.cumsum(counts), strict=True)])
    counts = np.diff(np.r_[starts, len(x)])
    seen = np.zeros((len(x), 2))
    seen[np.arange(len(x)), label] = 1
    inner = np.ones(len(x), dtype=bool)
    inner[starts] = False
    steps = np.zeros((2, 2))
    for k in (0, 1):
        steps[k, k] = (inner & (label == k)).sum()  # within a stretch all lines have one label
    grads = [np.zeros_like(weights), np.zeros_like(step)]
    moments = [np.zeros_like(weights), np.zeros_like(step)]
    for r in range(1, rounds + 1):
        gamma, joint = marginals(x @ weights, starts, counts, step, pairs=True)
        now = [(x.T @ (seen - gamma)) / len(x) - 1e-4 * weights, (steps - joint) / len(x) - 1e-3 * step]
        for k, at in enumerate((weights, step)):
            grads[k] = 0.9 * grads[k] + 0.1 * now[k]
            moments[k] = 0.99 * moments[k] + 0.01 * now[k] ** 2
            at += 0.25 * (grads[k] / (1 - 0.9**r)) / (np.sqrt(moments[k] / (1 - 0.99**r)) + 1e-8)
    field = Field(weights, step, 1.0, 0.0, share)
    slope, shift = _curve(field._means(rows) - 0.5, y.astype(float))
    return Field(weights, step, slope, shift, share)


LINED = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType()), T.StructField("size", T.BinaryType())])


def fit(docs: DataFrame, labels: DataFrame, part: Column | None = None, sample: int = SAMPLE, most: int = LINES) -> Field:
    """Train on labelled documents of ``part``, at most ``sample`` of them and ``most`` lines, the first by a hash of their id."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            rows = [line_features(t) for t in texts]
            sent = [(x.tobytes(), size.tobytes()) if len(x) <= most else (None, None) for x, size in rows]
            return [pa.array([len(x) for x, _ in rows], pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*sent, strict=True))]

        return work

    rows, s = map_texts(labelled_sample(docs, labels, "quality", sample, part), "text", LINED, make, keep=["doc_id", "y"])
    rows = cut(rows.select("doc_id", "y", F.xxhash64("doc_id").alias("h"), f"{s}.*"))
    counts = rows.select("doc_id", "h", "n").toPandas().sort_values(["h", "doc_id"])
    taken, so_far = [], 0
    for i, n in zip(counts["doc_id"].tolist(), counts["n"].tolist(), strict=True):
        if so_far + n <= most:
            taken.append((i,))
            so_far += n
    if len(taken) < len(counts):
        ids = docs.sparkSession.createDataFrame(taken, T.StructType([rows.schema["doc_id"]]))
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``sample`` ids
    found = rows.toPandas().sort_values("doc_id")
    lines = [(np.frombuffer(x).reshape(-1, FEATURES), np.frombuffer(size)) for x, size in zip(found["x"], found["size"], strict=True)]
    return train(lines, found["y"].to_numpy(dtype=int))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: its score, from a field that never saw held-out labels."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, crc_of("doc_id") % 3 != 1, sample))  # a few numbers
    schema = T.StructType([T.StructField("score", T.DoubleType())])

    def make():
        return lambda texts: [pa.array(field.value.scores(texts), pa.float64())]

    rows, s = map_texts(docs, "text", schema, make, keep=["doc_id"])
    held = F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), f"{s}.score", (F.col(f"{s}.score") >= 0.5).cast("int").alias("predicted"))
