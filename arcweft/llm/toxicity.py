"""Toxicity: two class-conditional Kneser-Ney models of the characters of words.

Each class, toxic and ordinary, has a model of order ``ORDER`` over the characters of its
words, with absolute discounting.  What a class hasn't seen is smoothed by lower orders that
both classes share: continuation counts, that is in how many contexts an n-gram occurs at
all.  Most words of a toxic document are ordinary, so its likelihood mixes both models word by
word, ``SHARE`` of it toxic.  A document's score compares this log-likelihood with the ordinary
one, normalised by length, through a logistic curve.  The curve is fitted on one part of the
labelled rows with models of the other parts; the models that score are counted on all parts.

Counting covers every labelled training row, on the executors, and keeps every n-gram: tables
grow with the corpus.  Up to ``BROADCAST_GRAMS`` different n-grams the tables are broadcast, by
64-bit hashes; above it they stay distributed, are joined with the n-grams of the texts' different
words, and these words' scores with the texts.

Words are runs of ASCII digits and letters and of characters beyond ASCII, lower-cased.

Cases: a text without words (null, empty, white space) gets the share of toxic labels; without
labels of both kinds every score is that share, or 0 without any; repeated rows are scored
each and alike, and all rows of a labelled id are counted; a very long text is scored whole;
other columns are not read, so their names can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, crc_of, cut, labelled_sample, map_texts, slices

ORDER = 6
#: Characters that there may be; each has half an occurrence beforehand.
CHARS = 1 << 20
DISCOUNT = 0.95
#: Part of a toxic document's words that the toxic model accounts for.
SHARE = 0.02
#: Words that are added to a document's length, so that one odd word of a short text says little.
PRIOR_WORDS = 50
#: Labelled rows at most that the final curve is fitted on.
CURVE_SAMPLE = 4_000
#: Labels up to this number are broadcast to the texts; above it the texts are shuffled to them.
BROADCAST_LABELS = 2_000_000
#: N-grams up to this number are gathered and broadcast; above it they are joined.
BROADCAST_GRAMS = 2_000_000
#: Characters of different words that a task remembers before it hands on what it has.
HELD_CHARS = 1_000_000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
GRAM = T.StructType([T.StructField("gram", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("toxic", "ordinary")])
PLACE = T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.LongType()), T.StructField("gram", T.StringType())])
PAD, END = "\x02" * (ORDER - 1), "\x03"

_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def number(gram: np.ndarray, char: np.ndarray, k: int) -> np.ndarray:
    """Extend hashes of (k - 1)-grams by the character before them."""
    h = (gram ^ (char.astype(np.uint64) + np.uint64(k))) * _C1
    h = (h ^ (h >> np.uint64(31))) * _C2
    return h ^ (h >> np.uint64(29))


def places(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of orders 1 to ORDER that end at each place of the padded words.

    Also returns the places that are scored (a word's characters and its end), the word of
    each, and the characters.
    """
    texts = [w.decode("utf-8", "surrogatepass") for w in words]
    flat = np.frombuffer("".join([PAD + t + END for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.r_[0, np.cumsum(sizes + ORDER - 1)[:-1]]
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.repeat(starts + ORDER - 1 - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    found, h = [], np.zeros(len(flat), dtype=np.uint64)
    for k in range(1, ORDER + 1):
        before = flat if k == 1 else np.r_[np.zeros(k - 1, dtype=flat.dtype), flat[: 1 - k]]
        h = number(h, before, k)
        found.append(h)
    return found, at, word, flat


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task has seen: n-grams, and how often each class has them; one may come several times."""
    words: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for part in slices(batch, "text"):
            for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                words[y].update(words_of(t or ""))
            if sum(map(len, words[0])) + sum(map(len, words[1])) > HELD_CHARS:
                yield from _grams(*words)
                words = (Counter(), Counter())
    yield from _grams(*words)


def _grams(ordinary: Counter, toxic: Counter) -> Iterator[pa.RecordBatch]:
    words = list(ordinary | toxic)
    if not words:
        return
    found, at, word, flat = places(words)
    keys, first, which = np.unique(found[-1][at], return_index=True, return_inverse=True)
    often = []
    for c in (toxic, ordinary):
        weight = np.fromiter((c[w] for w in words), dtype=np.int64, count=len(words))[word]
        often.append(np.bincount(which, weights=weight, minlength=len(keys)).astype(np.int64))
    for g in np.array_split(np.arange(len(keys)), max(1, len(keys) // 50_000)):
        grams = flat[at[first[g]][:, None] + np.arange(1 - ORDER, 1)].tobytes().decode("utf-32-le", "surrogatepass")
        grams = [grams[i : i + ORDER] for i in range(0, len(grams), ORDER)]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(often[0][g]), pa.array(often[1][g])], names=GRAM.names)


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash lies among sorted keys; behind the last, where tables have 0, without one."""
    i = np.searchsorted(keys, h)
    return np.where(np.r_[keys, np.uint64(0)][i] == h, i, len(keys))


def _counts(at: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=n + 1).astype(np.float64)


@dataclass
class Model:
    """Tables beside the sorted hashes of their n-grams, with a 0 behind the last."""

    grams: np.ndarray
    top: np.ndarray  # toxic, ordinary: counts of the highest order
    contexts: np.ndarray
    ctx: np.ndarray  # the same of its contexts
    kinds: np.ndarray  # how many different characters follow these contexts
    #: Orders 2 to ORDER - 1: n-grams and their continuations, contexts and their continuations and kinds.
    lower: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    chars: np.ndarray
    single: np.ndarray
    total: float

    def packed(self) -> Model:
        """The same with counts in as few bytes as hold them, to send it."""
        return self._counts_as(lambda a: a.astype(np.min_scalar_type(int(a.max()))))

    def unpacked(self) -> Model:
        return self._counts_as(lambda a: a.astype(np.float64))

    def _counts_as(self, f: Callable[[np.ndarray], np.ndarray]) -> Model:
        lower = [(g, f(more), h, f(of), f(kinds)) for g, more, h, of, kinds in self.lower]
        return replace(self, top=f(self.top), ctx=f(self.ctx), kinds=f(self.kinds), lower=lower, single=f(self.single))

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """log of ((1 - SHARE) P(ordinary) + SHARE P(toxic)) / P(ordinary) of each word."""
        found, at, word, _ = places(words)
        shared = (self.single[_find(self.chars, found[0][at])] + 0.5) / self.total
        for k in range(2, ORDER):
            grams, more, contexts, of, kinds = self.lower[k - 2]
            g, h = _find(grams, found[k - 1][at]), _find(contexts, found[k - 2][at - 1])
            n = of[h]
            known = n > 0
            shared = np.where(known, (np.maximum(more[g] - DISCOUNT, 0) + DISCOUNT * kinds[h] * shared) / np.where(known, n, 1), shared)
        g, h = _find(self.grams, found[-1][at]), _find(self.contexts, found[-2][at - 1])
        logs = []
        for y in (0, 1):
            n = self.ctx[y][h]
            known = n > 0
            p = (np.maximum(self.top[y][g] - DISCOUNT, 0) + DISCOUNT * self.kinds[y][h] * shared) / np.where(known, n, 1)
            logs.append(np.log(np.where(known, p, shared)))
        ratio = np.bincount(word, weights=logs[0] - logs[1], minlength=len(words))
        return np.logaddexp(np.log(1 - SHARE), np.log(SHARE) + ratio)


class Scorer:
    """Normalised differences of texts; scores of words are remembered, bounded for memory alone."""

    def __init__(self, model: Model, limit: int = 300_000) -> None:
        self.model, self.limit = model, limit
        self.index: dict[bytes, int] = {}
        self.score = np.zeros(0)

    def differences(self, texts: list[str]) -> np.ndarray:
        """Per text the log-likelihood ratio by its number of words; NaN without words."""
        if len(self.index) > self.limit:
            self.index, self.score = {}, np.zeros(0)
        index, known, counts, found = self.index, len(self.index), [], []
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            found.extend([index.setdefault(w, len(index)) for w in words])
        if len(index) > known:
            self.score = np.concatenate([self.score, self.model.word_scores(list(index)[known:])])
        at, n = np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)
        # each text is summed by itself, so a score doesn't depend on what else is in the batch
        score = np.bincount(np.repeat(np.arange(len(n)), n), weights=self.score[at], minlength=len(n))
        return np.where(n > 0, score / (n + PRIOR_WORDS), np.nan)


def build(grams: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """Tables from the gathered n-grams.  Their ends and beginnings are all n-grams of lower orders."""
    chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, ORDER)
    ends, contexts = [], []
    h = c = np.zeros(len(chars), dtype=np.uint64)
    for k in range(1, ORDER + 1):
        h = number(h, chars[:, ORDER - k], k)
        ends.append(h)
        if k < ORDER:
            c = number(c, chars[:, ORDER - 1 - k], k)
            contexts.append(c)
    by_class = (toxic, ordinary)
    keys, at = np.unique(ends[-1], return_inverse=True)
    top = np.stack([_counts(at, len(keys), n) for n in by_class])
    before, at = np.unique(contexts[-1], return_inverse=True)
    ctx = np.stack([_counts(at, len(before), n) for n in by_class])
    kinds = np.stack([_counts(at[n > 0], len(before)) for n in by_class])
    lower, more = [], np.zeros(1)
    for k in range(ORDER, 1, -1):
        known, first = np.unique(ends[k - 1], return_index=True)
        if k < ORDER:
            h, at = np.unique(contexts[k - 2][first], return_inverse=True)
            lower.append((known, more, h, _counts(at, len(h), more[:-1]), _counts(at, len(h))))
        shorter, at = np.unique(ends[k - 2][first], return_inverse=True)
        more = _counts(at, len(shorter))  # in how many contexts each (k - 1)-gram occurs
    return Model(keys, top, before, ctx, kinds, lower[::-1], shorter, more, float(more.sum()) + 0.5 * CHARS)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each word, by their places."""
    for batch in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for w in batch.column("word").to_pylist():
            padded = PAD + w + END
            for i in range(len(w) + 1):
                for column, value in zip(rows, (w, i, padded[i : i + ORDER]), strict=True):
                    column.append(value)
                if len(rows[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=PLACE.names)
                    rows = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=PLACE.names)


def _ends(level: DataFrame) -> DataFrame:
    """The n-grams without their first character, and in how many contexts counted rows have them."""
    end = F.expr("substring(gram, 2)").alias("gram")
    return cut(level.groupBy(end).agg(F.sum((F.col("more") > 0).cast("long")).alias("more")))


def joined_word_scores(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(word, score) as of ``Model.word_scores``, by joins alone.

    An n-gram meets a row of each n-gram one character longer, so no key has more rows than there
    are characters, whatever the corpus; only a word's n-grams meet as many as words have them.
    """
    spelt = cut(words.mapInArrow(_spell, PLACE))
    asked = spelt.select("gram", F.lit(0).cast("long").alias("toxic"), F.lit(0).cast("long").alias("ordinary"))
    level = grams.select("gram", "toxic", "ordinary").unionAll(asked).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    levels = {ORDER: cut(level.withColumn("more", F.col("toxic") + F.col("ordinary")))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = _ends(levels[k + 1])
    total = float(levels[1].agg(F.sum("more")).first()[0] or 0) + 0.5 * CHARS
    shared = levels[1].select(F.col("gram").alias("end"), ((F.col("more") + 0.5) / total).alias("shared"))

    def smoothed(count: str, of: str, kinds: str) -> Column:
        p = (F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("shared")) / F.col(of)
        return F.when(F.col(of) > 0, p).otherwise(F.col("shared"))

    for k in range(2, ORDER + 1):
        context = Window.partitionBy(F.substring("gram", 1, k - 1))
        counts = ("more",) if k < ORDER else ("toxic", "ordinary")
        sums = {f"{c}_of": F.sum(c).over(context) for c in counts} | {f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(context) for c in counts}
        found = levels[k].withColumns(sums).withColumn("end", F.expr("substring(gram, 2)")).join(shared, "end")
        if k < ORDER:
            shared = cut(found.select(F.col("gram").alias("end"), smoothed("more", "more_of", "more_kinds").alias("shared")))
    p = [F.log(smoothed(c, f"{c}_of", f"{c}_kinds")) for c in ("toxic", "ordinary")]
    ratios = found.select("gram", (p[0] - p[1]).alias("ratio"))
    each = F.array_sort(F.collect_list(F.struct("at", "ratio")))  # one order of summing, so that runs agree
    ratio = F.aggregate(each, F.lit(0.0), lambda so_far, x: so_far + x["ratio"])
    rows = spelt.join(ratios, "gram").groupBy("word").agg(ratio.alias("ratio"))
    a, b = F.lit(float(np.log(1 - SHARE))), F.col("ratio") + float(np.log(SHARE))
    return rows.select("word", (F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))).alias("score"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different words and how often it has them; a null word for a text without."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, words, often = [], [], []
            for row, t in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                bag = Counter(words_of(t or "")) or {None: 0}
                rows.extend([row] * len(bag))
                words.extend([w if w is None else w.decode("utf-8", "surrogatepass") for w in bag])
                often.extend(bag.values())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(often, pa.int64())], names=["row", "word", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of a task; one may come several times."""
    words: set[bytes] = set()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string())], names=["word"])

    for batch in batches:
        for part in slices(batch, "text"):
            for t in part.column("text").to_pylist():
                words.update(words_of(t or ""))
            if sum(map(len, words)) > HELD_CHARS:
                yield out()
                words = set()
    yield out()


Differences = Callable[[DataFrame, list[str]], DataFrame]


def _joined(docs: DataFrame, grams: DataFrame) -> Differences:
    """Normalised differences of documents by joins with their words' scores."""
    bounded_batches(docs.sparkSession)
    scores = cut(joined_word_scores(grams, docs.select("text").mapInArrow(_words, "word string").distinct()))

    def differences(rows: DataFrame, keep: list[str]) -> DataFrame:
        rows = cut(rows.select(*keep, "text", F.monotonically_increasing_id().alias("row")))
        bags = rows.select("row", "text").mapInArrow(_bags, "row long, word string, n long")
        n = F.sum("n")
        d = F.when(n > 0, F.sum(F.col("n") * F.col("score")) / (n + PRIOR_WORDS)).otherwise(F.lit(float("nan")))
        found = bags.join(scores, "word", "left").groupBy("row").agg(d.alias("d"))
        return rows.drop("text").join(found, "row").select(*keep, "d")

    return differences


def _broadcast(docs: DataFrame, grams: DataFrame) -> Differences:
    """The same from tables that every task has."""
    found = grams.toArrow()  # at most BROADCAST_GRAMS rows
    model = build(found["gram"].to_pylist(), found["toxic"].to_numpy(), found["ordinary"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    schema = T.StructType([T.StructField("d", T.DoubleType())])

    def make():
        scorer = Scorer(shared.value.unpacked())
        return lambda texts: [pa.array(scorer.differences(texts), pa.float64())]

    def differences(rows: DataFrame, keep: list[str]) -> DataFrame:
        scored, s = map_texts(rows, "text", schema, make, keep=keep)
        return scored.select(*keep, f"{s}.d")

    return differences


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x, the rare label weighing more, on a scale of one spread of x."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y > 0, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    w, hold = np.zeros(2), np.diag([0.1, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        bend = a.T @ (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + hold
        w += np.clip(np.linalg.solve(bend, a.T @ (weight * (y - p)) - hold @ w), -4, 4)
    return max(0.0, float(w[0])) / scale, float(w[1])


def count(docs: DataFrame, labels: DataFrame, part: Column, most: int = BROADCAST_GRAMS) -> Differences:
    """Count the models on all labelled rows of ``part``."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counted = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(part)
    small = counted.count() <= BROADCAST_LABELS
    rows = docs.select("doc_id", "text").join(F.broadcast(counted) if small else counted, "doc_id").select("text", "y")
    bounded_batches(docs.sparkSession)
    grams = rows.mapInArrow(count_grams, GRAM).groupBy("gram")
    grams = cut(grams.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    return (_broadcast if grams.count() <= most else _joined)(docs, grams)


def fit_curve(differences: Differences, sample: DataFrame) -> tuple[tuple[float, float], float]:
    """The curve from differences to scores, and the share of toxic rows."""
    scored = differences(sample, ["doc_id", "y"]).toPandas().sort_values("doc_id")
    y, d = scored["y"].to_numpy(dtype=float), scored["d"].to_numpy(dtype=float)
    share = float(y.mean()) if len(y) else 0.0
    full = ~np.isnan(d)
    if len(set(y[full].tolist())) == 2:
        return _curve(d[full], y[full]), share
    return (0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))), share


def fit(docs: DataFrame, labels: DataFrame, part: Column, most: int) -> tuple[Differences, tuple[float, float], float]:
    """Models of all rows of parts 1 to 4; a curve from one part, by models of the others."""
    learnt = part.isin(1, 2, 3, 4)
    for rest in (4, 3, 2, 1):  # the first that has both labels
        sample = cut(labelled_sample(docs, labels, "toxic", CURVE_SAMPLE, part == rest))
        if sample.select("y").distinct().count() == 2:
            curve, share = fit_curve(count(docs, labels, learnt & (part != rest), most), sample)
            if curve[0] > 0:
                return count(docs, labels, learnt, most), curve, share
    differences = count(docs, labels, learnt, most)
    return differences, *fit_curve(differences, labelled_sample(docs, labels, "toxic", CURVE_SAMPLE, learnt))


def report(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per document: its score, from models that never saw held-out labels."""
    part = crc_of("doc_id") % 5
    differences, (slope, shift), share = fit(docs, labels, part, most)
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), slope * F.col("d") + shift))
    score = F.when(F.isnan("d"), F.lit(share)).otherwise(1 / (1 + F.exp(-z)))
    held = F.coalesce(part == 0, F.lit(False))
    rows = differences(docs, ["doc_id"]).select("doc_id", held.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
