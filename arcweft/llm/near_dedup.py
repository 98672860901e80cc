"""Near duplicates: b-bit MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of ``width`` words.  Documents with equal sets are
one class, which its smallest id stands for.  A signature has ``SYMBOLS`` MinHash values of 16
bits, and the distance of two signatures is the number of symbols in which they differ.

The join finds every pair up to a distance ``T``: the symbols are split into T // 2 + 1 chunks,
so in some chunk the two differ in one symbol at most; each chunk is indexed once for each of
its symbols with that symbol left out, which enumerates the allowed error.  ``T`` is the least
distance beyond which a pair at the similarity threshold falls with a chance under ``MISS``.

Buckets are never expanded into all pairs.  Each bucket's smallest member, its hub, is compared
with the others: those within the distance are checked on their full sets, and what links is
joined into components.  A bucket whose other members are then in one component is finished.

The members of the rest are gathered by hub.  For two sets to link, the shingles in which they
differ must be few, and this symmetric difference stays the same when both are replaced by their
differences from any third set.  So each member is reduced to its difference from the shingles
that most members of its hub have, which is short for a near copy.  With ``weight`` w = |difference|
* (q + p) - |set| * (q - p) at the threshold p / q, two members link if and only if their weights
add up to at most 2 * (q + p) times what their differences have in common.  Then

* all whose weight and the least weight of the hub's members add up to 0 at most link with that
  member, the centre: one comparison of numbers each, and two others with a sum up to 0 are both
  among them;
* any other link needs one of the remaining members and a shared difference, as many of them as
  the weights say.  Differences are ordered by how many members have them, the rarest first;
  only those early enough to leave room for the rest are kept, and of these only those for which
  the least weight among the others that have them leaves room, too, which is asked twice.

What then still meets in a difference is checked on the full sets.  So every pair within the
distance is decided, and of a group of copies with edits of their own few pairs are made.

Cases: a null or empty text, or one of white space alone, has an empty set and links with
nothing; with fewer than ``width`` words the whole sequence is one shingle; repeated rows get
the same component and rows that share an id are one node; a null id is linked with nothing
and has a null component; extra columns pass through ``drop_near``; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, fresh, map_texts, release
from .components import components

SYMBOLS = 36
MISS = 1e-4
LANE, PER_LONG = 20, 3  # a symbol's 16 bits and 4 to spare
LONGS = SYMBOLS // PER_LONG
#: Ids up to this number are broadcast to pick their texts; above it the texts are shuffled.
BROADCAST_IDS = 200_000

_SIG = [f"s{i}" for i in range(LONGS)]
SIGNED = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    + [T.StructField(c, T.LongType()) for c in _SIG]
)
SET = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType()))])
#: Times that shared differences are filtered by the weights of those that have them.
BOUNDS = 2

_random = np.random.default_rng(20_240_601)
_TIMES = _random.integers(0, 2**64, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_WITH = _random.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words; forgotten when there are too many, for memory alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, width: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    x = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        x = (x ^ hashes[j : n + j]) * _C1
        x ^= x >> np.uint64(29)
        x *= _C2
        x ^= x >> np.uint64(32)
    return np.unique(x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of packed symbols per set; the sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.zeros((len(sets), LONGS), dtype=np.int64)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ _WITH[j]) * _TIMES[j], starts)
        symbol = ((least * _C2) >> np.uint64(48)).astype(np.int64)
        out[:, j // PER_LONG] |= symbol << (LANE * (j % PER_LONG))
    return out


def radius(threshold: Fraction, miss: float = MISS) -> int:
    """The least T with P(more than T symbols differ) <= miss at the threshold."""
    differ = 1 - float(threshold)
    tail, t = 1.0, -1
    while tail > miss:
        t += 1
        tail -= comb(SYMBOLS, t) * differ**t * (1 - differ) ** (SYMBOLS - t)
    return t


def chunks(t: int) -> list[list[int]]:
    """Symbol numbers of each chunk; with distance t, some chunk has one error at most."""
    return [c.tolist() for c in np.array_split(np.arange(SYMBOLS), t // 2 + 1)]


def _symbol(j: int) -> Column:
    return F.shiftright(F.col(f"s{j // PER_LONG}"), LANE * (j % PER_LONG)).bitwiseAND(F.lit(0xFFFF))


def keys(t: int) -> Column:
    """For each chunk and each of its symbols, a key of the chunk's other symbols."""
    found = []
    for c, members in enumerate(chunks(t)):
        for skip in members:
            rest = [_symbol(j) for j in members if j != skip]
            found.append(F.xxhash64(F.lit(c), F.lit(skip), *rest))
    return F.array(*found)


def distance(left: str, right: str) -> Column:
    """In how many symbols two signatures differ: lanes that aren't zero carry into their spare bits."""
    carry = sum(0xFFFF << (LANE * k) for k in range(PER_LONG))
    over = sum(0x10000 << (LANE * k) for k in range(PER_LONG))
    total = None
    for c in _SIG:
        lanes = (F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}")) + F.lit(carry)).bitwiseAND(F.lit(over))
        total = F.bit_count(lanes) if total is None else total + F.bit_count(lanes)
    return total


def signed(docs: DataFrame, width: int, text: str, id_col: str) -> DataFrame:
    """(id, n, digest, signature) of every row; digest and signature are null for an empty set."""

    def make():
        known = _Words()

        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingles(t, width, known) for t in texts]
            full = [s for s in sets if len(s)]
            sig = np.zeros((len(texts), LONGS), dtype=np.int64)
            empty = np.array([not len(s) for s in sets], dtype=bool)
            if full:
                sig[~empty] = signatures(full)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            counts = pa.array([len(s) for s in sets], pa.int64())
            return [counts, pa.array(digests, pa.binary()), *(pa.array(sig[:, i], mask=empty) for i in range(LONGS))]

        return work

    rows, s = map_texts(docs, text, SIGNED, make, keep=[id_col])
    return rows.select(F.col(f"`{id_col}`").alias("id"), f"{s}.*")


def sets_of(docs: DataFrame, ids: DataFrame, width: int, text: str, id_col: str, most: int) -> DataFrame:
    """(node, which, hashes) of the documents in ``ids``; ``which`` tells rows that share an id apart."""
    ids = cut(ids)
    small = ids.count() <= most
    picked = docs.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{text}`").alias("text"))
    picked = picked.join(F.broadcast(ids) if small else ids, "node", "left_semi")

    def make():
        known = _Words()

        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingles(t, width, known) for t in texts]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    rows, s = map_texts(picked, "text", SET, make, keep=["node"])
    return cut(rows.select("node", F.monotonically_increasing_id().alias("which"), f"{s}.*").where(F.size("hashes") > 0))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    close = F.col("common").cast("long") * threshold.denominator >= union.cast("long") * threshold.numerator
    return both.where(close).select("a", "b").distinct()


def weighed(stars: DataFrame, sets: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """The members of each hub with their differences from what most of them have.

    ``stars`` are (hub, node, component).  Returns (hub, node, component, w, own, lacks): the weight, what
    the member and few others have, and what it lacks of what most have; and by hub (hub, most, centre,
    low, high): what most members have, the member of the least weight, the least and the greatest weight.
    Shingles come with ``held``, the number of members whose differences have them; what a member has alone
    only takes places.
    """
    up, down = threshold.denominator + threshold.numerator, threshold.denominator - threshold.numerator
    members = stars.join(sets.select("node", "which"), "node")
    sizes = cut(members.groupBy("hub").agg(F.count(F.lit(1)).alias("m")))
    members = cut(members.join(sizes, "hub").withColumn("member", F.monotonically_increasing_id()))
    every = members.join(sets, ["node", "which"])

    often = every.select("hub", "m", F.explode("hashes").alias("shingle")).groupBy("hub", "shingle")
    often = often.agg(F.count(F.lit(1)).alias("count"), F.max("m").alias("m")).where("count > 1")
    often = often.withColumn("usual", F.col("count") * 2 > F.col("m"))
    held = F.when(F.col("usual"), F.col("m") - F.col("count")).otherwise(F.col("count"))
    often = cut(often.select("hub", "shingle", "usual", held.alias("held")))
    # more than half of a hub's members have each of these, so they are no more than twice a mean set
    usual = often.where("usual").groupBy("hub").agg(F.collect_list(F.struct("held", "shingle")).alias("most"))
    usual = cut(usual)

    most = F.coalesce(F.col("most.shingle"), F.array().cast("array<long>"))
    differ = every.join(usual, "hub", "left").select(
        "hub", "node", "component", "member", F.size("hashes").cast("long").alias("n"),
        F.array_except("hashes", most).alias("extra"), F.array_except(most, F.col("hashes")).alias("lacks"),
    )
    differ = cut(differ.withColumn("w", (F.size("extra") + F.size("lacks")) * F.lit(up).cast("long") - F.col("n") * down).drop("n"))
    few = often.where("NOT usual").select("hub", "shingle", "held")
    own = differ.select("hub", "member", F.explode("extra").alias("shingle")).join(few, ["hub", "shingle"])
    own = own.groupBy("member").agg(F.collect_list(F.struct("held", "shingle")).alias("own"))
    rows = differ.drop("extra").join(own, "member", "left").drop("member")
    centres = differ.groupBy("hub").agg(F.min(F.struct("w", "node")).alias("least"), F.max("w").alias("high"))
    centres = centres.select("hub", F.col("least.node").alias("centre"), F.col("least.w").alias("low"), "high")
    return cut(rows), cut(centres.join(usual, "hub", "left"))


PLACE = T.StructType([T.StructField(c, T.LongType()) for c in ("hub", "node", "component", "w", "low", "shingle", "after")])


def places(rows: DataFrame, centres: DataFrame, threshold: Fraction) -> DataFrame:
    """Differences by which a member can find another, and how many of its own come from there on.

    A member that isn't the centre's may meet all; the centre's may only meet the others.
    """
    twice = 2 * (threshold.denominator + threshold.numerator)
    open_ = centres.where("high + low > 0")  # otherwise all link with the centre
    both = rows.join(open_, "hub").select("hub", "node", "component", "own", "lacks", "most", "w", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "node", "component", "w", "low")]
            lists = {}
            for c in ("own", "lacks", "most"):
                column = batch.column(c)
                ends = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
                flat = column.flatten()  # nulls are left out
                lists[c] = ends, [f.to_numpy(zero_copy_only=False) for f in (flat.flatten() if pa.types.is_struct(flat.type) else [flat])]
            at, shingle, after = [], [], []
            for i in range(batch.num_rows):
                part = {c: [f[ends[i] : ends[i + 1]] for f in fields] for c, (ends, fields) in lists.items()}
                lacks = np.isin(part["most"][1], part["lacks"][0]) & (part["most"][0] > 1)
                held = np.concatenate([part["own"][0], part["most"][0][lacks]])
                mine = np.concatenate([part["own"][1], part["most"][1][lacks]])
                w, low = int(fixed[3][i]), int(fixed[4][i])
                other = low if w > -low else 1 - low
                need = max(1, -(-(w + other) // twice))
                order = np.lexsort((mine, held))[: max(0, len(mine) - need + 1)]
                at.append(np.full(len(order), i))
                shingle.append(mine[order])
                after.append(len(mine) - np.arange(len(order)))
            if at:
                at = np.concatenate(at).astype(np.int64)
                columns = [f[at].astype(np.int64) for f in fixed] + [np.concatenate(x).astype(np.int64) for x in (shingle, after)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=PLACE.names)

    return cut(both.mapInArrow(run, PLACE))


def difference_pairs(found: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): members of different components that share a difference early enough in both."""
    twice = 2 * (threshold.denominator + threshold.numerator)
    loose = F.col("w") + F.col("low") > 0
    for _ in range(BOUNDS):
        here = found.groupBy("hub", "shingle").agg(F.min("w").alias("any_w"), F.min(F.when(loose, F.col("w"))).alias("loose_w"), F.count(F.lit(1)).alias("k"))
        here = cut(here.where("k > 1 AND loose_w IS NOT NULL").drop("k"))
        room = F.col("after") * twice >= F.col("w") + F.when(loose, F.col("any_w")).otherwise(F.col("loose_w"))
        found = cut(found.join(here, ["hub", "shingle"]).where(room).drop("any_w", "loose_w"))
    found = found.withColumn("loose", loose)
    x, y = found.where("loose").alias("x"), found.alias("y")
    meet = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
    once = ~F.col("y.loose") | (F.col("x.node") < F.col("y.node"))
    room = F.least("x.after", "y.after") * twice >= F.col("x.w") + F.col("y.w")
    pairs = x.join(y, meet & once & room).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return pairs.distinct()


def near_groups(
    docs: DataFrame,
    width: int = 5,
    threshold: Fraction = Fraction(4, 5),
    text: str = "text",
    id_col: str = "doc_id",
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    t = radius(threshold)
    rows = cut(signed(docs, width, text, id_col))
    classes = rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest")
    nodes = cut(classes.agg(F.min("id").alias("node"), *[F.min(c).alias(c) for c in _SIG]))
    sig = nodes.select("node", F.struct(*_SIG).alias("sig"))

    entries = nodes.select("node", F.explode(keys(t)).alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    shared = cut(shared.where("hub < last").select("key", "hub"))  # written out, so that a skewed join can be split
    members = cut(entries.join(shared, "key").where("node != hub").select("key", "hub", "node"))

    # every bucket's smallest member with the others
    stars = cut(members.select("hub", "node").distinct())
    ids = stars.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    sets = sets_of(docs, ids, width, text, id_col, broadcast_ids)
    pairs = stars.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("p")), "a")
    pairs = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("q")), "b")
    pairs = cut(pairs.where(distance("p", "q") <= t).select("a", "b"))
    links = cut(confirmed(pairs, sets, threshold))
    release(docs.sparkSession)
    comps = cut(components(links))

    # buckets whose other members are in several components
    placed = cut(members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = cut(mixed.where("low < high").select("key"))
    stars = cut(placed.join(mixed, "key", "left_semi").select("hub", "node", "component").distinct())
    if not stars.isEmpty():
        del members, placed, mixed, pairs, entries, shared
        parts, centres = weighed(stars, sets, threshold)
        release(docs.sparkSession)
        near = parts.join(centres.select("hub", "centre", "low"), "hub").where("w + low <= 0 AND node != centre")
        near = near.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        near = cut(near)
        found = cut(difference_pairs(places(parts, centres, threshold), threshold))
        del parts, centres, comps
        release(docs.sparkSession)
        comps = cut(components(links.unionByName(near).unionByName(confirmed(found, sets, threshold))))
        release(docs.sparkSession)

    classes = nodes.select("digest", F.col("node").alias("least"))
    out = rows.select("id", "n", "digest").join(classes, "digest", "left")
    out = out.join(comps.select(F.col("node").alias("least"), "component"), "least", "left")
    least = F.when(F.col("id").isNotNull(), F.coalesce("component", "least", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def report(docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """One row per document."""
    rows = near_groups(docs, width, threshold)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def drop_near(
    docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The documents that are the smallest id of their component, with all columns."""
    name = fresh("gone", docs.columns)
    gone = near_groups(docs, width, threshold, text, id_col).where("id != component_id")
    gone = cut(gone.select(F.col("id").alias(name)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
