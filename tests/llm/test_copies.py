"""Exact and near duplicates and the mix, against brute force."""

import random
from fractions import Fraction
from itertools import combinations

import pytest

from arcweft.llm import exact_dedup, mixing, near_dedup
from arcweft.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text[, source]) rows."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def brute_exact(rows):
    out = []
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, -(x or 0)))):
            out.append((i, keep, len(ids), n == 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 300])
def test_exact(spark, hot):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "b"), (6, "b"), (7, "c"), (None, "c"), (None, "lost"), (8, "x" * 100_000), (9, "x" * 100_000)]
    rows += [(100 + k, "hot text") for k in range(hot)] + [(500 + k, "x" * 60 + str(k)) for k in range(50)]
    found = exact_dedup.report(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == brute_exact(rows)
    import hashlib

    want = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}
    assert {(r.doc_id, r.text_sha256) for r in found} == want


def test_exact_keeps_columns(spark):
    rows = spark.createDataFrame([(1, None, 5, "k"), (2, "", 6, None), (3, "z", 7, "h")], "doc_id long, text string, kept int, h string")
    left = exact_dedup.drop_copies(rows)
    assert left.columns == rows.columns
    assert sorted(tuple(r) for r in left.collect()) == [(2, "", 6, None), (3, "z", 7, "h")]
    odd = rows.withColumnRenamed("kept", "no_text").withColumnRenamed("h", "rest")
    assert exact_dedup.drop_copies(odd).columns == odd.columns and exact_dedup.drop_copies(odd).count() == 2
    assert exact_dedup.report(rows.limit(0)).isEmpty() and exact_dedup.drop_copies(rows.limit(0)).isEmpty()


def shingled(text, width):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)])


def brute_near(rows, width, threshold):
    sets = [(i, shingled(t, width)) for i, t, *_ in rows]
    part = {i: i for i, _ in sets if i is not None}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for (i, a), (j, b) in combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if len(a & b) >= threshold * len(a | b):
            x, y = find(i), find(j)
            part[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_rows(seed=1):
    """Groups with few to many edits, chains, and a large group around one base."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, i = [], 0
    for size, copies, most in ((60, 6, 3), (200, 8, 12), (90, 60, 5), (40, 5, 1), (300, 10, 25)):
        base = text(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
    w = text(80)
    for _ in range(12):  # each is close to the next alone
        rows.append((i, "\n".join(w)))
        i += 1
        w = w[2:] + text(2)
    shared = text(50)
    for _ in range(30):  # a common passage, no links
        rows.append((i, " ".join(text(60) + shared)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "  \n"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (i + 6, "é É"), (i + 7, "É é"), (0, rows[0][1]), (None, rows[0][1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "threshold"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near(spark, width, threshold):
    rows = near_rows()
    found = near_dedup.report(docs(spark, rows), width, threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_near(rows, width, threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 9, "x"), (2, "A b c d e f", 8, "y"), (3, None, 7, None)], "doc_id long, text string, id long, component_id string")
    left = near_dedup.drop_near(rows)
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert near_dedup.drop_near(rows.limit(0)).isEmpty()


def test_every_pair_within_the_radius_shares_a_key():
    rng = random.Random(5)
    for threshold in (Fraction(85, 100), Fraction(4, 5)):
        t = near_dedup.radius(threshold)
        chunks = near_dedup.chunks(t)
        assert sorted(j for c in chunks for j in c) == list(range(near_dedup.SYMBOLS))
        for _ in range(500):
            wrong = set(rng.sample(range(near_dedup.SYMBOLS), t))
            assert any(len(wrong & set(c)) <= 1 for c in chunks)


def test_near_with_a_large_group_whose_hubs_miss(spark):
    """Copies of one base with many edits each, the worst first: hubs link few of them."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(max(1, 14 - k // 12)):
            w[rng.randrange(150)] = f"e{rng.randrange(3000)}"
        rows.append((k, " ".join(w)))
    for k in range(160, 200):  # edits in common, too many for the base
        w = list(base)
        for j in range(0, 150, 12):
            w[j] = f"v{k % 3}"
        w[rng.randrange(150)] = f"e{k}"
        rows.append((k, " ".join(w)))
    rows += [(7, "another text of the same id altogether"), (7, rows[7][1]), (300, "another text of the same id, altogether")]
    for width, threshold in ((3, Fraction(85, 100)), (5, Fraction(4, 5))):
        sets = {}
        for i, t in rows:
            sets.setdefault(i, []).append(shingled(t, width))
        part = {i: i for i in sets}

        def find(x, part=part):
            while part[x] != x:
                x = part[x]
            return x

        for i, j in combinations(sorted(sets), 2):
            if any(len(a & b) >= threshold * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                part[max(x, y)] = min(x, y)
        found = near_dedup.report(docs(spark, rows), width, threshold).collect()
        assert {(r.doc_id, r.component_id) for r in found} == {(i, find(i)) for i in sets}
        assert 5 < len({find(i) for i in sets}) < 150


def test_near_shuffles_ids_beyond_the_limit_of_a_broadcast(spark):
    rows = near_rows(4)[:60]
    few, none = (sorted(near_dedup.near_groups(docs(spark, rows), broadcast_ids=k).collect(), key=str) for k in (10**6, 0))
    assert few == none


def test_pairs_meet_in_few_differences(spark):
    """A group of copies with edits of their own makes less than one in a hundred of its pairs."""
    rng = random.Random(3)
    rows, size = [], 400
    for k in range(size):
        w = [f"b{j}" for j in range(200)]
        for _ in range(rng.randint(2, 24)):
            w[rng.randrange(200)] = f"e{k}-{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = near_dedup.sets_of(docs(spark, rows), spark.range(size).withColumnRenamed("id", "node"), 5, "text", "doc_id", 10**6)
    stars = spark.createDataFrame([(0, k, k) for k in range(1, size)], "hub long, node long, component long")
    parts, centres = near_dedup.weighed(stars, sets, Fraction(4, 5))
    pairs = near_dedup.difference_pairs(near_dedup.places(parts, centres, Fraction(4, 5)), Fraction(4, 5))
    assert pairs.count() < size * (size - 1) // 2 // 100


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)]
    part = {x: x for e in edges for x in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in part if x in found} and set(part) - set(found) <= loops
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_write_few_files_for_few_edges(spark, monkeypatch):
    """Forty partitions of shuffles make no forty files a round of thirty edges."""
    from arcweft.llm import components as module

    written = []

    def cut(df, real=module.cut):
        out = real(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut", cut)
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        found = {r.node: r.component for r in components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")).collect()}
        assert found == dict.fromkeys(range(31), 0)
        assert len(written) > 4 and set(written[1:]) == {1}  # the first one is of the pairs as they came
        monkeypatch.setattr(module, "EDGES_A_TASK", 1)
        found = {r.node: r.component for r in components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")).collect()}
        assert found == dict.fromkeys(range(31), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_targets(sizes):
    """Shares by weight; what is above a bound is shared again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


def test_mix(spark):
    rng = random.Random(3)
    rows = []
    for name, n, longest in (("big", 900, 60), ("small", 15, 20), ("é", 200, 30), ("z", 120, 300), (None, 80, 40), ("none", 3, 0)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(0, longest)) if k else None, name) for k in range(n)]
    rows.append((None, "x y", "big"))
    rows.append(rows[-1])
    found = mixing.report(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    of = {i: s for i, _, s in rows}
    for r in found:
        sizes[of[r.doc_id]] = sizes.get(of[r.doc_id], 0) + r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
        assert r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) < 1e-6
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s, t in want.items():
        longest = max(r.size for r in found if of[r.doc_id] == s)
        assert abs(taken[s] - t) <= 3 * longest + 0.03 * t, s
    again = mixing.report(docs(spark, rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_mixture_repeats_documents(spark):
    rows = [(k, "w " * (k % 7 + 1), "a" if k % 5 else "b") for k in range(300)]
    frame = docs(spark, rows)
    mixed = mixing.mixture(frame)
    assert mixed.columns == frame.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    copies = {r.doc_id: r.taken // r.size for r in mixing.report(frame).collect()}
    assert counts == {k: n for k, n in copies.items() if n}
    assert mixing.mixture(frame.limit(0)).isEmpty() and mixing.report(frame.limit(0)).isEmpty()
    clash = frame.withColumn("copies", frame.doc_id).withColumn("size", frame.lang).withColumn("one", frame.text)
    assert mixing.mixture(clash).columns == clash.columns
    assert {r.taken for r in mixing.report(docs(spark, [(1, None, None), (2, "  ", "a")])).collect()} == {0}
