"""Operators on single texts, against brute force, libraries and held-out rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers

from arcweft.llm import html_text, licenses, line_crf, quality_rules, sentencepieces, text_stats, token_counts, toxicity
from arcweft.llm.bpe import PieceVocabulary, WordCache
from arcweft.llm._common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "  lead", "Hello  world\n\nfoo\tbar  ", "ﬁ ½ ①é \xa0x　y", "<s> a</s> <0x0A> <unk>", "▁a ▁", "a\0b​", "日本語テキスト",
    "a" * 5000, "thethe" * 700, "\r\n {\r\n" * 20, " " * 777, "😀😀 x", "ab " * 20_000,
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abthe in▁ ion\r\n)}{;thand") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    return ODD + made


def test_pieces_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    rows = {r.doc_id: r for r in sentencepieces.encode_decode(frame(spark, texts).repartition(3), MODEL, keep=["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert rows[i].ids == want and rows[i].decoded == library.decode(want)


def test_decoding_any_ids():
    from sentencepiece import SentencePieceProcessor

    library, decoder, rng = SentencePieceProcessor(model_file=MODEL), PieceVocabulary.load(MODEL).decoder(), random.Random(6)
    for _ in range(300):
        ids = [rng.choice((rng.randrange(3, 32000), rng.randrange(3, 259))) for _ in range(rng.randint(0, 12))]
        assert decoder.text(ids) == library.decode(ids)


def test_counts_match_the_libraries(spark):
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    texts = odd_texts()
    library = SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in token_counts.with_limit(frame(spark, texts), MODEL).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = token_counts.load_vocabulary(path, public_tokenizers.PATTERN)
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = [t or "" for t in texts]
    assert WordCache(vocabulary).counts(plain).tolist() == [len(own.encode_ordinary(t)) for t in plain]


def test_a_small_cache_changes_nothing():
    vocabulary, texts = PieceVocabulary.load(MODEL), [t or "" for t in odd_texts()]
    whole, small = WordCache(vocabulary), WordCache(vocabulary, limit=5)
    for t in texts:
        assert small.counts([t]).tolist() == whole.counts([t]).tolist()


# -- HTML -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("no tags at all, but a sentence that is long enough. It has two parts.", "no tags at all, but a sentence that is long enough. It has two parts."),
        ("<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head</h1><p>One  two\n three.<p>Four &amp;amp; &eacute;</article><footer>&copy; x</footer>", "Head\nOne two three.\nFour &amp; é"),
        ("<body><div class='sidebar'><p>Some words here.</p></div><main><p>First paragraph of the text.</p><div class='ad'>Buy now</div><p>Second one, too.</p></main>", "First paragraph of the text.\nSecond one, too."),
        ("<article><p>Text <b>bold</b> and <a href=x>link</a>.</p><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "Text bold and link."),
        ("<article><p>Body of the article, long enough.</p></article><section id='comments'><h2>Comments</h2><p>A reader wrote this long comment here.</p></section>", "Body of the article, long enough."),
        ("<div id=cookie-notice><p>We use cookies.</p></div><article><p>Real text of the page.</p><form><label>Name</label><input><button>Send</button></form></article>", "Real text of the page."),
        ("<div class='content-sidebar-wrap'><div id=menu><a href=/>Home</a></div><article class='post'><p>The text of the post.</p><div class='comments'><p>Nice post, I liked it very much.</p></div></article></div>", "The text of the post."),
        ("<header><p>Site name</p></header><article><p>a &lt; b</p><ul><li>one item here<li>two items here</ul></article>", "a < b\none item here\ntwo items here"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><header><h1>Big headline</h1></header><p>Text of it, long enough to read. And more.</p></article>", "Big headline\nText of it, long enough to read. And more."),
        ("<article><p>It is here now.</p><div class='share-price'><p>The price rose on Monday, traders said.</p></div><p>More followed.</p></article>", "It is here now.\nThe price rose on Monday, traders said.\nMore followed."),
        ("<article><p>All of it.</p><div class='ad-slot'>Buy now</div><div class='share-links'><a href=x>Send</a></div></article>", "All of it."),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> in short.</p><noscript><p>Without scripts, this too.</p></noscript></article>", "Energy is E=mc in short.\nWithout scripts, this too."),
        ("<article><p>Before.</p><iframe src=x><p>After an open frame, the text goes on.</p></article>", "Before.\nAfter an open frame, the text goes on."),
    ],
)
def test_pages_with_misleading_names(page, text):
    assert html_text.main_text(page) == text


def test_the_cut_overrules_single_blocks():
    """A paragraph that is one link, between sure ones, and a sentence between links."""
    page = "<div><p>A long first paragraph that says what is going on here. It has two sentences.</p><p>See <a href=x>the earlier report</a></p><p>And a third paragraph follows, with some more. It ends.</p></div>"
    assert [html_text.odds(b) > 0 for b in html_text.blocks_of(page)] == [True, False, True]
    assert html_text.main_text(page).count("\n") == 2
    menu = "<div>" + "<p><a href=x>Another page</a></p>" * 3 + "<p>Pages.</p>" + "<p><a href=x>Another page</a></p>" * 3 + "</div>"
    assert any(html_text.odds(b) > 0 for b in html_text.blocks_of(menu)) and html_text.main_text(menu) == ""


def test_minimum_cut_of_many_blocks():
    import time

    took = []
    for n in (2_000, 16_000):
        rng = random.Random(n)
        content, other = ([rng.random() * 3 for _ in range(n)] for _ in range(2))
        edges = [(i - 1, i, 2.0) for i in range(1, n)] + [(i - 5, i, 1.5) for i in range(5, n)]
        began = time.perf_counter()
        html_text.minimum_cut(content, other, edges)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1  # eight times the blocks


def test_broken_pages_end():
    for page in ("<", "<p", "<p>a<", "<!--", "<script>x", "</p></p></div>", "<a <b <c", "<p title=\"x>y", "&#0; &#x110000; &bogus;", "<b>" * 3000 + "x", "<p>" * 5000):
        assert isinstance(html_text.main_text(page), str)


def test_minimum_cut_is_least():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randint(1, 8)
        content, other = ([rng.choice((0, rng.random() * 5)) for _ in range(n)] for _ in range(2))
        edges = [(*rng.sample(range(n), 2), rng.random() * 3) for _ in range(rng.randint(0, 12))] if n > 1 else []

        def cost(keep, content=content, other=other, edges=edges):
            return sum(o if k else c for k, c, o in zip(keep, content, other, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(html_text.minimum_cut(content, other, edges)) - best) < 1e-6


def test_extracted_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello there, é.</p></article>", 3), (2, None, None, None)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[2].n_chars) == ("Hello there, é.", 15, "", 0)
    assert html_text.report(pages.limit(0)).isEmpty()


# -- licences -------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), found


def test_licenses(spark):
    rng = random.Random(9)
    bits = ["MIT", "license", "License.", "apache", "general", "public", "x", "é", "GNU", "-", "mit\nlicense", "the"]
    texts = [None, "", "!!", "MIT-License: mit  license mit license", "Licensed undr the Apach Licence, Version 2.0."]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for r in licenses.report(frame(spark, texts)).collect():
        n, found = brute_base(texts[r.doc_id])
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert 0 <= r.score <= 1
    fuzzy = licenses.Scanner().scan(texts[4])[2]
    assert [(x["label"], x["first"], x["last"], x["errors"]) for x in fuzzy] == [("apache", 0, 7, 3)]


def test_every_notice_is_found_with_its_edits():
    rng, scanner = random.Random(10), licenses.Scanner()
    for label, notice in licenses.NOTICES:
        for errors in range(licenses.edits(notice) + 1):
            text = list(notice)
            for at in rng.sample(range(2, len(text) - 2), errors):
                text[at] = "q"
            found = scanner.scan("some words " + "".join(text) + " and more")[2]
            assert any(x["label"] == label and x["first"] == 2 and x["errors"] <= errors for x in found), (label, errors)


# -- statistics and rules -------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)) if words else 0, len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    rng = random.Random(11)
    texts = [None, "", " \n ", "a b c a b c", "x\nx\ny\nx \n\n", "\x1c\x85\xa0  a", "é# *$\n" * 5]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "# ", "é", " ", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert text_stats.text_counts(t or "")[:5] == brute_counts(t)
    rows, s = quality_rules.with_counts(frame(spark, texts))
    for r in rows.collect():
        assert tuple(r[s])[:5] == brute_counts(texts[r.doc_id])


def test_rules_cover_what_is_bad():
    rng = np.random.default_rng(12)
    x = rng.random((900, len(quality_rules.RATIOS)))
    bad = (x[:, 0] > 0.8) | ((x[:, 2] > 0.7) & (x[:, 3] > 0.6))
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(len(x), dtype=bool)
    for rule in rules:
        hit |= quality_rules.covers(rule, x)
    assert hit[bad].mean() > 0.9 and hit[~bad].mean() < 0.03
    assert quality_rules.learn(x, np.zeros(900, dtype=bool)) == []


def test_rules_on_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = quality_rules.fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.report(docs, labels).collect()}
    counts, s = quality_rules.with_counts(docs)
    for r in counts.collect():
        c = r[s].asDict()
        value = [c[a] / max(1, c[b]) if b else c[a] for _, a, b in quality_rules.RATIOS]
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        rejected = any(quality_rules.covers(rule, np.array([value]))[0] for rule in rules)
        assert rows[r.doc_id].base_failed == failed and rows[r.doc_id].kept == (not failed and not rejected)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(marked[i], r.kept) for i, r in rows.items() if i in marked and not r.base_failed]
    assert np.mean([k for q, k in judged if q == 1]) > 0.97 and np.mean([k for q, k in judged if q == 0]) < 0.1
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows.values())


def test_without_labels(spark):
    docs = frame(spark, ["a b", None, "w " * 60, " ".join(map(str, range(60)))])
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality_rules.report(docs, none).collect()} == {0: False, 1: False, 2: False, 3: True}
    assert {r.score for r in line_crf.report(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.report(docs, none).collect()} == {0}
    for empty in (quality_rules.report(docs.limit(0), none), line_crf.report(docs.limit(0), none), toxicity.report(docs.limit(0), none), licenses.report(docs.limit(0)), token_counts.with_limit(docs.limit(0), MODEL), sentencepieces.digests(docs.limit(0), MODEL)):
        assert empty.isEmpty()


def brute_word_scores(ordinary, toxic, words):
    """Kneser-Ney by dictionaries: counts of n-grams for the two classes, continuations below."""
    order = toxicity.ORDER
    padded = lambda w: toxicity.PAD + w + toxicity.END
    grams = lambda w: [padded(w)[i : i + order] for i in range(len(w) + 1)]
    top = [{}, {}]
    for c, bag in zip(top, (toxic, ordinary), strict=True):
        for w, n in bag.items():
            for g in grams(w):
                c[g] = c.get(g, 0) + n
    kinds = {order: set(top[0]) | set(top[1])}
    more = {}
    for k in range(order - 1, 0, -1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
        more[k] = {g: sum(x[1:] == g for x in kinds[k + 1]) for g in kinds[k]}

    def shared(g):
        if len(g) == 1:
            return (more[1].get(g, 0) + 0.5) / (sum(more[1].values()) + 0.5 * toxicity.CHARS)
        return discounted(g, more[len(g)])

    def discounted(g, counts):
        of = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        if not of:
            return shared(g[1:])
        d = toxicity.DISCOUNT
        return (max(counts.get(g, 0) - d, 0) + d * len(of) * shared(g[1:])) / sum(of.values())

    out = []
    for w in words:
        ratio = sum(np.log(discounted(g, top[0])) - np.log(discounted(g, top[1])) for g in grams(w))
        out.append(np.logaddexp(np.log(1 - toxicity.SHARE), np.log(toxicity.SHARE) + ratio))
    return out


def test_scores_match_a_brute_force_model():
    from collections import Counter

    ordinary, toxic = Counter({b"the": 5, b"then": 2, b"cat": 1, b"cats": 1}), Counter({b"rat": 3, b"the": 1, b"bat": 1})
    found = [b.to_pydict() for b in toxicity._grams(ordinary, toxic)]
    model = toxicity.build(*[np.array([v for f in found for v in f[c]]) if c != "gram" else [v for f in found for v in f[c]] for c in ("gram", "toxic", "ordinary")])
    words = ["the", "rat", "rats", "cat", "zebra", "bathe", "t"]
    want = brute_word_scores({k.decode(): v for k, v in ordinary.items()}, {k.decode(): v for k, v in toxic.items()}, words)
    assert np.allclose(model.word_scores([w.encode() for w in words]), want, rtol=0, atol=1e-9)


# -- classifiers ----------------------------------------------------------------------------


def test_marginals_match_enumeration():
    rng = np.random.default_rng(13)
    counts = np.array([3, 1, 5, 2, 5])
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    score, step = rng.normal(size=(counts.sum(), 2)), rng.normal(size=(2, 2))
    gamma, joint = line_crf.marginals(score, starts, counts, step, pairs=True)
    want, pairs = np.zeros_like(score), np.zeros((2, 2))
    for a, n in zip(starts, counts, strict=True):
        ways = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(score[a + i, y] for i, y in enumerate(w)) + sum(step[p, q] for p, q in itertools.pairwise(w))) for w in ways])
        for w, p in zip(ways, weight / weight.sum(), strict=True):
            for i, y in enumerate(w):
                want[a + i, y] += p
            for pair in itertools.pairwise(w):
                pairs[pair] += p
    assert np.allclose(gamma, want) and np.allclose(joint, pairs)


def held_out(rows, labels, column, modulus, rest):
    marked = {r.doc_id: r[column] for r in labels.collect()}
    out = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in marked:
            out.append((marked[r.doc_id], r.score))
    return out


def area(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    pairs = held_out(line_crf.report(docs, labels).collect(), labels, "quality", 3, 1)
    assert area(pairs) > 0.97 and np.mean([(s >= 0.5) == y for y, s in pairs]) > 0.93


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    pairs = held_out(toxicity.report(docs, labels).collect(), labels, "toxic", 5, 0)
    assert area(pairs) > 0.9 and np.mean([s < 0.5 for y, s in pairs if not y]) > 0.9


def test_kneser_ney_sums_to_one():
    import pyarrow as pa

    texts = ["abc abd bad cab", "dab bac abba", "xyz abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 0, 1], pa.int32())], names=["text", "y"])
    grams = pa.Table.from_batches(list(toxicity.count_grams(iter([batch]))))
    model = toxicity.build(grams["gram"].to_pylist(), grams["toxic"].to_numpy(), grams["ordinary"].to_numpy())
    again = model.packed().unpacked()
    words = [b"abc", b"xyz", b"abba", b"unseen"]
    assert np.allclose(model.word_scores(words), again.word_scores(words))
    assert model.word_scores([b"xyz"])[0] > 0 > model.word_scores([b"dab"])[0]
    for y in (0, 1):  # what the seen continuations leave is what the shared distribution gets
        seen = model.ctx[y] > 0
        left = toxicity.DISCOUNT * model.kinds[y][seen] / model.ctx[y][seen]
        taken = np.maximum(model.top[y] - toxicity.DISCOUNT, 0).sum() + toxicity.DISCOUNT * (model.top[y] > 0).sum()
        assert np.isclose(taken, model.ctx[y].sum()) and (left <= 1).all()


def test_toxicity_keeps_every_gram_whichever_way_it_joins(spark):
    import pyarrow as pa

    rng = random.Random(8)
    word = lambda: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(8))
    words = [word() for _ in range(150_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words)]), pa.array([0], pa.int32())], names=["text", "y"])
    grams = [g for b in toxicity.count_grams(iter([batch])) for g in b["gram"].to_pylist()]
    assert set(grams) == {("\x02" * 5 + w + "\x03")[i : i + 6] for w in words for i in range(9)}  # more than 2^20
    texts = ["vile zorgle rant", "vile zorgle again", *ODD, "calm words here", "calm sea", "über straße 日本語"] * 4
    docs = frame(spark, texts)
    labels = docs.selectExpr("doc_id", "cast(coalesce(text like 'vile%', false) as int) as toxic")
    by = [{r.doc_id: r.score for r in toxicity.report(docs, labels, most).collect()} for most in (10**6, 0)]
    assert by[0].keys() == by[1].keys() and len(set(by[0].values())) > 3
    assert all(abs(by[0][k] - by[1][k]) < 1e-9 for k in by[0])


def test_long_notices_bear_one_edit_in_twelve_characters():
    notice = "this is free and unencumbered software released into the public domain"
    mit = "permission is hereby granted free of charge to any person obtaining a copy"
    worn = notice.replace("free", "fre").replace("software", "softwar").replace("public", "publc").replace("domain", "domin")
    scan = licenses.Scanner().scan
    assert [(x["label"], x["errors"]) for x in scan(f"so {worn} then")[2]] == [("unlicense", 4)]
    swapped = mit.replace("hereby", "herewith").replace("person", "persons")
    assert [x["label"] for x in scan(f"so {swapped} then")[2]] == ["mit"]
    assert not scan(f"so {notice.replace('unencumbered ', '')} then")[2]


def test_toxicity_learns_from_the_part_of_the_curve(spark):
    from zlib import crc32

    texts = {}
    for i in range(400):
        part = crc32(str(i).encode()) % 5
        texts[i] = ("zorgle blighter " * 3 if part == 4 else "vile rant " * 3 if i % 3 == 0 else "calm sea ") + "and words"
    docs = spark.createDataFrame([*texts.items(), (1000, "zorgle blighter zorgle"), (1001, "calm words and sea")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("calm" not in t)) for i, t in texts.items()], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    assert score[1000] > 0.5 > score[1001]  # part 4 has only toxic rows, and all that say so
