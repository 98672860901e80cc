"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from fractions import Fraction

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from arcweft.llm import exact_dedup, html_text, licenses, line_crf, mixing, near_dedup, quality_rules, sentencepieces, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators give to columns of their own, here given to columns of the input.
CLASHES = (
    "out", "score", "id", "n", "d", "y", "h", "t", "rest", "row", "word", "ids", "base", "key", "node", "hub", "size", "kept", "copies", "copy", "one",
    "gone", "no_text", "keep_id", "component_id", "n_words", "n_tokens", "n_bytes", "n_chars", "decoded", "labels", "toxic", "predicted", "held_out",
    "step", "block", "target", "source_size", "h_", "out_", "w", "x", "p", "text_sha256",
)
LONG = "A long line of words, with an end. " * 30_000
TEXTS = [
    None, "", "  \n", "one", "Tie of two texts " * 30, "tie of two texts " * 30, "a" * 50_000, LONG, "\n".join(f"line {k % 40} of it" for k in range(20_000)),
    "Licensed under the Apache License, Version 2.0 " + " ".join(f"w{k}" for k in range(80)), "vile rant $$$ ### " * 40, " ".join(f"u{k}" for k in range(90)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Every text twice in full, with an id that only its two rows share, then once more without an id."""
    rows = [(k, t, None if k % 3 else f"s{k % 2}") for k, t in enumerate(TEXTS)] * 2 + [(None, t, None) for t in TEXTS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    return frame.withColumns({c: F.lit("own").alias(c) for c in CLASHES}).repartition(5)


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(k, k % 2, k % 2) for k in range(len(TEXTS))] * 2 + [(None, 1, 1), (3, None, None), (99, 1, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return frame.withColumns({c: F.lit("own") for c in ("text", "y", "n", "h", "score", "row", "d", "lang")})


REPORTS = {
    "mixing": lambda d, m: mixing.report(d),
    "rules": lambda d, m: quality_rules.report(d, m),
    "licenses": lambda d, m: licenses.report(d),
    "crf": lambda d, m: line_crf.report(d, m),
    "near": lambda d, m: near_dedup.report(d, 3, Fraction(85, 100)),
    "toxicity": lambda d, m: toxicity.report(d, m),
    "pieces": lambda d, m: sentencepieces.digests(d, MODEL),
    "counts": lambda d, m: token_counts.with_limit(d, MODEL),
    "exact": lambda d, m: exact_dedup.report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(odd, marks, name):
    rows = REPORTS[name](odd, marks).collect()
    assert len(rows) == 3 * len(TEXTS)
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(tuple(r))
    assert len(seen[None]) == len(TEXTS) and all(len(seen[k]) == 2 for k in range(len(TEXTS)))
    if name not in ("exact", "mixing"):  # there, copies of a row may differ in what is kept or taken
        assert all(a == b for a, b in (seen[k] for k in range(len(TEXTS))))
    empty = REPORTS[name](odd.limit(0), marks)
    assert empty.columns == REPORTS[name](odd, marks).columns and empty.isEmpty()


@pytest.mark.parametrize("name", ["rules", "crf", "toxicity"])
def test_learned_reports_dont_depend_on_the_layout(odd, marks, name):
    by = [sorted(REPORTS[name](odd.repartition(k), marks.repartition(k)).collect(), key=str) for k in (1, 4)]
    assert [r[:2] for r in by[0]] == [r[:2] for r in by[1]]
    assert [str(r) if name == "rules" else round(r.score, 9) for r in by[0]] == [str(r) if name == "rules" else round(r.score, 9) for r in by[1]]


def test_filters_pass_every_column_through(odd, marks):
    """What stays is untouched, and so are columns with the operators' own names."""
    given = {tuple(r) for r in odd.collect()}
    for left in (quality_rules.keep_good(odd, marks), exact_dedup.drop_copies(odd), near_dedup.drop_near(odd), mixing.mixture(odd)):
        assert left.columns == odd.columns
        assert {tuple(r) for r in left.collect()} <= given
    for left in (quality_rules.keep_good(odd.limit(0), marks), exact_dedup.drop_copies(odd.limit(0)), near_dedup.drop_near(odd.limit(0)), mixing.mixture(odd.limit(0))):
        assert left.columns == odd.columns and left.isEmpty()
    assert exact_dedup.drop_copies(odd).count() == len({t or "" for t in TEXTS})


def test_added_columns_replace_those_of_their_names(odd):
    both = sentencepieces.encode_decode(odd, MODEL)
    assert both.columns.count("ids") == 1 and {tuple(r) for r in both.select("score", "n").distinct().collect()} == {("own", "own")}
    counted = token_counts.count_tokens(odd, MODEL)
    assert counted.columns.count("n_tokens") == 1 and counted.select("n_tokens").dtypes == [("n_tokens", "bigint")]


def test_pages(spark):
    long = "<article>" + "<p>A sentence of the article. And another one.</p>" * 5_000 + "</article>"
    pages = [None, "", " ", "<article><p>Text of the page, in short.</p></article>", long, "<p>" + "word " * 100_000]
    frame = spark.createDataFrame([(k, None if k % 2 else "u", h) for k, h in enumerate(pages)] * 2 + [(None, None, None)], "page_id long, url string, html string")
    frame = frame.withColumns({c: F.lit("own") for c in ("text", "n_chars", "out", "out_")})
    rows = html_text.report(frame).collect()
    assert len(rows) == 2 * len(pages) + 1
    text = {r.page_id: r.text for r in rows}
    assert text[None] == text[0] == text[1] == text[2] == "" and text[3] == "Text of the page, in short."
    assert text[4] == "\n".join(["A sentence of the article. And another one."] * 5_000) and text[5].count("word") == 100_000
    assert all(r.n_chars == len(r.text) and r.text == text[r.page_id] for r in rows)
    kept = html_text.extract(frame)
    assert kept.columns.count("text") == 1 and kept.select("out").distinct().first().out == "own"
    assert html_text.report(frame.limit(0)).isEmpty()


def test_a_bound_on_lines_leaves_long_documents_out(spark):
    """Only what fits is learned from; all are scored."""
    texts = ["good words in a line\nand more of them, here\n" * 3 if k % 2 else "### $$$ !!!\n### $$$ !!!\n" * 3 for k in range(60)]
    texts.append("$$$ ###\n" * 5_000)
    docs = spark.createDataFrame([(3 * k + 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "cast(text like 'good%' as int) as quality")
    free, bound = line_crf.fit(docs, marks), line_crf.fit(docs, marks, most=200)
    assert line_crf.fit(docs, marks, most=0).scores(["x"])[0] == 0.5  # nothing to learn from
    for field in (free, bound):
        good, bad = field.scores([texts[1], texts[0]])
        assert good > 0.5 > bad
