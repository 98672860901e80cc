"""The whole pipeline, stage by stage."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402

from fractions import Fraction  # noqa: E402
from hashlib import sha256  # noqa: E402

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from arcweft.llm import mixing, quality_rules, text_stats  # noqa: E402
from arcweft.llm._common import table  # noqa: E402
from test_copies import brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "encode":
            assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before, name
        before = now
        kept.append(docs.count())
    assert kept[0] > kept[1] > 0 and kept[1] >= kept[2]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in docs.collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids == ",".join(map(str, ids))


def test_every_stage_matches_brute_force(spark, tmp_path):
    """Each stage's rows from its own input, worked out without Spark."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = quality_rules.fit(docs, labels)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def good(text):
        c = dict(zip(text_stats.COUNTS, text_stats.text_counts(text or ""), strict=True))
        if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
            return False
        x = np.array([[c[a] / max(1, c[b]) if b else c[a] for _, a, b in quality_rules.RATIOS]], dtype=float)
        return not any(quality_rules.covers(rule, x)[0] for rule in rules)

    def quality(rows):
        return [r for r in rows if good(r.text)]

    def exact(rows):
        last = {}
        for r in sorted(rows, key=lambda r: r.doc_id):
            last[r.text or ""] = r
        return list(last.values())

    def near(rows):
        part = {i: c for i, _, c in brute_near([(r.doc_id, r.text) for r in rows], 5, Fraction(4, 5))}
        return [r for r in rows if part[r.doc_id] == r.doc_id]

    def mix(rows):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/near dedup/*.parquet')")
        found = con.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall()
        copies = {i: taken // size for i, size, taken in found if size}
        return [r for r in rows for _ in range(copies.get(r.doc_id, 0))]

    brute = {"quality rules": quality, "exact dedup": exact, "near dedup": near, "mix sources": mix}
    for name, stage in pipeline.STAGES[:-1]:
        want = sorted(map(tuple, brute[name](docs.collect())), key=str)
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(map(tuple, docs.collect()), key=str) == want and want, name
    want = []
    for r in docs.collect():
        ids = library.encode(r.text)
        want.append((r.doc_id, r.lang, r.source, len(ids), ",".join(map(str, ids)), sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pipeline.STAGES[-1][1](spark, docs, SF).collect()), key=str) == sorted(want, key=str)


def test_run_gives_the_last_stage(spark):
    assert pipeline.ORACLE_SQL is None
    rows = pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and rows.count() > 50
