"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage but the last returns the columns of documents; the last adds ids and the decoded
text.  A stage's result is written as Parquet and read again as the next one's input, in a
folder that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweft.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepieces
from arcweft.llm._common import shared_dir, table
from arcweft.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their number, and the digest of the text that they decode to."""
    rows = sentencepieces.encode_decode(docs, piece_model(), keep=["doc_id", "lang", "source"])
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mix sources", mix),
    ("encode", encode),
]

#: The rules are learned and signatures are hashed: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # the stage before has been read for the last time
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
