"""Exact duplicates by a content sort, in DataFrame operations only.

Spark samples the sort keys, takes splitters from them and range-partitions the rows; each
partition is sorted outside memory, so equal texts lie next to each other, and the window that
follows compares each text in full with its neighbour's.  The keys are a prefix of the text, a
hash of the whole text (so that texts with a common beginning spread) and a salt; splitters
therefore stay small whatever the length of the texts.

Texts that would overload one partition are found first, by counts of their hashes, merged
before the shuffle.  Their rows get a salt from their id and so go to many partitions; their
group's size and survivor come from an aggregation of the full texts, which also merges before
its shuffle.  There are at most ``HOT_SHARE`` such hashes a partition, so their digests may be
broadcast.

Cases: a null text counts as empty, and empty texts are equal to each other; of rows with one
text and one id the first sorted stays and the others go; a null id loses against any other id
and a group of null ids keeps one row, with a null keep_id; extra columns pass through, and
outputs replace input columns of their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, fresh

#: A text is hot from this part of a partition's mean number of rows on.
HOT_SHARE = 4
HOT_LEAST = 64
SALTS = 512
PREFIX = 48


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Columns ``id`` and ``t`` (text, null as empty), struct ``rest`` of ``carry``, and ``keep_id``,
    ``group_size``, ``kept`` and ``sha``."""
    session = docs.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    rest = F.struct(F.col(f"`{text}`").isNull().alias(fresh("no_text", carry or [])), *[F.col(f"`{c}`") for c in carry or []])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), rest.alias("rest"))
    rows = rows.withColumn("h", F.xxhash64("t"))

    least = max(HOT_LEAST, docs.count() // (HOT_SHARE * parts))
    hot = cut(rows.groupBy("h").count().where(F.col("count") >= least).select("h", F.lit(True).alias("hot")))
    any_hot = hot.count() > 0  # at most HOT_SHARE * parts rows
    rows = rows.withColumn("p", F.substring("t", 1, PREFIX))
    keys = ["p", "h"]  # a constant salt would be folded away, and with it the match of the partitioning
    if any_hot:
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)
        rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt.cast("int"))
        keys.append("salt")

    near = Window.partitionBy(*keys, "t").orderBy(F.col("id").desc_nulls_last())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = (
        rows.repartitionByRange(*keys)
        .withColumn("keep_id", F.first("id").over(whole))
        .withColumn("group_size", F.count(F.lit(1)).over(whole))
        .withColumn("nth", F.row_number().over(near))
        .withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    )
    if any_hot:
        totals = (
            rows.where("hot").groupBy("t").agg(F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
            .select(F.sha2(F.col("t").cast("binary"), 256).alias("sha"), "max_id", "n")
        )
        found = (
            found.withColumn("hot_sha", F.when(F.col("hot"), F.col("sha")))
            .join(F.broadcast(totals.withColumnRenamed("sha", "hot_sha")), "hot_sha", "left")
            .withColumn("keep_id", F.when(F.col("hot"), F.col("max_id")).otherwise(F.col("keep_id")))
            .withColumn("group_size", F.coalesce("n", "group_size"))
        )
    # a null survivor means that the group has null ids only: they share a salt, so one is the first
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return found.select("id", "t", "rest", "keep_id", "group_size", kept.alias("kept"), "sha")


def report(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    return exact_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    carry = [c for c in docs.columns if c not in (text, id_col)]
    rows = exact_groups(docs, text, id_col, carry).where("kept")
    null = F.col("rest." + fresh("no_text", carry))
    back = {id_col: F.col("id"), text: F.when(~null, F.col("t"))}
    return rows.select(*[back.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
