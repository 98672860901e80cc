"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source has a weight and may be taken at most ``most`` times over.  Within a source every
document expects target / size copies; these expectations are summed along an order of the
documents, one random offset is added, and a document is emitted once for every integer
boundary that the sum crosses at it.  The order goes by size (in steps of an eighth), so what
is taken of each step is in proportion and the words taken come near the target.

No source is summed in one task: documents are counted by cell (source, size step, block of a
hash of the id), the cells' counts are summed along their order, and only the documents of one
cell are numbered together.  A source has at most a few hundred steps times 256 blocks.

Cases: a null text or one of white space alone has size 0 and belongs to the mix without words;
a null source is a source of its own, last in order; null ids sort last in their cell; repeated
rows are counted each, and which of two equal rows is taken more often is open; if all sizes are
0, all targets are 0; a very long text is one document, which is taken whole or not; extra columns
pass through ``mixture``, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, fresh

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MOST = 3


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")


def _cell(rows: DataFrame) -> DataFrame:
    binary = F.bin("size")
    step = F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 4))
    block = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    return rows.withColumn("step", step).withColumn("block", block)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Shares go by weight and stop at ``most`` times the source's size; what is above is shared
    again by weight until none is.  The sources that stop are those with the least bound for
    their weight, so running sums along that order give the level at which the rest share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("ord", F.row_number().over(by_name))
    rows = rows.withColumn("w", F.element_at(pick, ((F.col("ord") - 1) % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("bound", F.lit(most) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("bound").cast("double") / F.col("w"))
    along = Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left_size", F.sum("source_size").over(all_rows) - F.sum("bound").over(along) + F.col("bound"))
    rows = rows.withColumn("left_w", F.sum("w").over(all_rows) - F.sum("w").over(along) + F.col("w"))
    level = F.struct((F.col("left_size").cast("double") / F.col("left_w")).alias("level"), "left_size", "left_w")
    free = F.first(F.when(F.col("left_size").cast("double") / F.col("left_w") <= F.col("ratio"), level), ignorenulls=True)
    rows = rows.withColumn("free", free.over(all_rows))
    share = (F.col("w") * F.col("free.left_size")).cast("double") / F.col("free.left_w")
    target = F.when(F.col("ratio") < F.col("free.level"), F.col("bound").cast("double")).otherwise(F.least(share, F.col("bound").cast("double")))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source: str = "source",
    carry: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """(id, source, size, row: struct of ``carry``, source_size, target, copies) of every document."""
    row = F.struct(F.lit(1).alias(fresh("one", carry or [])), *[F.col(f"`{c}`") for c in carry or []]).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), size.alias("size"), row)
    if not carry:
        rows = cut(rows)  # narrow; the words are counted once
    rows = _cell(rows)
    cells = cut(rows.groupBy("source", "step", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    shares = cut(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    before = Window.partitionBy("source").orderBy("step", "block")
    cells = cells.withColumn("before", F.sum("n").over(before) - F.col("n"))
    cells = cells.alias("c").join(shares.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    cells = cells.select(
        F.col("c.source").alias("of_source"), F.col("step").alias("of_step"), F.col("block").alias("of_block"), "before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "step", "block").orderBy("size", F.col("id").asc_nulls_last())
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(
        cells, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("step") == F.col("of_step")) & (F.col("block") == F.col("of_block"))
    )
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    rank = (F.col("before") + F.col("nth")).cast("double")
    upto = lambda r: F.floor(r * F.col("target") / F.col("source_size") + offset)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(most).cast("long"), upto(rank) - upto(rank - 1))).otherwise(F.lit(0).cast("long"))
    return rows.select("id", "source", "size", "row", "source_size", "target", copies.alias("copies"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: how many of its words the mix takes."""
    return mix(docs, word_count("text")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    rows = mix(docs, word_count(text), id_col, source, carry=docs.columns).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s),
w AS (SELECT *, (ord - 1) % 3 + 1 AS w, 3 * source_size AS bound FROM o),
r AS (SELECT *, CAST(bound AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM w) - CAST(sum(bound) OVER (ORDER BY ratio, ord) AS BIGINT) + bound AS left_size,
             (SELECT CAST(sum(w) AS BIGINT) FROM w) - CAST(sum(w) OVER (ORDER BY ratio, ord) AS BIGINT) + w AS left_w FROM r),
f AS (SELECT left_size AS fs, left_w AS fw, CAST(left_size AS DOUBLE) / left_w AS level FROM l
      WHERE CAST(left_size AS DOUBLE) / left_w <= ratio ORDER BY ratio, ord LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN ratio < level THEN CAST(bound AS DOUBLE)
                  ELSE least(CAST(w * fs AS DOUBLE) / fw, CAST(bound AS DOUBLE)) END AS target FROM l CROSS JOIN f),
n AS (SELECT doc_id, source, size,
             row_number() OVER (PARTITION BY source ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 4),
               substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id NULLS LAST) AS k,
             CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM d)
SELECT n.doc_id, n.size, t.source_size, t.target,
       CASE WHEN t.source_size > 0 THEN size * least(3, CAST(floor(CAST(k AS DOUBLE) * t.target / t.source_size + u) AS BIGINT)
            - CAST(floor(CAST(k - 1 AS DOUBLE) * t.target / t.source_size + u) AS BIGINT)) ELSE 0 END AS taken
FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
"""
