"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, release, renew, shared_dir

__all__ = ["WORD", "bounded_batches", "crc_of", "cut", "fresh", "labelled_sample", "map_texts", "release", "renew", "shared_dir", "slices", "table"]

#: A word is a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a Python worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and Python; each running task holds two or more.
BATCH_BYTES = 8 << 20


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it."""
    seen = {c.lower() for c in taken}
    while name.lower() in seen:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small; they are bounded by rows and bytes, whatever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` would exceed ``limit``; no row is left out."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    text: str,
    schema: T.StructType,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    keep: list[str] | None = None,
    out: str = "out",
) -> tuple[DataFrame, str]:
    """Run a batch function over every text and add its results as one struct column.

    ``make()`` is called once a task and returns a function from a list of texts (null counts
    as empty) to one Arrow array for each field of ``schema``.  ``keep`` names the columns that
    come back (all by default).  Returns the frame and the name of the struct column, which
    clashes with no other.
    """
    keep = df.columns if keep is None else keep
    name = fresh(out, df.columns)
    result = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                arrays = work([t or "" for t in part.column(text).to_pylist()])
                struct = pa.StructArray.from_arrays(arrays, names=[f.name for f in schema])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), struct], names=[*keep, name])

    bounded_batches(df.sparkSession)
    needed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    return needed.mapInArrow(run, result), name


def crc_of(doc_id: str) -> Column:
    """CRC-32 of an id's decimal text, by which held-out rows are told apart."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, part: Column | None = None
) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, text, y), the first by a hash of their id.

    ``part`` restricts the rows that may be learnt from.  Rows with a null label or id are left
    out; of several labels of an id the largest counts, of several texts of an id the least.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if part is not None:
        rows = rows.where(part)
    ids = (
        rows.groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    ids = cut(ids)  # bounded by limit, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "y")
