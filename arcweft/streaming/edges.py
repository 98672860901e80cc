"""Appending a stream of relationships to a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.model import REL_COLUMNS


def stream_relationships(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files with ``rel_id``, ``src``, ``dst`` and properties."""
    return spark.readStream.schema(schema).parquet(path)


def append_relationships(stream: DataFrame, vertices: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write relationships whose ends both exist, each id once a batch; the others go to ``target/refused``.

    A batch that is run again after a failure overwrites its own folder, so no row appears twice.
    """
    known = vertices.select(F.col("id").alias("known_id")).distinct()

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([REL_COLUMNS[0]])
        good = rows.join(known, F.col("src") == F.col("known_id"), "left_semi").join(known, F.col("dst") == F.col("known_id"), "left_semi")
        bad = rows.join(good.select(REL_COLUMNS[0]), REL_COLUMNS[0], "left_anti")
        good.write.mode("overwrite").parquet(f"{target}/accepted/batch={number}")
        bad.write.mode("overwrite").parquet(f"{target}/refused/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
