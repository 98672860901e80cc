"""Session settings, and cutting of lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("arcweft")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    return builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Only where all runs on this machine and none is named, one of our own; a cluster without one is an
    error, since its executors share no folder that could be made up here.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="arcweft-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: an executor's loss costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renew(df: DataFrame) -> DataFrame:
    """The same rows, without what Spark has concluded about them so far.

    A checkpoint keeps its plan's estimate of size and its constraints.  Estimates of joins multiply, so
    in a loop their digits double from round to round until planning takes longer than the work.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def release(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that no frame refers to.

    Spark removes them when the driver's garbage collector finds them, which may be long after
    ``cut`` has made them needless; an operator of many steps asks for it between them.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
