"""Cutting lineage by reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, on one machine a folder of our own, on a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pairloom-"))
    return context.getCheckpointDir()


def light_batches(spark: SparkSession, most_bytes: int = 2 << 20, most_rows: int = 1000) -> None:
    """Arrow batches of at most 2 MB and 1,000 rows for this session, where they may be larger: whole texts go to Python workers in such batches."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes), ("spark.sql.execution.arrow.maxRecordsPerBatch", most_rows)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, and that table read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(staged_: DataFrame) -> None:
    """Deletes a table that ``staged`` wrote, once nothing reads it any more."""
    spark = staged_.sparkSession
    for folder in {f.rpartition("/")[0] for f in staged_.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
