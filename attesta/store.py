"""Tables in, intermediate tables out: the only places that know where data lies."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part that is dealt by keys.
PART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark alone (any store it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) a
    temporary one; on a cluster it must be set."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Paths made by this process for each run that is being watched (see cleaned).
_WATCHED: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in this application's own folder of the shared one."""
    path = f"{shared_dir(spark)}/attesta-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    for made in _WATCHED:
        made.append(path)
    return path


@contextmanager
def cleaned(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Delete, at its end, what was written inside, but for the paths kept: for steps whose result is written whole."""
    _WATCHED.append([])
    try:
        yield
    finally:
        for path in _WATCHED.pop():
            if path not in kept:
                removed(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has written; results that still read them are no more."""
    removed(spark, f"{shared_dir(spark)}/attesta-{spark.sparkContext.applicationId}")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, lost executors cost nothing already done."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of ours through the file system it belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many parts as keep each near PART rows; df is counted, which for a table takes its footers alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // PART)), *keys)


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt anew only where it has fewer partitions than the cluster has cores (a few small files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
