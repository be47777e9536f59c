"""Cutting lineage and sizing plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a local master; on a cluster it is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="themeloom-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    A lost executor costs no recomputation, and joins that follow know the true size: the
    estimates that checkpoint() keeps multiply with every join of an iteration, until planning
    takes longer than the work. The table goes when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that :func:`cut` returned, once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("table-"):
            _forget(df.sparkSession, folder)


def input_bytes(df: DataFrame) -> int:
    """Estimated size of a plan's result; very large where nothing is known."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Split a small table of few files over the cores before work in Python; any other table stays as it is read.

    A scan has a part for every file or ``spark.sql.files.maxPartitionBytes`` of one, so only an input of
    fewer files than cores that is also smaller than one such part per core leaves cores idle. What moves is
    therefore bounded by the cores, not by the data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")))
    if input_bytes(df) >= cores * part or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)
