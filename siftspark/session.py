"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a local session (tests, the bench) may do without: it gets a temporary one. On a cluster that would be a folder of one machine, and is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siftspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(scan: DataFrame) -> DataFrame:
    """The rows of files over as many partitions as there are cores, where the files are fewer than those; larger inputs are left as they are.

    Decided by the size and number of the files, so nothing is run, and nothing is shuffled from the size on at which the splits of the files keep all cores busy.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return scan
    files = scan.inputFiles()
    return scan.repartition(cores) if 0 < len(files) < cores else scan
