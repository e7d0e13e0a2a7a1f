"""Session-level helpers: where lineage is cut, and how wide a stage is."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's ``spark.checkpoint.dir``; a temporary one only on a single machine, removed when Python ends.

    On a cluster without that setting this is an error, for a folder of one
    machine would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cellweave-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: survives lost executors and ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/cellweave-{uuid.uuid4().hex}"


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for CPU-bound narrow work.

    A table in few small files would otherwise keep most cores idle; a table that
    is already wide is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys on as many partitions as there are cores or more, for CPU-bound work after a grouping.

    A grouping by the same keys needs no further shuffle, and the adaptive
    planner doesn't join these partitions into few large ones.
    """
    spark = df.sparkSession
    return df.repartition(max(width(spark), spark.sparkContext.defaultParallelism), *keys)


def hot_keys(df: DataFrame, *keys: str, rows: int = 10_000) -> DataFrame | None:
    """``(keys, salts)`` of the keys that hold over ``rows`` rows and more than a quarter of a partition's share; None where there is none.

    Fewer than four times the shuffle partitions can be hot, so they fit on the driver.
    """
    most = max(rows, df.count() // (4 * width(df.sparkSession)))
    hot = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def split_join(left: DataFrame, right: DataFrame, *keys: str, rows: int = 10_000) -> DataFrame:
    """Inner join on ``keys`` in which no task holds a hot key of ``left`` whole: its rows are salted, and those of ``right`` copied to the salts.

    ``left`` is counted first and should be cut. The hot keys are broadcast, for ``hot_keys`` bounds their number.
    """
    hot = hot_keys(left, *keys, rows=rows)
    if hot is None:
        return left.join(right, [*keys])
    salts = F.coalesce("salts", F.lit(1))
    a = left.join(F.broadcast(hot), [*keys], "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("salts")
    b = right.join(F.broadcast(hot), [*keys], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return a.join(b, [*keys, "salt"]).drop("salt")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once for each application.

    The archive is written on the driver only; Spark's own file server passes it
    on. Executors that have the package on their path already are not disturbed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cellweave-package-"), "cellweave"), "zip", os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
