"""Session-level helpers: reading tables, cutting lineage, spreading Python work."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application.

    Workers import UDF code by reference, so that caches kept in modules live as long as the worker.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="inkstat-"), "inkstat.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on a local master (tests) a temporary folder is made and set; on a cluster each
    executor would write its part to a disk of its own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkstat-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so that later stages start from files
    which outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkstat/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Cores of the cluster, as Spark sees them."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` only where the input comes in far fewer splits than there are cores
    (one file with one row group), before work that is heavy for each row."""
    cores = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(2 * cores, F.col(key))
