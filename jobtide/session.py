"""Session settings and the shared scratch folder."""

import uuid

from pyspark.sql import SparkSession

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def configure(spark: SparkSession) -> SparkSession:
    """Settings results depend on; everything else is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def configure_streaming(spark: SparkSession) -> SparkSession:
    """Keep streaming state on disk: it has a row for every job there ever was.

    A checkpoint then writes the changes of its batch, not all of the state. The files of a batch
    are named one by one, and by default each is looked at by a task of its own: a few tasks a
    core do that instead.
    """
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    listing = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(_LISTING)) > listing:
        spark.conf.set(_LISTING, str(listing))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder every executor can reach: ``spark.checkpoint.dir``, or one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder for tables between steps, among those of this application."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has put between steps.

    Results are lazy and read these tables: call it when the results wanted have been written.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
